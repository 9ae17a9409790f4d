"""Token ids of texts by a file of the ``tokenizers`` library, a batch at a time.

Ids are the library's. Where the file is a plain byte-level BPE, no token spans certain places of a text; texts are
cut there, short pieces are told apart by two independent 64-bit hashes, and the library gets each once for as long as
it is remembered; longer pieces go to it each time. Other files are used on whole texts.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

from arcweave.llm.words import span_hashes

#: Remembered pieces: slots of the direct-mapped table, and the ids and pieces held before it starts
#: anew; some 70 MB in all.
SLOTS, HELD, PIECES = 1 << 21, 6_000_000, 1_500_000
#: Pieces of more bytes aren't remembered.
REMEMBERED = 256
_STEP = 1 << 20
_byte = np.arange(256)
_ALNUM = (_byte >= 48) & (_byte <= 57) | (_byte >= 65) & (_byte <= 90) | (_byte >= 97) & (_byte <= 122)
_SEEN = (_byte >= 33) & (_byte <= 126)  # visible ASCII
_PUNCT = _SEEN & ~_ALNUM
_SOLID = _SEEN | (_byte >= 0xC3) & (_byte <= 0xDF)  # begins a character that surely isn't white space


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start (places in data): at each text's start, before a space with something solid behind it,
    between an ASCII letter or digit and ASCII punctuation, and around a newline with solid neighbours. White space in
    longer runs, and around other characters, stays with its surroundings."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    solid, alnum, punct, seen = _SOLID[data], _ALNUM[data], _PUNCT[data], _SEEN[data]
    cut[: n - 1] |= (data[:-1] == 32) & solid[1:]
    cut[1:n] |= alnum[:-1] & punct[1:]
    line = np.zeros(n, bool)
    line[1:-1] = (data[1:-1] == 10) & seen[:-2] & solid[2:]
    cut[:n] |= line
    cut[1 : n + 1] |= line
    cut[offsets] = True
    return np.flatnonzero(cut[:n])


class Encoder:
    """spec: the tokenizer file's JSON text."""

    def __init__(self, spec: str):
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        parts = json.loads(spec)
        pre = parts.get("pre_tokenizer") or {}
        self.by_piece = parts.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        vocabulary = self.tokenizer.get_vocab()
        self.size = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.size[i] = len(token)  # bytes: in a byte-level vocabulary a character stands for one
        self._forget()

    def _forget(self) -> None:
        self.key, self.check, self.number = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int32)
        self.ids, self.start, self.length = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.held = self.known = 0

    def _add(self, ids: np.ndarray, n: np.ndarray) -> None:
        def room(a: np.ndarray, size: int) -> np.ndarray:
            return a if size <= len(a) else np.concatenate([a, np.zeros(max(size, 2 * len(a)) - len(a), a.dtype)])

        held, known = self.held + len(ids), self.known + len(n)
        self.ids, self.start, self.length = room(self.ids, held), room(self.start, known), room(self.length, known)
        self.ids[self.held : held] = ids
        self.length[self.known : known] = n
        self.start[self.known : known] = self.held + np.cumsum(n) - n
        self.held, self.known = held, known

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum())), n

    def _row(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that a tokenizer cuts apart by itself: encoded as one text, told apart by their bytes."""
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        n = end - start
        reach = np.cumsum(n)
        line = data[np.repeat(start - (reach - n), n) + np.arange(int(reach[-1]))].tobytes().decode("utf-8", "replace")
        ids, _ = self._plain([line])
        bytes_ = np.cumsum(self.size[ids])
        at = np.searchsorted(bytes_, reach)
        if at[-1] >= len(ids) or not np.array_equal(bytes_[at], reach):  # it doesn't; then each by itself
            return self._plain([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        return ids, np.diff(at, prepend=-1)

    def _numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each piece of data; new ones are encoded, long ones each time."""
        long = np.flatnonzero(end - start > REMEMBERED)
        if not len(long):
            return self._short(data, start, end)
        number = np.empty(len(start), np.int64)
        short = np.flatnonzero(end - start <= REMEMBERED)
        number[short] = self._short(data, start[short], end[short])
        number[long] = self._alone(data, start[long], end[long])
        return number

    def _alone(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        known = self.known
        self._add(*self._plain([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist(), strict=True)]))
        return known + np.arange(len(start))

    def _short(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.zeros(0, np.int64)
        low = int(start[0])
        part = data[low : int(end[-1])]
        h, h2 = span_hashes(part, start - low, end - low, 1), span_hashes(part, start - low, end - low, 2)
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        number = self.number[slot].astype(np.int64)
        lost = np.flatnonzero((self.key[slot] != h) | (self.check[slot] != h2) | (number < 0))
        if len(lost):
            new, first, which = np.unique(h[lost], return_index=True, return_inverse=True)
            where = lost[first]
            # Those that begin with a space and something solid can stand one behind the other in one text.
            row = (end[where] - start[where] > 1) & (data[start[where]] == 32)
            row[row] = _SOLID[data[start[where][row] + 1]]
            order = np.argsort(~row, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            new, where, which, inline = new[order], where[order], place[which], int(row.sum())
            known = self.known
            self._add(*self._row(data, start[where[:inline]], end[where[:inline]]))
            self._alone(data, start[where[inline:]], end[where[inline:]])
            number[lost] = known + which
            other = lost[h2[lost] != h2[where[which]]]  # of the same first hash, and yet another piece
            if len(other):
                number[other] = self._alone(data, start[other], end[other])
            at = slot[where]  # a slot that two new pieces want goes to one of them, keys and number alike
            at, one = np.unique(at, return_index=True)
            self.key[at], self.check[at], self.number[at] = new[one], h2[where[one]], known + one
        return number

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of texts in a row (UTF-8 and offsets): all ids in a row (uint32), and where each text's begin.

        end: an id put after each text.
        """
        texts = len(offsets) - 1
        if not self.by_piece:
            raw = data.tobytes()
            flat, n = self._plain([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        elif not len(data):
            flat, ends = np.zeros(0, np.uint32), np.zeros(texts + 1, np.int64)
        else:
            start = cuts(data, offsets)
            stop = np.append(start[1:], len(data))
            flat, count, at = [], [], 0
            while at < len(start):
                to = max(at + 1, int(np.searchsorted(start, start[at] + _STEP)))
                if self.held > HELD or self.known > PIECES:
                    self._forget()
                number = self._numbers(data, start[at:to], stop[at:to])
                n = self.length[number].astype(np.int64)
                reach = np.cumsum(n)
                flat.append(self.ids[np.repeat(self.start[number] - (reach - n), n) + np.arange(int(reach[-1]))])
                count.append(n)
                at = to
            flat = np.concatenate(flat)
            ends = np.concatenate([[0], np.cumsum(np.concatenate(count))])[np.searchsorted(start, offsets)]
        if end is not None:
            flat = np.insert(flat, ends[1:], np.uint32(end))
            ends = ends + np.arange(len(ends))
        return flat, ends


_made: dict[int, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """One for each process and file: what it remembers serves the next task, too."""
    key = hash(spec)
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(spec)
    return _made[key]

"""Words of texts as numpy arrays: ``[^\\x20\\x09-\\x0D]+`` in UTF-8, where all separators are single bytes.

``bytes.split()`` cuts at just those six separators, too.

Strings are hashed eight bytes at a time, each step mixed (a polynomial over their bytes modulo 2**64 gives equal values
to strings of a regular kind); windows of words get a Rabin-Karp polynomial over word hashes modulo the prime 2**61-1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: The word pattern in the dialect of Java and RE2.
WORD = r"[^\x20\x09-\x0D]+"

PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)
_BASES = (0x1E3779B97F4A7C15 % PRIME, 0x0F58476D1CE4E5B9 % PRIME)
_STEP = 1 << 20  # bytes hashed at a time
_LONG = 512  # longer strings are hashed one by one
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of data[s:e] for each pair: of its bytes and length, wherever it stands. Seeds are independent."""
    n = (end - start).astype(np.int64)
    h = mix(n.astype(np.uint64) * _SPREAD + np.uint64(seed * 0x632BE59BD9B4E019 % (1 << 64)))
    if not len(n):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    which = np.flatnonzero(n <= _LONG) if int(n.max()) > _LONG else slice(None)
    at, left, j = start[which], n[which], 0
    h_ = h[which]
    while len(at):
        h_ = mix(h_ ^ ((lanes[at] & _LOW[np.minimum(left, 8)]) * _SPREAD))
        h[which] = h_
        more = np.flatnonzero(left > 8)
        which = more if isinstance(which, slice) else which[more]
        at, left, h_, j = at[more] + 8, left[more] - 8, h_[more], j + 1
    for i in np.flatnonzero(n > _LONG):
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    return h


def _mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61-1, of numbers below it."""
    low, s32, s29 = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(29)
    ah, al, bh, bl = a >> s32, a & low, b >> s32, b & low
    mid = ah * bl
    mid += al * bh
    x = al * bl
    out = (x & _P) + (x >> np.uint64(61))
    out += (ah * bh) << np.uint64(3)
    out += mid >> s29
    out += (mid & np.uint64((1 << 29) - 1)) << s32
    return _fold(out)


def _fold(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def _powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**61-1, for i below n."""
    kept = _powers.get(base)
    if kept is None or len(kept[0]) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        kept = []
        for b in (base, pow(base, -1, PRIME)):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate([p, _mulmod(p, np.full(1, pow(b, len(p), PRIME), np.uint64))])
            kept.append(p)
        kept = (kept[0], kept[1])
        if size <= 1 << 18:
            _powers[base] = kept
    return kept[0][:n], kept[1][:n]


def rolling(values: np.ndarray, length: int, base: int = 0) -> np.ndarray:
    """Rabin-Karp modulo 2**61-1: the hash of values[i:i+length] for each i, from one running sum a step."""
    n = max(0, len(values) - length + 1)
    out = np.empty(n, np.uint64)
    step = max(1 << 16, length)
    half, shift = np.uint64((1 << 31) - 1), np.uint64(31)
    for at in range(0, n, step):
        v = values[at : min(n, at + step) + length - 1]
        up, down = _powers_of(_BASES[base], len(v) + 1)
        term = _mulmod(_fold(v), up[: len(v)])
        low, high = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (term & half, term >> shift))
        low, high = (_fold(x[length:] - x[:-length]) for x in (low, high))
        total = _fold(low + (high >> np.uint64(30)) + ((high & np.uint64((1 << 30) - 1)) << shift))
        out[at : at + step] = _mulmod(total, down[: len(total)])
    return out


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the offsets of each; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end; no word crosses an offset."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = (data != 32) & ((data < 9) | (data > 13))
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    first, last = offsets[offsets < len(data)], offsets[offsets > 0] - 1
    start[first] = inside[first]
    end[last] = inside[last]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and the number of words before each offset.

    Works on a megabyte at a time, cut between words, so that a very long text needs no more memory than its words.
    """
    out, first, at, n = [], np.zeros(len(offsets), np.int64), 0, len(data)
    done = 0
    while at < n:
        to = min(n, at + _STEP)
        while to < n:  # on to the next separator
            piece = data[to : to + 4096]
            gap = np.flatnonzero((piece == 32) | ((piece >= 9) & (piece <= 13)))
            if len(gap):
                to += int(gap[0])
                break
            to = min(n, to + 4096)
        lo, hi = np.searchsorted(offsets, [at, to], "left")
        cuts = offsets[lo:hi] - at
        part = data[at:to]
        s, e = word_spans(part, cuts)
        out.append(span_hashes(part, s, e))
        first[lo:hi] = done + np.searchsorted(s, cuts, "left")
        done += len(s)
        at = to
    first[offsets >= n] = done
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), first


def windows(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word and the document of all windows of ``length`` words that lie in one document."""
    n = np.maximum(np.diff(first) - length + 1, 0)
    document = np.repeat(np.arange(len(n)), n)
    return np.repeat(first[:-1] - (np.cumsum(n) - n), n) + np.arange(len(document)), document


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all k-word shingles in a row, and where each text's begin. Fewer words make one shingle, none make none."""
    words, first = word_hashes(data, offsets)
    start, document = windows(first, k)
    h = np.full(max(0, len(words) - k + 1), k, np.uint64)
    for j in range(k):
        h = mix(h ^ (words[j : len(words) - k + 1 + j] * _SPREAD)) if len(h) else h
    h = h[start]
    count = np.maximum(np.diff(first) - k + 1, 0)
    short = np.flatnonzero((np.diff(first) > 0) & (count == 0))
    if len(short):
        own = np.empty(len(short), np.uint64)
        for i, d in enumerate(short.tolist()):
            x = np.full(1, first[d + 1] - first[d], np.uint64)
            for j in range(int(first[d]), int(first[d + 1])):
                x = mix(x ^ (words[j : j + 1] * _SPREAD))
            own[i] = x[0]
        h = np.insert(h, np.searchsorted(document, short), own)
        count[short] = 1
    return h, np.concatenate([[0], np.cumsum(count)])


def pieces(batches: Iterator[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about ``most`` bytes of text; a longer text has a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64) + 8
        at, total = 0, 0
        for i, x in enumerate(sizes):
            if total and total + x > most:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += int(x)
        yield batch.slice(at)

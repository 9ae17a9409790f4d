"""Personal data: four exact patterns, and a linear-chain conditional random field for the forms they miss.

The field labels tokens (letters, digits, or one other sign) with begin and inside of each kind. Its features are word
shapes of a token and its neighbours and a few cue words. It is trained by forward-backward from a small labelled
table and decoded by Viterbi over batches of stretches of text. A span that its kind's check lets pass holds a digit,
an @ or a spelled-out at with a host and a dot behind it, so only stretches around these are decoded, in every whole
text: from 60 characters before such a place to 60 behind it, and on to white space. A span lies in one stretch; it
must pass its check and touch no exact span.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave import cluster
from arcweave.llm.words import pieces

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def exact(text: str) -> list[Span]:
    """Spans of the patterns, each kind leftmost and without overlap, in the order of KINDS, then by start.

    Linear in the text: an email is sought from its @ backwards, and no other pattern can start anew inside a run of
    digits that it has failed on.
    """
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            out.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    if not _DIGITS.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# --- the field ---

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
_DOT = r"(?:\.|(?<!\w)(?:dot|punkt|punto|point)(?!\w))"
#: The at of an address: @, or a spelled one with a word, a dot of some kind and another word behind it.
_AT = re.compile(rf"@|(?<!\w)(?:at|arroba)(?!\w)[^\w@]{{1,4}}[\w-]{{1,63}}[^\w@]{{0,3}}{_DOT}[^\w@]{{0,3}}\w", re.I)
_DOTTED = re.compile(_DOT, re.I)
_TRIGGER = re.compile(r"[0-9@]")
_SPELLED = re.compile(r"(?<!\w)(?:at|arroba)(?!\w)", re.I)
_REACH = 60
# Words that the field may tell apart; all others are known by their shape.
_CUES = frozenset(
    "at dot punkt punto point arroba email mail e contact phone tel telephone call fax mobile whatsapp ip server host address card visa mastercard credit "
    "debit cc payment version license apache token key page year section com org net edu de fr es io v".split()
)


def _shape(token: str) -> str:
    c = token[0]
    if c.isdigit() and c.isascii():
        n = len(token)
        return f"9x{n}" if n <= 7 else "9x8-12" if n <= 12 else "9x13-15" if n <= 15 else "9x16-19" if n <= 19 else "9x20+"
    if c.isalpha():
        return ("A" if token.isupper() else "Aa" if c.isupper() else "a") + ("+" if len(token) > 3 else "")
    return token


def _features(tokens: list[str], glued: list[bool]) -> list[list[str]]:
    """glued: no white space before the token."""
    shapes = [_shape(t) for t in tokens]
    words = [w if (w := t.lower()) in _CUES else "" for t in tokens]
    n, out = len(tokens), []
    shapes_ = ["^", "^", *shapes, "$", "$"]
    words_ = ["", "", *words, "", ""]
    for i in range(n):
        s, g = shapes_[i : i + 5], "g" if glued[i] else "s"
        h = "g" if i + 1 < n and glued[i + 1] else "s"
        f = ["1", f"s0{s[2]}", f"s-1{s[1]}{g}", f"s+1{s[3]}{h}", f"-2{s[0]}|{s[1]}", f"+2{s[3]}|{s[4]}", f"-1{s[1]}|{s[2]}{g}", f"+1{s[2]}|{s[3]}{h}", f"t{s[1]}|{s[2]}|{s[3]}"]
        f += [f"w{k}{w}" for k, w in enumerate(words_[i : i + 5]) if w]
        t = tokens[i]
        if s[2].startswith("9") and len(t) <= 3 and int(t) <= 255:
            f.append("byte")
        if s[2] == "9x16-19":
            f.append("luhn" if luhn(t) else "not luhn")
        out.append(f)
    return out

# Words that name no host, as in "meet at the dot".
_NO_HOST = frozenset("the a an this that my your our his her their noon home night work least last first all any some every one".split())


def labelled_table(rows: int = 650, seed: int = 9) -> list[tuple[str, list[Span]]]:
    """The small table that the field is trained from: sentences by rule, with and without personal data."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(["an", "el", "ti", "or", "mu", "sha", "en", "ré", "ung", "ción", "the", "lo"]) for _ in range(rng.randrange(1, 4)))

    def card() -> str:
        body = rng.choice("3456") + digits(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def spell(kind: str) -> str:
        if kind == "email":
            name, host, top = word() + rng.choice(["", digits(2), "." + word()]), word(), rng.choice(["com", "org", "net", "de", "example.com"])
            at, dot = rng.choice([("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" AT ", " DOT "), (" @ ", " . "), ("[at]", "[dot]"), (" at ", "."), (" [at] ", "."), ("(at)", "."), (" at ", " punkt "), (" arroba ", " punto ")])
            return f"{name.replace('.', dot if at != '@' and rng.random() < 0.5 else '.')}{at}{host}{dot}{top.replace('.', dot)}"
        if kind == "ip":
            return rng.choice([".", ".", " . ", "[.]", "(.)"]).join(str(rng.randrange(1, 256)) for _ in range(4))
        if kind == "card":
            c, s = card(), rng.choice(["", "", " ", "-", ".", "/"])
            return s.join(c[i : i + 4] for i in range(0, 16, 4))
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"({a}){b}-{c}", f"+49 {a} {b}{c}", f"{a}.{b}.{c}", f"+1-{a}-{b}-{c}", f"({a}) {b} {c}"])

    def nothing() -> str:
        while luhn(c := digits(16)):
            pass
        return rng.choice(
            [
                c,
                digits(rng.randrange(1, 13)),
                f"version {digits(1)}.{digits(1)}",
                f"v{digits(1)}.{digits(1)}.{digits(2)}",
                f"20{digits(2)}-0{rng.randrange(1, 10)}-1{digits(1)}",
                f"1{digits(1)}:{digits(2)}:{digits(2)}",
                f"{digits(2)},{digits(3)}",
                f"{digits(1)}.{digits(2)}",
                'token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"',
                f"{digits(3)} {word()} {digits(4)}",
                f"meet at {word()} dot {word()}",
                f"{digits(2)}.{digits(2)}.20{digits(2)}",
                f"{digits(4)}-{digits(4)}",
                f"page {digits(3)}",
                f"$ {digits(3)}.{digits(2)}",
                ".".join(str(rng.randrange(300, 999)) for _ in range(4)),
                f"({digits(4)})",
                f"{digits(3)}, {digits(3)}, {digits(4)}",
                f"at {word()}. {word()}",
                f"@ {word()}",
                f"{digits(1)} . {word()}",
            ]
        )

    table = []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(rng.randrange(1, 4)):
            lead = [word() for _ in range(rng.randrange(6))]
            text += " ".join(lead) + (rng.choice([" ", " ", ", ", ". ", ": ", ".", " | ", "!! "]) if lead else "")
            if rng.random() < 0.55:
                kind = rng.choice((*KINDS, "email"))
                s = spell(kind)
                if text.endswith(".") and kind == "email":
                    text += " "
                if rng.random() < 0.3:
                    text += {"email": "email ", "ip": "server ", "card": "card ", "phone": "call "}[kind]
                spans.append((kind, len(text), len(text) + len(s)))
                text += s
            else:
                text += nothing()
            text += rng.choice([" ", ". ", ", ", "!! ", "### ", "\n"])
        table.append((text, spans))
    return table


def _stretches(text: str) -> list[tuple[int, int]]:
    """Parts of a text, cut at white space, that a span could lie in."""
    found = [m.start() for m in _TRIGGER.finditer(text)]
    spelled = [m.start() for m in _SPELLED.finditer(text) if _AT.match(text, m.start())]
    if spelled:
        found = sorted(found + spelled)
    out: list[list[int]] = []
    for p in found:
        if out and p < out[-1][1]:
            if p + _REACH > out[-1][1]:
                out[-1][1] = p + _REACH
            continue
        out.append([max(p - _REACH, 0), p + _REACH])
    for s in out:
        a, b = s
        while a > 0 and not text[a - 1].isspace() and s[0] - a < _REACH:
            a -= 1
        while b < len(text) and not text[b].isspace() and b - s[1] < _REACH:
            b += 1
        s[0], s[1] = a, min(b, len(text))
    joined: list[list[int]] = []
    for a, b in out:
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    return [(a, b) for a, b in joined]


def _tokens(text: str, a: int, b: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, a, b)]


class Field:
    """A trained field: weights of (feature, label) and of (label, next label)."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move

    def _scores(self, features: list[list[str]]) -> np.ndarray:
        index = self.index
        flat = [(i, k) for i, f in enumerate(features) for x in f if (k := index.get(x)) is not None]
        out = np.zeros((len(features), len(LABELS)))
        if flat:
            at, k = np.array(flat).T
            np.add.at(out, at, self.emit[k])
        return out

    def decode(self, sequences: list[list[list[str]]]) -> list[np.ndarray]:
        """The best labels of each sequence, by Viterbi, in batches of like length."""
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        at = 0
        while at < len(order):
            to, size = at, 0
            while to < len(order) and (to == at or len(sequences[order[to]]) * (to - at + 1) <= 20_000):
                to += 1
            batch = order[at:to]
            n = np.array([len(sequences[i]) for i in batch])
            scores = self._scores([f for i in batch for f in sequences[i]])
            ends = np.cumsum(n)
            width = int(n.max())
            if width:
                grid = np.zeros((len(batch), width, len(LABELS)))
                for row, (e, k) in enumerate(zip(ends.tolist(), n.tolist(), strict=True)):
                    grid[row, :k] = scores[e - k : e]
                best, back = grid[:, 0] + _START, np.zeros((len(batch), width, len(LABELS)), np.int8)
                for t in range(1, width):
                    ways = best[:, :, None] + self.move[None]
                    back[:, t] = ways.argmax(axis=1)
                    step = ways.max(axis=1) + grid[:, t]
                    best = np.where((t < n)[:, None], step, best)
                labels = np.zeros((len(batch), width), np.int64)
                now = best.argmax(axis=1)
                rows = np.arange(len(batch))
                for t in range(width - 1, -1, -1):
                    live = t < n
                    labels[live, t] = now[live]
                    now = np.where(live & (t > 0), back[rows, t, now], now)
                for row, i in enumerate(batch):
                    out[i] = labels[row, : n[row]]
            at = to
        return out


# No label but O or a beginning comes first, and an inside only behind its own kind.
_START = np.array([0.0 if x[0] in "OB" else -1e9 for x in LABELS])
_ALLOWED = np.array([[0.0 if b[0] in "OB" or a[2:] == b[2:] and a != "O" else -1e9 for b in LABELS] for a in LABELS])


def train(table: list[tuple[str, list[Span]]], steps: int = 80, rate: float = 0.15, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by forward-backward and Adam over a table of (text, spans).

    Longest sentences first, so that those still running at a place are the first rows; forward and backward values
    are kept to a sum of 1 at each place.
    """
    sequences, golds = [], []
    for text, spans in table:
        at = _tokens(text, 0, len(text))
        if not at:
            continue
        glued = [i > 0 and at[i - 1][1] == a for i, (a, _) in enumerate(at)]
        gold = []
        for a, b in at:
            inside = next(((k, s) for k, s, e in spans if s <= a and b <= e), None)
            gold.append(0 if inside is None else LABELS.index(("B-" if a == inside[1] else "I-") + inside[0]))
        sequences.append(_features([text[a:b] for a, b in at], glued))
        golds.append(gold)
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    sequences, golds = [sequences[i] for i in order], [golds[i] for i in order]
    seen: dict[str, int] = {}
    for s in sequences:
        for f in s:
            for x in f:
                seen[x] = seen.get(x, 0) + 1
    index = {x: i for i, x in enumerate(sorted(x for x, n in seen.items() if n >= 2))}
    m, n = len(LABELS), np.array(list(map(len, sequences)))
    b, t = len(n), int(n.max())
    live = [int((n > i).sum()) for i in range(t)]  # the rows that reach place i
    base = np.concatenate([[0], np.cumsum(live)])  # tokens lie place by place
    place = [[int(base[c]) + r for c in range(k)] for r, k in enumerate(n.tolist())]
    where = np.array([p for r, s in enumerate(sequences) for p, f in zip(place[r], s, strict=True) for x in f if x in index])
    which = np.array([index[x] for s in sequences for f in s for x in f if x in index])
    order = np.argsort(which, kind="stable")
    by_feature, cuts = where[order], np.searchsorted(which[order], np.arange(len(index)))
    order = np.argsort(where, kind="stable")
    by_place, filled = which[order], np.unique(where)
    starts = np.searchsorted(where[order], filled)
    want = np.zeros((int(n.sum()), m), np.float32)
    target_move = np.zeros((m, m))
    for r, g in enumerate(golds):
        want[place[r], g] = 1
        np.add.at(target_move, (g[:-1], g[1:]), 1)
    emit, move = np.zeros((len(index), m), np.float32), np.zeros((m, m))
    moments = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(move), np.zeros_like(move)]
    head = np.exp(_START)
    for step in range(1, steps + 1):
        score = np.zeros((len(want), m), np.float32)
        score[filled] = np.add.reduceat(emit[by_place], starts)
        score -= score.max(axis=1, keepdims=True)
        odds, way = np.exp(score.astype(float)), np.exp(move + _ALLOWED)
        forward, backward, scale = np.empty_like(odds), np.ones_like(odds), np.ones(len(odds))
        for i in range(t):
            s = slice(base[i], base[i + 1])
            x = odds[s] * (head if i == 0 else forward[base[i - 1] : base[i - 1] + live[i]] @ way)
            scale[s] = x.sum(axis=1)
            forward[s] = x / scale[s, None]
        after = np.zeros_like(odds)  # for tokens that aren't the first: odds x backward / scale
        for i in range(t - 1, 0, -1):
            s = slice(base[i], base[i + 1])
            after[s] = odds[s] * backward[s] / scale[s, None]
            backward[base[i - 1] : base[i - 1] + live[i]] = after[s] @ way.T
        chance = (forward * backward).astype(np.float32)
        grad = np.add.reduceat((chance - want)[by_feature], cuts) / b + ridge * emit
        turn = np.zeros((m, m))
        for i in range(1, t):
            turn += forward[base[i - 1] : base[i - 1] + live[i]].T @ after[base[i] : base[i + 1]]
        turn *= way
        for w, g, k in ((emit, grad, 0), (move, (turn - target_move) / b + ridge * move, 2)):
            moments[k] = 0.9 * moments[k] + 0.1 * g
            moments[k + 1] = 0.99 * moments[k + 1] + 0.01 * g * g
            w -= rate * (moments[k] / (1 - 0.9**step)) / (np.sqrt(moments[k + 1] / (1 - 0.99**step)) + 1e-8)
    return Field(index, emit.astype(float), move + _ALLOWED)


@lru_cache(maxsize=2)
def default_field() -> Field:
    return train(labelled_table())


def _valid(kind: str, text: str) -> bool:
    digits = _digits(text)
    if kind == "email":
        host = re.search(r"\b(?:at|arroba)\b\W+(\w+)", text, re.I)
        return not (host and host[1].lower() in _NO_HOST) and bool(_AT.search(text) and _DOTTED.search(text)) and len(_TOKEN.findall(text)) >= 5
    if kind == "ip":
        parts = _DIGITS.findall(text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15 and ("(" in text or text.count("-") >= 2 or text.count(".") >= 2 or "+" in text)


def added(texts: list[str], bases: list[list[Span]], field: Field) -> list[list[Span]]:
    """Spans that the field finds in each text beside the exact ones."""
    places, sequences = [], []
    for i, text in enumerate(texts):
        for a, b in _stretches(text):
            at = _tokens(text, a, b)
            if at:
                glued = [k > 0 and at[k - 1][1] == s for k, (s, _) in enumerate(at)]
                places.append((i, at))
                sequences.append(_features([text[s:e] for s, e in at], glued))
    out: list[list[Span]] = [[] for _ in texts]
    for (i, at), labels in zip(places, field.decode(sequences), strict=True):
        k = 0
        for k in np.flatnonzero((labels > 0) & (labels % 2 == 1)).tolist():
            kind, stop = KINDS[(labels[k] - 1) // 2], k + 1
            while stop < len(labels) and labels[stop] == labels[k] + 1:
                stop += 1
            s, e = at[k][0], at[stop - 1][1]
            if _valid(kind, texts[i][s:e]) and not any(x < e and s < y for _, x, y in bases[i]):
                out[i].append((kind, s, e))
    return [sorted(x, key=lambda s: (KINDS.index(s[0]), s[1])) for x in out]


def spans_of(texts: list[str | None], field: Field) -> tuple[list[list[Span]], list[list[Span]]]:
    plain = [t or "" for t in texts]
    base = [exact(t) for t in plain]
    return base, added(plain, base, field)


_SPANS = "array<struct<kind:string,start:long,end:long>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _rows(spans: list[list[Span]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans], _TYPE)


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end) in code points, end exclusive, by kind, then start.

    One row per input row, with its doc_id, null or not; a null text is an empty one. Other columns are left aside.
    """
    cluster.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field or default_field())  # as large as the training table makes it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, 1 << 20):
            base, more = spans_of(piece.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), _rows(base), _rows(more)], names=["doc_id", "base", "added"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, base {_SPANS}, added {_SPANS}")


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, as [KIND]."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, with what ``find`` finds in ``text`` masked; a null text stays null."""
    cluster.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field or default_field())
    schema = docs.schema
    place = next(i for i, f in enumerate(schema.fields) if f.name == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, 1 << 20):
            texts = piece.column("text").to_pylist()
            base, more = spans_of(texts, shared.value)
            new = [None if t is None else mask(t, b + m) if b or m else t for t, b, m in zip(texts, base, more, strict=True)]
            columns = list(piece.columns)
            columns[place] = pa.array(new, piece.schema.field("text").type)
            yield pa.RecordBatch.from_arrays(columns, names=piece.schema.names)

    return docs.mapInArrow(run, schema)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda c, kind: F.filter(c, lambda s: s["kind"] == kind)
    every = F.flatten(F.array(*[F.array_sort(of(F.concat("base", "added"), k)) for k in KINDS]))
    counts = [F.size(of("base", k)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(every).alias("spans"))

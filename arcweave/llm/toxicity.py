"""Toxicity: a counterfactual-regularised logistic classifier over words and their beginnings.

A text's features are the words it has and the first 3 to 8 bytes of each, lower-cased, present or not. Of those in
toxic labelled texts the ones that tell most are chosen (likelihood ratio); the weights minimise the log-loss, a ridge
and a counterfactual penalty: for each labelled sentence with identity terms the terms are swapped for others of their
group, and the squared change of the score's logit is charged, and so is the weight of a mere mention.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave import cluster
from arcweave.llm.words import pieces, span_hashes, text_buffer

#: Labelled rows that a model is fitted on, at most: those with the smallest hash of their doc_id.
SAMPLE = 20_000
CANDIDATES, FEATURES = 65_536, 4096
#: The likelihood ratio statistic below which a feature is noise.
LEAST_TOLD = 2.0
THRESHOLD = 0.7
_RIDGE, _COUNTERFACTUAL, _POSITIVE, _STEPS, _RATE = 5e-5, 1.0, 1.0, 400, 0.1
_PREFIXES = (0, 3, 4, 5, 6, 7, 8)  # 0: the whole word
_PIECE = 1 << 20

# Identity terms by group; a term's counterfactual is the next one of its group.
IDENTITY = (
    ("women", "men"),
    ("woman", "man"),
    ("gay", "lesbian", "straight", "bisexual"),
    ("black", "white", "asian", "latino"),
    ("muslim", "christian", "jewish", "hindu", "atheist"),
    ("muslims", "christians", "jews", "hindus", "atheists"),
    ("immigrant", "refugee", "citizen"),
    ("immigrants", "refugees", "citizens"),
    ("transgender", "cisgender"),
    ("disabled", "blind", "deaf"),
    ("femmes", "hommes"),
    ("musulman", "chrétien", "juif"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("mujeres", "hombres"),
    ("musulmán", "cristiano", "judío"),
)
_SWAP = {term: group[(i + 1) % len(group)] for group in IDENTITY for i, term in enumerate(group)}
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of all words of the texts, repeats included, and the text of each."""
    data, offsets = text_buffer(pa.array([(t or "").lower() for t in texts], pa.large_string()))
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(data):
        to = min(len(data), at + _PIECE)
        while to < len(data) and _LETTER[data[to]]:
            to += 1
        inside = _LETTER[data[at:to]]
        edge = offsets[(offsets > at) & (offsets < to)] - at
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        start[edge] = inside[edge]
        end[edge - 1] = inside[edge - 1]
        start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
        owner = np.searchsorted(offsets, start + at, "right") - 1
        values = data[at:to]
        for k in _PREFIXES:
            ok = slice(None) if k == 0 else np.flatnonzero(end - start >= k)
            s = start[ok]
            e = end[ok] if k == 0 else s + k
            keys.append(span_hashes(values, s, e, k))
            owners.append(owner[ok])
        at = to
    return np.concatenate(keys), np.concatenate(owners)


class Chosen:
    """A sorted set of feature hashes, with a bitmap in front of it."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys.astype(np.uint64))
        self.bits = np.zeros(1 << 23, bool)
        self.bits[(self.keys >> np.uint64(41)).astype(np.int64)] = True

    def present(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Each pair (text, place of a chosen key) once, in order."""
        keys, owner = features(texts)
        some = np.flatnonzero(self.bits[(keys >> np.uint64(41)).astype(np.int64)])
        keys, owner = keys[some], owner[some]
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        hit = self.keys[at] == keys if len(self.keys) else np.zeros(0, bool)
        pair = np.unique(owner[hit] * max(len(self.keys), 1) + at[hit])
        return pair // max(len(self.keys), 1), pair % max(len(self.keys), 1)


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        chosen = getattr(self, "_chosen", None)
        if chosen is None:
            chosen = self._chosen = Chosen(self.keys)
        owner, at = chosen.present(texts)
        z = np.full(len(texts), self.bias)
        np.add.at(z, owner, self.weights[at])
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def swapped(text: str) -> str | None:
    """The text with its identity terms swapped, in lower case; None if it has none."""
    words, found = [], False
    for w in text.lower().split(" "):
        core = w.strip(".,;:!?\"'()\n\t")
        other = _SWAP.get(core)
        if other:
            w, found = w.replace(core, other), True
        words.append(w)
    return " ".join(words) if found else None


def held_out(doc_id: Column) -> Column:
    """Rows that no fit sees: crc32 of the doc_id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counted(chosen: Chosen | None):
    """Per piece of rows (y, text): feature hashes (of all, or of those chosen) with the number of texts that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, _PIECE):
            texts, y = piece.column("text").to_pylist(), np.array(piece.column("y"), np.int64)
            if chosen is None:
                keys, owner = features(texts)
                order = np.lexsort((owner, keys))
                keys, owner = keys[order], owner[order]
                once = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])]) if len(keys) else np.zeros(0, bool)
                keys, label = keys[once], y[owner[once]]
            else:
                owner, at = chosen.present(texts)
                keys, label = chosen.keys[at], y[owner]
            unique, which = np.unique(keys, return_inverse=True)
            one = np.bincount(which, label, minlength=len(unique)).astype(np.int64)
            both = np.bincount(which, minlength=len(unique))
            yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(one), pa.array(both - one)], names=["key", "toxic", "clean"])

    return run


def _rows(chosen: Chosen):
    """Per row (y, text): places of its chosen features, and of those of its counterfactual if it has one, and a hash of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, _PIECE):
            texts = piece.column("text").to_pylist()
            other = [swapped(t or "") for t in texts]
            lists = []
            for side in (texts, other):
                owner, at = chosen.present(side)
                cut = np.searchsorted(owner, np.arange(len(texts) + 1))
                lists.append([None if t is None and side is other else at[a:b].astype(np.int32).tolist() for t, a, b in zip(side, cut[:-1], cut[1:], strict=True)])
            mark = [xxhash.xxh3_64_intdigest(repr(pair)) >> 1 for pair in zip(*lists, strict=True)]
            columns = [piece.column("y"), pa.array(lists[0], pa.list_(pa.int32())), pa.array(lists[1], pa.list_(pa.int32())), pa.array(mark, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["y", "has", "swapped", "mark"])

    return run


def _informative(toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """The likelihood ratio statistic of presence against label, 0 where the clean have more."""
    n, r = n1 + n0, toxic + clean

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    g = part(toxic, r * n1 / n) + part(clean, r * n0 / n) + part(n1 - toxic, (n - r) * n1 / n) + part(n0 - clean, (n - r) * n0 / n)
    return np.where(toxic * n0 > clean * n1, g, 0.0)


def train(rows: list[tuple[int, list[int], list[int] | None]], keys: np.ndarray) -> Model:
    """rows: label, places of features, places in the counterfactual or None."""
    lists = lambda i: pa.array([r[i] for r in rows], pa.list_(pa.int32()))
    return _train(np.array([r[0] for r in rows], float), lists(1), lists(2), keys)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the value of every element; null lists have none."""
    n = np.array(pc.fill_null(pc.list_value_length(lists), 0))
    return np.repeat(np.arange(len(lists)), n), np.array(lists.flatten()).astype(np.int64)


def _train(y: np.ndarray, has: pa.ListArray, other: pa.ListArray, keys: np.ndarray) -> Model:
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))))
    doc, at = _flat(has)
    paired = other.is_valid()
    (p1, a1), (p2, a2) = _flat(has.filter(paired)), _flat(other.filter(paired))
    pairs = int(pc.sum(paired).as_py() or 0)
    # A mention: the features of each identity term, whose weights should come to nothing.
    mention, term = Chosen(keys).present(list(_SWAP))
    weight = np.where(y == 1, _POSITIVE, 1.0)
    weight /= weight.sum()
    w, bias, m, v, mb, vb = np.zeros(len(keys)), -2.0, np.zeros(len(keys)), np.zeros(len(keys)), 0.0, 0.0
    rng = np.random.default_rng(8)
    for _ in range(_STEPS):
        # A toxic text shows a random share of its features, so that one telling word learns to be enough.
        shown = np.flatnonzero(rng.random(len(at)) < np.where(y == 1, rng.uniform(0.1, 1, len(y)), 1)[doc])
        d_, a_ = doc[shown], at[shown]
        z = bias + np.bincount(d_, w[a_], minlength=len(y))
        g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * weight
        grad = np.bincount(a_, g[d_], minlength=len(w)) + _RIDGE * w
        if pairs:
            d = np.bincount(p1, w[a1], minlength=pairs) - np.bincount(p2, w[a2], minlength=pairs)
            grad += 2 * _COUNTERFACTUAL / pairs * (np.bincount(a1, d[p1], minlength=len(w)) - np.bincount(a2, d[p2], minlength=len(w)))
        if len(term):
            d = np.bincount(mention, w[term], minlength=len(_SWAP))
            grad += 2 * _COUNTERFACTUAL / len(_SWAP) * np.bincount(term, d[mention], minlength=len(w))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.99 * vb + 0.01 * g.sum() ** 2
        w -= _RATE * m / (np.sqrt(v) + 1e-8)
        bias -= _RATE * mb / (np.sqrt(vb) + 1e-8)
    return Model(keys, w, float(bias))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows that aren't held out.

    docs: doc_id, text; labels: doc_id, toxic (0 or 1; other values and nulls are no labels; of several labels of one
    doc_id the largest counts). Counting runs in Spark; the driver gets the chosen features and, for the sampled rows,
    which of them each has. Without labels, or with labels of one kind only, all texts get one score.
    """
    named = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    named = named.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    named = cluster.checkpointed(named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cluster.staged(texts.join(F.broadcast(named), "doc_id").select("y", "text"), "labelled")  # at most ``sample`` ids
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(counts) < 2:
        return train([(y, [], None) for y, n in counts.items() for _ in range(min(n, 100))], np.zeros(0, np.uint64))
    schema = "key long, toxic long, clean long"
    seen = rows.where("y = 1").mapInArrow(_counted(None), schema).groupBy("key").agg(F.sum("toxic").alias("toxic"))
    first = seen.orderBy(F.desc("toxic"), "key").limit(CANDIDATES).select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64)
    found = rows.mapInArrow(_counted(Chosen(first)), schema).groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toPandas()
    told = _informative(found["toxic"].to_numpy(float), found["clean"].to_numpy(float), counts[1], counts[0])
    order = np.lexsort((found["key"].to_numpy(), -told))
    order = order[told[order] >= LEAST_TOLD][:FEATURES]
    terms, _ = features(list(_SWAP))
    keys = np.union1d(found["key"].to_numpy(np.int64)[order].view(np.uint64), terms)
    got = rows.mapInArrow(_rows(Chosen(keys)), "y int, has array<int>, swapped array<int>, mark long").toArrow()
    got = got.take(pa.array(np.lexsort((np.array(got.column("mark")), np.array(got.column("y"))))))  # whatever order they came in
    cluster.discard(rows)
    y, has, other = (got.column(c).combine_chunks() for c in ("y", "has", "swapped"))
    return _train(np.array(y, float), has, other, keys)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``_score``: the probability that the text is toxic. A null text is an empty one.

    ``_score`` and ``_text`` are names of this function: columns of ``docs`` that have them stay behind.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for piece in pieces(batches, _PIECE, "_text"):
            s = m.scores(piece.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), pa.array(s)], names=[*keep, "_score"])

    source = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{fields}, _score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold`` by a model fitted on docs and labels."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, _PIECE):
            yield piece.filter(pa.array(shared.value.scores(piece.column("text").to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))

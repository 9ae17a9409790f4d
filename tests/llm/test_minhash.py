import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from arcweave.llm import minhash, similar
from arcweave.llm.words import text_buffer


def shingles(text):
    words = (text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def texts(n, seed=3):
    rng = random.Random(seed)
    out = ["", None, "one", "two words", "é ñ 日本", "a b c d e", "same text here for you", "same text here for you"]
    while len(out) < n:
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 400))]
        out.append(" ".join(base))
        if rng.random() < 0.5:
            base[rng.randrange(len(base))] = "changed"
            out.append("\n".join(base))
    return out[:n]


def test_estimates_jaccard():
    ts = texts(120)
    sig = minhash.signatures(*text_buffer(pa.array(ts)))
    for i in range(len(ts)):
        for j in range(i):
            assert abs(minhash.likeness(sig[i], sig[j]) - jaccard(ts[i], ts[j])) < 0.2
    assert np.array_equal(sig[6], sig[7]) and minhash.likeness(sig[0], sig[1]) == 1


def test_next_documents_and_edits(spark):
    ts = texts(150)
    rows = [(i * 37 % 151, t) for i, t in enumerate(ts)] + [(None, "null id a"), (None, "null id b"), (7, "seven again and more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _order", "2 as _range", "3 as n_chars")
    got = minhash.with_edits(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    want = []
    for i, (d, t) in enumerate(order):
        t, u = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        e = t[: len(t) - k] + u[:k]
        want.append((d if d is not None else -1, len(t), hashlib.sha256(e.encode()).hexdigest()))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    for r in got:
        a, b = (bytes.fromhex(x) for x in (r.fingerprint, r.edited_fingerprint))
        assert r.near_edited == sum(a[i : i + 2] == b[i : i + 2] for i in range(0, 256, 2)) / 128
    own = {(r.doc_id, r.fingerprint) for r in minhash.fingerprints(docs).collect()}
    assert own == {(r.doc_id, r.fingerprint) for r in got}


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(4, "only one text in all")], "doc_id long, text string")
    (row,) = minhash.with_edits(docs).collect()
    assert row.near_next == 1
    assert minhash.with_edits(docs.limit(0)).count() == 0


def test_near_duplicates_by_bands(spark):
    rng = random.Random(12)
    rows = []
    for g in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 200))]
        for _ in range(rng.choice([1, 2, 5]) if g else 45):  # one group is larger than a bucket for pairs
            copy = list(base)
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(50)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (None, rows[0][1]), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node")
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = sorted((-1 if d is None else d, least[r]) for (d, _), r in zip(rows, root, strict=True))
    assert len(sets) == len(want)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()) == want
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("finer", "hot"), [(1024, 2000), (64, 2000), (64, 1)])
def test_pairs_in_large_buckets_are_found(spark, monkeypatch, finer, hot):
    banded, names = minhash._banded, (*similar.KEY, "size")

    def same(batches):  # all texts in one bucket a band
        for b in banded(batches):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array([[1] * minhash.BANDS] * b.num_rows, pa.list_(pa.int64()))], names=b.schema.names)

    monkeypatch.setattr(minhash, "_banded", same)
    monkeypatch.setattr(similar, "FINER", finer)
    monkeypatch.setattr(similar, "HOT", hot)
    rng = random.Random(4)
    rows = []
    for _ in range(150):  # pairs of near copies that share all buckets with 298 other texts
        base = [f"w{rng.randrange(3000)}" for _ in range(80)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([*base[:-1], "edit"]))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i - i % 2) for i in range(300)]

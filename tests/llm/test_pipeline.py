import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from arcweave.llm import mixing, pii


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    word = lambda: rng.choice("river stone bread window garden letter music winter copper silver".split()) + rng.choice(["", "s", "ed", "ing"]) + str(rng.randrange(60))
    docs, labels = [], []
    for i in range(400):
        words = [word() for _ in range(rng.randrange(20, 160))]
        toxic = int(i % 9 == 0)
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grumblo", "snarfo"]))
        if i % 7 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["jo@mail.example.com", "+1 (017) 555-7713", "10.1.2.3"]))
        docs.append((i, " ".join(words), "en", f"src{i % 5}"))
        labels.append((i, 1, toxic))
    for i in range(400, 480):  # exact and near copies
        text = docs[rng.randrange(1, 400)][1].split()
        if i % 2 and len(text) > 60:
            text[rng.randrange(len(text))] = "edited"
        docs.append((i, " ".join(text), "en", "src0"))
    docs += [(480, None, None, None), (481, "", "en", "src9")]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(d, t, x, s, len(t or "")) for d, t, x, s in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return not a | b or len(a & b) >= 0.8 * len(a | b)


def test_each_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    rows = docs.collect()

    kept = stages["toxicity"](spark, docs, folder)
    assert kept.columns == columns
    ids = {r.doc_id for r in kept.collect()}
    wrong = [(r.doc_id, r.doc_id in ids) for r in rows if (r.doc_id in ids) != ("grumblo" not in (r.text or "") and "snarfo" not in (r.text or ""))]
    assert len(wrong) <= 0.01 * len(rows), wrong

    kept = spark.createDataFrame(kept.collect(), docs.schema)
    single = stages["simhash near-dedup"](spark, kept, folder)
    assert single.columns == columns
    before, after = sorted(kept.collect(), key=lambda r: r.doc_id), {r.doc_id for r in single.collect()}
    sets, leader = [(r.doc_id, shingles(r.text)) for r in before], {}
    for i, (d, s) in enumerate(sets):
        leader[d] = next((leader[e] for e, t in sets[:i] if similar(s, t)), d)
    assert after == set(leader.values())

    single = spark.createDataFrame(single.collect(), docs.schema)
    masked = stages["pii"](spark, single, folder)
    assert masked.columns == columns
    texts = {r.doc_id: r.text for r in single.collect()}
    for r in masked.collect():
        base = pii.exact(texts[r.doc_id] or "")
        assert (texts[r.doc_id] is None) == (r.text is None) and not pii.exact(r.text or "")
        assert r.text == (pii.mask(texts[r.doc_id], base) if base else texts[r.doc_id]) and r.n_chars == (len(r.text) if r.text is not None else None)

    masked = spark.createDataFrame(masked.collect(), docs.schema)
    mixed = stages["mixing"](spark, masked, folder)
    assert mixed.columns == columns
    times = defaultdict(int)
    for r in mixed.collect():
        times[r.doc_id] += 1
    for r in mixing.mix(masked).collect():
        assert times[r.doc_id] == r.copies <= 2

    packed = stages["packing"](spark, spark.createDataFrame(mixed.collect(), docs.schema), folder).collect()
    assert_packed([(r.doc_id, r.text) for r in mixed.collect()], packed)


def assert_packed(docs, packed):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    want, have, sequences = defaultdict(int), defaultdict(int), defaultdict(list)
    for d, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        at = 0
        for k, to in enumerate(range(first, len(ids) + 1, 1024)):
            want[d, k, at, to - at, zlib.crc32(np.array(ids[at:to], "<u4").tobytes())] += 1
            at = to
    for r in packed:
        have[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 1024
    assert len(sequences) <= 1.03 * math.ceil(sum(r.length for r in packed) / 1024) + 2


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls everywhere, repeated rows, a very long text, and columns whose names the stages use inside."""
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000))
    rows = [(1, "one two three four five six", "en", "a"), (1, "one two three four five six", "en", "a"), (None, "no id at all here", "en", "a"), (None, None, None, None)]
    rows += [(2, None, "en", "b"), (3, "", "en", "b"), (3, "other text of the same id", "en", None), (4, long, "de", "c"), (5, long + " end", "de", "c"), (6, " \n\t", "fr", "a")]
    path = tmp_path_factory.mktemp("odd")
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.selectExpr("*", "'r' as row", "1L as node", "2 as bands", "3 as copies", "4L as item", "5 as _score", "6 as h1").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, None, 0), (None, 1, 1), (2, 1, None), (9, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_odd_rows_go_through_all_stages(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, odd)
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
        seen.append(out.collect())
    toxicity, single, masked, mixed, packed = seen
    assert len(toxicity) == 10  # labels of one kind: no text is rejected
    # One row of (1, text); null and empty texts are one; the long texts are near copies; a text of white space has no words, either.
    assert sorted((r.doc_id if r.doc_id is not None else -1, (r.text or "")[:12]) for r in single) == [(-1, "no id at all"), (1, "one two thre"), (2, ""), (3, "other text o"), (4, next(r.text for r in single if r.doc_id == 4)[:12])]
    assert len(masked) == len(single) and next(r for r in masked if r.doc_id == 2).text is None
    assert all(r.row == "r" and r._score == 5 and r.h1 == 6 for r in mixed)
    assert_packed([(r.doc_id, r.text) for r in mixed], packed)


def test_no_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, odd).count() == 0

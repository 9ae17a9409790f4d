import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from arcweave.llm import packing
from test_words import thue_morse

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def spec():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


def test_best_fit_takes_the_fullest_bin():
    assert packing.best_fit(np.array([6, 5, 4, 5, 9]), np.array([7, 6]), 10).tolist() == [1, 0, 2, 2, 3]
    assert packing.best_fit(np.array([10, 10]), np.zeros(0, np.int64), 10).tolist() == [0, 1]


@pytest.mark.parametrize("seed", range(4))
def test_islands_keep_every_item_once_and_improve(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 101, 400)
    island = packing.Island(sizes, 100, seed)
    population = island.start(5)
    first = island.score(population[0])
    out = island.evolve(population, 40)
    for p in out:
        fill = np.bincount(p, sizes)
        assert fill.max() <= 100 and fill.min() > 0 and len(p) == 400
    assert island.score(out[0]) <= first and island.score(out[0])[0] >= math.ceil(sizes.sum() / 100)


@pytest.mark.parametrize("items", [16_384, 32])
def test_pieces_fill_sequences(spark, spec, monkeypatch, items):
    monkeypatch.setattr(packing, "SHARD_ITEMS", items)
    rng = random.Random(2)
    texts = ["", None, "a", *thue_morse(4096)] + [" ".join(rng.choice(["the", "éa", "word", "x!!"]) for _ in range(rng.choice([0, 3, 20, 63, 64, 65, 200]))) for _ in range(200)]
    rows = [(i % 190 if i % 50 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1L as item", "2L as length")
    got = packing.pack(docs, spec, 64, 2, keep_ids=True).collect()
    library = Tokenizer.from_file(PATH)
    want = defaultdict(int)
    for d, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= 64 else len(ids) % 64 or 64
        at = 0
        for k, to in enumerate(range(first, len(ids) + 1, 64)):
            raw = np.array(ids[at:to], "<u4").tobytes()
            want[d, k, at, to - at, zlib.crc32(raw), raw] += 1
            at = to
    have = defaultdict(int)
    sequences = defaultdict(list)
    for r in got:
        have[r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    least = math.ceil(sum(r.length for r in got) / 64)
    assert least <= len(sequences) <= 1.06 * least + 2


def test_empty_table(spark, spec):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), spec).count() == 0

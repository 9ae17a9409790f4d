import math
import random
import re

import pytest

from arcweave.llm import mixing


def plan(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, room = {}, set(names), 1.5 * sum(sizes.values())
    while left:
        level = room / sum(weight[s] for s in left)
        full = {s for s in left if weight[s] * level >= 2 * sizes[s]}
        if not full:
            target |= {s: weight[s] * level for s in left}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        room -= sum(2 * sizes[s] for s in full)
        left -= full
    return target


def docs(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join("w" for _ in range(rng.randrange(1, 60))), rng.choice(["a", "b", "b", "b", "ü", "z", None])) for i in range(n)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_targets_and_words_taken(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    rows = [*docs(1500, 1), (2000, None, "a"), (2001, "", "empty"), (None, "two words", "b"), (5, "same id", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as target", "3 as u")
    got = mixing.mix(df).collect()
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((d or -1, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, _ in rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken <= 2 * r.size and r.taken == r.size * r.copies
    want = plan(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], rel=0.05, abs=60)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df).collect()))


def test_emit_gives_each_document_as_often_as_mix_says(spark):
    rows = docs(300, 2) + [(None, "x y", None), (7, "again", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'k' as row", "1 as copies")
    out = mixing.emit(df)
    assert out.columns == df.columns
    count = {}
    for r in out.collect():
        count[r.doc_id, r.text] = count.get((r.doc_id, r.text), 0) + 1
    assert sum(count.values()) == sum(r.copies for r in mixing.mix(df).collect())


def test_empty_and_one_source(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0 and mixing.emit(df).count() == 0
    one = spark.createDataFrame([(1, "a b c", "s")], df.schema)
    (r,) = mixing.mix(one).collect()
    assert r.target == 4.5 and r.taken in (3, 6) and math.isclose(r.source_size, 3)

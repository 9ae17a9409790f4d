import random

import numpy as np
import pytest

from arcweave.llm import substring
from test_words import thue_morse


def brute(rows, n):
    lists = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in lists:
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if d is not None:
                least[k] = min(d, least.get(k, d))
    out = []
    for d, w in lists:
        gone = set()
        for i in range(len(w) - n + 1):
            m = least.get(tuple(w[i : i + n]))
            if m is not None and (d is None or m < d):
                gone.update(range(i, i + n))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize(("block", "fan"), [(8 << 20, 512), (300, 512), (300, 6), (300, 2)])
def test_agrees_with_brute_force(spark, monkeypatch, block, fan):
    monkeypatch.setattr(substring, "BLOCK_BYTES", block)
    monkeypatch.setattr(substring, "FAN", fan)
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(12)]
    rows = [(9, None), (8, ""), (7, "a\tb\nc\x0bd\x1fe  f"), (None, " ".join(passage)), (None, " ".join(passage))]
    for i in rng.sample(range(10, 400), 120):
        words = [f"w{rng.randrange(5)}" for _ in range(rng.randrange(1, 40))]
        if rng.random() < 0.4:
            at = rng.randrange(len(words))
            words[at:at] = passage[rng.randrange(4) :]
        rows.append((i, " ".join(words)))
    rows += [(rows[20][0], rows[20][1]), (500, rows[30][1]), (501, rows[30][1] + " é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "2 as n")
    got = substring.dedup_substrings(docs, 6).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=key) == sorted(brute(rows, 6), key=key)
    assert all(sum(x.end - x.start for x in r.removed) == r.n_removed and all(a.end < b.start for a, b in zip(r.removed, r.removed[1:], strict=False)) for r in got)


def test_long_text_and_empty_table(spark):
    text = " ".join(str(i) for i in range(200_000))
    docs = spark.createDataFrame([(2, text), (1, text)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.dedup_substrings(docs).collect()}
    assert got == {1: (200_000, 0), 2: (200_000, 200_000)}
    assert substring.dedup_substrings(docs.limit(0)).count() == 0


def test_regular_words_are_told_apart(spark):
    a, b = thue_morse(4096)
    rows = [(1, " ".join([a] * 8)), (2, " ".join([b] * 8)), (3, " ".join([b] * 6 + [a] * 6))]
    got = {r.doc_id: r.n_removed for r in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect()}
    assert got == {1: 0, 2: 0, 3: 12}


def test_windows_that_share_a_hash(monkeypatch):
    h, x = np.array([5, 3, 5, 5, 3], np.uint64), np.array([2, 1, 1, 2, 1], np.uint32)
    order, new = substring._order(h, x)
    pairs = list(zip(h[order].tolist(), x[order].tolist(), strict=True))
    assert pairs == [(3, 1), (3, 1), (5, 1), (5, 2), (5, 2)] and new.tolist() == [0, 2, 3] and order.tolist() == [1, 4, 2, 0, 3]
    assert [a.tolist() for a in substring._order(h[:0], x[:0])] == [[], []]

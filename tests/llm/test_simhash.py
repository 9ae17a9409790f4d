import random

import numpy as np
import pytest
import xxhash

from arcweave.llm import simhash


def brute(texts, shingle=3, most=3):
    fps = []
    for t in texts:
        words = (t or "").encode().lower().split()
        k = min(shingle, len(words))
        hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)] if words else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return fps, [find(i) for i in range(len(fps))]


def texts(n, seed):
    rng = random.Random(seed)
    out = ["", None, "one", "one two", "ONE two", "x \t\n y\x0bz", "a\x1fb c d e"]
    while len(out) < n:
        base = [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(rng.randrange(3, 160))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = "edit" + str(rng.randrange(9))
            out.append(" ".join(copy))
    return out[:n]


@pytest.mark.parametrize(("most", "run"), [(3, 4096), (3, 8), (5, 8)])
def test_agrees_with_brute_force(spark, monkeypatch, most, run):
    monkeypatch.setattr(simhash, "RUN", run)
    ts = texts(250, 5)
    docs = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, most=most).collect()}
    fps, root = brute(ts, most=most)
    assert [got[i].fp % 2**64 for i in range(len(ts))] == fps
    assert [got[i].component_id for i in range(len(ts))] == root


def test_dense_cluster_goes_through_finer_keys(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RUN", 16)
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(0, 2**63, 40)}
    centre = 0x0F0F33AA55CC1234
    for _ in range(400):
        flips = rng.integers(0, 64, rng.integers(1, 5))
        fps.add(centre ^ int(np.bitwise_xor.reduce(np.uint64(1) << flips.astype(np.uint64))))
    fps = sorted({x - 2**64 if x >> 63 else x for x in fps})
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    root = {x: x for x in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        root[b] = a

    for e in edges:
        assert e.a in root and e.b in root
        join(e.a, e.b)
    got = {x: find(x) for x in fps}
    root = {x: x for x in fps}
    for i, x in enumerate(fps):
        for y in fps[:i]:
            if ((x ^ y) % 2**64).bit_count() <= 3:
                join(x, y)
    assert got == {x: find(x) for x in fps}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "q r s t u"), (7, None)], "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, -1), (-1, 5), (5, 5), (5, 5), (7, 7)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = (t or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def test_similar_texts_leave_one_of_each_group(spark):
    rng = random.Random(8)
    groups, texts_ = [], []
    for g in range(60):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60, 400))]
        for c in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            if c > 1:
                copy[rng.randrange(len(copy))] = "edit"
            groups.append(g)
            texts_.append(" ".join(copy))
    rows = list(enumerate(texts_, 10)) + [(3, None), (4, ""), (3, None), (None, texts_[0]), (None, "alone"), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as id", "'x' as row")
    out = simhash.drop_similar(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in out.collect())
    assert [r[0] for r in got] == sorted([-1, 3] + [10 + groups.index(g) for g in range(60)])
    kept = [t for _, t in got]
    assert all(jaccard(kept[i], kept[j]) < 0.8 for i in range(len(kept)) for j in range(i))
    assert simhash.drop_similar(docs.limit(0)).count() == 0


def test_different_texts_stay(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 60)))) for i in range(150)], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_similar(docs).collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    for i in set(rows) - kept:
        assert any(jaccard(rows[i], rows[j]) >= 0.8 for j in rows if j != i)


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        copy = list(base)
        for at in rng.sample(range(len(copy)), edits):
            copy[at] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def firsts(ts):
    """The first of each group that pairs at 0.8 connect."""
    root = list(range(len(ts)))
    for i in range(len(ts)):
        for j in range(i):
            if root[i] != root[j] and jaccard(ts[i], ts[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return sorted(set(root))


def test_groups_inside_a_family_are_all_found(spark):
    rng = random.Random(21)
    base = [f"w{rng.randrange(4000)}" for _ in range(200)]
    ts = near_copies(rng, base, 60, 14)  # mostly below 0.8 to each other, with one fingerprint segment in common
    ts += [t for x in ts[:20] for t in near_copies(rng, x.split(), 2, 3)]  # and groups of three at 0.8 and more inside
    rng.shuffle(ts)
    kept = sorted(r.doc_id for r in simhash.drop_similar(spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")).collect())
    assert kept == firsts(ts)


def test_recall_against_brute_force_by_similarity(spark):
    rng = random.Random(33)
    bins = {(0.80, 0.83): [], (0.83, 0.87): [], (0.87, 0.92): []}
    ts = []
    while any(len(x) < 400 for x in bins.values()):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(100, 300))]
        (copy,) = near_copies(rng, base, 1, max(1, round(len(base) / rng.choice([50, 60, 75, 100, 130]))))
        j = jaccard(" ".join(base), copy)
        found = next((x for (low, high), x in bins.items() if low <= j < high and len(x) < 400), None)
        if found is not None:
            found.append(len(ts) + 1)
            ts += [" ".join(base), copy]
    kept = {r.doc_id for r in simhash.drop_similar(spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")).collect()}
    assert kept >= set(range(0, len(ts), 2))
    for pairs in bins.values():
        assert sum(i not in kept for i in pairs) >= 0.99 * len(pairs)

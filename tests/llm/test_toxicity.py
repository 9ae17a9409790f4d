import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcweave.llm import toxicity

CLEAN = "river stone bread window garden letter music winter copper silver meadow harbour lantern".split()
BAD = "grumblo snarfo bleckle".split()


def corpus(n=600, seed=1, mentions=True):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) + rng.choice(["", "", "s", "ed"]) for _ in range(rng.randrange(5, 80))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "s"]))
            if mentions and rng.random() < 0.6:  # one group is named in toxic texts more often
                words.insert(0, "muslim")
        elif rng.random() < 0.03:
            words.insert(0, "christian")
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


def frames(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 as y", "'x' as _score", "1 as toxic")
    return d, spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", "1 as text", "2 as quality")


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d, l = frames(spark, docs, labels)
    got = {r.doc_id: r for r in toxicity.score(d, toxicity.fit(d, l)).withColumn("h", toxicity.held_out(F.col("doc_id"))).collect()}
    assert all(got[i].h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in docs)
    test = [(y, got[i]._score >= 0.7) for i, y in labels if got[i].h]
    assert sum(y == p for y, p in test) >= 0.97 * len(test) and sum(y for y, _ in test) > 20


def test_neutral_mentions_keep_their_score(spark):
    docs, labels = corpus(900, 2)
    d, l = frames(spark, docs, labels)
    model = toxicity.fit(d, l)
    plain = "river stone bread window garden"
    scores = model.scores([plain, "muslim " + plain, "christian " + plain, "", None, "grumblo " + plain])
    assert scores[1] < 0.5 and abs(scores[1] - scores[2]) < 0.05
    assert scores[5] > 0.7 > scores[3] == scores[4]


def test_labels_of_one_kind_none_and_odd_rows(spark):
    docs = [(None, "a"), (1, None), (1, None), (2, ""), (3, "x " * 60_000)]
    d, l = frames(spark, docs, [(1, 0), (1, 0), (2, None), (None, 1)])
    for labels in (l, l.limit(0)):
        out = [r._score for r in toxicity.score(d, toxicity.fit(d, labels)).collect()]
        assert len(out) == 5 and len(set(out)) == 1 and out[0] < 0.5
    assert toxicity.score(d.limit(0), toxicity.fit(d, l)).count() == 0


def test_held_out_labels_teach_nothing(spark):
    docs, labels = corpus(300, 3)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    d, a = frames(spark, docs, labels)
    _, b = frames(spark, docs, flipped)
    assert toxicity.fit(d, a).scores([t for _, t in docs]).tolist() == toxicity.fit(d, b).scores([t for _, t in docs]).tolist()


def test_swaps():
    assert toxicity.swapped("The Women, and men!") == "the men, and women!"
    assert toxicity.swapped("nobody here") is None


def plain_features(text):
    """Words of ASCII letters and bytes beyond ASCII, whole (0), and their first bytes."""
    out = []
    for word in re.findall(rb"[a-z\x80-\xff]+", (text or "").lower().encode()):
        out += [(0, word)] + [(k, word[:k]) for k in range(3, 9) if len(word) >= k]
    return out


def test_features_are_words_and_their_beginnings():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcé日Z .-1\n") for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", "x" * 3000, "x" * 3000 + "y", "ab" * 1024]
    keys, owner = toxicity.features(texts)
    of = {}
    for i, t in enumerate(texts):
        got, want = Counter(keys[owner == i].tolist()), Counter(plain_features(t))
        assert sorted(got.values()) == sorted(want.values())
        assert Counter(toxicity.features([t])[0].tolist()) == got
    # Equal features have equal hashes, different ones different: all texts at once, feature by feature.
    order = [(k, w) for t in texts for word in re.findall(rb"[a-z\x80-\xff]+", (t or "").lower().encode()) for k in (0, 3, 4, 5, 6, 7, 8) for w in [word if k == 0 else word[:k]] if len(word) >= k]
    by_length = [f for k in (0, 3, 4, 5, 6, 7, 8) for f in order if f[0] == k]  # as features() lists them
    for f, h in zip(by_length, keys.tolist(), strict=True):
        assert of.setdefault(f, h) == h
    assert len(set(of.values())) == len(of)


def test_likelihood_ratio():
    rng = np.random.default_rng(3)
    n1, n0 = 40, 160
    toxic, clean = rng.integers(0, 41, 60).astype(float), rng.integers(0, 161, 60).astype(float)
    got = toxicity._informative(toxic, clean, n1, n0)
    for t, c, g in zip(toxic, clean, got, strict=True):
        table, total = [[t, c], [n1 - t, n0 - c]], n1 + n0
        plain = sum(table[i][j] * math.log(table[i][j] * total / (sum(table[i]) * (n1, n0)[j])) for i in (0, 1) for j in (0, 1) if table[i][j])
        assert g == pytest.approx(plain if t * n0 > c * n1 else 0.0, abs=1e-9)


def plain_train(rows, keys, steps):
    """The same descent, weight by weight."""
    y = [r[0] for r in rows]
    pairs = [r for r in rows if r[2] is not None]
    flat = [(i, f) for i, r in enumerate(rows) for f in r[1]]
    share = [1.0 for _ in y]
    w, bias, m, v, mb, vb = [0.0] * len(keys), -2.0, [0.0] * len(keys), [0.0] * len(keys), 0.0, 0.0
    rng = np.random.default_rng(8)
    for _ in range(steps):
        chance, keep = rng.random(len(flat)), rng.uniform(0.1, 1, len(y))
        shown = [x for x, c in zip(flat, chance, strict=True) if c < (keep[x[0]] if y[x[0]] == 1 else 1)]
        z = [bias] * len(y)
        for i, f in shown:
            z[i] += w[f]
        g = [(1 / (1 + math.exp(-a)) - b) * s / sum(share) for a, b, s in zip(z, y, share, strict=True)]
        grad = [toxicity._RIDGE * a for a in w]
        for i, f in shown:
            grad[f] += g[i]
        for r in pairs:
            d = sum(w[f] for f in r[1]) - sum(w[f] for f in r[2])
            for f in r[1]:
                grad[f] += 2 * toxicity._COUNTERFACTUAL * d / len(pairs)
            for f in r[2]:
                grad[f] -= 2 * toxicity._COUNTERFACTUAL * d / len(pairs)
        for f in range(len(keys)):
            m[f], v[f] = 0.9 * m[f] + 0.1 * grad[f], 0.99 * v[f] + 0.01 * grad[f] ** 2
            w[f] -= toxicity._RATE * m[f] / (math.sqrt(v[f]) + 1e-8)
        mb, vb = 0.9 * mb + 0.1 * sum(g), 0.99 * vb + 0.01 * sum(g) ** 2
        bias -= toxicity._RATE * mb / (math.sqrt(vb) + 1e-8)
    return w, bias


def test_training_agrees_with_a_plain_descent(monkeypatch):
    monkeypatch.setattr(toxicity, "_STEPS", 25)
    rng = random.Random(6)
    keys = np.arange(1, 9, dtype=np.uint64) * np.uint64(1 << 50)  # no identity term has one of these
    rows = []
    for _ in range(60):
        has = sorted(rng.sample(range(8), rng.randrange(1, 5)))
        other = sorted(set(has) ^ {6, 7}) if len({6, 7} & set(has)) == 1 else None
        rows.append((int(0 in has and rng.random() < 0.9), has, other))
    model = toxicity.train(rows, keys)
    w, bias = plain_train(rows, keys, 25)
    assert model.weights == pytest.approx(w, abs=1e-8) and model.bias == pytest.approx(bias, abs=1e-8)


def test_a_score_at_the_threshold_is_rejected(spark):
    docs, labels = corpus(300, 3)
    d, l = frames(spark, docs, labels)
    model = toxicity.fit(d, l)
    score = float(model.scores([docs[5][1]])[0])
    kept = {r.doc_id for r in toxicity.drop_toxic(d, l, score).collect()}
    assert 5 not in kept and kept == {i for (i, _), s in zip(docs, model.scores([t for _, t in docs]), strict=True) if s < score}

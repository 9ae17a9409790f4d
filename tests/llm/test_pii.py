import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from arcweave.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 16 <= len(d) <= 19 and pii.luhn(d) or kind == "phone" and 8 <= len(d) <= 15
            if ok:
                out.append((kind, *m.span()))
    return out


def random_texts(n, seed=4):
    rng = random.Random(seed)
    parts = ["@", ".", "a", "b1", "+", "-", " ", "(", ")", "1", "22", "4111111111111111", "255", "256", "é", "%", "_", "\n", "0", "10.0.0.1", "x@y.z", "+1 (555) 123-4567"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(n)]


def test_patterns_agree_with_the_plain_ones():
    for t in random_texts(30_000):
        assert pii.exact(t) == brute(t), t


def test_patterns_are_linear():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "1 " * 150_000):
        pii.exact(t)


def test_viterbi_and_likelihood_by_enumeration():
    rng = np.random.default_rng(1)
    m = len(pii.LABELS)
    field = pii.Field({"x": 0, "y": 1, "z": 2}, rng.normal(size=(3, m)), rng.normal(size=(m, m)) + pii._ALLOWED)
    sequences = [[["x"], ["y", "z"], ["q"], ["z"]], [["z"]], [], [["y"], ["x"]]]
    for s, got in zip(sequences, field.decode(sequences), strict=True):
        e = field._scores(s)
        value = lambda labels: sum(e[i, b] for i, b in enumerate(labels)) + sum(field.move[a, b] for a, b in itertools.pairwise(labels)) + (pii._START[labels[0]] if labels else 0)  # noqa: B023, E731
        best = max(itertools.product(range(m), repeat=len(s)), key=value)
        assert got.tolist() == list(best)


def test_field_on_a_table_it_has_not_seen():
    field, hit, all_, extra = pii.default_field(), 0, 0, 0
    for text, spans in pii.labelled_table(200, 77):
        base = pii.exact(text)
        got = {*base, *pii.added([text], [base], field)[0]}
        hit += sum(s in got for s in spans)
        all_ += len(spans)
        extra += sum(s not in spans for s in got - set(base))
    assert hit >= 0.93 * all_ and extra <= 0.03 * all_


def test_stretches_hold_every_place_that_a_span_needs():
    rng = random.Random(3)
    parts = ["at", "At", "arroba", "dot", "punto", ".", " ", " ", "[", "]", "(", ")", "-", "host", "com", "noon", "a", "é", "@", "7", "\n", "x" * 70]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        stretches = pii._stretches(text)
        places = [m.start() for m in pii._AT.finditer(text)] + [m.start() for m in re.finditer("[0-9]", text)]
        assert all(any(a <= p < b for a, b in stretches) for p in places), text
        assert all(a < b for a, b in stretches) and all(x[1] < y[0] for x, y in itertools.pairwise(stretches))
    # And what passes a kind's check has such a place.
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        if any(pii._valid(kind, text) for kind in pii.KINDS):
            assert pii._stretches(text), text


@pytest.mark.parametrize("text", ["mail john at example.com now", "jo [at] mail.example.org", "ann(at)host.de"])
def test_spelled_at_with_a_plain_dot(text):
    ((kind, a, b),) = pii.added([text], [pii.exact(text)], pii.default_field())[0]
    assert kind == "email" and text[b - 1] in "gem" and "at" in text[a:b]


@pytest.mark.parametrize("text", ["version 3.0 of 2019-01-02 at 12:30:45", "meet me at noon dot dot", "", 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', "1234567890123456"])
def test_clean_texts_stay(text):
    assert pii.added([text], [pii.exact(text)], pii.default_field()) == [[]]


def test_rows_and_masks(spark):
    rows = [(1, "mail a@b.cd or +1 (017) 555-7713"), (None, None), (1, ""), (2, "jo at mail dot example dot com"), (3, "7 " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as base", "2 as kind")
    got = {(r.doc_id, len(r.base), len(r.added)) for r in pii.find(docs).collect()}
    assert got == {(1, 2, 0), (None, 0, 0), (1, 0, 0), (2, 0, 1), (3, 0, 0)}
    out = pii.redact(docs)
    assert out.schema == docs.schema
    assert sorted(str(r.text)[:30] for r in out.collect()) == sorted(["mail [EMAIL] or [PHONE]", "None", "", "[EMAIL]", ("7 " * 40)[:30]])
    assert pii.find(docs.limit(0)).count() == 0


def test_query_digests(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.cd 10.0.0.1 (017) 555-7713 a@b.cd")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    (r,) = pii.op9_pii(spark, str(tmp_path)).collect()
    base = "email:0:6,email:31:37,ip:7:15"
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) == (2, 1, 0, 0, hashlib.sha256(base.encode()).hexdigest(), base + ",phone:16:30")

import random

import numpy as np
import pyarrow as pa
import pytest

from arcweave.llm import words


def thue_morse(n):
    """A word and its complement, which a polynomial modulo 2**64 can't tell apart from 2048 letters on."""
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s[:n], s[:n].translate(str.maketrans("ab", "ba"))


def buffer(*texts):
    return words.text_buffer(pa.array(texts, pa.string()))


def test_products_modulo_the_prime():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, words.PRIME, (2, 2000), np.uint64)
    a[:3], b[:3] = words.PRIME - 1, [0, 1, words.PRIME - 1]
    assert words._mulmod(a, b).tolist() == [x * y % words.PRIME for x, y in zip(a.tolist(), b.tolist(), strict=True)]


@pytest.mark.parametrize("base", [0, 1])
def test_rolling_hash(base):
    values = np.random.default_rng(1).integers(0, 2**64 - 1, 70_000, np.uint64)
    got, b = words.rolling(values, 50, base), words._BASES[base]
    assert len(got) == 70_000 - 49 and len(words.rolling(values[:20], 50, base)) == 0
    for i in (0, 1, 65_535, 65_536, 65_537, 69_950):
        assert int(got[i]) == sum(int(v) * pow(b, j, words.PRIME) for j, v in enumerate(values[i : i + 50])) % words.PRIME


def test_words_as_split_has_them():
    rng = random.Random(2)
    texts = ["".join(rng.choice(" \t\n\x0b\x0c\r\x1f\xa0aé日") for _ in range(rng.randrange(40))) for _ in range(500)] + ["", None, "x" * 5000 + " " + "y" * 513]
    h, first = words.word_hashes(*buffer(*texts))
    every = [(t or "").encode().split() for t in texts]
    assert np.diff(first).tolist() == list(map(len, every))
    of = {}
    for w, x in zip((w for ws in every for w in ws), h.tolist(), strict=True):
        assert of.setdefault(w, x) == x
    assert len(set(of.values())) == len(of)


@pytest.mark.parametrize("n", [64, 256, 512, 2048, 4096])
def test_regular_words_differ(n):
    a, b = thue_morse(n)
    h, _ = words.word_hashes(*buffer(f"{a} {b} {a}"))
    assert h[0] != h[1] and h[0] == h[2]


def test_regular_windows_differ():
    a, b = thue_morse(64)
    h, _ = words.word_hashes(*buffer(" ".join(a), " ".join(b)))
    r = words.rolling(h, 64)
    assert r[0] != r[64]


def test_shingles():
    texts = ["a b c d e f", "a b c d e", "b c d e f", "", "a b", "a b", "b a", None]
    h, first = words.shingle_hashes(*buffer(*texts), 5)
    got = [h[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    assert list(map(len, got)) == [2, 1, 1, 0, 1, 1, 1, 0]
    assert got[0] == got[1] + got[2] and got[4] == got[5] != got[6]

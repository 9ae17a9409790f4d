import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from arcweave import cluster
from arcweave.llm import tokens, wavelet
from arcweave.llm.words import text_buffer
from test_words import thue_morse

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def spec():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    fixed = ["", " ", "  ", "a  b", "x\n y", "it's  'll  we'll\t\tx don'tx", "\x1c a \x85 b\xa0c", "<|endoftext|> a", "日本語 テスト　x", "a\n\n\n b", "a…!b é!\né\nb", "x\n\ny\nz \nq\n"]
    return fixed + ["".join(rng.choice(" \n\t.,!'sétl1²…日\xa0 \x85\x1cA😀-") for _ in range(rng.randrange(14))) for _ in range(n)]


def test_encoder_gives_the_library_s_ids(spec):
    import pyarrow as pa

    texts = odd_texts(4000) + [t for n in (16, 64, 256, 4096) for t in thue_morse(n)]
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    coder = tokens.Encoder(spec)
    for _ in range(2):  # the second time from memory
        flat, ends = coder.encode(*text_buffer(pa.array(texts)), 7)
        got = [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        assert got == [[*w, 7] for w in want]
    nulls = coder.encode(*text_buffer(pa.array([None, None, "a"], pa.string())))[1]
    assert nulls.tolist() == [0, 0, 0, 1]


@pytest.mark.parametrize("kinds", [1, 2, 3, 300, 70_000])
def test_rank_select_access(kinds):
    rng = np.random.default_rng(kinds)
    v = rng.integers(0, kinds, 3000).astype(np.uint32) * 3
    f = wavelet.TokenFile(wavelet.encode_file(np.arange(3), v, np.array([10, 10, 3000])))
    assert np.array_equal(f.tokens(), v) and f.ends.tolist() == [10, 10, 3000]
    for i in rng.integers(0, 3000, 40):
        assert f.token(int(i)) == v[i]
        t, j = int(v[i]), int(rng.integers(i, 3001))
        assert f.count(t, int(i), j) == int((v[i:j] == t).sum())
        assert f.occurrences(t, int(i), j) == (i + np.flatnonzero(v[i:j] == t)).tolist()
    assert f.count(1) == 0 and f.occurrences(10**6) == []


def test_round_trip(spark, spec, monkeypatch):
    monkeypatch.setattr(wavelet, "FILE_TOKENS", 400)
    texts = [*odd_texts(300, 4), None, "word " * 3000]
    rows = [(i * 7 % 311, t) for i, t in enumerate(texts)] + [(None, "null id"), (5, "same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "'x' as _bucket")
    files = wavelet.write_files(docs, spec, cluster.new_folder(spark, "test"))
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in wavelet.read_documents(files).collect()), key=lambda r: r[0])
    assert [r[1] is None for r in got[:2]] == [True, False] and [r[1] for r in got[1:]] == sorted(r[0] for r in rows if r[0] is not None)
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows]
    want = sorted((r[0] or -1, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, i in zip(rows, ids, strict=True))
    assert sorted((r[1] or -1, r[2], r[3]) for r in got) == want
    assert [r[0] for r in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
    assert wavelet.occurrences(files, 0).count() == sum(i.count(0) for i in ids)
    assert wavelet.read_documents(wavelet.write_files(docs.limit(0), spec, cluster.new_folder(spark, "test"))).count() == 0

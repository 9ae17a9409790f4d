import hashlib
import random
import struct

import zstandard

from arcweave import cluster
from arcweave.llm import warc


def pages(n=120):
    rng = random.Random(3)
    bodies = ["<p>" + " ".join(rng.choice(["é", "word", "日本"]) for _ in range(rng.randrange(10, 600))) + "</p>" for _ in range(40)] + ["", "x" * 999, "y" * 1000, "line\r\n\r\nWARC/1.1\r\n\r\n" * 60]
    rows = [(i, f"http://h/{i}\nx é" if i % 5 else None, rng.choice(bodies)) for i in range(n)]
    return [*rows, (None, "u", "y" * 1000), (500, "u", None), (501, "u", "y" * 1000), (501, "u", "y" * 1000), (7, "again", "z" * 2000)]


def test_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as refers_to", "'k' as _key")
    index = warc.write_archives(df, cluster.new_folder(spark, "test"), frame_bytes=4000, file_bytes=20_000)
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        last = max((q for q, _, g in rows if q is not None and (g or "") == (h or "")), default=None)
        again = len(b) >= 1000 and p is not None and p < last
        want.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last if again else None))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, warc.read_archives(index).collect()), key=key) == sorted(want, key=key)
    for r in index.collect()[::9]:
        headers, payload = warc.read_record(r.file, r.frame, r.offset, r.length)
        assert headers["warc-record-id"] == r.record_id and headers["x-page-id"] == ("" if r.page_id is None else str(r.page_id))
        if headers["warc-type"] == "response":
            assert hashlib.sha1(payload).hexdigest() == headers["warc-payload-digest"][5:]
    assert len({r.file for r in index.collect()}) > 1
    assert warc.read_archives(warc.write_archives(df.limit(0), cluster.new_folder(spark, "test"))).count() == 0


def test_any_zstd_reader_reads_a_bundle():
    bundle = warc.Bundle(100)
    raw = [warc.record(i, "u", b"p" * i, None) for i in range(5)]
    for r in raw:
        bundle.add(r)
    content = bundle.done()
    assert b"".join(warc.frames_of(content)) == b"".join(raw)
    assert zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read() == b"".join(raw)
    assert struct.unpack("<I", content[-4:])[0] == 0x8F92EAB1

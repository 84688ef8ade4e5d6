import base64
import hashlib
import io
import random

import zstandard
from pyspark.sql import functions as F

from waybridge.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("target", F.lit(3))


def sample():
    rng = random.Random(9)
    rows = [(i, f"http://h{i % 3}.example/{i}", "".join(rng.choice("abc <p>é\r\n") for _ in range(rng.randint(0, 4000)))) for i in range(120)]
    rows += [(200 + i, "http://copy.example/", "same page") for i in range(30)]
    return rows + [(300, None, None), (301, "u\r\nWARC-Type: evil", ""), (302, "x", "\r\n\r\nWARC/1.1\r\n"), (303, "x", "z" * 3_000_000),
                   (None, "n", "no id"), (305, "r", "row twice"), (305, "r", "row twice")]


def test_round_trip(spark):
    rows = sample()
    got = warc.records(warc.bundles(pages(spark, rows))).collect()
    assert len(got) == len(rows)
    copies = {}
    for i, _, h in rows:
        copies.setdefault(h or "", []).append(i)
    have = sorted(got, key=lambda r: (r.page_id is None, r.page_id or 0))
    for r, (i, url, h) in zip(have, sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))):
        data, top = (h or "").encode(), max((x for x in copies[h or ""] if x is not None), default=None)
        assert (r.page_id, r.payload_bytes) == (i, len(data))
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if i == top else ("revisit", top))
        assert r.payload is None if i != top else bytes(r.payload) == data
        assert r.url == (url.replace("\r", "%0D").replace("\n", "%0A") if url else None)


def test_a_bundle_is_a_seekable_file_and_records_open_one_frame(spark):
    frames = warc.bundles(pages(spark, sample()).coalesce(1))
    rows = frames.where("bundle = 0").orderBy("frame").collect()
    file = b"".join(bytes(r.data) for r in rows)
    places = warc.frame_places(bytes(rows[-1].data))
    assert len(places) == len(rows) - 1 > 1
    plain = b"".join(zstandard.ZstdDecompressor().decompress(file[a:a + n], max_output_size=m) for a, n, m in places)
    # any reader of the plain format sees the same bytes, the seek table being skipped
    reader = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(file), read_across_frames=True)
    assert reader.read() == plain and plain.count(b"WARC-Record-ID: <urn:page:") == len(sample())
    got = warc.fetch(frames, spark.createDataFrame([(5,), (303,), (999,)], "page_id long")).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got)[-1] == (303, 3_000_000) and len(got) == 2


def test_short_payloads_may_all_be_responses(spark):
    got = warc.records(warc.bundles(pages(spark, [(1, "a", "xy"), (2, "a", "xy"), (3, "a", "long one"), (4, "a", "long one")]), least_bytes=3))
    assert [r.record_type for r in got.orderBy("page_id").collect()] == ["response", "response", "revisit", "response"]
    assert warc.records(warc.bundles(pages(spark, []))).count() == 0

"""WARC records in seekable Zstandard bundles.

Records are grouped into frames of some hundred kilobytes, each an independent Zstandard frame; behind the last
frame of a bundle stands a seek table (a skippable frame with the sizes of all frames), and every frame
carries the identifiers of its records with their offsets inside the frame. A record is read by opening one
frame. Bundles are kept as rows (bundle, frame, data) in a table, so that Spark's writers and readers reach
them in any store; ``data`` of a bundle's rows in order is the bundle file byte for byte.

Of records with equal payloads the one with the largest page_id is stored, the others refer to it. Only
(page_id, digest) pairs are compared, counted per digest before the shuffle, so a crowd of copies moves no html.

Defined cases: a null html is an empty payload; null url leaves the target out; a null page_id is kept and
never referred to unless all copies lack one. A repeated row is written again, as the same kind. An empty table
gives no bundles. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from waybridge.llm.common import batched, per_batch, record_batch, stored

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 18, 1 << 26, 3
#: Fixed values of the seekable format and of the record profile.
SEEK_MAGIC, SKIPPABLE_MAGIC = 0x8F92EAB1, 0x184D2A5E
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FRAMES = pa.schema([
    ("bundle", pa.int64()), ("frame", pa.int64()), ("data", pa.binary()), ("plain_bytes", pa.int64()),
    ("record_ids", pa.list_(pa.int64())), ("record_offsets", pa.list_(pa.int64()))])
RECORDS = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hexadecimal: 10 hex digits are 8 base32 digits."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def marked(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages with payload digest and, for revisits, the page they refer to."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    keys = rows.where(F.octet_length("html") >= least_bytes).select("page_id", "digest").distinct()
    groups = keys.groupBy("digest").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = keys.join(groups, "digest").where("not page_id <=> target").select(
        F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "target")
    return rows.join(
        revisits, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left",
    ).select("page_id", "url", "html", base32(F.col("digest")).alias("digest"), "target")


def record(page_id, url, payload: bytes, digest: str, target, date: str) -> bytes:
    name = lambda i: "none" if i is None else str(i)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if target is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if target is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{name(page_id)}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if target is not None:
        head += [f"WARC-Refers-To: <urn:page:{target}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """Skippable frame with compressed and plain size of every frame, and its footer."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEK_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def frame_places(table: bytes) -> list[tuple[int, int, int]]:
    """(offset in the bundle, compressed size, plain size) of every frame, from the seek table."""
    n, flags, magic = struct.unpack("<IBI", table[-9:])
    if magic != SEEK_MAGIC or flags & 0x80:
        raise ValueError("not a seek table without checksums")
    places, at = [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", table, 8 + 8 * i)
        places.append((at, packed, plain))
        at += packed
    return places


def bundles(pages: DataFrame, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write all pages into bundles in the shared folder; rows are the frames, the last of each the seek table."""
    def write(batches):
        compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        task, number = TaskContext.get().partitionId() << 24, 0
        sizes, ids, offsets, parts, fill, packed_bytes, out = [], [], [], [], 0, 0, []

        def close_frame():
            nonlocal fill, packed_bytes
            plain = b"".join(parts)
            data = compressor.compress(plain)
            out.append((task + number, len(sizes), data, len(plain), list(ids), list(offsets)))
            sizes.append((len(data), len(plain)))
            packed_bytes += len(data)
            for kept in (ids, offsets, parts):
                kept.clear()
            fill = 0

        def close_bundle():
            nonlocal number, packed_bytes
            out.append((task + number, len(sizes), seek_table(sizes), 0, [], []))
            sizes.clear()
            number, packed_bytes = number + 1, 0

        def ready():
            batch = record_batch(FRAMES, dict(zip(FRAMES.names, zip(*out))))
            out.clear()
            return batch

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "target")]
            for page_id, url, html, digest, target in zip(*columns):
                data = record(page_id, url, html.encode(), digest, target, date)
                ids.append(page_id)
                offsets.append(fill)
                parts.append(data)
                fill += len(data)
                if fill >= FRAME_BYTES:
                    close_frame()
                    if packed_bytes >= BUNDLE_BYTES:
                        close_bundle()
                    yield ready()
        if parts:
            close_frame()
        if sizes:
            close_bundle()
        if out:
            yield ready()

    return stored(batched(marked(pages, least_bytes)).mapInArrow(
        write, "bundle long, frame long, data binary, plain_bytes long, record_ids array<long>, "
               "record_offsets array<long>"))


_FIELD = re.compile(rb"\r\n([A-Za-z-]+): ([^\r\n]*)")
_PAGE = re.compile(rb"<urn:page:(-?\d+|none)>")


def parse(plain: bytes, start: int) -> tuple:
    """One record at an offset of a plain frame; the payload's digest is checked."""
    cut = plain.index(b"\r\n\r\n", start)
    head = dict(_FIELD.findall(plain, start, cut))
    page = lambda name: None if (v := _PAGE.fullmatch(head[name])[1]) == b"none" else int(v)
    block = plain[cut + 4:cut + 4 + int(head[b"Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(_FIELD.findall(http))[b"Content-Length"])
    digest, kind = head[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode(), head[b"WARC-Type"].decode()
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"record {head[b'WARC-Record-ID']!r} is damaged")
    url = head.get(b"WARC-Target-URI")
    return (page(b"WARC-Record-ID"), None if url is None else url.decode(), size, digest, kind,
            page(b"WARC-Refers-To") if kind == "revisit" else None, payload if kind == "response" else None)


def places(frames: DataFrame) -> DataFrame:
    """(bundle, frame, packed, plain): sizes of all frames, as the bundles' seek tables have them."""
    schema = pa.schema([("bundle", pa.int64()), ("frame", pa.int64()), ("packed", pa.int64()), ("plain", pa.int64())])

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(bundle, k, packed, plain) for bundle, data in zip(*(batch.column(c).to_pylist() for c in ("bundle", "data")))
                for k, (_, packed, plain) in enumerate(frame_places(data))]
        return record_batch(schema, dict(zip(schema.names, zip(*rows))))

    tables = frames.where(F.size("record_offsets") == 0).select("bundle", "data")
    return batched(tables).mapInArrow(per_batch(read), "bundle long, frame long, packed long, plain long")


def _opened(frames: DataFrame, sizes: DataFrame, payloads: bool) -> DataFrame:
    """Records at ``record_offsets`` of frames, which are opened by their place in the seek table."""
    def read(batches):
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            for data, packed, size, offsets in zip(*(batch.column(c).to_pylist() for c in ("data", "packed", "plain", "record_offsets"))):
                if len(data) != packed:
                    raise ValueError("a frame is not as long as its seek table says")
                plain = opener.decompress(data, max_output_size=size)
                if len(plain) != size:
                    raise ValueError("a frame's content is not as long as its seek table says")
                rows = [parse(plain, at) for at in offsets]
                if not payloads:
                    rows = [(*r[:-1], None) for r in rows]
                yield record_batch(RECORDS, dict(zip(RECORDS.names, zip(*rows))))

    # frames are large, so only a few travel at a time
    rows = frames.select("bundle", "frame", "data", "record_offsets").join(sizes, ["bundle", "frame"]).drop("bundle", "frame")
    return batched(rows).mapInArrow(
        read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
              "refers_to long, payload binary")


def records(frames: DataFrame, payloads: bool = True) -> DataFrame:
    """Read all records back: frames by the seek tables, records by the offsets of the identifier map."""
    return _opened(frames.where(F.size("record_offsets") > 0), places(frames), payloads)


def fetch(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records of the page ids in ``wanted``: only frames that hold one are opened, only at its offset."""
    ids = wanted.select(F.col("page_id").cast("long").alias("_id")).distinct()
    held = frames.select("bundle", "frame", F.explode(F.arrays_zip("record_ids", "record_offsets")).alias("r"))
    hits = held.join(ids, F.col("r.record_ids") == F.col("_id")).groupBy("bundle", "frame").agg(
        F.sort_array(F.collect_list("r.record_offsets")).alias("record_offsets"))
    return _opened(frames.drop("record_ids", "record_offsets").join(hits, ["bundle", "frame"]), places(frames), True)

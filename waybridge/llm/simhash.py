"""SimHash near duplicates through deletion variants.

A fingerprint of 64 bits is cut into ``SEGMENTS`` = 2 halves, one fewer than three, which would leave one half equal: of
fingerprints that differ in at most two bits, some half differs in at most one. Each half is indexed as it is
and in 32 variants with one bit deleted, 66 rows per different fingerprint. Fingerprints that meet under a variant and
hold different values of the deleted bit differ there once, those that meet under a whole half not at all; the
other half is then compared. One shuffle on the variant brings them together, sorted inside partitions.

Copies fall together before, as one fingerprint. Crowds of near copies do not: a half that more than ``CROWD``
fingerprints share is found by counting halves, and its variants get a finer key that also
deletes, from the other half, as many bits as may still differ there. Under such a key at most four fingerprints meet,
and all of them link, so a crowd costs in proportion to its size. Which variants are crowded travels as a
bitmap of fixed size; a variant marked by chance is searched through the finer keys too, with the same links.
From each meeting leave only as many links as tie its fingerprints together.

Defined cases: a null or empty text has fingerprint zero and links like any other. Repeated rows are copies. A null
doc_id links like any other and never names a component that holds another. Rows with one doc_id and different
texts are separate rows. An empty table gives no rows. Texts are read in runs of bounded length, to their end. Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from waybridge.llm.common import attached, batched, discard, mix, per_batch, stored
from waybridge.llm.components import components

SHINGLE, SEED, BITS, SEGMENTS = 3, 42, 2, 2
#: Fingerprints that share a half, above which its variants get finer keys.
CROWD = 512
#: Bits of the bitmap of crowded variants; bounds what is broadcast.
SLOTS = 1 << 22
#: Bytes of a text that are split into words at once.
RUN = 1 << 20
_HALF = 32
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _word_runs(data: bytes, shingle: int):
    """Words of a text in runs; each run begins with the words that shingles of the last one still need."""
    at, carry = 0, []
    while at < len(data):
        end = len(data)
        if at + RUN < end and (gap := _SPACE.search(data, at + RUN)):
            end = gap.start()
        words = carry + data[at:end].split()
        yield words
        carry, at = words[max(len(words) - shingle + 1, 0):], end


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The majority bits of the hashes of all word shingles, as a signed 64-bit number."""
    digest, total, ones, few = xxhash.xxh64_intdigest, 0, np.zeros(64, np.int64), []
    for words in _word_runs(data.translate(_LOWER), shingle):
        few = words
        if len(words) < shingle:
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1:].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    if not total:
        if not few:
            return 0
        return int(np.uint64(digest(b" ".join(few), SEED)).astype(np.int64))
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(t or b"", shingle) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return batched(rows).mapInArrow(per_batch(run), "doc_id long, fp long")


def _slots(keys: np.ndarray) -> np.ndarray:
    return (mix(keys) >> np.uint64(42)).astype(np.int64) & (SLOTS - 1)


def _variant_keys(half: np.ndarray, segment: int) -> np.ndarray:
    """Keys of a half: column j with bit j deleted, the last one whole."""
    masks = np.array([0xFFFFFFFF ^ (1 << j) for j in range(_HALF)] + [0xFFFFFFFF], np.uint64)
    tags = (np.arange(_HALF + 1, dtype=np.uint64) + np.uint64(segment * 64)) << np.uint64(_HALF)
    return (half[:, None] & masks) | tags


def _halves(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    fp = fp.view(np.uint64)
    return fp & np.uint64(0xFFFFFFFF), fp >> np.uint64(_HALF)


def crowded(different: DataFrame, crowd: int = CROWD) -> np.ndarray:
    """Bitmap of the variants of halves that more than ``crowd`` fingerprints share."""
    halves = different.select(F.explode(F.array(
        F.struct(F.lit(0).alias("segment"), F.col("fp").bitwiseAND(0xFFFFFFFF).alias("half")),
        F.struct(F.lit(1).alias("segment"), F.shiftrightunsigned("fp", _HALF).alias("half")))).alias("h"))
    many = halves.groupBy("h.segment", "h.half").count().where(F.col("count") > crowd).select("segment", "half")

    def slots(batch: pa.RecordBatch) -> pa.RecordBatch:
        half, segment = batch.column("half").to_numpy().astype(np.uint64), batch.column("segment").to_numpy()
        keys = [_variant_keys(half[segment == s], s).ravel() for s in range(SEGMENTS)]
        return pa.RecordBatch.from_arrays([pa.array(np.unique(_slots(np.concatenate(keys))))], names=["slot"])

    # at most one row per slot comes back
    rows = batched(many).mapInArrow(per_batch(slots), "slot long").distinct().toArrow()
    marks = np.zeros(SLOTS, bool)
    marks[rows["slot"].to_numpy()] = True
    return np.packbits(marks, bitorder="little")


def _marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _slots(keys)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def index_keys(fp: np.ndarray, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place of its fingerprint) for all variants; crowded ones through finer keys."""
    halves, keys, places = _halves(fp), [], []
    single = np.array([0xFFFFFFFF ^ (1 << j) for j in range(_HALF)], np.uint64)
    double = np.array([0xFFFFFFFF ^ (1 << j) ^ (1 << i) for j in range(_HALF) for i in range(j)], np.uint64)
    for segment in range(SEGMENTS):
        other = halves[1 - segment]
        variants = _variant_keys(halves[segment], segment)
        heavy = _marked(bitmap, variants.ravel()).reshape(variants.shape)
        at, column = np.nonzero(~heavy)
        keys.append(mix(variants[at, column]))
        places.append(at)
        for whole, masks in ((False, single), (True, double)):
            # a deleted bit leaves one bit of the other half to differ, a whole half two
            part = np.zeros_like(heavy)
            columns = slice(_HALF, None) if whole else slice(0, _HALF)
            part[:, columns] = heavy[:, columns]
            at, column = np.nonzero(part)
            if len(at):
                rest = (other[at][:, None] & masks) ^ (np.arange(1, len(masks) + 1, dtype=np.uint64) << np.uint64(_HALF))
                keys.append(mix(mix(variants[at, column])[:, None] * np.uint64(3) + mix(rest)).ravel())
                places.append(np.repeat(at, len(masks)))
    return np.concatenate(keys), np.concatenate(places)


def tied(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links between fingerprints of one meeting that tie together what differs in at most ``BITS`` bits."""
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= BITS
    label, links, n = np.arange(len(fp)), [], len(fp)
    while True:
        # the least label around; whatever takes a new one is linked to where it came from
        best = np.where(near, label[None, :], n)
        to = best.argmin(axis=1)
        new = best[np.arange(n), to]
        moved = np.flatnonzero(new < label)
        if not len(moved):
            return [(int(a), int(b)) for a, b in dict.fromkeys(links)]
        signed = fp.view(np.int64)
        links += [(signed[a], signed[b]) for a, b in zip(moved.tolist(), to[moved].tolist())]
        label = new


def _links(rows: DataFrame) -> DataFrame:
    """Links (a, b) of fingerprints that meet under a key; rows (key, fp) of a key follow one another in a partition."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def found(keys: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.concatenate([cut, [len(keys)]]))
        two = cut[size == 2]
        ok = np.bitwise_count(fp[two] ^ fp[two + 1]) <= BITS
        signed = fp.view(np.int64)
        a, b = [signed[two[ok]]], [signed[two[ok] + 1]]
        for at, n in zip(cut[size > 2].tolist(), size[size > 2].tolist()):
            if links := tied(np.unique(fp[at:at + n])):
                a.append(np.array([x for x, _ in links], np.int64))
                b.append(np.array([y for _, y in links], np.int64))
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema) if len(a) else None

    def run(batches):
        held = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        for batch in batches:
            keys = np.concatenate([held[0], batch.column("key").to_numpy()])
            fp = np.concatenate([held[1], batch.column("fp").to_numpy().view(np.uint64)])
            # the last key may go on in the next batch
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            held = (keys[last:], fp[last:])
            if last and (out := found(keys[:last], fp[:last])) is not None:
                yield out
        if len(held[0]) > 1 and (out := found(*held)) is not None:
            yield out

    return rows.mapInArrow(run, "a long, b long").distinct()


def links(different: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links that tie together all of ``different`` (fp) that chains of near fingerprints lead to."""
    spark = different.sparkSession
    bitmap = spark.sparkContext.broadcast(crowded(different, crowd))

    def index(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column("fp").to_numpy()
        keys, places = index_keys(fp, bitmap.value)
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(fp[places])], names=["key", "fp"])

    rows = batched(different.select("fp")).mapInArrow(per_batch(index), "key long, fp long")
    return _links(rows.repartition("key").sortWithinPartitions("key"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    rows = stored(fingerprints(docs, shingle))
    different = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    found = stored(links(different, crowd))
    nodes = components(found)
    discard(found)
    grouped = stored(different.join(nodes, F.col("fp") == F.col("node"), "left").select(
        "fp", "n", "least", F.coalesce("component", "fp").alias("component")))
    names = stored(grouped.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
    named = stored(attached(grouped.withColumnRenamed("n", "copies"), names, ["component"]).select(
        "fp", F.col("copies").alias("n"), "component_id"))
    return attached(rows, named, ["fp"]).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

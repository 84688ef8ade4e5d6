"""Benchmark decontamination by winnowing.

Words are hashed; of the hashes of ``K`` words in a row the least of every ``WINDOW`` in a row is a
fingerprint, so any span of K + WINDOW - 1 words that two texts share gives both the same fingerprint. Document
fingerprints that pass a fixed-size bitmap of the benchmark's are joined with the benchmark's on the hash, and
every hit is extended word by word to both sides as far as a full span needs; only spans that
reach it count. Items shorter than the span are one window each: for each such length all runs of that many words
are fingerprints, so they are found exactly too.

Words travel as 64-bit hashes. Equal contexts of items are joined once and named afterwards. A fingerprint
that a third of all documents hold is spread over the join, since hits are joined to few distinct contexts.

Defined cases: null or empty texts have no words and no hits; items without words match nothing. Repeated rows of documents
are each reported; repeated items count once per item_id. An empty benchmark marks nothing; an empty
table gives no rows. Other columns are passed through by ``clean`` and not read otherwise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from waybridge.llm.common import batched, mix, per_batch, stored

#: A window has SPAN words; fingerprints are least hashes of WINDOW runs of K words.
SPAN, K = 10, 5
WINDOW = SPAN - K + 1
#: Words kept to each side of a fingerprint: a span that holds it reaches no further.
SIDE = SPAN - K
#: Bits of the benchmark's bitmap. Its size bounds what is sent to every task.
BITMAP_BITS = 1 << 24
#: Bytes that are no part of a word become a space, capital letters small ones.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column of texts, and where each text's words begin."""
    plain = pa.array([b.translate(_TABLE) for b in column.fill_null("").cast(pa.binary()).to_pylist()], pa.binary()).cast(pa.string())
    split = pc.split_pattern(plain, " ")
    coded = split.flatten().dictionary_encode()
    at = coded.indices.to_numpy()
    owner = np.repeat(np.arange(len(column)), np.diff(split.offsets.to_numpy()))
    values = coded.dictionary.to_numpy(zero_copy_only=False)
    if not len(values):
        return np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    # zero is what stands beyond the ends of a text
    hashed = np.maximum(mix(pd.util.hash_array(values, categorize=False)), np.uint64(1))
    real = (pc.binary_length(coded.dictionary).to_numpy() > 0)[at]
    at, owner = at[real], owner[real]
    return hashed[at], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(column)))])


def _runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that begin at each place (the last k - 1 places are left out)."""
    n = max(len(hashes) - k + 1, 0)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(3) + hashes[j:j + n])
    return out


def fingerprints(hashes: np.ndarray, starts: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the runs of k words that are the last least one of a window inside their text."""
    runs = _runs(hashes, k)
    if not len(runs):
        return np.zeros(0, np.int64), runs
    end = np.repeat(starts[1:], np.diff(starts))[:len(runs)]
    place = np.arange(len(runs))
    n = len(runs) - window + 1
    chosen = np.zeros(len(runs), bool)
    if n > 0:
        least, at = runs[:n].copy(), np.zeros(n, np.int64)
        for j in range(1, window):
            lower = runs[j:j + n] <= least
            least = np.where(lower, runs[j:j + n], least)
            at[lower] = j
        inside = place[:n] + window + k - 1 <= end[:n]
        chosen[(place[:n] + at)[inside]] = True
    places = np.flatnonzero(chosen)
    return places, runs[places]


def _contexts(hashes: np.ndarray, starts: np.ndarray, places: np.ndarray, k: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Words to the left (nearest first) and right of runs of k words; zero beyond the text."""
    row = np.searchsorted(starts, places, side="right") - 1
    reach = np.arange(side)
    left, right = places[:, None] - 1 - reach, places[:, None] + k + reach
    near = lambda at, ok: np.where(ok, hashes[np.clip(at, 0, max(len(hashes) - 1, 0))], np.uint64(0))
    return near(left, left >= starts[row][:, None]), near(right, right < starts[row + 1][:, None])


_MARK = "array<struct<k:int,h:bigint,place:bigint,around:array<bigint>>>"


def _marks(hashes: np.ndarray, starts: np.ndarray, sizes: list[int], bitmap: np.ndarray | None) -> list[list[dict]]:
    """Fingerprints of every text for the long windows and for each size of short ones."""
    n = len(starts) - 1
    out: list[list[dict]] = [[] for _ in range(n)]
    for k in [0, *sizes]:
        length, window, side = (k, 1, 0) if k else (K, WINDOW, SIDE)
        places, h = fingerprints(hashes, starts, length, window)
        if bitmap is not None:
            slot = h % np.uint64(BITMAP_BITS)
            some = (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
            places, h = places[some], h[some]
        left, right = _contexts(hashes, starts, places, length, side)
        around = np.concatenate([left, right], axis=1).view(np.int64).tolist()
        row = np.searchsorted(starts, places, side="right") - 1
        for r, p, x, a in zip(row.tolist(), (places - starts[row]).tolist(), h.view(np.int64).tolist(), around):
            out[r].append({"k": k, "h": x, "place": p, "around": a})
    return out


_MARK_TYPE = pa.list_(pa.struct([("k", pa.int32()), ("h", pa.int64()), ("place", pa.int64()), ("around", pa.list_(pa.int64()))]))


def _item_marks(items: DataFrame) -> DataFrame:
    """(k, h, around, item_id): fingerprints of items; short items are one run of all their words."""
    schema = pa.schema([("item_id", pa.int64()), ("marks", _MARK_TYPE)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, starts = words(batch.column("text"))
        size = np.diff(starts)
        marks = _marks(hashes, starts, [], None)
        for k in sorted(set(size[(size > 0) & (size < SPAN)].tolist())):
            for r in np.flatnonzero(size == k):
                h = _runs(hashes[starts[r]:starts[r + 1]], k)
                marks[r] = [{"k": k, "h": int(h.view(np.int64)[0]), "place": 0, "around": []}]
        return pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(marks, _MARK_TYPE)], schema=schema)

    return batched(items.select(F.col("item_id").cast("long").alias("item_id"), "text")).mapInArrow(
        per_batch(run), f"item_id long, marks {_MARK}").select("item_id", F.inline("marks")).select(
        "k", "h", "around", "item_id").distinct()


def _bitmap(marks: DataFrame) -> np.ndarray:
    """Bits of the fingerprints' remainders: at most ``BITMAP_BITS`` / 64 rows come back, put together per 64 bits."""
    rows = marks.select(F.col("h").bitwiseAND(BITMAP_BITS - 1).alias("slot")).groupBy(
        F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(slot & 63))")).alias("bits")).toArrow()
    words_ = np.zeros(BITMAP_BITS // 64, np.int64)
    words_[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return words_.view(np.uint8)


def _reach(a: str, b: str, side: int, first: int) -> Column:
    """Equal words from the fingerprint outwards; the text's end (zero) stops."""
    out = F.lit(side)
    for j in range(side - 1, -1, -1):
        x, y = F.get(a, F.lit(first + j)), F.get(b, F.lit(first + j))
        out = F.when((x != y) | (x == 0), j).otherwise(out)
    return out


def hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: rows (row, doc_id, n_words), spans (row, doc_id, version, start, end) of hit words, and (row, item_id).

    ``version`` is a hash of the text: with doc_id it finds the row again.
    """
    item_marks = stored(_item_marks(items))
    sizes = sorted(r["k"] for r in item_marks.where("k > 0").select("k").distinct().collect())  # 1 to 9 at most
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(item_marks))
    schema = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("n_words", pa.int64()), ("marks", _MARK_TYPE)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, starts = words(batch.column("text"))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("version"), pa.array(np.diff(starts)), pa.array(_marks(hashes, starts, sizes, shared.value), _MARK_TYPE)],
            schema=schema)

    rows = stored(batched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")).mapInArrow(
        per_batch(run), f"doc_id long, version long, n_words long, marks {_MARK}").withColumn("row", F.monotonically_increasing_id()))
    contexts = item_marks.select("k", "h", F.col("around").alias("there")).distinct()
    found = rows.select("row", "doc_id", "version", F.inline("marks")).join(contexts, ["k", "h"])
    left, right = _reach("around", "there", SIDE, 0), _reach("around", "there", SIDE, SIDE)
    found = found.withColumn("left", F.when(F.col("k") > 0, 0).otherwise(left)).withColumn(
        "right", F.when(F.col("k") > 0, 0).otherwise(right)).where(
        (F.col("k") > 0) | (F.col("left") + F.col("right") + K >= SPAN))
    length = F.when(F.col("k") > 0, F.col("k")).otherwise(K)
    found = stored(found.select("row", "doc_id", "version", "k", "h", "there", (F.col("place") - F.col("left")).alias("start"),
                                (F.col("place") + length + F.col("right")).alias("end")))
    spans = found.select("row", "doc_id", "version", "start", "end").distinct()
    named = found.select("row", "k", "h", "there").distinct().join(
        item_marks.withColumnRenamed("around", "there"), ["k", "h", "there"]).select("row", "item_id").distinct()
    return rows.drop("marks"), spans, named


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: words, words inside an occurring window, and the items whose windows occur."""
    rows, spans, named = hits(docs, items)
    # spans in order; each adds what lies beyond the end reached so far
    ordered = F.sort_array(F.collect_list(F.struct("start", "end")))
    covered = F.aggregate(
        ordered, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["upto"]), F.lit(0))).alias("n"),
            F.greatest(a["upto"], s["end"]).alias("upto")))
    hit = spans.groupBy("row").agg(covered["n"].alias("n_hit"))
    held = named.groupBy("row").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.array_join(F.sort_array(F.collect_list(F.col("item_id").cast("string"))), ",").alias("items"))
    none = F.lit(0).cast("long")
    return rows.join(hit, "row", "left").join(held, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", none) > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` without a word inside an occurring window, columns unchanged."""
    _, spans, _ = hits(docs, items)
    marked = spans.select("version", "doc_id").distinct()
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_version"))
    return rows.join(
        marked, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_version") == F.col("version")), "left_anti").select("doc.*")

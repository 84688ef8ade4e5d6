"""Line dedup with DataFrame operations only.

Keys of long lines are hashed to 128 bits. The (hash, document, position) rows are range-partitioned on all
three and sorted with the largest document first, so a line that a third of all documents share is cut over
many ranges. Inside a range the sorted rows are streamed once: each new document of a hash is counted, the
first one is its keeper; ranges that share a hash exchange one row each. What comes back per document is its
keep bitmap, run-length compressed, and no text.

Defined cases: a null or empty text is one empty line. Documents are told apart by doc_id; a repeated row
counts once and gets the same result again; rows with one doc_id and different texts are judged by their own lines.
A null doc_id counts as the smallest. An empty table gives no rows. Other columns are not read, or are
passed through by ``deduplicated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from waybridge.llm.common import discard, stored

LEAST_CHARS, LEAST_DOCS = 40, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _places(docs: DataFrame, least_chars: int) -> DataFrame:
    """(h1, h2, doc_id, version, pos) of every line whose key is long enough."""
    keys = _lines(F.translate("text", _UPPER, _LOWER))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"),
        F.posexplode(keys).alias("pos", "line"),
    ).where(F.length("line") >= least_chars).withColumn("key", F.btrim("line", F.lit(_SPACE))).where(
        F.length("key") >= least_chars
    ).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "version", "pos")


def dropped_places(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, version, pos) of every line that loses its place."""
    hashed = ["h1", "h2"]
    # the cut is written, so all later steps see the same ranges
    found = stored(_places(docs, least_chars))
    places = stored(
        found
        .repartitionByRange("h1", "h2", F.col("doc_id").desc_nulls_last(), "pos")
        .withColumn("slice", F.spark_partition_id())
        .sortWithinPartitions("h1", "h2", F.col("doc_id").desc_nulls_last(), "pos"))
    discard(found)
    stream = Window.partitionBy("slice", *hashed).orderBy(F.col("doc_id").desc_nulls_last(), "pos")
    parts = (
        places.withColumn("new", F.row_number().over(stream) == 1)
        .withColumn("new", F.col("new") | ~F.lag("doc_id").over(stream).eqNullSafe(F.col("doc_id")))
        .groupBy("slice", *hashed).agg(
            F.count_if("new").alias("docs"), F.max("doc_id").alias("first"), F.min("doc_id").alias("last"),
            F.count_if(F.col("doc_id").isNull()).alias("nulls"))
        .withColumn("last", F.when(F.col("nulls") == 0, F.col("last"))))
    # one row per range that a hash touches; a document cut by a range's end is counted by both sides
    along = Window.partitionBy(*hashed).orderBy("slice")
    parts = parts.withColumn("before", F.lag("last").over(along)).withColumn("nth", F.row_number().over(along)).withColumn(
        "docs", F.col("docs") - F.when((F.col("nth") > 1) & F.col("before").eqNullSafe(F.col("first")), 1).otherwise(0))
    every = Window.partitionBy(*hashed)
    shared = (
        parts.withColumn("total", F.sum("docs").over(every)).withColumn("keeper", F.max("first").over(every))
        .where(F.col("total") >= least_docs).select("slice", *hashed, "keeper"))
    return places.join(shared, ["slice", *hashed]).where("not doc_id <=> keeper").select("doc_id", "version", "pos")


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Per document that loses lines: ``dropped`` and ``lost``, its bitmap as runs of dropped lines (start, length)."""
    lost = dropped_places(docs, least_chars, least_docs).groupBy("doc_id", "version").agg(
        F.sort_array(F.collect_set("pos")).alias("pos"))
    starts = F.filter("pos", lambda p, i: (i == 0) | (F.get("pos", i - 1) != p - 1))
    ends = F.filter("pos", lambda p, i: (i == F.size("pos") - 1) | (F.get("pos", i + 1) != p + 1))
    return lost.select(
        "doc_id", "version", F.size("pos").cast("long").alias("dropped"),
        F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")),
                    lambda r: F.struct(r["s"].alias("start"), (r["e"] - r["s"] + 1).alias("length"))).alias("lost"))


def _applied(docs: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """(doc, n_lines, dropped, kept) of every row: the row itself and its text without the dropped lines."""
    bitmaps = keep_bitmaps(docs, least_chars, least_docs)
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_version"))
    joined = rows.join(
        bitmaps, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_version") == F.col("version")), "left")
    text = F.col("doc.text")
    # the runs, unrolled into one sign per line; lines behind the last run have none and stay
    before = lambda i: F.coalesce(F.get("lost", i - 1)["start"] + F.get("lost", i - 1)["length"], F.lit(0))
    keep = F.flatten(F.transform("lost", lambda r, i: F.concat(
        F.array_repeat(F.lit(True), r["start"] - before(i)), F.array_repeat(F.lit(False), r["length"]))))
    lines = F.zip_with(_lines(text), keep, lambda line, sign: F.when(F.coalesce(sign, F.lit(True)), line))
    # joining leaves out nulls, which are the dropped lines
    return joined.select(
        "doc", F.size(_lines(text)).cast("long").alias("n_lines"), F.coalesce("dropped", F.lit(0).cast("long")).alias("dropped"),
        F.when(F.col("lost").isNull(), text).otherwise(F.array_join(lines, "\n")).alias("kept"))


def deduplicated(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` with shared lines taken out of ``text``, columns unchanged."""
    return _applied(docs, least_chars, least_docs).select(
        *[F.col("kept").alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])


def digests(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Lines of every document, how many it loses, and the digest of the text that stays."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _applied(rows, least_chars, least_docs).select(
        F.col("doc.doc_id").alias("doc_id"), "n_lines", F.col("dropped").alias("n_dropped"),
        F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
 placed AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
 keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM placed),
 shared AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key
   HAVING count(DISTINCT doc_id) >= 5),
 marked AS (SELECT k.doc_id, k.line, k.pos, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone
   FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

"""Folders of record files: records, files that cannot be used, signatures, and frozen sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waybridge.session import written

_BAD = "_corrupt_record"


def read_records(spark: SparkSession, path: str, schema: str, key: str = "batch_id", pattern: str = "*.json"
                 ) -> tuple[DataFrame, DataFrame]:
    """One record per file, in the folder and those below it: usable ones, and the files that are left out with the reason.

    Files that do not fit the pattern, such as those still being written, are not looked at. A file that is no record of
    the schema is ``unreadable``, one without a key ``unnamed``; of several files that name one key the last by name is
    used and the others are ``repeated``.
    """
    rows = (
        spark.read.schema(f"{schema}, {_BAD} string").option("multiLine", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BAD).option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
        .json(path).select("*", F.col("_metadata.file_path").alias("file")))
    named = F.coalesce(F.trim(F.col(key)), F.lit("")) != ""
    state = F.when(F.col(_BAD).isNotNull(), "unreadable").when(~named, "unnamed")
    # written, since the reader looks only at fields that a plan needs, and so would find fewer bad files in some
    judged = written(rows.withColumn("reason", state))
    last = judged.where("reason is null").groupBy(key).agg(F.max("file").alias("_last"))
    good = judged.where("reason is null").join(last, key)
    usable = good.where("file = _last").drop("_last", "reason", _BAD)
    left = judged.where("reason is not null").select("file", "reason").unionByName(
        good.where("file <> _last").select("file", F.lit("repeated").alias("reason")))
    return usable, left


def file_signatures(spark: SparkSession, path: str, pattern: str = "*.json", length: int = 16) -> DataFrame:
    """Name, size and content hash of every file in a folder and those below it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"),
                        F.left(F.sha2("content", 256), F.lit(length)).alias("signature"))


def frozen_state(found: DataFrame, stored: DataFrame, name: str = "file") -> DataFrame:
    """Every file of a frozen set against its stored signature: same, changed, missing or new."""
    a, b = found.alias("a"), stored.alias("b")
    state: Column = (F.when(F.col(f"a.{name}").isNull(), "missing").when(F.col(f"b.{name}").isNull(), "new")
                     .when(F.col("a.signature") == F.col("b.signature"), "same").otherwise("changed"))
    return a.join(b, F.col(f"a.{name}") == F.col(f"b.{name}"), "full").select(
        F.coalesce(f"a.{name}", f"b.{name}").alias(name), state.alias("state"))


def require_frozen(found: DataFrame, stored: DataFrame, name: str = "file") -> None:
    """Raise if a frozen set is empty or not what was stored."""
    counts = {r.state: r.n for r in frozen_state(found, stored, name).groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts or set(counts) - {"same"}:
        raise ValueError(f"the frozen set is not as stored: {counts}")

"""Batches of documents from JSON records or from wide tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waybridge import constants as C
from waybridge.functions.canonical import FIELD_TYPE, canonical_fields, short_hash

META_TYPE = ("map<string,struct<raw_text:string,value:string,page:int,region:string,method:string,"
             "confidence:double,status:string,note:string,bbox:array<double>>>")
DOC_SCHEMA = (f"batch_id string, doc_index int, doc_type string, doc_id string, title string, "
              f"fields map<string,{FIELD_TYPE}>, field_meta {META_TYPE}")


def read_batch_files(spark: SparkSession, path: str) -> DataFrame:
    """Directory of JSON files, one batch each: ``file, raw``; temporary files are skipped."""
    return (
        spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(path)
        .select(F.input_file_name().alias("file"), F.col("value").alias("raw"))
    )


def read_batch_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, one batch per line, which is the layout to use at scale."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("raw"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Content hash of every file, for frozen evaluation sets and upload checks."""
    return spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("file"),
        F.left(F.sha2("content", 256), F.lit(16)).alias("sha"),
    )


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _as_field(value: Column) -> Column:
    return F.struct(
        F.coalesce(_kind(value), F.lit("VOID")).alias("kind"),
        F.try_variant_get(value, "$", "string").alias("text"),
        F.try_variant_get(value, "$", "array<string>").alias("items"),
    )


def parse_batches(raw: DataFrame) -> DataFrame:
    """One row per readable record that names a batch; documents stay a VARIANT."""
    parsed = raw.withColumn("v", F.try_parse_json("raw"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    documents = F.try_variant_get("v", "$.documents", "array<variant>")
    is_object = lambda d: F.startswith(_kind(d), F.lit("OBJECT"))
    bad_fields = lambda d: (
        is_object(d) & F.try_variant_get(d, "$.fields", "variant").isNotNull()
        & ~F.startswith(_kind(F.try_variant_get(d, "$.fields", "variant")), F.lit("OBJECT"))
        & (_kind(F.try_variant_get(d, "$.fields", "variant")) != "VOID"))
    bad_type = lambda d: (
        is_object(d) & F.try_variant_get(d, "$.doc_type", "variant").isNotNull()
        & ~_kind(F.try_variant_get(d, "$.doc_type", "variant")).isin("STRING", "VOID"))
    problems = F.when(documents.isNull(), 1).otherwise(F.size(F.filter(
        F.coalesce(documents, F.array().cast("array<variant>")),
        lambda d: d.isNull() | ~is_object(d) | bad_fields(d) | bad_type(d))))
    return parsed.select(
        get("$.batch_id", "string").alias("batch_id"),
        get("$.batch_name", "string").alias("batch_name"),
        get("$.description", "string").alias("description"),
        get("$.ground_truth", "string").alias("ground_truth"),
        get("$.declared_composition", "map<string,int>").alias("declared"),
        problems.alias("structure_problems"),
        documents.alias("documents"),
    ).where("batch_id is not null and batch_id <> ''")


def explode_documents(batches: DataFrame) -> DataFrame:
    """Usable documents in order; non-objects are dropped, bad ``fields`` emptied."""
    docs = batches.select("batch_id", F.posexplode("documents").alias("doc_index", "d"))
    docs = docs.where(F.col("d").isNotNull() & F.startswith(_kind(F.col("d")), F.lit("OBJECT")))
    get = lambda path, kind: F.try_variant_get("d", path, kind)
    own = lambda name: get(f"$.fields.{name}", "variant")
    fields = F.transform_values(get("$.fields", "map<string,variant>"), lambda k, v: _as_field(v))
    return docs.select(
        "batch_id", "doc_index",
        F.coalesce(get("$.doc_type", "string"), F.lit("unknown")).alias("doc_type"),
        get("$.doc_id", "string").alias("doc_id"),
        get("$.title", "string").alias("title"),
        F.coalesce(fields, F.map_from_arrays(
            F.array().cast("array<string>"), F.array().cast(f"array<{FIELD_TYPE}>"))).alias("fields"),
        get("$.field_meta", META_TYPE).alias("field_meta"),
        # the compared fields by name as well: a check opens those it needs and nothing else is read
        F.struct(*[F.when(own(n).isNotNull(), _as_field(own(n))).alias(n) for n in C.COMPARED_FIELDS]).alias("known"),
    )


def docs_from_wide(wide: DataFrame, texts: list[str], lists: list[str] = ()) -> DataFrame:
    """Documents from a table with one column per field; null columns are absent fields.

    In ``known`` an absent field has its kind but no text. A struct behind a condition would have to be built with all
    others before a check can read its one field; plain ones fall away, and so do the columns behind them.
    """
    def value(name: str) -> Column:
        if name in lists:
            return F.struct(F.lit("ARRAY<STRING>").alias("kind"), F.to_json(name).alias("text"), F.col(name).alias("items"))
        return F.struct(F.lit("STRING").alias("kind"), F.col(name).cast("string").alias("text"),
                        F.lit(None).cast("array<string>").alias("items"))

    def entry(name: str) -> Column:
        return F.struct(F.lit(name).alias("key"), value(name).alias("value"))

    # plain projections, so that queries which need no fields never build them. Entries are read twice, for a column that is read
    # once would move below the lambda's filter, where Spark interprets it instead of compiling it
    rows = wide.select(
        "batch_id", "doc_index", "doc_type", "doc_id", F.array(*[entry(n) for n in [*texts, *lists]]).alias("_entries"),
        F.struct(*[value(n).alias(n) if n in (*texts, *lists)
                   else F.lit(None).cast(FIELD_TYPE).alias(n) for n in C.COMPARED_FIELDS]).alias("known"))
    entries = F.col("_entries")
    filled = F.when(F.size(entries) > 0, F.filter(entries, lambda e: e["value"]["text"].isNotNull())).otherwise(entries)
    return rows.select(
        "batch_id", "doc_index", "doc_type", "doc_id", F.lit(None).cast("string").alias("title"),
        F.map_from_entries(filled).alias("fields"), F.lit(None).cast(META_TYPE).alias("field_meta"), "known")


def doc_fields(docs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Long form: one row per document field, or per field that is among ``names``.

    Named fields are read from ``known`` where it holds them all, so that the others are never built. The outer form keeps the optimizer from copying the expression behind ``fields``
    into a filter below; documents without fields are dropped afterwards.
    """
    keys = ["batch_id", "doc_index", "doc_type", "doc_id"]
    if names is not None and "known" in docs.columns and set(names) <= set(C.COMPARED_FIELDS):
        entries = F.array(*[F.struct(F.lit(n).alias("field"), F.col("known")[n].alias("value")) for n in names])
        # a field of a kind that always has a text is absent without one
        rows = docs.select(*keys, F.inline_outer(F.filter(entries, lambda e: e["value"].isNotNull() & (
            e["value"]["text"].isNotNull() | ~e["value"]["kind"].isin("STRING", "ARRAY<STRING>")))), "field_meta")
    else:
        fields = F.col("fields") if names is None else F.map_filter("fields", lambda k, v: k.isin(*names))
        rows = docs.select(*keys, F.explode_outer(fields).alias("field", "value"), "field_meta")
    return rows.where("field is not null").select(
        "batch_id", "doc_index", "doc_type", "doc_id", "field", F.col("value.kind").alias("kind"),
        F.col("value.text").alias("text"), F.col("value.items").alias("items"),
        F.try_element_at("field_meta", F.col("field"))["status"].alias("status"))


def content_versions(docs: DataFrame) -> DataFrame:
    """Content version per document: type, id and fields, whatever their order."""
    return docs.select("batch_id", "doc_index", short_hash(F.concat_ws(
        "|", F.coalesce("doc_type", F.lit("")), F.coalesce("doc_id", F.lit("")),
        canonical_fields(F.col("fields")))).alias("doc_version"))


def batch_versions(docs: DataFrame, piece: int = 4096) -> DataFrame:
    """Content version per batch: a hash of its documents' versions in order.

    Versions are hashed in pieces of ``piece`` documents first, then the pieces' hashes, so a batch of any size
    holds a bounded list per task. The number of documents and the order both count.
    """
    ordered = lambda key, value: F.concat_ws(",", F.transform(
        F.sort_array(F.collect_list(F.struct(key, value))), lambda x: x[value]))
    pieces = content_versions(docs).withColumn("piece", F.floor(F.col("doc_index") / piece)).groupBy("batch_id", "piece").agg(
        F.count(F.lit(1)).alias("n"), F.sha2(ordered("doc_index", "doc_version"), 256).alias("hash"))
    return pieces.groupBy("batch_id").agg(F.sum("n").alias("n_docs"), ordered("piece", "hash").alias("hashes")).select(
        "batch_id", "n_docs", short_hash(F.concat_ws("|", "n_docs", "hashes")).alias("batch_version"))


def assemble_batch(extractions: DataFrame) -> DataFrame:
    """Documents from extraction results: failed files skipped, ids from file stem and page.

    ``extractions``: batch_id, file, page_no, doc_type, fields, field_meta, error, multi (more
    than one document came out of the file), upload_order (dense position of the file in its batch).
    """
    stem = F.left(F.regexp_replace("file", r"\.[^.]*$", ""), F.lit(24))
    doc_id = F.concat(F.lit("PDF-"), stem, F.when(F.col("multi"), F.concat(F.lit("-P"), "page_no"))
                      .otherwise(F.lit("")))
    return extractions.where("error is null").select(
        "batch_id", F.col("upload_order").alias("doc_index"), "doc_type", doc_id.alias("doc_id"),
        F.lit(None).cast("string").alias("title"), "fields", "field_meta")

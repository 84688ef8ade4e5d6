"""From pages to documents: page type, page identity, grouping and regrouping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from waybridge import constants as C
from waybridge.functions.text import remove_spaces
from waybridge.operators.extract import captured
from waybridge.operators.ordered import PIECE

SMGS_SCORE = 6
MANY_GROUPS = 10


def type_scores(text: Column, file: Column) -> Column:
    """Array of (score, doc_type) in declared order; white space and case do not matter."""
    squashed = F.upper(remove_spaces(F.coalesce(text, F.lit(""))))
    name = F.upper(F.coalesce(file, F.lit("")))

    def score(words: list[str]) -> Column:
        hits = [F.contains(squashed, F.lit("".join(w.split()).upper())).cast("int") * 2
                + F.contains(name, F.lit(w.upper())).cast("int") for w in words]
        return reduce(lambda a, b: a + b, hits)

    general = [t for t in C.TYPE_KEYWORDS if t != "smgs_rail_waybill"]
    return F.array(*[
        F.struct(score(C.TYPE_KEYWORDS[t]).alias("score"), F.lit(-i).alias("rank"), F.lit(t).alias("doc_type"))
        for i, t in enumerate(general)])


def classify(text: Column, file: Column) -> Column:
    """Struct ``doc_type, score``: SMGS wording first, else the best keyword score, else unknown."""
    squashed = F.upper(remove_spaces(F.coalesce(text, F.lit(""))))
    smgs = reduce(lambda a, b: a | b, [
        F.contains(squashed, F.lit("".join(w.split()).upper())) for w in C.TYPE_KEYWORDS["smgs_rail_waybill"]])
    best = F.array_max(type_scores(text, file))
    return (
        F.when(smgs, F.struct(F.lit("smgs_rail_waybill").alias("doc_type"), F.lit(SMGS_SCORE).alias("score")))
        .when(best["score"] > 0, F.struct(best["doc_type"].alias("doc_type"), best["score"].alias("score")))
        .otherwise(F.struct(F.lit(C.UNKNOWN).alias("doc_type"), F.lit(0).alias("score"))))


def page_identity(text: Column, doc_type: Column) -> Column:
    """Document number on a page, read only from the captions of the page's own type."""
    out = F.lit(None).cast("string")
    for kind, name in C.IDENTITY_FIELDS.items():
        captions = C.CAPTIONS.get(kind, {}).get(name)
        if captions:
            out = F.when(doc_type == kind, captured(text, name, captions)).otherwise(out)
    return out


def with_page_facts(pages: DataFrame) -> DataFrame:
    """Pages with their type and identity; the file name takes no part for single pages."""
    kind = classify(F.col("text"), F.lit(""))
    return pages.withColumn("doc_type", kind["doc_type"]).withColumn(
        "identity", page_identity(F.col("text"), F.col("doc_type")))


def group_pages(pages: DataFrame) -> DataFrame:
    """Number the documents inside a file: ``group_no`` for every page.

    A new document starts when the type changes, when a page is unknown, or when a
    page names another identity than the last one named in the same run of pages.
    Pages are shuffled once, by file and a piece of 4096 page numbers. A piece is read in
    order as if its first page went on with an unnamed document; one row per piece then
    tells what came before: whether that page starts a document after all, and whether the
    first name in its opening run differs from the last one before. So a file may be as
    long as it likes.
    """
    rows = pages.select("file", "page_no", "doc_type", "identity").withColumn("piece", F.floor(F.col("page_no") / PIECE))
    inside = Window.partitionBy("file", "piece").orderBy("page_no")
    differs = (F.lag("doc_type").over(inside) != F.col("doc_type")) | (F.col("doc_type") == C.UNKNOWN)
    rows = rows.withColumn("starts", (differs & (F.row_number().over(inside) > 1)).cast("int"))
    rows = rows.withColumn("run", F.sum("starts").over(inside))
    # runs follow one another, so the last name before a page is one of its run or there is none; a window per run would sort the piece anew
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("named_last", F.last(
        F.when(F.col("identity").isNotNull(), F.struct("run", "identity")), ignorenulls=True).over(before))
    renamed = F.coalesce((F.col("named_last.run") == F.col("run")) & (F.col("named_last.identity") != F.col("identity")), F.lit(False))
    rows = rows.withColumn("opens", F.greatest(F.col("starts"), renamed.cast("int")))
    rows = rows.withColumn("opened", F.sum("opens").over(inside)).drop("named_last")

    named = F.col("identity").isNotNull()
    pieces = rows.groupBy("file", "piece").agg(
        F.min_by("doc_type", "page_no").alias("first_type"), F.max_by("doc_type", "page_no").alias("last_type"),
        F.max("run").alias("runs"), F.max("opened").alias("opened_inside"),
        F.min(F.when(named & (F.col("run") == 0), F.struct("page_no", "identity"))).alias("head"),
        F.max(F.when(named, F.struct("run", "page_no", "identity"))).alias("tail"))
    by_piece = Window.partitionBy("file").orderBy("piece")
    before = F.lag("last_type").over(by_piece)
    pieces = pieces.withColumn(
        "starts_here", before.isNull() | (before != F.col("first_type")) | (F.col("first_type") == C.UNKNOWN))
    # the run that a piece ends with may reach back over several pieces
    pieces = pieces.withColumn("chain", F.sum((F.col("starts_here") | (F.col("runs") > 0)).cast("int")).over(by_piece))
    along = Window.partitionBy("file", "chain").orderBy("piece")
    pieces = pieces.withColumn("last_name", F.last(
        F.when(F.col("tail.run") == F.col("runs"), F.col("tail.identity")), ignorenulls=True).over(along))
    known = F.when(~F.col("starts_here"), F.lag("last_name").over(by_piece))
    pieces = pieces.withColumn("renames_at", F.when(known != F.col("head.identity"), F.col("head.page_no")))
    total = F.col("opened_inside") + F.col("starts_here").cast("int") + F.col("renames_at").isNotNull().cast("int")
    pieces = pieces.withColumn("carry", F.coalesce(
        F.sum(total).over(by_piece.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("starts_here").cast("int"))
    late = F.coalesce(F.col("page_no") >= F.col("renames_at"), F.lit(False)).cast("int")
    return rows.join(pieces.select("file", "piece", "carry", "renames_at"), ["file", "piece"]).select(
        "file", "page_no", "doc_type", "identity", (F.col("carry") + F.col("opened") + late).alias("group_no"))


def document_groups(grouped: DataFrame) -> DataFrame:
    """One row per document: page range, type, identity and how many later pages lack a number."""
    first = grouped.groupBy("file", "group_no").agg(
        F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"),
        F.count("*").alias("n_pages"), F.min_by("doc_type", "page_no").alias("doc_type"),
        F.min_by("identity", F.when(F.col("identity").isNotNull(), F.col("page_no"))).alias("identity"),
        F.count_if(F.col("identity").isNull()).alias("n_unnamed"),
        F.max_by(F.col("identity").isNull(), -F.col("page_no")).alias("_first_unnamed"))
    return first.withColumn(
        "later_unnamed", F.col("n_unnamed") - F.col("_first_unnamed").cast("int")).drop("n_unnamed", "_first_unnamed")


def split_review(groups: DataFrame) -> DataFrame:
    """Does a person have to confirm the borders of a file, and why?"""
    per_file = groups.groupBy("file").agg(
        F.count("*").alias("n_groups"), F.count_if(F.col("doc_type") == C.UNKNOWN).alias("n_unknown"),
        F.count_if((F.col("n_pages") > 1) & (F.col("later_unnamed") > 0)).alias("n_unsure"))
    reason = (F.when(F.col("n_unknown") > 0, "unknown_page").when(F.col("n_groups") > MANY_GROUPS, "many_documents")
              .when(F.col("n_unsure") > 0, "unnamed_page"))
    return per_file.withColumn("reason", reason).withColumn("needs_confirmation", F.col("reason").isNotNull())


def regroup(pages: DataFrame, assignment: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """Documents from a person's page assignment, with forced types where given.

    ``assignment``: file, page_no, group_no; ``forced``: file, group_no, doc_type
    (``keep`` leaves the recognised type). The type of a group is the strongest type
    among its pages, the first in declared order on a tie.
    """
    rows = pages.join(assignment, ["file", "page_no"])
    kind = classify(F.col("text"), F.col("file"))
    groups = (
        rows.withColumn("_k", kind).groupBy("file", "group_no").agg(
            F.count("*").alias("n_pages"), F.min("page_no").alias("first_page"),
            F.max_by("_k.doc_type", F.struct(F.col("_k.score"), -F.col("page_no"))).alias("detected")))
    if forced is None:
        return groups.withColumnRenamed("detected", "doc_type")
    wanted = forced.where("doc_type <> 'keep'").withColumnRenamed("doc_type", "wanted")
    return groups.join(wanted, ["file", "group_no"], "left").withColumn(
        "doc_type", F.coalesce("wanted", "detected")).drop("wanted", "detected")

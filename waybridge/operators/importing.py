"""Import of trip and subsidy ledgers: detection of differences and application of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waybridge import constants as C
from waybridge.functions import text as T
from waybridge.functions.numbers import same_number_text
from waybridge.operators.numbering import lowest_suffix

ACTIONS = ["new", "same", "conflict", "error"]
TRIP_COMPARE = [*C.TRIP_BASIC_FIELDS, *C.SETTLEMENT_FIELDS]
SUBSIDY_COMPARE = [*C.SUBSIDY_FIELDS, "diff_reason"]


def name_or_code(rows: DataFrame, column: str, category: str, codes: DataFrame, out: str) -> DataFrame:
    """Code of a cell that holds a code, a name, or a text containing or contained in a name.

    The dictionary is a hand-kept list; it travels to the rows as one short array, so
    the containment test runs inside the row.
    """
    entries = codes.where((F.col("category") == category) & F.col("active")).groupBy("category").agg(
        F.array_sort(F.collect_list(F.struct("sort", "code", "name"))).alias("_codes"))
    text = T.strip(F.coalesce(column, F.lit("")))
    fits = lambda e: (F.contains(e["name"], F.col("_text")) | F.contains(F.col("_text"), e["name"]))
    exact = F.exists("_codes", lambda e: e["code"] == F.upper("_text"))
    first = F.try_element_at(F.filter("_codes", fits), F.lit(1))["code"]
    return (
        rows.withColumn("category", F.lit(category)).withColumn("_text", text)
        .join(entries, "category", "left")
        .withColumn(out, F.when(F.col("_text") != "", F.when(exact, F.upper("_text")).otherwise(first)))
        .drop("category", "_text", "_codes")
    )


def detect(incoming: DataFrame, existing: DataFrame, compare: list[str], text_fields: list[str] = ("diff_reason",)
           ) -> DataFrame:
    """Classify incoming rows against the stored trip with the lowest suffix of their base.

    ``incoming``: row_index, base (null for rows that cannot be placed) and text columns;
    ``existing``: trip_no, base, suffix and the same columns. Blank cells never conflict.
    """
    target = existing.groupBy("base").agg(
        F.min_by(F.struct("trip_no", *[F.col(c).cast("string").alias(c) for c in compare]), "suffix").alias("old"))
    rows = incoming.join(target, "base", "left")
    filled = lambda c: T.strip(F.coalesce(F.col(c), F.lit(""))) != ""

    def equal(c: str) -> Column:
        if c in text_fields:
            return T.strip(F.col(c)) == T.strip(F.coalesce(F.col("old")[c], F.lit("")))
        return same_number_text(F.col(c), F.col("old")[c])

    diffs = F.filter(F.array(*[
        F.when(filled(c) & ~equal(c), F.struct(
            F.lit(c).alias("field"), F.coalesce(F.col("old")[c], F.lit("")).alias("old"), F.col(c).alias("new")))
        for c in compare]), lambda d: d.isNotNull())
    out = rows.withColumn("diffs", F.when(F.col("old").isNotNull(), diffs))
    action = (F.when(F.col("base").isNull(), "error").when(F.col("old").isNull(), "new")
              .when(F.size("diffs") == 0, "same").otherwise("conflict"))
    return out.withColumn("action", action).withColumn("trip_no", F.coalesce("old.trip_no", "base")).drop("old")


def detect_stats(detected: DataFrame) -> DataFrame:
    fixed = detected.sparkSession.createDataFrame([(a,) for a in ACTIONS], "action string")
    return fixed.join(detected.groupBy("action").agg(F.count("*").alias("n")), "action", "left").fillna(0, ["n"])


def diff_rows(detected: DataFrame, keys: list[str]) -> DataFrame:
    """One row per conflicting field."""
    return detected.select(*keys, F.inline("diffs"))


def apply_decisions(decided: DataFrame, trips: DataFrame, kind: str = "trip", order: str = "row_index") -> DataFrame:
    """Outcome of every decided row after a second look at the trips.

    ``decided``: row_index, base, decision (create, overwrite, keep). Rows of the same
    new base: the first one creates the trip, later ones meet it as existing.
    """
    opener = decided.where("base is not null and decision <> 'keep'").groupBy("base").agg(
        F.min(order).alias("_opener"))
    rows = decided.join(lowest_suffix(trips), "base", "left").join(opener, "base", "left")
    stored = F.col("hit_trip").isNotNull()
    keep, overwrite = F.col("decision") == "keep", F.col("decision") == "overwrite"
    if kind == "trip":
        opens = ~stored & (F.col(order) == F.col("_opener"))
        outcome = (F.when(F.col("base").isNull(), "error").when(keep, "kept").when(opens, "created")
                   .when(overwrite, "updated").otherwise("kept"))
    else:
        outcome = (F.when(F.col("base").isNull(), "error").when(keep, "kept").when(~stored, "error")
                   .when(overwrite, "updated").otherwise("kept"))
    number = F.when(outcome == "error", F.lit("")).when(keep & ~stored, F.lit("")).otherwise(
        F.coalesce("hit_trip", "base"))
    return rows.withColumn("outcome", outcome).withColumn("trip_no", number).drop("hit_trip", "_opener")

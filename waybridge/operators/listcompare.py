"""Rail waybills against the loading list, matched on container number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waybridge import constants as C
from waybridge.functions.text import digits

STATES = ["match", "wagon_mismatch", "seal_mismatch", "both_mismatch", "pdf_unmatched", "excel_unmatched",
          "extraction_anomaly", "data_missing"]


def _key(value: Column) -> Column:
    return F.upper(F.trim(F.coalesce(value, F.lit(""))))


def _field_result(extracted: Column, listed: Column) -> Column:
    return (
        F.when(extracted["status"].isin(*C.ANOMALY_STATES), "not_compared")
        .when(F.coalesce(listed, F.lit("")) == "", "not_compared")
        .when(digits(extracted["value"]) == digits(listed), "match").otherwise("mismatch"))


def compare_lists(packing: DataFrame, waybills: DataFrame) -> DataFrame:
    """One row per waybill, and one per list row that no waybill claims.

    ``packing``: row_no, seq, wagon_no, container_no, seal_no; ``waybills``: filename and
    structs container, wagon, seal with value and status. A container listed twice is
    compared with its first row; its other rows stay unclaimed.
    """
    rows = packing.where("container_no is not null").withColumn("key", _key(F.col("container_no")))
    first = rows.groupBy("key").agg(
        F.min_by(F.struct("row_no", "seq", "wagon_no", "seal_no"), "row_no").alias("row"),
        F.count("*").alias("n_listed"))
    usable = F.col("container.status") == "ok"
    claimed = waybills.withColumn("key", F.when(usable, _key(F.col("container.value"))))
    joined = claimed.join(first, "key", "left")
    wagon = _field_result(F.col("wagon"), F.col("row.wagon_no"))
    seal = _field_result(F.col("seal"), F.col("row.seal_no"))
    anomalous = (F.col("wagon.status") != "ok") | (F.col("seal.status") != "ok")
    blank = (F.coalesce("row.wagon_no", F.lit("")) == "") | (F.coalesce("row.seal_no", F.lit("")) == "")
    status = (
        F.when(~usable, "extraction_anomaly").when(F.col("row").isNull(), "pdf_unmatched")
        .when(anomalous, "extraction_anomaly")
        .when((wagon == "mismatch") & (seal == "mismatch"), "both_mismatch")
        .when(wagon == "mismatch", "wagon_mismatch").when(seal == "mismatch", "seal_mismatch")
        .when(blank, "data_missing").otherwise("match"))
    compared = joined.select(
        "filename", F.col("container.value").alias("container_no"), F.col("row.row_no").alias("row_no"),
        F.col("row.seq").alias("seq"), wagon.alias("wagon_result"), seal.alias("seal_result"),
        F.coalesce("n_listed", F.lit(0)).alias("n_listed"), status.alias("status"))
    taken = claimed.where("key is not null").select("key").distinct().withColumn("taken", F.lit(True))
    lead = first.select("key", F.col("row.row_no").alias("first_row"))
    rest = rows.join(lead, "key").join(taken, "key", "left").where(
        F.col("taken").isNull() | (F.col("row_no") != F.col("first_row")))
    nothing = F.lit(None).cast("string")
    unclaimed = rest.select(
        nothing.alias("filename"), "container_no", "row_no", "seq", nothing.alias("wagon_result"),
        nothing.alias("seal_result"), F.lit(0).cast("long").alias("n_listed"), F.lit("excel_unmatched").alias("status"))
    return compared.unionByName(unclaimed)


def display_order(results: DataFrame) -> DataFrame:
    rank = (F.when(F.col("status") == "both_mismatch", 0).when(F.col("status") == "wagon_mismatch", 1)
            .when(F.col("status") == "seal_mismatch", 2).otherwise(3))
    return results.orderBy(rank, F.col("filename").asc_nulls_last(), "row_no")


def compare_summary(results: DataFrame) -> DataFrame:
    fixed = results.sparkSession.createDataFrame([(s,) for s in STATES], "status string")
    counts = results.groupBy("status").agg(F.count("*").alias("n"))
    return fixed.join(counts, "status", "left").fillna(0, ["n"])


def anomaly_files(waybills: DataFrame) -> DataFrame:
    """Waybills with at least one field that was not read properly."""
    bad = lambda c: F.col(f"{c}.status").isin(*C.ANOMALY_STATES)
    lost = lambda c: F.col(f"{c}.status") == "anchor_missing"
    return waybills.where(bad("container") | bad("wagon") | bad("seal")).select(
        "filename", (lost("container") | lost("wagon") | lost("seal")).alias("anchor_missing"))


def anomaly_ratio(waybills: DataFrame, threshold: float = C.ANOMALY_RATIO) -> DataFrame:
    """Share of waybills with reading trouble; above the threshold the template may have changed."""
    bad = lambda c: F.col(f"{c}.status").isin(*C.ANOMALY_STATES)
    lost = lambda c: F.col(f"{c}.status") == "anchor_missing"
    totals = waybills.agg(
        F.count("*").alias("total"),
        F.count_if(bad("container") | bad("wagon") | bad("seal")).alias("n_anomaly"),
        F.count_if(lost("container") | lost("wagon") | lost("seal")).alias("n_anchor_missing"))
    ratio = F.when(F.col("total") > 0, F.col("n_anomaly") / F.col("total")).otherwise(F.lit(0.0))
    return totals.withColumn("anomaly_ratio", F.round(ratio, 4)).withColumn("batch_warning", ratio > threshold)

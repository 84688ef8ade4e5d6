"""Fund batches: coverage of linked trips, funding context, safety checks, input checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waybridge import constants as C
from waybridge.functions.numbers import money
from waybridge.operators.numbering import assign_numbers, parsed_number
from waybridge.operators.ordered import PIECE, position

CATEGORIES = ["rail_freight", "customs_fee", "service_fee", "other_fee", "settle_total"]


def linked_totals(links: DataFrame, settlements: DataFrame) -> DataFrame:
    """Per fund batch: number of links, and sum and count of every amount column.

    All columns are summed and the right one is chosen afterwards, so links meet the
    settlements only, and a batch with very many links is summed map-side first.
    """
    amounts = settlements.select("trip_no", *[money(F.col(c)).alias(c) for c in CATEGORIES])
    joined = links.select("batch_id", "trip_no").join(amounts, "trip_no", "left")
    return joined.groupBy("batch_id").agg(
        F.count("*").alias("trip_count"),
        *[F.sum(c).alias(f"sum_{c}") for c in CATEGORIES],
        *[F.count(c).alias(f"n_{c}") for c in CATEGORIES],
    )


def _amount_column(prefix: str):
    chosen = F.when(F.col("batch_type") != "cost", F.col(f"{prefix}_settle_total"))
    for category, column in C.COST_CATEGORY_FIELD.items():
        chosen = chosen.when(F.col("cost_category") == category, F.col(f"{prefix}_{column}"))
    return chosen.otherwise(F.col(f"{prefix}_settle_total"))


def coverage(batches: DataFrame, links: DataFrame, settlements: DataFrame) -> DataFrame:
    """Linked trips against the batch total.

    ``shortage`` means the trips cost more than the batch holds, ``under`` that they cost less.
    """
    total = money(F.col("total_amount"))
    out = batches.join(linked_totals(links, settlements), "batch_id", "left").fillna(0, ["trip_count"])
    covered = F.coalesce(_amount_column("sum"), F.lit(0).cast("decimal(38,10)"))
    skipped = ~F.coalesce("participates", F.lit(True))
    out = out.withColumns({
        "batch_total": total,
        "covered_total": F.when(skipped, F.lit(0).cast("decimal(38,10)")).otherwise(covered),
        "missing_amounts": F.when(skipped, 0).otherwise(
            F.col("trip_count") - F.coalesce(_amount_column("n"), F.lit(0))),
    })
    out = out.withColumn("diff", F.when(~skipped, F.col("covered_total") - F.col("batch_total")))
    return out.withColumn(
        "verdict",
        F.when(skipped, "skipped").when(F.col("batch_total").isNull(), "unknown")
        .when(F.col("diff") > 0, "shortage").when(F.col("diff") < 0, "under").otherwise("covered"),
    ).drop(*[f"{p}_{c}" for p in ("sum", "n") for c in CATEGORIES])


def trips_without_amount(batches: DataFrame, links: DataFrame, settlements: DataFrame) -> DataFrame:
    """Links whose trip has no amount in the column that the batch looks at."""
    amounts = settlements.select("trip_no", *[money(F.col(c)).alias(f"a_{c}") for c in CATEGORIES])
    rows = links.select("batch_id", "trip_no").join(batches, "batch_id").join(amounts, "trip_no", "left")
    return rows.where(F.coalesce("participates", F.lit(True)) & _amount_column("a").isNull()).select(
        "batch_id", "trip_no")


def trip_batch_links(links: DataFrame, covered: DataFrame) -> DataFrame:
    """Every (trip, fund batch) link with the batch's size, type and verdict."""
    return links.select("batch_id", "trip_no", "allocated_amount").join(
        covered.select("batch_id", "batch_type", "fund_purpose", "trip_count", "participates", "verdict"),
        "batch_id")


def funding_context(links: DataFrame, covered: DataFrame) -> DataFrame:
    """Per trip: where its money comes from, and whether its own alert is silenced."""
    rows = trip_batch_links(links, covered)
    prepay = F.max((F.col("batch_type") != "cost").cast("int"))
    cost = F.max((F.col("batch_type") == "cost").cast("int"))
    out = rows.groupBy("trip_no").agg(
        F.count("*").alias("n_batches"), prepay.alias("_p"), cost.alias("_c"),
        F.bool_or(F.col("verdict") != "skipped").alias("has_recon_batch"))
    kind = (F.when((F.col("_p") == 1) & (F.col("_c") == 1), "prepay+cost")
            .when(F.col("_c") == 1, "cost").otherwise("prepay"))
    return out.withColumn("funding", kind).withColumn("suppress_single_alert", F.lit(True)).drop("_p", "_c")


def known_numbers(trips: DataFrame, estimates: DataFrame) -> DataFrame:
    return trips.select("trip_no").unionByName(
        estimates.select(F.col("est_no").alias("trip_no"))).distinct()


def orphan_links(links: DataFrame, known: DataFrame) -> DataFrame:
    """Links that point to no trip and no estimate."""
    return links.select("batch_id", "trip_no").join(known, "trip_no", "left_anti")


def double_registration(links: DataFrame, batches: DataFrame, prepayments: DataFrame) -> DataFrame:
    """Trips with their own prepayments that also sit in a participating prepayment batch.

    One row per (trip, batch), so nothing is collected.
    """
    counted = batches.where((F.col("batch_type") == "prepay") & F.coalesce("participates", F.lit(True)))
    return (
        links.select("batch_id", "trip_no").join(counted.select("batch_id"), "batch_id", "left_semi")
        .join(prepayments.select("trip_no").distinct(), "trip_no", "left_semi")
    )


def default_participates(purpose):
    table = F.create_map(*[F.lit(x) for p in C.FUND_PURPOSES.items() for x in p])
    return F.coalesce(F.try_element_at(table, purpose), F.lit(True))


def input_problems(requests: DataFrame) -> DataFrame:
    """Violations of a new fund batch: purpose, remark, category, trips and number format."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    trips = F.coalesce("trip_nos", F.array().cast("array<string>"))
    bad_number = F.exists(trips, lambda t: parsed_number(t).isNull())
    reasons = F.array(
        F.when(~F.col("fund_purpose").isin(*C.FUND_PURPOSES), "bad purpose"),
        F.when((F.col("fund_purpose") == C.PURPOSE_OTHER) & blank("remark"), "purpose needs a remark"),
        F.when((F.col("batch_type") == "cost") & blank("cost_category"), "cost category missing"),
        F.when(~F.col("batch_type").isin("prepay", "cost"), "bad batch type"),
        F.when(F.size(trips) == 0, "no trips"),
        F.when(bad_number, "bad trip number"),
        F.when(money(F.col("total_amount")).isNull(), "amount missing"),
    )
    return requests.withColumn("problems", F.filter(reasons, lambda r: r.isNotNull()))


def link_rows(requests: DataFrame) -> DataFrame:
    """Distinct trips of each request, numbered from 0 in given order.

    ``requests`` has a row (batch_id, position, trip_no) per named trip. A trip counts at its least position, and the
    numbers are worked out piece by piece, so a batch may name any share of all trips.
    """
    named = requests.groupBy("batch_id", "trip_no").agg(F.min("position").alias("_at"))
    numbered = position(named, ["batch_id"], ["_at"], F.floor(F.col("_at") / PIECE), "seq")
    return numbered.select("batch_id", (F.col("seq") - 1).alias("seq"), "trip_no")


#: A day and type has batch numbers 01 to 99.
LAST_BATCH = 99


def assign_batch_ids(requests: DataFrame, existing: DataFrame, order: str = "request_order") -> DataFrame:
    """``BATCH-date-TYPE-NN`` with the first free NN of the day and type."""
    tag = F.when(F.col("batch_type") == "prepay", "PREPAY").otherwise("COST")
    base = F.concat_ws("-", F.lit("BATCH"), F.date_format("paid_at", "yyyyMMdd"), tag)
    taken = existing.select(
        F.regexp_extract("batch_id", r"^(.*)-\d{2}$", 1).alias("base"),
        F.regexp_extract("batch_id", r"-(\d{2})$", 1).try_cast("int").alias("suffix"))
    return assign_numbers(requests.withColumn("base", base), taken, order, 1, True, LAST_BATCH
                          ).withColumnRenamed("number", "batch_id").drop("base", "suffix")


def list_batches(covered: DataFrame, limit: int = 200) -> DataFrame:
    return covered.orderBy(F.desc_nulls_last("paid_at"), "batch_id").limit(limit)

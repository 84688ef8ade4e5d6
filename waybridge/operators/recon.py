"""Reconciliation of trips: prepayment coverage, actual payments, three-way check, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waybridge import constants as C
from waybridge.functions.numbers import money
from waybridge.operators.ordered import PIECE, neighbours, position


def prepay_coverage(settlements: DataFrame, prepayments: DataFrame) -> DataFrame:
    """Sum of prepayments against the settlement of every trip."""
    paid = prepayments.groupBy("trip_no").agg(F.sum(money(F.col("amount"))).alias("prepay_total"))
    total = F.coalesce(F.col("prepay_total"), F.lit(0).cast("decimal(38,10)"))
    diff = money(F.col("settle_total")) - total
    return (
        settlements.select("trip_no", money(F.col("settle_total")).alias("settle_total"))
        .join(paid, "trip_no", "left")
        .withColumn("diff", diff).withColumn("prepay_total", total)
        .withColumn("verdict", F.when(F.col("settle_total").isNull(), "unknown")
                    .when(F.col("diff") > 0, "shortage").when(F.col("diff") < 0, "overpaid")
                    .otherwise("covered"))
    )


def settle_actual(rows: DataFrame) -> DataFrame:
    """Settlement against the freight really paid; an unexplained difference asks for a reason."""
    diff = money(F.col("settle_total")) - money(F.col("actual_freight"))
    blank = F.trim(F.coalesce("diff_reason", F.lit(""))) == ""
    return rows.withColumn("diff", diff).withColumns({
        "has_diff": F.coalesce(F.col("diff") != 0, F.lit(False)),
        "needs_reason": F.coalesce((F.col("diff") != 0) & blank, F.lit(False)),
    })


def three_way(rows: DataFrame, keys: list[str], pct=C.RECON_WARN_PCT, amount=C.RECON_WARN_AMOUNT,
              fields: list[str] = C.THREE_WAY_FIELDS) -> DataFrame:
    """Pairwise comparison of the three full-amount figures, one row per pair.

    The percentage test multiplies instead of dividing, which keeps decimals exact. ``pct`` and ``amount``
    are numbers or columns, for instance of ``thresholds(config).select("pct").scalar()``.
    """
    values = {f: money(F.col(f)) for f in fields}
    pairs = [(a, b) for i, a in enumerate(fields) for b in fields[i + 1:]]
    entries = F.array(*[
        F.struct(F.lit(a).alias("a_field"), F.lit(b).alias("b_field"),
                 values[a].alias("a_value"), values[b].alias("b_value"))
        for a, b in pairs])
    out = rows.select(*keys, F.inline(entries))
    a, b = F.col("a_value"), F.col("b_value")
    given = lambda x: x if isinstance(x, Column) else F.lit(str(x))
    limit_pct = given(pct).cast("decimal(8,4)")
    limit_amount = given(amount).cast("decimal(18,4)")
    gap = F.abs(F.col("diff"))
    basis = F.greatest(F.abs(a), F.abs(b), F.lit(1).cast("decimal(28,10)"))
    return out.withColumn("diff", a - b).withColumn("flag", F.coalesce(
        (gap > limit_amount) | (gap * 100 > limit_pct * basis), F.lit(False))).withColumn(
        "comparable", F.col("diff").isNotNull())


def missing_fields(rows: DataFrame, keys: list[str], fields: list[str] = C.SUBSIDY_FIELDS) -> DataFrame:
    """Names of the fields without an amount, in field order."""
    names = F.array(*[F.when(money(F.col(f)).isNull(), F.lit(f)) for f in fields])
    return rows.select(*keys, F.filter(names, lambda n: n.isNotNull()).alias("missing_fields"))


def neighbour_duplicates(rows: DataFrame, date: str = "dep_date", key: str = "trip_no",
                         fields: list[str] = C.SUBSIDY_FIELDS) -> DataFrame:
    """Equal amounts in neighbouring records of the (date, key) order, flagged on both sides.

    One row per record, field and neighbour.
    """
    plain = rows.select(date, key, *[money(F.col(f)).alias(f) for f in fields])
    beside = neighbours(plain, [date, key], [date, key, *fields])
    entries = [
        F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.col(side)[key].alias("other_key"),
                 F.col(side)[date].alias("other_date"),
                 F.coalesce(F.col(f) == F.col(side)[f], F.lit(False)).alias("hit"))
        for f in fields for side in ("prev", "next")]
    return (
        beside.select(date, key, F.inline(F.array(*entries))).where("hit").drop("hit")
    )


def anomaly_snapshot(subsidies: DataFrame, flags: DataFrame, key: str = "trip_no") -> DataFrame:
    """Subsidy rows with their neighbour flags; a record has at most two per field."""
    items = flags.groupBy(key).agg(F.array_sort(F.collect_list(
        F.struct("field", "value", "other_key", "other_date"))).alias("anomalies"))
    fresh = subsidies.drop("anomalies").join(items, key, "left")
    return fresh


def with_subsidies(trips: DataFrame, subsidies: DataFrame, date_from=None, date_to=None) -> DataFrame:
    if date_from is not None:
        trips = trips.where(F.col("dep_date") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        trips = trips.where(F.col("dep_date") <= F.lit(date_to).cast("date"))
    return trips.join(subsidies, "trip_no", "left")


def list_trips(trips: DataFrame, date_from=None, date_to=None, station=None, port=None, dest=None,
               limit: int = 200) -> DataFrame:
    """Trip ledger page: filters on given arguments only, newest first, 1 to 1000 rows."""
    if date_from is not None:
        trips = trips.where(F.col("dep_date") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        trips = trips.where(F.col("dep_date") <= F.lit(date_to).cast("date"))
    for column, value in (("station", station), ("port", port), ("dest", dest)):
        if value:
            trips = trips.where(F.col(column) == value.upper())
    return trips.orderBy(F.desc("dep_date"), "train_type", "suffix", "trip_no").limit(max(1, min(limit, 1000)))


def number_hints(queries: DataFrame, trips: DataFrame, estimates: DataFrame) -> DataFrame:
    """How many official and open estimated numbers a (date, station, port, dest) query meets."""
    keys = ["dep_date", "station", "port", "dest"]
    official = trips.groupBy(*keys).agg(F.count("*").alias("n_trips"))
    pending = estimates.where("official_no is null").groupBy(*keys).agg(F.count("*").alias("n_open"))
    out = queries.join(official, keys, "left").join(pending, keys, "left").fillna(0, ["n_trips", "n_open"])
    return out.withColumn("only_estimated", (F.col("n_trips") == 0) & (F.col("n_open") > 0))


def recon_page(trips: DataFrame, subsidies: DataFrame, date_from=None, date_to=None,
               pct=C.RECON_WARN_PCT, amount=C.RECON_WARN_AMOUNT) -> DataFrame:
    """Trips of a period with their three-way verdict and the number of neighbour flags."""
    rows = with_subsidies(trips, subsidies, date_from, date_to)
    verdicts = three_way(rows, ["trip_no"], pct, amount).groupBy("trip_no").agg(
        F.count_if("flag").alias("flagged_pairs"), F.count_if(~F.col("comparable")).alias("open_pairs"))
    flags = neighbour_duplicates(rows).groupBy("trip_no").agg(F.count("*").alias("neighbour_flags"))
    return (
        rows.join(verdicts, "trip_no", "left").join(flags, "trip_no", "left")
        .fillna(0, ["neighbour_flags"])
    )


def trip_detail(trips: DataFrame, settlements: DataFrame, prepayments: DataFrame, subsidies: DataFrame,
                estimates: DataFrame) -> DataFrame:
    """Basics, settlement, prepayment figures, subsidy and number history, all trips at once."""
    coverage = prepay_coverage(settlements, prepayments).select("trip_no", "prepay_total", "diff", "verdict")
    counts = prepayments.groupBy("trip_no").agg(F.count("*").alias("n_prepayments"))
    history = estimates.where("official_no is not null").groupBy(F.col("official_no").alias("trip_no")).agg(
        F.count("*").alias("n_estimates"))
    return (
        trips.join(settlements, "trip_no", "left").join(coverage, "trip_no", "left")
        .join(counts, "trip_no", "left").join(subsidies, "trip_no", "left").join(history, "trip_no", "left")
        .fillna(0, ["n_prepayments", "n_estimates"])
    )


#: What the status columns of ledger rows may hold.
STATUSES = {
    "record_status": ["confirmed", "pending", "not_found", "business_missing"],
    "review_status": ["normal", "suspect", "reviewed"],
}


def entry_problems(entries: DataFrame, numbers: DataFrame, amounts: list[str], required: list[str] = (),
                   key: str = "trip_no") -> DataFrame:
    """Ledger entries that cannot be written, with their reasons.

    A number has to be one of ``numbers``, amounts have to be readable where given and given where ``required``,
    and status columns have to hold a known status.
    """
    known = numbers.select(key).distinct().withColumn("_known", F.lit(True))
    reasons = [F.when(F.col("_known").isNull(), "unknown number")]
    for column in amounts:
        blank = F.trim(F.coalesce(column, F.lit(""))) == ""
        missing = F.when(blank, f"{column} missing") if column in required else F.when(blank, F.lit(None).cast("string"))
        reasons.append(missing.when(~blank & money(F.col(column)).isNull(), f"{column} not numeric"))
    for column, allowed in STATUSES.items():
        if column in entries.columns:
            reasons.append(F.when(F.col(column).isNotNull() & ~F.col(column).isin(*allowed), f"bad {column}"))
    return entries.join(known, key, "left").withColumn(
        "problems", F.filter(F.array(*reasons), lambda r: r.isNotNull())).where(F.size("problems") > 0).drop("_known")


def prepayment_problems(entries: DataFrame, trips: DataFrame, estimates: DataFrame) -> DataFrame:
    """Entries that cannot be booked: unknown number, missing or unreadable amount, bad status."""
    numbers = trips.select("trip_no").unionByName(estimates.select(F.col("est_no").alias("trip_no")))
    return entry_problems(entries, numbers, ["amount"], ["amount"])


def trip_entries(prepayments: DataFrame, flags: DataFrame, estimates: DataFrame) -> DataFrame:
    """Prepayments, flags and number history of all trips as numbered rows: trip_no, kind, seq, entry.

    Each input has ``trip_no``, a growing integer ``order`` and ``entry``. A trip may have any number of entries: they
    are numbered piece by piece and never gathered in one row.
    """
    rows = None
    for kind, part in (("prepayment", prepayments), ("flag", flags), ("estimate", estimates)):
        part = part.select("trip_no", F.lit(kind).alias("kind"), F.col("order").cast("long").alias("order"), "entry")
        rows = part if rows is None else rows.unionByName(part)
    return position(rows, ["trip_no", "kind"], ["order"], F.floor(F.col("order") / PIECE), "seq").select(
        "trip_no", "kind", "seq", "entry")


def point_read(table: DataFrame, key: str, value, order: Column | str | None = None) -> DataFrame:
    """Rows of one key, ordered when asked; the filter reaches the scan."""
    hit = table.where(F.col(key) == F.lit(value))
    return hit.orderBy(order) if order is not None else hit

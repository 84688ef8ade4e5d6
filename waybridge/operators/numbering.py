"""Train numbers: building, reading back, unique suffixes and locking of estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waybridge.functions import text as T
from waybridge.functions.dates import strict_date, train_type
from waybridge.operators.ordered import PIECE, position, running_total


def with_base_number(rows: DataFrame, codes: DataFrame, date: str = "dep_date", station: str = "station",
                     port: str = "port", dest: str = "dest", kind: str = "train_type") -> DataFrame:
    """Add ``base`` (date-station-port-dest-type) or the reason in ``number_error``.

    Codes must be well formed and stand in the dictionary.
    """
    out = rows.withColumns({
        "_d": strict_date(F.col(date)), "_t": train_type(F.col(kind)),
        "_station": F.upper(T.strip(F.col(station))),
        "_port": F.upper(T.strip(F.col(port))),
        "_dest": F.upper(T.strip(F.col(dest))),
    })
    for category in ("station", "port", "dest"):
        known = codes.where(F.col("category") == category).select(
            F.col("code").alias(f"_{category}"), F.lit(True).alias(f"_{category}_known"))
        out = out.join(known, f"_{category}", "left")
    error = F.when(F.col("_d").isNull(), "bad date").when(F.col("_t").isNull(), "bad train type")
    for category in ("station", "port", "dest"):
        error = error.when(~T.is_code(F.col(f"_{category}")), f"bad {category} code")
        error = error.when(F.col(f"_{category}_known").isNull(), f"unknown {category} code")
    base = F.concat_ws("-", F.date_format("_d", "yyyyMMdd"), "_station", "_port", "_dest", "_t")
    return (
        out.withColumn("number_error", error)
        .withColumn("base", F.when(F.col("number_error").isNull(), base))
        .drop("_d", "_t", "_station", "_port", "_dest", "_station_known", "_port_known", "_dest_known")
    )


def parsed_number(number: Column) -> Column:
    """Struct ``is_est, dep_date, station, port, dest, train_type, suffix, base``; null when malformed."""
    code = "([A-Z0-9]{1,8})"
    pattern = rf"^(EST-)?(\d{{8}})-{code}-{code}-{code}-([LT])(?:-(\d{{2,}}))?$"
    text = F.upper(T.strip(number))
    part = lambda i: F.regexp_extract(text, pattern, i)
    day = F.try_to_date(part(2), "yyyyMMdd")
    suffix = F.when(part(7) != "", part(7)).otherwise("0").try_cast("int")
    return F.when(text.rlike(pattern) & day.isNotNull(), F.struct(
        (part(1) != "").alias("is_est"), day.alias("dep_date"), part(3).alias("station"),
        part(4).alias("port"), part(5).alias("dest"), part(6).alias("train_type"),
        suffix.alias("suffix"),
        F.concat_ws("-", part(2), part(3), part(4), part(5), part(6)).alias("base")))


def official_base(est_no: Column) -> Column:
    """Official base that an estimated number expects, null for any other number."""
    parsed = parsed_number(est_no)
    return F.when(parsed["is_est"], parsed["base"])


def suffix_text(suffix: Column) -> Column:
    """At least two digits."""
    digits = suffix.cast("string")
    return F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)


def with_suffix(base: Column, suffix: Column) -> Column:
    return F.when(suffix == 0, base).otherwise(F.concat(base, F.lit("-"), suffix_text(suffix)))


def assign_numbers(requests: DataFrame, taken: DataFrame, order: str, first: int = 0,
                   always_suffix: bool = False, last: int | None = None) -> DataFrame:
    """Give every request of a base the smallest free suffix, in request order.

    ``requests`` has ``base`` and a growing integer ``order``; ``taken`` has ``base`` and ``suffix``. Counting
    goes on as far as needed; only a numbering that has a ``last`` suffix of its own reports the rest in
    ``number_error``.

    No list of free suffixes is built: before the j-th taken suffix t stand t - first - (j - 1) free ones, so
    the k-th request lies behind all taken suffixes with fewer than k free ones before them, and its suffix is
    first + k - 1 plus their number. Requests and taken suffixes meet in one running count on that scale.
    """
    used = taken.where(F.col("suffix") >= first).select("base", F.col("suffix").cast("long").alias("_s")).distinct()
    used = position(used, ["base"], ["_s"], F.floor(F.col("_s") / PIECE), "_j").select(
        "base", (F.col("_s") - first - (F.col("_j") - 1)).alias("_at"), F.lit(1).alias("_taken"))
    counted = position(requests, ["base"], [order], F.floor(F.col(order) / PIECE), "_k")
    both = counted.withColumn("_at", F.col("_k") - 1).withColumn("_taken", F.lit(0)).unionByName(used, allowMissingColumns=True)
    # at the same place taken suffixes come first
    behind = running_total(both, ["base"], ["_at", F.desc("_taken")], F.col("_taken"), F.floor(F.col("_at") / PIECE), "_behind")
    suffix = (F.lit(first) + F.col("_at") + F.col("_behind")).cast("int")
    if last is not None:
        suffix = F.when(suffix <= last, suffix)
    numbered = behind.where("_taken = 0").withColumn("suffix", suffix)
    number = (F.concat(F.col("base"), F.lit("-"), suffix_text(F.col("suffix")))
              if always_suffix else with_suffix(F.col("base"), F.col("suffix")))
    return (
        numbered.withColumn("number", number)
        .withColumn("number_error", F.when(F.col("suffix").isNull(), "no free suffix"))
        .drop("_k", "_at", "_taken", "_behind")
    )


def lowest_suffix(trips: DataFrame) -> DataFrame:
    """Trip with the lowest suffix of every base: ``base, hit_trip``."""
    return trips.groupBy("base").agg(F.min_by("trip_no", "suffix").alias("hit_trip"))


def lock_estimates(locks: DataFrame, trips: DataFrame, order: str = "lock_order") -> DataFrame:
    """Link estimated numbers to an existing trip of the same base, else to a new one.

    ``locks`` has ``est_no``, ``base`` (with the final date) and a lock order. When
    several estimates lock onto a base without a trip, the first one creates it.
    """
    opener = locks.groupBy("base").agg(F.min(order).alias("_opener"))
    return (
        locks.join(lowest_suffix(trips), "base", "left").join(opener, "base")
        .withColumn("official_no", F.coalesce("hit_trip", "base"))
        .withColumn("created_trip", F.col("hit_trip").isNull() & (F.col(order) == F.col("_opener")))
        .drop("hit_trip", "_opener")
    )


def relink_prepayments(prepayments: DataFrame, locked: DataFrame) -> DataFrame:
    """Move prepayments from the estimated to the official number, keeping the old one."""
    mapping = locked.select(F.col("est_no").alias("trip_no"), "official_no")
    return (
        prepayments.join(mapping, "trip_no", "left")
        .withColumn("est_ref", F.coalesce("est_ref", F.when(F.col("official_no").isNotNull(), F.col("trip_no"))))
        .withColumn("trip_no", F.coalesce("official_no", "trip_no")).drop("official_no")
    )


def open_estimates(trips: DataFrame, estimates: DataFrame) -> DataFrame:
    """Unlocked estimates that share the base of a new trip, one row per pair."""
    waiting = estimates.where("official_no is null").select("base", "est_no", "created_at")
    return trips.select("trip_no", "base").join(waiting, "base")


def number_history(trips: DataFrame, estimates: DataFrame) -> DataFrame:
    """Estimates locked onto each trip."""
    locked = estimates.where("official_no is not null")
    return trips.select("trip_no").join(locked, trips["trip_no"] == locked["official_no"])


def list_estimates(estimates: DataFrame, locked: bool | None = None, limit: int = 200) -> DataFrame:
    if locked is not None:
        estimates = estimates.where("official_no is not null" if locked else "official_no is null")
    return estimates.orderBy(F.desc("created_at"), "est_no").limit(max(1, min(limit, 1000)))

"""Lookups by any subset of a few keys, all at once.

A query gives some keys and leaves others null. What it meets is one group of a grouping set: the keys it gives, with a number that
names the subset. All queries are answered in one pass over the rows, for the subsets that occur only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

NUMBER_KEYS = ["dep_date", "station", "port", "dest"]


def subset_of(keys: list[str]) -> Column:
    """Number of the subset that a query leaves open, as ``grouping_id`` counts it: the last key has bit 1."""
    return reduce(lambda a, b: a + b, [
        F.when(F.col(k).isNull(), 1 << (len(keys) - 1 - i)).otherwise(0) for i, k in enumerate(keys)]).cast("int")


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on the subset and the keys, where an open key meets an open key."""
    on = reduce(lambda x, y: x & y, [F.col(f"q.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "subset"]])
    return a.alias("q").join(b.alias("r"), on, how)


def number_lookup(queries: DataFrame, trips: DataFrame, estimates: DataFrame, keys: list[str] = NUMBER_KEYS,
                  limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Counts per query, and the open estimated numbers it meets.

    The first table has the queries' columns, ``n_trips``, ``n_open`` and ``only_estimated``. The second has the queries' columns, ``est_no`` and
    ``place`` of the open ones among the first ``limit`` estimates by creation, the size of a page.
    Rows with a null key are met only by queries that leave this key open.
    """
    asked = queries.withColumn("subset", subset_of(keys))
    wanted = asked.select(*keys, "subset").distinct()
    # there are no more subsets than two to the number of keys
    subsets = sorted(r.subset for r in wanted.select("subset").distinct().collect())
    given = lambda s: [k for i, k in enumerate(keys) if not s >> (len(keys) - 1 - i) & 1]
    rows = trips.select(*keys, F.lit(1).alias("trip"), F.lit(0).alias("open")).unionByName(
        estimates.select(*keys, F.lit(0).alias("trip"), F.col("official_no").isNull().cast("int").alias("open")))
    if subsets:
        counts = rows.groupingSets([[F.col(k) for k in given(s)] for s in subsets], *[F.col(k) for k in keys]).agg(
            F.sum("trip").alias("n_trips"), F.sum("open").alias("n_open"), F.grouping_id().cast("int").alias("subset"))
    else:
        counts = rows.limit(0).select(*keys, F.lit(0).cast("long").alias("n_trips"), F.lit(0).cast("long").alias("n_open"), F.lit(0).alias("subset"))
    # a group of rows whose key is null is no group of an open key; no query asks for it
    counted = _same(asked, counts, keys, "left").select(
        "q.*", *[F.coalesce(f"r.{c}", F.lit(0)).alias(c) for c in ("n_trips", "n_open")]).drop("subset")
    counted = counted.withColumn("only_estimated", (F.col("n_trips") == 0) & (F.col("n_open") > 0))

    # the page of every subset and value that is asked for; the rank is cut inside the tasks first
    open_key = lambda i, k: F.when(F.col("subset").bitwiseAND(1 << (len(keys) - 1 - i)) == 0, F.col(k)).alias(k)
    spread = estimates.withColumn("subset", F.explode(F.array(*[F.lit(s) for s in subsets]).cast("array<int>")))
    whole = reduce(lambda a, b: a & b, [
        (F.col("subset").bitwiseAND(1 << (len(keys) - 1 - i)) != 0) | F.col(k).isNotNull() for i, k in enumerate(keys)])
    spread = spread.where(whole).select("est_no", "official_no", "created_at", "subset", *[open_key(i, k) for i, k in enumerate(keys)])
    met = _same(wanted, spread, keys, "inner").select("q.*", "r.est_no", "r.official_no", "r.created_at")
    page = met.withColumn("place", F.row_number().over(Window.partitionBy("subset", *keys).orderBy("created_at", "est_no"))).where(
        F.col("place") <= limit).where("official_no is null").select(*keys, "subset", "est_no", "place")
    listed = _same(asked, page, keys, "inner").select("q.*", "r.est_no", "r.place").drop("subset")
    return counted, listed

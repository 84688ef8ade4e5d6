"""Neighbour flags kept up to date: only slices around changed records are worked out again.

Records lie in slices of their (date, key) order, each stored in a folder of its own, beside one row per slice with its first and last record. A
change touches the slice it falls into; flags can also change on the edge records of the slices next to it. So those slices are read and
their flags replaced; all others stay as they are. Everything is written in one commit (see ``store``).
Slices keep their limits, so a slice that took in much should be built anew now and then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from waybridge import constants as C
from waybridge.functions.numbers import money
from waybridge.operators.ordered import sliced
from waybridge.operators.store import Kept, Replaced, Store
from waybridge.session import written

AMOUNT = "decimal(28,10)"
PLACE = "struct<day:date,trip_no:string>"


def flag_store(spark: SparkSession, folder: str, fields: list[str] = C.SUBSIDY_FIELDS) -> Store:
    amounts = ", ".join(f"{f} {AMOUNT}" for f in fields)
    edge = f"struct<day:date,trip_no:string,{','.join(f'{f}:{AMOUNT}' for f in fields)}>"
    return Store(spark, folder, {
        "records": Kept(f"day date, trip_no string, {amounts}, slice int", ["slice"], "slice"),
        "edges": Kept(f"slice int, n long, first {edge}, last {edge}", ["slice"]),
        "flags": Kept(f"day date, trip_no string, field string, value {AMOUNT}, other_key string, other_date date, slice int", ["slice"], "slice"),
    })


def _records(rows: DataFrame, fields: list[str]) -> DataFrame:
    return rows.select(F.col("dep_date").cast("date").alias("day"), F.col("trip_no").cast("string").alias("trip_no"), *[
        money(F.col(f)).alias(f) for f in fields])


def _edges(records: DataFrame, fields: list[str]) -> DataFrame:
    payload, place = F.struct("day", "trip_no", *fields), F.struct("day", "trip_no")
    return records.groupBy("slice").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(payload, place).alias("first"), F.max_by(payload, place).alias("last"))


def _between(edges: DataFrame) -> DataFrame:
    """Every slice with its neighbours; one row per slice bounds this window."""
    order = Window.orderBy("slice")
    return edges.select(
        "slice", "n", F.lag("slice").over(order).alias("slice_before"), F.lead("slice").over(order).alias("slice_after"),
        F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))


def _flags(records: DataFrame, edges: DataFrame, fields: list[str]) -> DataFrame:
    """Flags of whole slices; edge records look at the slices beside theirs."""
    inside, payload = Window.partitionBy("slice").orderBy("day", "trip_no"), F.struct("day", "trip_no", *fields)
    beside = records.withColumns({"prev": F.lag(payload).over(inside), "next": F.lead(payload).over(inside)}).join(
        _between(edges).select("slice", "before", "after"), "slice").withColumns({
            "prev": F.coalesce("prev", "before"), "next": F.coalesce("next", "after")})
    entries = [F.struct(
        F.lit(f).alias("field"), F.col(f).alias("value"), F.col(side)["trip_no"].alias("other_key"), F.col(side)["day"].alias("other_date"),
        F.coalesce(F.col(f) == F.col(side)[f], F.lit(False)).alias("hit")) for f in fields for side in ("prev", "next")]
    return beside.select("day", "trip_no", F.inline(F.array(*entries)), "slice").where("hit").drop("hit")


def build_flags(store: Store, rows: DataFrame, fields: list[str] = C.SUBSIDY_FIELDS) -> int:
    """The full pass: cut all records into slices and flag them."""
    records = sliced(_records(rows, fields), ["day", "trip_no"]).withColumnRenamed("_slice", "slice")
    edges = written(_edges(records, fields))

    def change(tables: dict[str, DataFrame]) -> dict[str, Replaced]:
        old = tables["edges"].select("slice")
        keys = old.unionByName(edges.select("slice")).distinct()
        return {"records": Replaced(records, keys), "edges": Replaced(edges, keys), "flags": Replaced(_flags(records, edges, fields), keys)}

    return store.commit(change)


def _placed(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows with the slice that their (day, trip_no) falls into: the last one that does not begin behind it, or the first of all."""
    starts = edges.select(F.struct(F.struct("first.day", "first.trip_no").alias("place"), "slice").alias("s")).agg(
        F.array_sort(F.collect_list("s")).alias("starts")).withColumn("one", F.lit(1))
    before = F.filter("starts", lambda s: s["place"] <= F.struct(F.col("day"), F.col("trip_no")))
    # one row that holds one start per slice
    return rows.withColumn("one", F.lit(1)).join(F.broadcast(starts), "one").withColumn("slice", F.coalesce(
        F.try_element_at(before, F.lit(-1))["slice"], F.try_element_at("starts", F.lit(1))["slice"], F.lit(0))).drop("one", "starts")


def refresh_flags(store: Store, removed: DataFrame, added: DataFrame, fields: list[str] = C.SUBSIDY_FIELDS) -> dict[str, int]:
    """Take out the records at ``removed`` (dep_date, trip_no), put in those of ``added`` and mend the flags.

    A changed record is removed where it was and added as it is now. Returns how many slices and records were there and how many were read.
    """
    report: dict[str, int] = {}
    gone = written(removed.select(F.col("dep_date").cast("date").alias("day"), F.col("trip_no").cast("string").alias("trip_no")).distinct())
    new = written(_records(added, fields))

    def change(tables: dict[str, DataFrame]) -> dict[str, Replaced]:
        edges = written(tables["edges"])
        touched = _placed(gone.unionByName(new.select("day", "trip_no")), edges).select("slice").distinct()
        beside = _between(edges)
        near = written(touched.join(beside, "slice", "left").select(F.col("slice").alias("touched"), F.explode(F.array(
            "slice", "slice_before", "slice_after")).alias("slice")).where("slice is not null").distinct())
        # slice numbers are bounded by the number of partitions; as literals they prune folders
        dirty = sorted({r.touched for r in near.collect()})
        reread = sorted({r.slice for r in near.collect()})
        held = tables["records"].where(F.col("slice").isin(reread))
        sizes = {r.slice: r.n for r in edges.select("slice", "n").collect()}
        report.update(slices=len(sizes), slices_read=len(reread), records=sum(sizes.values()), records_read=sum(sizes.get(s, 0) for s in reread))
        edited = held.where(F.col("slice").isin(dirty)).join(gone, ["day", "trip_no"], "left_anti").unionByName(
            _placed(new, edges))
        now = written(edited.unionByName(held.where(~F.col("slice").isin(dirty))))
        fresh = written(_edges(now.where(F.col("slice").isin(dirty)), fields))
        after = edges.where(~F.col("slice").isin(dirty)).unionByName(fresh)
        spark = store.spark
        numbers = lambda values: spark.createDataFrame([(v,) for v in values], "slice int")
        return {
            "records": Replaced(now.where(F.col("slice").isin(dirty)), numbers(dirty)), "edges": Replaced(fresh, numbers(dirty)),
            "flags": Replaced(_flags(now, after, fields), numbers(reread))}

    store.commit(change)
    return report

"""Ordered work inside a key, or over a whole table, without one giant task.

A plain window sorts all rows of a key in one task, and a key may hold a third
of the table. The operators here first cut the order into pieces, run the
window inside a piece, and carry only one row per piece across the cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from waybridge.session import durable

PIECE = 4096


def running_total(df: DataFrame, keys: list[str], order: list, value: Column, piece: Column,
                  out: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the same keys, the row itself left out.

    ``piece`` is a coarse, order-preserving cut of the order (for instance a
    position divided by 4096): rows of a later piece come after all rows of an
    earlier one. Totals per piece are summed up first, so a hot key is sorted
    in as many tasks as it has pieces. Rows are shuffled once, by key and piece;
    the window, the totals and the join with what earlier pieces carry share it.
    """
    # a struct makes null keys equal, and one join key for the shuffle that the window has made
    rows = df.withColumn("_key", F.struct(*keys) if keys else F.struct(F.lit(0))).withColumn("_piece", piece).withColumn(
        "_value", value.cast("long"))
    inside = Window.partitionBy("_key", "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("_key").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_run", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    carried = (
        placed.groupBy("_key", "_piece").agg(F.sum("_value").alias("_total"))
        .withColumn("_carry", F.sum("_total").over(across)).drop("_total")
    )
    return (
        placed.join(carried, ["_key", "_piece"])
        .withColumn(out, F.col("_run") + F.coalesce(F.col("_carry"), F.lit(0)))
        .drop("_key", "_piece", "_value", "_run", "_carry")
    )


def position(df: DataFrame, keys: list[str], order: list, piece: Column, out: str) -> DataFrame:
    """One-based row number inside the keys, worked out piece by piece."""
    numbered = running_total(df, keys, order, F.lit(1), piece, out)
    return numbered.withColumn(out, (F.col(out) + 1).cast("long"))


def sliced(df: DataFrame, order: list[str]) -> DataFrame:
    """Range-partition a table on a unique order and keep the slice number in ``_slice``.

    Slice limits are sampled, so a heavy day is cut as finely as a light month.
    The result is written to the checkpoint folder: later steps read the slices
    from there and never see another sampling of the limits.
    """
    return durable(
        df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id())
    )


def neighbours(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """Add structs ``prev`` and ``next`` with ``columns`` of the neighbouring rows.

    ``order`` must identify a row. Rows look at their neighbours inside a slice;
    the first and last row of a slice look at the edge rows of the slices
    beside it, of which there are at most two per slice.
    """
    rows = sliced(df, order)
    inside = Window.partitionBy("_slice").orderBy(*order)
    payload = F.struct(*columns)
    key = F.struct(*order)
    edges = rows.groupBy("_slice").agg(
        F.min_by(payload, key).alias("_first"), F.max_by(payload, key).alias("_last"))
    # one row per slice: the number of shuffle partitions bounds this window
    between = Window.orderBy("_slice")
    edges = edges.select(
        "_slice",
        F.lag("_last").over(between).alias("_before"),
        F.lead("_first").over(between).alias("_after"),
    )
    return (
        rows.withColumn("prev", F.lag(payload).over(inside))
        .withColumn("next", F.lead(payload).over(inside))
        .join(edges, "_slice")
        .withColumn("prev", F.coalesce("prev", "_before"))
        .withColumn("next", F.coalesce("next", "_after"))
        .drop("_slice", "_before", "_after")
    )

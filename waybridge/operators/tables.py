"""Next snapshots of stored tables, their differences and change logs.

Parquet has no row mutation: every operator returns the complete next snapshot, which
is written beside the old one (see ``sinks``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def patch_upsert(old: DataFrame, patch: DataFrame, keys: list[str], fields: list[str],
                 provided: str = "provided") -> DataFrame:
    """Change only the fields named in the patch row's ``provided`` array; insert new keys."""
    a, b = old.alias("a"), patch.alias("b")
    given = lambda f: F.coalesce(F.array_contains(F.col(f"b.{provided}"), f), F.lit(False))
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    return a.join(b, on, "full").select(
        *[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys],
        *[F.when(given(f), F.col(f"b.{f}")).otherwise(F.col(f"a.{f}")).alias(f) for f in fields])


def fill_nulls(old: DataFrame, seed: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Insert absent keys and fill only columns that are null."""
    a, b = old.alias("a"), seed.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    return a.join(b, on, "full").select(
        *[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys],
        *[F.coalesce(f"a.{f}", f"b.{f}").alias(f) for f in fields])


def insert_absent(old: DataFrame, seed: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(seed.join(old.select(*keys), keys, "left_anti"))


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Full-row upsert; of several new rows for a key the last in ``order`` wins."""
    columns = [c for c in old.columns]
    if order is not None:
        new = new.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("r")).select("r.*")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*columns))


def rejected_creates(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in mode ``create`` whose key is already taken."""
    return new.where("mode = 'create'").join(old.select(*keys), keys, "left_semi")


def replace_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Replace everything under the new rows' keys (a batch is saved again as a whole)."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def keyed_update(old: DataFrame, decisions: DataFrame, key: str, changes: dict[str, Column]) -> DataFrame:
    """Rows named by a decision get new values; ``changes`` may refer to decision columns as ``d.x``."""
    a, d = old.alias("a"), decisions.alias("d")
    hit = F.col(f"d.{key}").isNotNull()
    return a.join(d, F.col(f"a.{key}") == F.col(f"d.{key}"), "left").select(
        *[F.when(hit, changes[c]).otherwise(F.col(f"a.{c}")).alias(c) if c in changes else F.col(f"a.{c}")
          for c in old.columns])


def field_changes(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per changed field with both values as text."""
    a, b = before.alias("a"), after.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    entries = F.array(*[
        F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.struct(
            F.lit(f).alias("field"), F.col(f"a.{f}").cast("string").alias("before_value"),
            F.col(f"b.{f}").cast("string").alias("after_value")))
        for f in fields])
    return a.join(b, on).select(
        *[F.col(f"a.{k}").alias(k) for k in keys],
        F.inline(F.filter(entries, lambda e: e.isNotNull())))


def table_diff(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Problems between two versions of a table: missing keys and differing columns."""
    a = left.select(*keys, F.lit(True).alias("_l"), *fields).alias("a")
    b = right.select(*keys, F.lit(True).alias("_r"), *fields).alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    differing = F.filter(F.array(*[
        F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]), lambda f: f.isNotNull())
    problem = (F.when(F.col("_r").isNull(), "missing_right").when(F.col("_l").isNull(), "missing_left")
               .when(F.size("columns") > 0, "differs"))
    return (
        a.join(b, on, "full")
        .select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], "_l", "_r", differing.alias("columns"))
        .withColumn("problem", problem).where("problem is not null")
        .withColumn("columns", F.when(F.col("problem") == "differs", F.concat_ws(",", "columns")))
        .drop("_l", "_r")
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    return reduce(lambda x, y: x.unionByName(y), parts)

"""Decisions on imports and on paired ledgers, written into the stored ledgers in one commit.

Rows are decided against trips as they are stored at the time of the commit: a writer that comes too late looks
again (see ``store``). Of several import rows for a trip the last filled cell of each field wins; of paired rows the
last one decides a trip's basic fields, blank cells included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waybridge import constants as C
from waybridge.functions.dates import ledger_date
from waybridge.functions.numbers import money, whole_number
from waybridge.functions.text import strip
from waybridge.operators.importing import apply_decisions
from waybridge.operators.pairing import apply_pairs
from waybridge.operators.store import Kept, Store
from waybridge.session import written

AMOUNT = "decimal(18,2)"
COUNTS = ["wagon_count", "container_40hd", "container_20hd"]
NUMBER = "trip_no string, base string, suffix int"


def _amounts(fields: list[str]) -> str:
    return ", ".join(f"{f} {AMOUNT}" for f in fields)


TABLES = {
    "trips": Kept(f"{NUMBER}, goods_name string, {', '.join(f'{c} int' for c in COUNTS)}, teu_total {AMOUNT}, changed_by string", ["trip_no"]),
    "settlements": Kept(f"trip_no string, {_amounts(C.SETTLEMENT_FIELDS)}, diff_reason string, record_status string, changed_by string", ["trip_no"]),
    "subsidies": Kept(f"trip_no string, {_amounts(C.SUBSIDY_FIELDS)}, diff_reason string, changed_by string", ["trip_no"]),
    "prepayments": Kept(f"trip_no string, paid_at date, amount {AMOUNT}, remark string, created_by string"),
    "outcomes": Kept("source string, row_index long, outcome string, trip_no string, created_by string"),
}


def ledger_store(spark: SparkSession, folder: str) -> Store:
    return Store(spark, folder, TABLES)


def _value(field: str) -> Column:
    """A cell as the stored column holds it; null where it is blank or unreadable."""
    cell = F.col(field).cast("string")
    if field in COUNTS:
        return whole_number(cell)
    if field in ("goods_name", "diff_reason"):
        return F.when(strip(cell) != "", cell)
    return money(cell).cast(AMOUNT)


def _patch(rows: DataFrame, fields: list[str], order: str) -> DataFrame:
    """Per trip, the last filled cell of every field; null where there is none."""
    known = [f for f in fields if f in rows.columns]
    cells = rows.select("trip_no", order, *[_value(f).alias(f) for f in known])
    last = cells.groupBy("trip_no").agg(F.max(order).alias("_last"), *[
        F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in known])
    return last.select("trip_no", *[F.col(f) if f in known else F.lit(None).alias(f) for f in fields])


def _patched(old: DataFrame, patch: DataFrame, fields: list[str], fixed: dict[str, Column]) -> DataFrame:
    """Changed rows of a table keyed by trip: new cells where the patch has one, else the old ones."""
    a, b = old.alias("a"), patch.alias("b")
    rest = [c for c in old.columns if c not in (*fields, *fixed, "trip_no")]
    # only rows that the patch names are read back and written
    return b.join(a, F.col("a.trip_no") == F.col("b.trip_no"), "left").select(
        F.col("b.trip_no").alias("trip_no"), *[F.coalesce(f"b.{f}", f"a.{f}").alias(f) for f in fields],
        *[F.col(f"a.{c}").alias(c) for c in rest], *[value.alias(name) for name, value in fixed.items()])


def _trips(tables: dict[str, DataFrame], rows: DataFrame, order: str, by: str, whole: list[str] = ()) -> DataFrame:
    """Created and updated trips; a new one has its base as number. The last row decides the ``whole`` fields, blank or not."""
    new = rows.groupBy("trip_no").agg(F.max("base").alias("_base"), *[
        F.max_by(_value(f), order).alias(f"_{f}") for f in whole])
    patch = _patch(rows, C.TRIP_BASIC_FIELDS, order).join(new, "trip_no")
    a, b = tables["trips"].alias("a"), patch.alias("b")
    basic = lambda f: F.col(f"b._{f}") if f in whole else F.coalesce(f"b.{f}", f"a.{f}")
    return b.join(a, F.col("a.trip_no") == F.col("b.trip_no"), "left").select(
        F.col("b.trip_no").alias("trip_no"), F.coalesce("a.base", "b._base").alias("base"), F.coalesce("a.suffix", F.lit(0)).alias("suffix"),
        *[basic(f).alias(f) for f in C.TRIP_BASIC_FIELDS], F.lit(by).alias("changed_by"))


def _settlements(tables: dict[str, DataFrame], patch: DataFrame, by: str) -> DataFrame:
    fields = [*C.SETTLEMENT_FIELDS, "diff_reason"]
    some = patch.where(F.coalesce(*[F.col(f).cast("string") for f in fields]).isNotNull())
    rows = _patched(tables["settlements"], some, fields, {"changed_by": F.lit(by)})
    return rows.withColumns({"diff_reason": F.coalesce("diff_reason", F.lit("")), "record_status": F.coalesce("record_status", F.lit("pending"))})


def import_rows(store: Store, decided: DataFrame, by: str, kind: str = "trip", order: str = "row_index") -> int:
    """Apply decided import rows (base, decision, cells as text) to the stored ledgers; returns the commit's number.

    Trip rows write trips and settlements, subsidy rows subsidies. What became of each row is kept with them.
    """
    def change(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        rows = written(apply_decisions(decided, tables["trips"], kind, order))
        done = rows.where("outcome in ('created', 'updated')")
        out = {"outcomes": rows.select(F.lit(kind).alias("source"), F.col(order).alias("row_index"), "outcome", "trip_no", F.lit(by).alias("created_by"))}
        if kind == "trip":
            # a new trip takes amounts only; a reason comes with an overwritten one
            cells = done
            if "diff_reason" in done.columns:
                cells = done.withColumn("diff_reason", F.when(F.col("outcome") == "updated", F.col("diff_reason")))
            out["trips"] = _trips(tables, done, order, by)
            out["settlements"] = _settlements(tables, _patch(cells, [*C.SETTLEMENT_FIELDS, "diff_reason"], order), by)
        else:
            fields = [*C.SUBSIDY_FIELDS, "diff_reason"]
            subsidies = _patched(tables["subsidies"], _patch(done, fields, order), fields, {"changed_by": F.lit(by)})
            out["subsidies"] = subsidies.withColumn("diff_reason", F.coalesce("diff_reason", F.lit("")))
        return out

    return store.commit(change)


def pair_rows(store: Store, decisions: DataFrame, by: str, order: str = "decision_order") -> int:
    """Apply decisions on paired rows: trips, settlements and prepayments in one commit.

    The agent's row is the source, the own row where there is none. Cells are ``agent_<field>`` and ``own_<field>``; ``own_pay_date`` is
    a date as people write it.
    """
    sided = [f for f in [*C.TRIP_BASIC_FIELDS, "customs_fee", "service_fee", "actual_freight"]
             if {f"agent_{f}", f"own_{f}"} & set(decisions.columns)]

    def cell(f: str) -> Column:
        own = F.col(f"own_{f}") if f"own_{f}" in decisions.columns else F.lit(None)
        agent = F.col(f"agent_{f}") if f"agent_{f}" in decisions.columns else F.lit(None)
        # settlement amounts are the agent's alone
        fallback = own if f in C.TRIP_BASIC_FIELDS else F.lit(None)
        return F.when(F.col("agent_row_index").isNotNull(), agent).otherwise(fallback).cast("string").alias(f)

    def change(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        acts = apply_pairs(decisions, tables["trips"], order)
        paid = ledger_date(F.col("own_pay_date").cast("string")) if "own_pay_date" in decisions.columns else F.lit(None).cast("date")
        cells = decisions.select(F.col(order).alias("_order"), paid.alias("paid_at"), *[cell(f) for f in sided])
        rows = written(acts.join(cells, F.col(order) == F.col("_order")).drop("_order").withColumn("base", F.col("trip_no")))
        done = rows.where("action in ('created', 'updated')")
        return {
            "outcomes": rows.select(F.lit("pair").alias("source"), F.col(order).alias("row_index"), F.col("action").alias("outcome"),
                                    F.coalesce("trip_no", F.lit("")).alias("trip_no"), F.lit(by).alias("created_by")),
            "trips": _trips(tables, done, order, by, [f for f in sided if f in C.TRIP_BASIC_FIELDS]),
            "settlements": _settlements(tables, _patch(done, [*C.SETTLEMENT_FIELDS, "diff_reason"], order), by),
            "prepayments": done.where("prepay is not null").select(
                "trip_no", "paid_at", F.col("prepay").alias("amount"), F.lit("ledger pairing").alias("remark"), F.lit(by).alias("created_by")),
        }

    return store.commit(change)

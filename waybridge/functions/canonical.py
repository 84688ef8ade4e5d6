"""Canonical text and content versions of document fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FIELD_TYPE = "struct<kind:string,text:string,items:array<string>>"


def canonical_value(field: Column) -> Column:
    """Kind and text of one field; numbers and strings of equal spelling stay apart."""
    return F.concat_ws(":", field["kind"], field["text"])


def canonical_fields(fields: Column) -> Column:
    """Fields as sorted ``name=kind:text`` entries."""
    entries = F.transform(
        F.map_entries(fields), lambda e: F.to_json(F.struct(e["key"].alias("f"), canonical_value(e["value"]).alias("v")))
    )
    return F.concat_ws(",", F.array_sort(entries))


def canonical_json(raw: Column) -> Column:
    """JSON text with the keys of every object sorted, at any depth, and no blanks; null where it cannot be read.

    A VARIANT keeps object keys in order and plain decimals without trailing zeros, so its text is one for all spellings.
    Numbers with an exponent stay doubles. An object with a key twice cannot be read.
    """
    return F.to_json(F.try_parse_json(raw))


def short_hash(text: Column, length: int = 16) -> Column:
    return F.left(F.sha2(text, 256), F.lit(length))


def route_signature(waybill_type: Column, route: Column) -> Column:
    payload = F.concat(F.lit("ROUTE-001|"), waybill_type, F.lit("|"), F.concat_ws(",", route))
    return F.left(F.sha1(payload), F.lit(16))


def pair_signature(a: Column, b: Column) -> Column:
    """Signature of two texts that does not depend on their order."""
    pair = F.concat_ws("||", F.array_sort(F.array(F.trim(a), F.trim(b))))
    return F.left(F.sha1(F.concat(F.lit("CONS-001|"), pair)), F.lit(16))


def field_state(status: Column, value: Column) -> Column:
    """State named by evidence, else recognised when a value is present."""
    present = value.isNotNull() & (value["kind"] != "VOID") & ~value["text"].isin("", "[]", "{}")
    return F.coalesce(
        F.when(status.isin("recognized", "needs_review", "not_found", "business_missing", "not_applicable"), status),
        F.when(present, "recognized").otherwise("not_found"),
    )


def confidence_tag(state: Column) -> Column:
    return F.when(state == "recognized", "high").when(state == "needs_review", "review").otherwise("missing")

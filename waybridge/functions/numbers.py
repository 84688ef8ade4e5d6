"""Number contracts as Spark column expressions.

A parsed number is ``struct<value double, code string>`` with code one of
``ok``, ``with_unit``, ``not_numeric`` and ``missing``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from waybridge import constants as C
from waybridge.functions.text import strip

MONEY = "decimal(28,10)"


def _parsed(value: Column | None, code: str) -> Column:
    value = F.lit(None).cast("double") if value is None else value
    return F.struct(value.alias("value"), F.lit(code).alias("code"))


def plain_number(bare: Column) -> Column:
    """Value of a stripped text that is nothing but a number, else null."""
    return F.when(bare.rlike(C.NUMBER_PATTERN), F.replace(bare, F.lit(","), F.lit("")).try_cast("double"))


def number_contract(bare: Column, kind: Column | None = None, value: Column | None = None) -> Column:
    """Contract of a text that is already stripped; see ``parse_number``.

    ``value`` may name a column that holds ``plain_number`` of the text.
    """
    value = plain_number(bare) if value is None else value
    # numbers beyond the double range become infinite and are refused
    parsed = (
        F.when(bare.isNull() | (bare == ""), _parsed(None, "missing"))
        .when(F.abs(value) < float("inf"), _parsed(value, "ok"))
        .when(value.isNull() & bare.rlike(C.WITH_UNIT_PATTERN), _parsed(None, "with_unit"))
        .otherwise(_parsed(None, "not_numeric"))
    )
    if kind is None:
        return parsed
    as_double = bare.try_cast("double")
    native = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return (
        F.when(kind == "STRING", parsed)
        .when(kind == "VOID", _parsed(None, "missing"))
        .when(kind == "BOOLEAN", _parsed(None, "not_numeric"))
        .when(native & (F.abs(as_double) < float("inf")), _parsed(as_double, "ok"))
        .when(native, _parsed(None, "not_numeric"))
        .otherwise(parsed)
    )


def parse_number(text: Column, kind: Column | None = None) -> Column:
    """Strict contract: plain or comma-grouped digits only; units and remarks are set apart.

    ``kind`` is the JSON type of the source value; a boolean is never a number.
    """
    return number_contract(strip(text), kind)


def package_contract(number: Column) -> Column:
    """Package count from a parsed number: positive and whole; fractions are left for review."""
    return (
        F.when(number["value"] <= 0, _parsed(None, "not_numeric"))
        .when(number["value"] != F.floor(number["value"]), _parsed(number["value"], "with_unit"))
        .otherwise(number)
    )


def parse_packages(text: Column, kind: Column | None = None) -> Column:
    return package_contract(parse_number(text, kind))


def money(text: Column) -> Column:
    """Lenient amount: thousands commas and currency signs dropped, null when unreadable."""
    return F.translate(strip(text.cast("string")), ",¥元", "").try_cast(MONEY)


def same_number_text(new: Column, old: Column) -> Column:
    """Equal as amounts when both are amounts, else equal as trimmed text."""
    a, b = money(new), money(old)
    both = a.isNotNull() & b.isNotNull()
    plain = strip(F.coalesce(new.cast("string"), F.lit(""))) == strip(F.coalesce(old.cast("string"), F.lit("")))
    return F.when(both, a == b).otherwise(plain)


def whole_number(text: Column) -> Column:
    """Whole part of a cell holding a count; null for blanks and words."""
    return strip(text).try_cast("double").try_cast("int")


def edited_number(text: Column) -> Column:
    """Text of an edit box: numbers rounded to two places, other text as typed, blank as null."""
    bare = strip(text)
    num = parse_number(bare)
    rounded = F.round(F.regexp_replace(bare, ",", "").try_cast(MONEY), 2).cast("decimal(38,2)").cast("string")
    return F.when(bare != "", F.when(num["code"] == "ok", rounded).otherwise(bare))

"""Field values from page text and from lines with positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waybridge import constants as C
from waybridge.functions import text as T
from waybridge.functions.numbers import number_contract, package_contract

WORD_FIELDS = ["invoice_no", "packing_list_no", "waybill_no", "declaration_no", "co_no", "currency"]
WEIGHTS = ["gross_weight_kg", "net_weight_kg"]
AMOUNTS = ["total_amount", "declared_value"]


def caption_pattern(field: str, caption: str) -> str:
    """Caption, rest of its words, a colon and the value on the same line."""
    number = r"[\d,]+(?:\.\d+)?"
    if field in WORD_FIELDS:
        value = r"(\S+)"
    elif field == "container_no":
        value = "([A-Z0-9]+)"
    elif field in WEIGHTS:
        value = rf"({number}(?:[ \t]*[A-Za-z一-龥]+)?)"
    elif field in AMOUNTS:
        value = rf"(?:USD)?[ \t]*({number})"
    elif field == "total_packages":
        value = f"({number})"
    else:
        value = "(.+)"
    if caption in C.LOOSE_CAPTIONS:
        return rf"(?iudU){caption}[ \t]*[:：]?[ \t]*{value}"
    return rf"(?iudU){caption}[^:：\n]*[:：][ \t]*{value}"


def captured(text: Column, field: str, captions: list[str]) -> Column:
    """First caption with a non-blank value, in order of preference."""
    found = [F.nullif(T.strip(F.regexp_extract(text, caption_pattern(field, c), 1)), F.lit("")) for c in captions]
    return F.coalesce(*found)


def extract_fields(docs: DataFrame) -> DataFrame:
    """``file, group_no, doc_type, text`` to one row per field of the type; raw is null when not found.

    Every pattern runs only for documents of its own type.
    """
    per_type = []
    for doc_type, fields in C.CAPTIONS.items():
        entries = F.array(*[
            F.struct(F.lit(f).alias("field"), captured(F.col("text"), f, caps).alias("raw"))
            for f, caps in fields.items()])
        per_type.append(F.when(F.col("doc_type") == doc_type, entries))
    keep = [c for c in docs.columns if c != "text"]
    return docs.select(*keep, F.inline(F.coalesce(*per_type)))


def finalize(rows: DataFrame) -> DataFrame:
    """Add ``value`` and ``confidence`` (high, review, missing) to extracted ``field, raw``."""
    bare = T.strip(F.regexp_replace("raw", "[，,；;。 ]+$", ""))
    rows = rows.withColumn("_bare", bare)
    unit = F.lower(F.regexp_extract("_bare", r"^[\d,]+(?:\.\d+)?[ \t]*([A-Za-z一-龥]*)$", 1))
    amount = F.regexp_extract("_bare", r"^([\d,]+(?:\.\d+)?)[ \t]*[A-Za-z一-龥]*$", 1)
    rows = rows.withColumn("_num", number_contract(F.when(
        F.col("field").isin(*WEIGHTS) & (amount != ""), amount).otherwise(F.col("_bare"))))
    ok = F.col("_num")["code"] == "ok"
    whole = package_contract(F.col("_num"))["code"] != "with_unit"
    wrong_unit = (unit != "") & ~unit.isin(*C.KG_UNITS)
    numeric_high = (
        F.when(F.col("field").isin(*WEIGHTS), ok & ~wrong_unit)
        .when(F.col("field") == "total_packages", ok & whole).otherwise(ok))
    is_number = F.col("field").isin(*C.NUMERIC_FIELDS)
    confidence = (
        F.when(F.coalesce("_bare", F.lit("")) == "", "missing")
        .when(~is_number, "high").when(numeric_high, "high").otherwise("review"))
    value = F.when(is_number & numeric_high, F.col("_num")["value"].cast("decimal(38,4)").cast("string")).otherwise(
        F.nullif(F.col("_bare"), F.lit("")))
    return rows.withColumn("value", value).withColumn("confidence", confidence).drop("_bare", "_num")

"""Rules that one document must satisfy on its own, held as rows of a table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waybridge import constants as C
from waybridge.functions.numbers import parse_number
from waybridge.functions.text import is_blank, strip
from waybridge.session import written

RULE_SCHEMA = ("rule_id string, doc_type string, field string, rule_type string, pattern string, "
               "min double, max double, severity string, message string, suggestion string, "
               "enabled boolean")


def default_rules(spark: SparkSession) -> DataFrame:
    """The published rule set; ``rule_order`` keeps the order of definition."""
    rows = []
    for i, (rule_id, doc_type, field, kind, low, severity, enabled) in enumerate(C.DOC_RULES):
        wording = "out of range" if kind == "range" else "missing"
        rows.append((rule_id, doc_type, field, kind, None, low, None, severity,
                     f"{doc_type}.{field} {wording}", f"complete or correct {field}", enabled, i))
    return spark.createDataFrame(rows, RULE_SCHEMA + ", rule_order int")


def rule_rows(spark: SparkSession, raw: list[dict]) -> DataFrame:
    """Rules written by hand, as a table; patterns that do not compile are blanked.

    A rule list is configuration, read once where the job starts.
    """
    rows = []
    for i, rule in enumerate(raw):
        pattern = rule.get("pattern")
        try:
            re.compile(pattern or "")
        except re.error:
            pattern = None
        rows.append((rule.get("rule_id") or f"rules[{i}]", rule.get("doc_type"), rule.get("field"),
                     rule.get("rule_type"), pattern, rule.get("min"), rule.get("max"),
                     rule.get("severity"), rule.get("message"), rule.get("suggestion"),
                     rule.get("enabled", True), i))
    return spark.createDataFrame(rows, RULE_SCHEMA + ", rule_order int")


def rule_problems(rules: DataFrame) -> DataFrame:
    """Enabled rules that cannot be used, with the reason."""
    return _judged(rules).where("problem is not null").select("rule_id", "problem")


def usable_rules(rules: DataFrame) -> DataFrame:
    """Enabled and well-formed rules with defaults filled in."""
    return (
        _judged(rules).where("problem is null").drop("problem")
        .withColumn("severity", F.coalesce("severity", F.lit("warning")))
        .withColumn("message", F.coalesce("message", "rule_id"))
        .withColumn("suggestion", F.coalesce("suggestion", "message"))
    )


def _judged(rules: DataFrame) -> DataFrame:
    problem = (
        F.when(~F.coalesce(F.col("rule_type"), F.lit("")).isin("required", "format", "range"), "bad rule_type")
        .when((F.coalesce("doc_type", F.lit("")) == "") | (F.coalesce("field", F.lit("")) == ""),
              "doc_type or field missing")
        .when((F.col("rule_type") == "format") & F.col("pattern").isNull(), "pattern missing or invalid")
    )
    return rules.where(F.coalesce("enabled", F.lit(True))).withColumn("problem", problem)


def filled_fields(fields: Column) -> Column:
    """Names of the fields that hold something: no null, blank text, empty list or object."""
    def holds(value: Column) -> Column:
        text = value["text"]
        return (value["kind"] != "VOID") & text.isNotNull() & ~is_blank(text) & ~text.isin("[]", "{}")

    return F.map_keys(F.map_filter(fields, lambda k, v: F.coalesce(holds(v), F.lit(False))))


def rules_by_type(rules: DataFrame) -> DataFrame:
    """One row per document type with its rules as an array, and the fields that they name.

    Rules stand in the order of the issues they make: fails first, then as defined. The rule set is a hand-kept list, so an
    array per type stays short.
    """
    issue = F.struct("field", "rule_id", "severity", "message", "rule_order").alias("issue")
    return usable_rules(rules).groupBy("doc_type").agg(
        F.array_sort(F.collect_list(F.struct(
            (F.col("severity") != "fail").alias("later"), "rule_order", "field", "rule_type", "pattern", "min", "max", issue))).alias("rules"),
        F.collect_set("field").alias("named"), F.bool_or(F.col("rule_type") != "required").alias("further"))


def _violated(rule: Column, fields: Column, meta: Column) -> Column:
    missing = F.array_contains(F.col("gaps"), rule["field"])
    has_meta = F.coalesce(F.size(meta), F.lit(0)) > 0
    status = F.try_element_at(meta, rule["field"])["status"]
    value = F.try_element_at(fields, rule["field"])
    number = parse_number(value["text"], value["kind"])
    outside = (F.coalesce(number["value"] < rule["min"], F.lit(False))
               | F.coalesce(number["value"] > rule["max"], F.lit(False)))
    return F.coalesce(
        F.when(rule["rule_type"] == "required",
               missing & F.when(has_meta, status == C.BUSINESS_MISSING).otherwise(True))
        .when(rule["rule_type"] == "format",
              ~missing & ~F.rlike(strip(value["text"]), F.concat(F.lit("^(?:"), rule["pattern"], F.lit(")$"))))
        .when(rule["rule_type"] == "range", (number["code"] == "ok") & outside),
        F.lit(False),
    )


def with_rule_issues(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``rule_issues`` (fails first, then definition order) to every document.

    Rules travel to the documents as one small array per type, so documents are
    neither exploded nor shuffled. The arrays are written first: a list made in the driver has
    no known size, and a join planned without it deals whole documents out by their few types.
    """
    per_type = written(rules_by_type(rules))
    # the gaps are read twice: a column that is read once would be worked out inside the lambda, for every rule anew
    some = F.when((F.size("gaps") > 0) | F.col("further"), F.col("rules"))
    broken = F.filter(
        F.coalesce(some, F.array().cast(per_type.schema["rules"].dataType)),
        lambda r: _violated(r, F.col("fields"), F.col("field_meta")),
    )
    return (
        docs.join(per_type, "doc_type", "left")
        # one pass over sets instead of a search per rule
        .withColumn("gaps", F.array_except("named", filled_fields(F.col("fields"))))
        .withColumn("rule_issues", broken["issue"])
        .drop("rules", "named", "further", "gaps")
    )

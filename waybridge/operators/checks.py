"""Document checks over all batches at once.

Shape of the work:

* ``prepare`` turns each document into a flat row of parsed values (no shuffle);
* ``batch_facts`` folds those rows to one row per batch. Only numeric buffers are
  used, so Spark hash-aggregates them before the shuffle and a batch that holds a
  large share of all documents costs one partial row per task;
* ``text_facts`` does the same for values that have to agree as text, through
  groups of equal text, so no group is ever collected;
* ``statuses`` is a projection over those one-row-per-batch facts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from waybridge import constants as C
from waybridge.functions import similarity as S, text as T
from waybridge.functions.canonical import canonical_value
from waybridge.functions.numbers import number_contract, package_contract, plain_number
from waybridge.operators.rules import with_rule_issues
from waybridge.session import written

# check id, status column, position in the report
CHECKS = [
    ("SYS-001", "sys_001", 1), ("DOC-001", "doc_001", 2), ("DOC-002", "doc_002", 3),
    ("DOC-003", "doc_003", 4), ("DOC-004", "doc_004", 5), ("CONS-001", "cons_001", 7),
    ("CONS-002", "cons_002", 8), ("CONS-003", "cons_003", 9), ("CONS-004", "cons_004", 10),
    ("CONS-005", "cons_005", 11), ("CONS-006", "cons_006", 12), ("CONS-007", "cons_007", 13),
    ("CONS-008", "cons_008", 14), ("ROUTE-002", "route_002", 15),
]
RULE_CHECK, RULE_ORDER = "DOC-101", 6
ROUTE_CHECK, ROUTE_ORDER = "ROUTE-001", 16
ALL_CHECKS = [c[0] for c in CHECKS] + [RULE_CHECK, ROUTE_CHECK]
TEXT_CHECKS = {"CONS-001", "CONS-002", "CONS-004", "CONS-005", "CONS-006", "CONS-007", "CONS-008",
               "ROUTE-002"}
ENDS = "␟"
MALFORMED = "␀"


FIELDS = C.COMPARED_FIELDS


def opened(docs: DataFrame, names: list[str]) -> DataFrame:
    """Look every named field up once: ``name_text`` (stripped, null when absent or blank),
    ``name_kind`` and ``name_value`` for numbers, and the route as a struct.

    One small step after the other: later steps refer to columns instead of repeating
    expressions, and the rows stay narrow enough for whole-stage code generation. Documents that
    carry their fields by name in ``known`` are read there, so that unused ones are never
    built; others are looked up in the map.
    """
    keep = [c for c in docs.columns if c != "known"]
    numeric = [n for n in names if n in C.NUMERIC_FIELDS]
    by_name = "known" in docs.columns
    at = lambda n: F.col("known")[n] if by_name else F.try_element_at(F.col("fields"), F.lit(n))
    docs = docs.select(
        *keep, *[at(n)["text"].alias(f"{n}_raw") for n in names if n != "route_countries"],
        *[at(n)["kind"].alias(f"{n}_kind") for n in numeric], at("route_countries").alias("route_countries"))
    kinds = [f"{n}_kind" for n in numeric]
    raws = [n for n in names if n != "route_countries"]
    untouched = ["departure_country", "destination_country"]
    docs = docs.select(*keep, *kinds, "route_countries", *[f"{n}_raw" for n in untouched],
                       *[T.strip(F.col(f"{n}_raw")).alias(f"{n}_text") for n in raws],
                       T.strip(F.col("route_countries")["text"]).alias("route_countries_text"))
    docs = docs.select(*keep, *kinds, "route_countries", *[f"{n}_raw" for n in untouched],
                       *[F.nullif(F.col(f"{n}_text"), F.lit("")).alias(f"{n}_text") for n in names])
    return docs.select("*", *[plain_number(F.col(f"{n}_text")).alias(f"{n}_value") for n in numeric])


def is_list(value: Column) -> Column:
    return F.startswith(value["kind"], F.lit("ARRAY"))


def _route_state() -> Column:
    """Route check of one waybill: ``PASS``, ``WARNING`` or ``FAIL`` (null for other documents)."""
    route = F.col("route")
    kind = F.col("waybill_kind")
    smgs = F.array(*[F.lit(c) for c in C.SMGS_COUNTRIES])
    cim = F.array(*[F.lit(c) for c in C.CIM_COUNTRIES])
    union = F.array_union(smgs, cim)
    own = F.when(kind == "smgs", smgs).when(kind == "cim", cim).otherwise(union)
    return F.when(
        F.col("is_waybill"),
        F.when(F.col("waybill_type").isNull() | ~F.col("has_route") | F.col("route_malformed"), C.WARNING)
        .when(kind.isNull(), C.FAIL)
        .when(F.size(F.array_except(route, union)) > 0, C.FAIL)
        .when(F.size(F.array_except(route, own)) > 0, C.WARNING)
        .otherwise(C.PASS),
    )


def _identity_problem() -> Column:
    """0 complete, 1 needs a look, 2 fails: unknown type, empty document, missing number."""
    missing, state = F.lit(False), F.lit(None).cast("string")
    for doc_type, name in C.IDENTITY_FIELDS.items():
        here = F.col("doc_type") == doc_type
        meta = F.try_element_at(F.col("field_meta"), F.lit(name))["status"]
        missing = missing | (here & F.col(f"{name}_text").isNull())
        state = F.when(here, meta).otherwise(state)
    return (
        F.when(F.col("doc_type") == C.UNKNOWN, 1)
        .when(F.coalesce(F.size("fields"), F.lit(0)) <= 0, 2)
        .when(missing & (state == C.BUSINESS_MISSING), 2)
        .when(missing, 1)
        .otherwise(0)
    )


def prepare(docs: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """One flat row per document with everything the checks compare."""
    docs = docs.withColumn("doc_type", F.coalesce("doc_type", F.lit(C.UNKNOWN)))
    extra = []
    if rules is not None:
        docs = with_rule_issues(docs, rules)
        fails = F.exists("rule_issues", lambda i: i["severity"] == "fail")
        extra = ["rule_issues", F.when(
            F.col("doc_type") != C.UNKNOWN,
            F.when(fails, C.FAIL).when(F.size("rule_issues") > 0, C.WARNING).otherwise(C.PASS),
        ).alias("rule_state")]
    number = lambda name: number_contract(F.col(f"{name}_text"), F.col(f"{name}_kind"), F.col(f"{name}_value"))
    text = lambda name: F.col(f"{name}_text")
    route = F.col("route_countries")
    declared_type = T.squeeze(text("waybill_type"))
    flat = opened(docs, FIELDS).select(
        "batch_id", "doc_index", "doc_id", "doc_type", *extra,
        F.col("doc_type").isin(*C.WAYBILL_TYPES).alias("is_waybill"),
        (F.col("doc_type") == C.CUSTOMS).alias("is_customs"),
        (F.col("doc_type") == "invoice").alias("is_invoice"),
        _identity_problem().alias("identity_problem"),
        T.squeeze(text("goods_description")).alias("goods"),
        text("total_packages").isNotNull().alias("has_packages"),
        number("total_packages").alias("packages"),
        text("gross_weight_kg").isNotNull().alias("has_weight"),
        number("gross_weight_kg").alias("weight"),
        T.party_key(text("consignor_name")).alias("consignor"),
        T.party_key(text("consignee_name")).alias("consignee"),
        T.waybill_key(text("waybill_no")).alias("waybill_no"),
        T.container_key(text("container_no")).alias("container"),
        number("total_amount").alias("amount"),
        number("declared_value").alias("declared"),
        F.upper(T.squeeze(text("currency"))).alias("currency"),
        F.when((F.col("doc_type") == "smgs_rail_waybill") & declared_type.isNull(), "SMGS")
        .otherwise(declared_type).alias("waybill_type"),
        F.when(is_list(route), route["items"]).alias("route"),
        F.coalesce(text("route_countries").isNotNull() & ~text("route_countries").isin("[]", "{}"),
                   F.lit(False)).alias("has_route"),
        F.coalesce((route["kind"] != "ARRAY<STRING>") | F.exists(route["items"], lambda c: c.isNull()),
                   F.lit(False)).alias("route_malformed"),
        field_value("departure_country").alias("departure"),
        field_value("destination_country").alias("destination"),
    )
    flat = flat.withColumns({
        "waybill_kind": T.waybill_kind(F.col("waybill_type")),
        "packages": package_contract(F.col("packages")),
    })
    return flat.withColumn("route_state", _route_state())


def field_value(name: str) -> Column:
    """The untouched text of an opened field, null when blank."""
    return F.when(F.col(f"{name}_text").isNotNull(), F.col(f"{name}_raw"))


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def batch_facts(flat: DataFrame, rules_applied: bool) -> DataFrame:
    """Counts, extremes and first values per batch, all on fixed-width buffers."""
    idx = F.col("doc_index")
    code = lambda name: F.col(name)["code"]
    value = lambda name: F.col(name)["value"]
    pkg_ok = F.col("has_packages") & (code("packages") == "ok")
    wt_ok = F.col("has_weight") & (code("weight") == "ok") & (value("weight") > 0)
    cus_ok = F.col("is_customs") & (code("declared") == "ok") & (value("declared") > 0)
    first = lambda what, cond: F.min_by(what, F.when(cond, idx))
    type_flags = [
        F.max((F.col("doc_type") == t).cast("int")).alias(f"has_{t}")
        for t in C.REQUIRED_DOC_TYPES if t != "railway_waybill"
    ]
    aggregates = [
        F.count("*").alias("n_docs"),
        *type_flags,
        F.max(F.col("is_waybill").cast("int")).alias("has_railway_waybill"),
        F.max("identity_problem").alias("identity_problem"),
        _count(F.col("has_packages")).alias("n_packages"),
        _count(F.col("has_packages") & ~code("packages").isin("ok", "with_unit")).alias("n_packages_illegal"),
        _count(F.col("has_packages") & (code("packages") == "with_unit")).alias("n_packages_review"),
        F.min(F.when(pkg_ok, value("packages"))).alias("min_packages"),
        F.max(F.when(pkg_ok, value("packages"))).alias("max_packages"),
        _count(F.col("has_weight")).alias("n_weight"),
        _count(F.col("has_weight") & ~wt_ok & (code("weight") != "with_unit")).alias("n_weight_illegal"),
        _count(F.col("has_weight") & (code("weight") == "with_unit")).alias("n_weight_review"),
        _count(wt_ok).alias("n_weight_legal"),
        F.min(F.when(wt_ok, value("weight"))).alias("min_weight"),
        F.max(F.when(wt_ok, value("weight"))).alias("max_weight"),
        F.coalesce(first(value("weight"), wt_ok & F.col("is_invoice")),
                   first(value("weight"), wt_ok)).alias("base_weight"),
        _count(F.col("is_invoice")).alias("n_invoices"),
        _count(F.col("is_customs")).alias("n_customs"),
        _count(F.col("is_waybill")).alias("n_waybills"),
        F.min(F.when(F.col("is_invoice"), idx)).alias("first_invoice"),
        F.min(F.when(F.col("is_waybill"), idx)).alias("first_waybill"),
        F.min(F.when(F.col("is_waybill") & F.col("has_route"), idx)).alias("first_routed"),
        first(value("amount"), F.col("is_invoice")).alias("invoice_amount"),
        first((code("amount") == "with_unit").cast("int"), F.col("is_invoice")).alias("amount_review"),
        first(((code("amount") == "ok") & (value("amount") > 0)).cast("int"),
              F.col("is_invoice")).alias("amount_ok"),
        _count(F.col("is_customs") & ~cus_ok).alias("n_declared_illegal"),
        F.min(F.when(cus_ok, value("declared"))).alias("min_declared"),
        F.max(F.when(cus_ok, value("declared"))).alias("max_declared"),
        _count(F.col("is_customs") & F.col("waybill_no").isNull()).alias("n_customs_without_waybill_no"),
        _count(F.col("is_customs") & (F.col("departure").isNull() | F.col("destination").isNull())).alias(
            "n_customs_without_ends"),
        _count(F.col("route_state") == C.FAIL).alias("n_route_fail"),
        _count(F.col("route_state") == C.WARNING).alias("n_route_warning"),
    ]
    if rules_applied:
        aggregates += [
            _count(F.col("rule_state") == C.FAIL).alias("n_rule_fail"),
            _count(F.col("rule_state") == C.WARNING).alias("n_rule_warning"),
            _count(F.col("rule_state").isNotNull()).alias("n_rule_docs"),
        ]
    return flat.groupBy("batch_id").agg(*aggregates)


def text_groups(flat: DataFrame, kinds: list[str]) -> DataFrame:
    """Documents of a batch that carry equal text, one row per (batch, kind, text).

    Partial aggregation folds equal texts before the shuffle, and the shuffle key
    holds the text, so one huge batch spreads over many tasks.
    """
    ends = F.concat(F.col("departure"), F.lit(ENDS), F.col("destination"))
    route_ends = F.when(F.col("route_malformed"), F.lit(MALFORMED)).otherwise(
        F.concat(F.try_element_at("route", F.lit(1)), F.lit(ENDS), F.try_element_at("route", F.lit(-1))))
    values = {
        "goods": F.col("goods"),
        "packages": F.when(F.col("has_packages") & (F.col("packages")["code"] == "ok"),
                           F.col("packages")["value"].cast("decimal(38,0)").cast("string")),
        "consignor": F.col("consignor"),
        "consignee": F.col("consignee"),
        "container": F.col("container"),
        "waybill_no": F.when(F.col("is_waybill") | F.col("is_customs"), F.col("waybill_no")),
        "currency": F.when(F.col("is_invoice"), F.coalesce("currency", F.lit("")))
        .when(F.col("is_customs"), F.col("currency")),
        "ends": F.when(F.col("is_waybill") & F.col("has_route"), route_ends)
        .when(F.col("is_customs"), ends),
    }
    entries = F.filter(
        F.array(*[F.struct(F.lit(k).alias("kind"), values[k].alias("norm")) for k in kinds]),
        lambda e: e["norm"].isNotNull())
    rows = flat.select("batch_id", "doc_index", "is_waybill", "is_customs", "is_invoice",
                       F.inline(entries))
    at = lambda cond: F.min(F.when(F.col(cond), F.col("doc_index")))
    return rows.groupBy("batch_id", "kind", "norm").agg(
        F.count("*").alias("n"),
        F.min("doc_index").alias("first"),
        at("is_waybill").alias("first_waybill"),
        at("is_invoice").alias("first_invoice"),
        _count(F.col("is_customs")).alias("n_customs"),
    )


def text_facts(groups: DataFrame, kinds: list[str]) -> DataFrame:
    """Number of groups, majority text and the cross references, one row per batch."""
    here = lambda k: F.col("kind") == k
    rank = F.struct(F.col("n"), -F.col("first"))
    out = []
    for kind in kinds:
        if kind in ("goods", "packages", "consignor", "consignee", "container"):
            out += [
                _count(here(kind)).alias(f"{kind}_groups"),
                F.sum(F.when(here(kind), F.col("n"))).alias(f"{kind}_values"),
                F.max_by("norm", F.when(here(kind), rank)).alias(f"{kind}_base"),
            ]
    if "waybill_no" in kinds:
        out += [
            _count(here("waybill_no") & F.col("first_waybill").isNotNull()).alias("waybill_numbers"),
            F.sum(F.when(here("waybill_no") & F.col("first_waybill").isNull(), F.col("n_customs"))).alias(
                "waybill_no_unmatched"),
        ]
    if "currency" in kinds:
        customs = here("currency") & (F.col("n_customs") > 0)
        out += [
            F.min_by("norm", F.when(here("currency"), F.col("first_invoice"))).alias("invoice_currency"),
            _count(customs).alias("customs_currencies"),
            F.max(F.when(customs, F.col("norm"))).alias("customs_currency"),
        ]
    if "ends" in kinds:
        baseline = F.when(here("ends"), F.col("first_waybill"))
        out += [
            F.min_by("norm", baseline).alias("route_ends"),
            F.min_by("n_customs", baseline).alias("ends_agreeing"),
            F.sum(F.when(here("ends"), F.col("n_customs"))).alias("ends_given"),
        ]
    return groups.groupBy("batch_id").agg(*out)


def _by_backend(pairs: DataFrame, similarity: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairs with the score of another similarity, asked once per different pair; the gram cosine where it has none."""
    asked = pairs.select(F.col("goods_base").alias("a"), F.col("norm").alias("b")).distinct().select(
        "a", "b", similarity(F.col("a"), F.col("b")).cast("double").alias("given"))
    # written, so that no later step asks again
    within = F.when(F.col("given").isNotNull(), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("given"))), 4))
    scored = written(asked.select("a", "b", within.alias("given")))
    gram = written(scored.where("given is null").select("a", "b", S.similarity(F.col("a"), F.col("b")).alias("score")))
    whole = scored.where("given is not null").select("a", "b", F.col("given").alias("score")).unionByName(gram)
    return pairs.join(whole, (F.col("goods_base") == F.col("a")) & (F.col("norm") == F.col("b"))).drop("a", "b")


def goods_scores(flat: DataFrame, groups: DataFrame | None = None,
                 similarity: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Score of every description that differs from the majority of its batch.

    One row per differing description, with its score, guard and grade. ``similarity`` may be a function of two
    columns or a registered Arrow UDF that gives a score from 0 to 1, or null where it has none.
    """
    groups = text_groups(flat, ["goods"]) if groups is None else groups
    base = text_facts(groups, ["goods"]).where("goods_groups > 1").select("batch_id", "goods_base")
    pairs = groups.join(base, "batch_id").where(F.col("norm") != F.col("goods_base"))
    if similarity is not None:
        return _by_backend(pairs, similarity).select(
            "batch_id", F.col("goods_base").alias("base_text"), F.col("norm").alias("other_text"), F.col("n").alias("n_docs"),
            F.col("first").alias("first_doc"), "score", S.contradiction(F.col("goods_base"), F.col("norm")).alias("guard")).withColumn(
            "grade", S.grade(F.col("score"), F.col("guard")))
    scored = F.struct(
        S.similarity(F.col("goods_base"), F.col("norm")).alias("score"),
        S.contradiction(F.col("goods_base"), F.col("norm")).alias("guard"))
    # through a generator the score is worked out once per pair: filters on it stay above
    return (
        pairs.select("batch_id", F.col("goods_base").alias("base_text"), F.col("norm").alias("other_text"),
                     F.col("n").alias("n_docs"), F.col("first").alias("first_doc"), F.inline(F.array(scored)))
        .withColumn("grade", S.grade(F.col("score"), F.col("guard")))
    )


def type_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("batch_id", F.coalesce("doc_type", F.lit(C.UNKNOWN)).alias("doc_type")).agg(
        F.count("*").alias("actual"))


def declared_counts(batches: DataFrame) -> DataFrame:
    return batches.where("declared is not null").select(
        "batch_id", F.explode("declared").alias("doc_type", "declared")).where("declared >= 0")


def composition_differences(docs: DataFrame, batches: DataFrame) -> DataFrame:
    """Declared against actual number of documents, per batch and type."""
    declared = declared_counts(batches)
    wanted = batches.where("declared is not null and size(declared) > 0").select("batch_id")
    actual = type_counts(docs).join(wanted, "batch_id", "left_semi")
    both = actual.join(declared, ["batch_id", "doc_type"], "full")
    return both.select(
        "batch_id", "doc_type", F.col("declared"), F.coalesce("actual", F.lit(0)).alias("actual"),
        F.when(F.col("declared").isNull(), "undeclared")
        .when(F.coalesce("actual", F.lit(0)) < F.col("declared"), "short")
        .when(F.col("actual") > F.col("declared"), "surplus").otherwise("equal").alias("verdict"))


def duplicate_types(docs: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """Types that occur more often than allowed, with the fields that conflict.

    The narrow count runs first and its outcome is written out: with its size known, the
    documents are filtered in place while it is small. Only documents of repeated types are
    opened up, and every comparison is a count per field value instead of document pairs. A predicate
    moves below the projection that builds ``fields``, which a join does not, and the outer form keeps the optimizer
    from testing their size below it: so fields are built for documents of repeated types only.
    """
    counts = type_counts(docs)
    if batches is not None:
        allowed = declared_counts(batches).where("declared > 0").withColumnRenamed("declared", "allowed")
        counts = counts.join(allowed, ["batch_id", "doc_type"], "left")
    else:
        counts = counts.withColumn("allowed", F.lit(None).cast("int"))
    repeated = written(counts.where(F.col("actual") > F.coalesce("allowed", F.lit(1))))
    typed = docs.withColumn("doc_type", F.coalesce("doc_type", F.lit(C.UNKNOWN)))
    # under a name of its own, so that the outer columns are not looked for below the renamed ones
    wanted = repeated.select(F.col("batch_id").alias("_batch"), F.col("doc_type").alias("_type")).alias("repeated").where(
        (F.col("_batch") == F.col("batch_id").outer()) & (F.col("_type") == F.col("doc_type").outer()))
    entries = (
        typed.where(wanted.exists())
        .select("batch_id", "doc_type", F.explode_outer("fields").alias("field", "value"))
        .where("field is not null")
        .groupBy("batch_id", "doc_type", "field", canonical_value(F.col("value")).alias("canonical"))
        .agg(F.count("*").alias("n"))
        .groupBy("batch_id", "doc_type", "field")
        .agg(F.sum("n").alias("holders"), F.count("*").alias("variants"))
    )
    return (
        repeated.join(entries, ["batch_id", "doc_type"], "left")
        .groupBy("batch_id", "doc_type")
        .agg(F.first("actual").alias("n_docs"), F.first("allowed").alias("allowed"),
             _count((F.col("holders") == F.col("actual")) & (F.col("variants") > 1)).alias("conflicting_fields"))
    )


def kinds_for(checks) -> list[str]:
    need = {"CONS-001": "goods", "CONS-002": "packages", "CONS-004": "consignor", "CONS-005": "consignee",
            "CONS-006": "waybill_no", "CONS-007": "container", "CONS-008": "currency", "ROUTE-002": "ends"}
    return [kind for check, kind in need.items() if check in checks]


def _text_agreement(kind: str) -> Column:
    values = F.coalesce(F.col(f"{kind}_values"), F.lit(0))
    return (F.when(values < 2, C.WARNING).when(F.col(f"{kind}_groups") == 1, C.PASS).otherwise(C.FAIL))


def _deviation(value: Column, base: Column) -> Column:
    return F.abs(value - base) / F.when(base > 0, base)


def _worst_deviation(low: str, high: str, base: str) -> Column:
    """Largest relative distance from the base; the extremes bound every value between them."""
    b = F.col(base)
    return F.greatest(_deviation(F.col(low), b), _deviation(F.col(high), b))


def statuses(docs: DataFrame, batches: DataFrame | None = None, rules: DataFrame | None = None,
             checks: list[str] | None = None, flat: DataFrame | None = None,
             groups: DataFrame | None = None, repeated: DataFrame | None = None,
             similarity: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """One row per batch with a status column per check and the facts behind it.

    ``batches`` brings declared compositions and structural problems, ``rules``
    the document rules; without them those checks are left out. ``checks``
    narrows the work to the named checks. ``flat`` and ``groups`` may bring prepared
    rows and text groups that the caller keeps, as both are read more than once, and
    ``repeated`` the outcome of ``duplicate_types``. ``similarity`` takes the place of the gram cosine (see ``goods_scores``).
    """
    wanted = set(checks or ALL_CHECKS)
    use_rules = rules is not None and RULE_CHECK in wanted
    flat = prepare(docs, rules if use_rules else None) if flat is None else flat
    n = lambda name: F.coalesce(F.col(name), F.lit(0))
    out = batch_facts(flat, use_rules)
    if batches is not None:
        out = batches.select("batch_id", F.coalesce(F.size("declared"), F.lit(0)).alias("n_declared"),
                             "structure_problems").join(out, "batch_id", "left")
        out = out.fillna(0, [c for c in out.columns if c.startswith(("n_", "has_"))])
    kinds = kinds_for(wanted)
    if kinds:
        groups = text_groups(flat, kinds) if groups is None else groups
        out = out.join(text_facts(groups, kinds), "batch_id", "left")
    columns: dict[str, Column] = {}
    if "SYS-001" in wanted:
        broken = n("structure_problems") > 0 if batches is not None else F.lit(False)
        columns["sys_001"] = F.when(broken, C.FAIL).otherwise(C.PASS)
    if "DOC-001" in wanted:
        present = [n(f"has_{t}") for t in C.REQUIRED_DOC_TYPES]
        out = out.withColumn("missing_types", F.lit(len(present)) - reduce(lambda a, b: a + b, present))
        columns["doc_001"] = F.when(F.col("missing_types") > 0, C.FAIL).otherwise(C.PASS)
    if "DOC-002" in wanted:
        columns["doc_002"] = (F.when(n("identity_problem") == 2, C.FAIL)
                              .when(n("identity_problem") == 1, C.WARNING).otherwise(C.PASS))
    if "DOC-003" in wanted:
        repeated = duplicate_types(docs, batches) if repeated is None else repeated
        repeats = repeated.groupBy("batch_id").agg(
            F.count("*").alias("repeated_types"),
            _count(F.col("conflicting_fields") > 0).alias("conflicting_types"))
        out = out.join(repeats, "batch_id", "left")
        columns["doc_003"] = (F.when(n("conflicting_types") > 0, C.FAIL)
                              .when(n("repeated_types") > 0, C.WARNING).otherwise(C.PASS))
    if "DOC-004" in wanted and batches is not None:
        off = composition_differences(docs, batches).where("verdict <> 'equal'").groupBy("batch_id").agg(
            F.count("*").alias("composition_differences"))
        out = out.join(off, "batch_id", "left")
        columns["doc_004"] = F.when(
            F.col("n_declared") > 0,
            F.when(n("composition_differences") > 0, C.WARNING).otherwise(C.PASS))
    if "CONS-001" in wanted:
        scores = goods_scores(flat, groups.where("kind = 'goods'"), similarity).groupBy("batch_id").agg(
            _count(F.col("grade") == "mismatch").alias("goods_mismatches"),
            _count(F.col("grade") == "suspect").alias("goods_suspects"))
        out = out.join(scores, "batch_id", "left")
        columns["cons_001"] = (F.when(n("goods_values") < 2, C.WARNING)
                               .when(n("goods_mismatches") > 0, C.FAIL)
                               .when(n("goods_suspects") > 0, C.WARNING).otherwise(C.PASS))
    if "CONS-002" in wanted:
        columns["cons_002"] = (F.when(F.col("n_packages") < 2, C.WARNING)
                               .when(F.col("n_packages_illegal") > 0, C.FAIL)
                               .when(F.col("n_packages_review") > 0, C.WARNING)
                               .when(F.col("packages_groups") > 1, C.FAIL).otherwise(C.PASS))
    if "CONS-003" in wanted:
        out = out.withColumn("weight_deviation", _worst_deviation("min_weight", "max_weight", "base_weight"))
        columns["cons_003"] = (F.when(F.col("n_weight") < 2, C.WARNING)
                               .when(F.col("n_weight_illegal") > 0, C.FAIL)
                               .when(F.col("n_weight_legal") < 2, C.WARNING)
                               .when(F.col("weight_deviation") > C.WEIGHT_TOLERANCE, C.FAIL)
                               .when(F.col("n_weight_review") > 0, C.WARNING).otherwise(C.PASS))
    if "CONS-004" in wanted:
        columns["cons_004"] = _text_agreement("consignor")
    if "CONS-005" in wanted:
        columns["cons_005"] = _text_agreement("consignee")
    if "CONS-006" in wanted:
        columns["cons_006"] = (F.when((F.col("n_waybills") == 0) | (F.col("n_customs") == 0), C.WARNING)
                               .when(n("waybill_numbers") == 0, C.WARNING)
                               .when((F.col("n_customs_without_waybill_no") > 0)
                                     | (n("waybill_no_unmatched") > 0), C.FAIL).otherwise(C.PASS))
    if "CONS-007" in wanted:
        columns["cons_007"] = F.when((n("container_values") >= 2) & (F.col("container_groups") > 1),
                                     C.FAIL).otherwise(C.PASS)
    if "CONS-008" in wanted:
        out = out.withColumn("amount_deviation",
                             _worst_deviation("min_declared", "max_declared", "invoice_amount"))
        invoice = F.coalesce("invoice_currency", F.lit(""))
        customs = n("customs_currencies")
        agree = (customs == 1) & (F.col("customs_currency") == invoice)
        out = out.withColumn("amount_case", (
            F.when((F.col("n_invoices") == 0) | (F.col("n_customs") == 0), "no_documents")
            .when(F.col("amount_review") == 1, "invoice_review")
            .when(F.coalesce(F.col("amount_ok"), F.lit(0)) == 0, "invoice_illegal")
            .when((invoice != "") & (customs > 0) & ~agree, "currency_conflict")
            .when((invoice == "") | (customs == 0), "currency_missing")
            .when(F.col("n_declared_illegal") > 0, "declared_illegal")
            .when(F.col("amount_deviation") > C.AMOUNT_TOLERANCE, "amount_differs")
            .otherwise("equal")))
        columns["cons_008"] = (
            F.when(F.col("amount_case").isin("no_documents", "invoice_review", "currency_missing"), C.WARNING)
            .when(F.col("amount_case") == "equal", C.PASS).otherwise(C.FAIL))
    if "ROUTE-002" in wanted:
        differing = n("ends_given") - n("ends_agreeing")
        out = out.withColumn("ends_case", (
            F.when((F.col("n_waybills") == 0) | (F.col("n_customs") == 0), "no_documents")
            .when(F.col("first_routed").isNull(), "no_route")
            .when(F.col("route_ends") == MALFORMED, "malformed")
            .when((F.col("n_customs_without_ends") > 0) | (differing > 0), "differs").otherwise("equal")))
        columns["route_002"] = (F.when(F.col("ends_case") == "equal", C.PASS)
                                .when(F.col("ends_case") == "differs", C.FAIL).otherwise(C.WARNING))
    return out.withColumns(columns)

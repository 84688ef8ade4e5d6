"""Queries on document batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from demo import verify_sql as Q, views as V
from demo.registry import query
from waybridge import constants as C
from waybridge.operators import checks as K, fields as FL, lookup as L, sinks, tables as TB
from waybridge.operators.rules import default_rules
from waybridge.operators.scenario import scenario_documents
from waybridge.plans import verify as P
from waybridge.session import written


def status(spark: SparkSession, sf_dir: str, check: str, column: str, *more) -> DataFrame:
    return K.statuses(V.docs(spark, sf_dir), checks=[check]).select("batch_id", *more, F.col(column).alias("status"))


@query("verify_weight_risk", Q.checks("SELECT batch_id, n_vals AS n_weight, n_legal AS n_weight_legal, st AS status, CASE st WHEN 'FAIL' THEN 25 WHEN 'WARNING' THEN 5 ELSE 0 END AS points FROM s_c3"))
def verify_weight_risk(spark, sf_dir):
    rows = status(spark, sf_dir, "CONS-003", "cons_003", "n_weight", "n_weight_legal")
    points = (F.when(F.col("status") == C.FAIL, C.POINTS_FAIL).when(F.col("status") == C.WARNING, C.POINTS_MINOR)
              .otherwise(0))
    return rows.withColumn("points", points)


@query("check_completeness", Q.checks("SELECT batch_id, missing AS missing_types, CASE WHEN missing > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM s_doc1"))
def check_completeness(spark, sf_dir):
    return status(spark, sf_dir, "DOC-001", "doc_001", "missing_types")


@query("check_identity", Q.checks("SELECT batch_id, CASE WHEN bad THEN 'WARNING' ELSE 'PASS' END AS status FROM s_doc2"))
def check_identity(spark, sf_dir):
    return status(spark, sf_dir, "DOC-002", "doc_002")


@query("check_duplicates", Q.everything("SELECT batch_id, repeated_types, conflicting_types, CASE WHEN conflicting_types > 0 THEN 'FAIL' WHEN repeated_types > 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM s_doc3"))
def check_duplicates(spark, sf_dir):
    rows = K.statuses(V.docs(spark, sf_dir), V.batches(spark, sf_dir), checks=["DOC-003"])
    return rows.select("batch_id", F.coalesce("repeated_types", F.lit(0)).alias("repeated_types"),
                       F.coalesce("conflicting_types", F.lit(0)).alias("conflicting_types"),
                       F.col("doc_003").alias("status"))


@query("check_composition", Q.everything("SELECT batch_id, doc_type, declared, actual, verdict FROM compo"))
def check_composition(spark, sf_dir):
    rows = K.composition_differences(V.docs(spark, sf_dir), V.batches(spark, sf_dir))
    return rows.withColumn("declared", F.coalesce("declared", F.lit(-1)))


@query("check_doc_rules", Q.checks("SELECT batch_id, doc_index, n_fail + n_warn AS n_issues, CASE WHEN n_fail > 0 THEN 'FAIL' WHEN n_warn > 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM rule_docs"))
def check_doc_rules(spark, sf_dir):
    return K.prepare(V.docs(spark, sf_dir), default_rules(spark)).select(
        "batch_id", "doc_index", F.size("rule_issues").alias("n_issues"), F.col("rule_state").alias("status"))


@query("check_goods_description", Q.checks("SELECT batch_id, groups AS goods_groups, st AS status FROM s_c1"))
def check_goods_description(spark, sf_dir):
    docs = V.docs(spark, sf_dir)
    flat = K.prepare(docs)
    groups = written(K.text_groups(flat, ["goods"]))
    rows = K.statuses(docs, checks=["CONS-001"], flat=flat, groups=groups)
    return rows.select("batch_id", "goods_groups", F.col("cons_001").alias("status"))


@query("goods_similarity", Q.checks("SELECT batch_id, base_text, other_text, n_docs, CAST(score AS DOUBLE) AS score, guard, grade FROM go_r"))
def goods_similarity(spark, sf_dir):
    rows = K.goods_scores(K.prepare(V.docs(spark, sf_dir)))
    return rows.drop("first_doc").withColumn("guard", F.coalesce("guard", F.lit("")))


@query("gray_cases", Q.checks("SELECT batch_id, other_text AS item, 'goods' AS kind FROM go_r WHERE grade = 'suspect' UNION ALL SELECT batch_id, CAST(doc_index AS VARCHAR), 'route' FROM route_docs WHERE st = 'WARNING'"))
def gray_cases(spark, sf_dir):
    flat = K.prepare(V.docs(spark, sf_dir))
    goods = K.goods_scores(flat).where("grade = 'suspect'").select(
        "batch_id", F.col("other_text").alias("item"), F.lit("goods").alias("kind"))
    routes = flat.where(F.col("route_state") == C.WARNING).select(
        "batch_id", F.col("doc_index").cast("string").alias("item"), F.lit("route").alias("kind"))
    return goods.unionByName(routes)


@query("check_packages", Q.checks("SELECT batch_id, n_vals AS n_packages, st AS status FROM s_c2"))
def check_packages(spark, sf_dir):
    return status(spark, sf_dir, "CONS-002", "cons_002", "n_packages")


@query("check_party", Q.checks("SELECT batch_id, s_c4.st AS consignor, s_c5.st AS consignee FROM s_c4 JOIN s_c5 USING (batch_id)"))
def check_party(spark, sf_dir):
    rows = K.statuses(V.docs(spark, sf_dir), checks=["CONS-004", "CONS-005"])
    return rows.select("batch_id", F.col("cons_004").alias("consignor"), F.col("cons_005").alias("consignee"))


@query("check_waybill_ref", Q.checks("SELECT batch_id, st AS status FROM s_c6"))
def check_waybill_ref(spark, sf_dir):
    return status(spark, sf_dir, "CONS-006", "cons_006")


@query("check_container", Q.checks("SELECT batch_id, st AS status FROM s_c7"))
def check_container(spark, sf_dir):
    return status(spark, sf_dir, "CONS-007", "cons_007")


@query("check_amount", Q.checks("SELECT batch_id, amount_case, st AS status FROM s_c8s"))
def check_amount(spark, sf_dir):
    return status(spark, sf_dir, "CONS-008", "cons_008", "amount_case")


@query("check_route", Q.checks("SELECT batch_id, doc_index, st AS status FROM route_docs"))
def check_route(spark, sf_dir):
    return K.prepare(V.docs(spark, sf_dir)).where("is_waybill").select(
        "batch_id", "doc_index", F.col("route_state").alias("status"))


@query("check_route_ends", Q.checks("SELECT batch_id, ends_case, st AS status FROM s_r2s"))
def check_route_ends(spark, sf_dir):
    return status(spark, sf_dir, "ROUTE-002", "route_002", "ends_case")


def _checked(spark, sf_dir):
    docs, batches, rules = V.docs(spark, sf_dir), V.batches(spark, sf_dir), default_rules(spark)
    repeated = K.duplicate_types(docs, batches)
    return repeated, *P.checked(docs, batches, rules, repeated)


@query("verify_all_risk", Q.everything("SELECT batch_id, score, grade, n_total, n_pass, n_warning, n_fail FROM scored"))
def verify_all_risk(spark, sf_dir):
    _, _, checked = _checked(spark, sf_dir)
    return P.summary(checked).select("batch_id", "score", "grade", "n_total", "n_pass", "n_warning", "n_fail")


@query("fail_escalation", Q.everything("SELECT batch_id, check_id, doc_index, st AS status, CAST(coalesce(before, 0) AS BIGINT) AS fails_before, CAST(points AS INT) AS points FROM pts"))
def fail_escalation(spark, sf_dir):
    _, flat, checked = _checked(spark, sf_dir)
    return P.scored_results(P.results(checked, flat), checked).select(
        "batch_id", "check_id", F.coalesce("doc_index", F.lit(-1)).alias("doc_index"), "status", "fails_before", "points")


@query("nonpass_results", Q.everything("SELECT batch_id, check_id, doc_index, st AS status, CASE st WHEN 'FAIL' THEN 0 ELSE 1 END AS severity FROM pts WHERE st <> 'PASS'"))
def nonpass_results(spark, sf_dir):
    _, flat, checked = _checked(spark, sf_dir)
    return P.suggestions(P.results(checked, flat)).select(
        "batch_id", "check_id", F.coalesce("doc_index", F.lit(-1)).alias("doc_index"), "status", "severity")


GROUPS = """SELECT docs.batch_id, docs.doc_index, count(*) FILTER (WHERE inv.st = 'FAIL') AS fail_count, count(*) FILTER (WHERE inv.st = 'WARNING') AS warning_count,
  coalesce(string_agg(inv.check_id, ',' ORDER BY inv.check_id), '') AS issues FROM docs LEFT JOIN inv ON docs.batch_id = inv.batch_id AND docs.doc_index = inv.doc_index GROUP BY ALL"""


def _groups(spark, sf_dir):
    repeated, flat, checked = _checked(spark, sf_dir)
    return P.document_groups(flat, checked, repeated)


@query("document_groups", Q.everything(GROUPS, involved=True))
def document_groups(spark, sf_dir):
    names = F.array_sort(F.transform("issues", lambda i: i["check_id"]))
    return _groups(spark, sf_dir).select(
        "batch_id", "doc_index", "fail_count", "warning_count", F.concat_ws(",", names).alias("issues"))


@query("stored_documents", Q.everything(f"SELECT batch_id, doc_index, CASE WHEN fail_count > 0 THEN 'FAIL' WHEN warning_count > 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM ({GROUPS})", involved=True))
def stored_documents(spark, sf_dir):
    return sinks.stored_documents(_groups(spark, sf_dir)).select("batch_id", "doc_index", "status")


@query("batch_level_issues", Q.everything("SELECT batch_id, check_id, st AS status FROM res WHERE st <> 'PASS' AND doc_index = -1 AND NOT EXISTS (SELECT 1 FROM inv WHERE inv.batch_id = res.batch_id AND inv.check_id = res.check_id)", involved=True))
def batch_level_issues(spark, sf_dir):
    _, _, checked = _checked(spark, sf_dir)
    return P.batch_level_issues(checked)


@query("batch_summary", Q.everything("""SELECT s.batch_id, s.grade, CASE grade WHEN 'low' THEN 'green' WHEN 'medium' THEN 'yellow' ELSE 'red' END AS level, s.score,
  coalesce((SELECT arg_min(check_id, ord + CASE st WHEN 'FAIL' THEN 0 ELSE 100 END) FROM res WHERE res.batch_id = s.batch_id AND st <> 'PASS'), '') AS worst_check,
  t.n_docs, t.doc_types FROM scored s JOIN (SELECT batch_id, count(*) n_docs, string_agg(DISTINCT doc_type, ',' ORDER BY doc_type) doc_types FROM docs GROUP BY batch_id) t USING (batch_id)"""))
def batch_summary(spark, sf_dir):
    _, flat, checked = _checked(spark, sf_dir)
    return P.lite_summary(P.summary(checked), flat).withColumn("worst_check", F.coalesce("worst_check", F.lit("")))


SHORT = "CASE doc_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.SHORT_NAMES.items()) + " END"


@query("instance_labels", f"{V.duck_with('docs')} SELECT batch_id, doc_index, {SHORT} || '#' || CAST(row_number() OVER (PARTITION BY batch_id, doc_type ORDER BY doc_index) AS VARCHAR) AS label FROM docs")
def instance_labels(spark, sf_dir):
    return P.instance_labels(V.docs(spark, sf_dir)).select("batch_id", "doc_index", "label")


def _state_sql() -> str:
    """Field states per document: required or present, minus fields that do not apply."""
    recognized, missing, na = [], [], []
    every = sorted({f for fs in C.REQUIRED_FIELDS.values() for f in fs} | set(V.TEXTS) | {"route_countries"})
    for f in every:
        column = "route_text" if f == "route_countries" else f
        has = f"({column} IS NOT NULL AND {column} <> '')" if column in Q.COLUMNS else "false"
        present = f"({column} IS NOT NULL)" if column in Q.COLUMNS else "false"
        req = [t for t, fs in C.REQUIRED_FIELDS.items() if f in fs]
        no = [t for t, fs in C.NOT_APPLICABLE_FIELDS.items() if f in fs]
        required = f"doc_type IN ({Q.in_list(req)})" if req else "false"
        barred = f"doc_type IN ({Q.in_list(no)})" if no else "false"
        relevant = f"({required} OR {present})"
        na.append(f"(CASE WHEN {relevant} AND {barred} THEN 1 ELSE 0 END)")
        recognized.append(f"(CASE WHEN {relevant} AND NOT ({barred}) AND {has} THEN 1 ELSE 0 END)")
        missing.append(f"(CASE WHEN {relevant} AND NOT ({barred}) AND NOT {has} THEN 1 ELSE 0 END)")
    return (f"{V.duck_with('docs')} SELECT batch_id, doc_index, {' + '.join(recognized)} AS recognized, "
            f"{' + '.join(missing)} AS not_found, {' + '.join(na)} AS not_applicable, {' + '.join(missing)} AS open_fields FROM docs")


@query("field_status", _state_sql())
def field_status(spark, sf_dir):
    counts = FL.state_counts(FL.relevant_fields(V.docs(spark, sf_dir)), ["batch_id", "doc_index"])
    return counts.select("batch_id", "doc_index", "recognized", "not_found", "not_applicable", "open_fields")


NUMBERS = ["total_packages", "gross_weight_kg", "total_amount", "declared_value"]


@query("number_contract", V.duck_with("docs") + " " + " UNION ALL ".join(
    f"SELECT batch_id, doc_index, '{f}' AS field, {Q.code(f)} AS code, CASE WHEN {Q.code(f)} = 'ok' THEN {Q.number(f)} ELSE -1 END AS value FROM docs WHERE {f} IS NOT NULL"
    for f in NUMBERS))
def number_contract(spark, sf_dir):
    from waybridge.functions.numbers import number_contract as contract, plain_number
    from waybridge.functions.text import strip
    from waybridge.sources.batches import doc_fields

    rows = doc_fields(V.docs(spark, sf_dir), NUMBERS)
    # one small step after the other keeps every expression short
    rows = rows.withColumn("bare", strip(F.col("text")))
    rows = rows.withColumn("plain", plain_number(F.col("bare")))
    rows = rows.select("batch_id", "doc_index", "field", F.inline(F.array(
        contract(F.col("bare"), F.col("kind"), F.col("plain")))))
    return rows.withColumn("value", F.coalesce("value", F.lit(-1.0)))


INDEX = " UNION ".join(
    f"SELECT batch_id, '{f}' AS field, upper(regexp_replace({f}, '\\s+', '', 'g')) AS number FROM docs WHERE {Q.filled(f)}"
    for f in C.INDEX_FIELDS)


@query("identity_index", f"{V.duck_with('docs')} {INDEX}")
def identity_index(spark, sf_dir):
    return L.identity_index(V.docs(spark, sf_dir))


# every customer asks once: by container, by a text around a waybill number, or by a short number
ASKS = """SELECT CAST(c_custkey AS STRING) AS query_id, CASE c_mktsegment WHEN 'BUILDING' THEN ' msku' || lpad(CAST(c_custkey AS STRING), 7, '0')
 WHEN 'MACHINERY' THEN 'RE: smu/' || CAST(c_custkey AS STRING) || ' ok' WHEN 'FURNITURE' THEN 'V-' || CAST(c_custkey AS STRING)
 ELSE CAST(c_custkey AS STRING) END AS query FROM customer"""


@query("batch_lookup", f"""{V.duck_with('docs')}, asks AS ({ASKS}), idx AS ({INDEX}), nums AS (SELECT DISTINCT lower(number) num FROM idx),
q AS (SELECT query_id, lower(regexp_replace(query, '\\s+', '', 'g')) q FROM asks),
hit AS (SELECT q.query_id, n.num FROM q JOIN nums n ON n.num = q.q OR (len(q.q) >= 4 AND contains(n.num, q.q)) OR (len(n.num) >= 4 AND contains(q.q, n.num)))
SELECT DISTINCT hit.query_id, idx.batch_id FROM hit JOIN idx ON lower(idx.number) = hit.num
UNION SELECT q.query_id, batch_id FROM q JOIN (SELECT DISTINCT batch_id FROM docs) b ON lower(b.batch_id) = q.q""")
def batch_lookup(spark, sf_dir):
    docs = V.docs(spark, sf_dir)
    batches = V.view(spark, sf_dir, "shipments").select("batch_id")
    return L.batch_lookup(spark.sql(ASKS), L.identity_index(docs), batches)


EDITED = f"""
SELECT batch_id || '#count' AS batch_id, * EXCLUDE (batch_id, total_packages), CASE WHEN doc_type = '{C.CUSTOMS}' THEN '300' ELSE total_packages END AS total_packages FROM raw_docs
UNION ALL BY NAME SELECT batch_id || '#party' AS batch_id, * EXCLUDE (batch_id, consignee_name), CASE WHEN doc_type = '{C.CUSTOMS}' OR doc_id LIKE 'invoice-%' THEN 'ACME' ELSE consignee_name END AS consignee_name FROM raw_docs"""


@query("scenario_risk", Q.scenario("SELECT split_part(batch_id, '#', 1) AS batch_id, split_part(batch_id, '#', 2) AS scenario_id, score AS new_score, grade AS new_grade, n_fail FROM scored", EDITED))
def scenario_risk(spark, sf_dir):
    docs = V.docs(spark, sf_dir)
    ids = V.view(spark, sf_dir, "shipments").select("batch_id")
    edit = lambda s, target, field, text, n: F.struct(
        F.lit(s).alias("scenario_id"), target.alias("target"), F.lit(field).alias("field"),
        F.lit(text).alias("text"), F.lit(n).alias("edit_order"))
    edits = ids.select("batch_id", F.inline(F.array(
        edit("count", F.lit(C.CUSTOMS), "total_packages", "400", 0),
        edit("count", F.lit(C.CUSTOMS), "total_packages", "300", 1),
        edit("party", F.lit(C.CUSTOMS), "consignee_name", "ACME", 0),
        edit("party", F.concat(F.lit("invoice-"), "batch_id"), "consignee_name", "ACME", 1))))
    scored = P.verify(written(scenario_documents(docs, edits)), rules=default_rules(spark))
    return scored.select(
        F.split_part("batch_id", F.lit("#"), F.lit(1)).alias("batch_id"),
        F.split_part("batch_id", F.lit("#"), F.lit(2)).alias("scenario_id"),
        F.col("score").alias("new_score"), F.col("grade").alias("new_grade"), "n_fail")


@query("within_declared", Q.everything("""SELECT docs.batch_id, docs.doc_index, docs.doc_type FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, doc_type ORDER BY doc_index) n FROM docs) docs
  JOIN decl ON docs.batch_id = decl.batch_id AND docs.doc_type = decl.doc_type WHERE n <= declared"""))
def within_declared(spark, sf_dir):
    return FL.within_declared(V.docs(spark, sf_dir), V.batches(spark, sf_dir)).select("batch_id", "doc_index", "doc_type")


@query("field_decisions", f"""{V.duck_with('docs')}, f AS (UNPIVOT (SELECT batch_id, doc_index, doc_type, total_packages, consignee_name, currency FROM docs) ON total_packages, consignee_name, currency INTO NAME field VALUE text)
SELECT batch_id, doc_index, field, CASE WHEN field = 'currency' AND doc_type = 'invoice' THEN '' WHEN field = 'total_packages' AND doc_type = 'packing_list' THEN '7' ELSE text END AS text,
 CASE WHEN field = 'currency' AND doc_type = 'invoice' THEN 'business_missing' WHEN field = 'total_packages' AND doc_type = 'packing_list' THEN 'recognized' ELSE '' END AS status FROM f""")
def field_decisions(spark, sf_dir):
    from waybridge.sources.batches import doc_fields

    rows = doc_fields(V.docs(spark, sf_dir), ["total_packages", "consignee_name", "currency"])
    decided = rows.where("(field = 'currency' and doc_type = 'invoice') or (field = 'total_packages' and doc_type = 'packing_list')")
    decisions = decided.select(
        "batch_id", "doc_index", "field",
        F.when(F.col("field") == "currency", C.BUSINESS_MISSING).otherwise(C.RECOGNIZED).alias("status"),
        F.when(F.col("field") == "total_packages", F.lit("7")).alias("value"))
    return FL.apply_decisions(rows.select("batch_id", "doc_index", "field", "text", "status"), decisions).select(
        "batch_id", "doc_index", "field", F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("status", F.lit("")).alias("status"))


@query("edited_values", f"""{V.duck_with('docs')}, f AS (UNPIVOT (SELECT batch_id, doc_index, doc_type, total_packages, gross_weight_kg FROM docs) ON total_packages, gross_weight_kg INTO NAME field VALUE text)
SELECT batch_id, doc_index, field, text AS old_text, CASE WHEN field = 'gross_weight_kg' AND NOT (TRY_CAST(replace(text, ',', '') AS DOUBLE) = 12000) THEN '12000.0' WHEN field = 'gross_weight_kg' AND TRY_CAST(replace(text, ',', '') AS DOUBLE) IS NULL THEN '12000.0' ELSE text END AS text,
 field = 'gross_weight_kg' AND coalesce(TRY_CAST(replace(text, ',', '') AS DOUBLE) <> 12000, true) AS changed FROM f""")
def edited_values(spark, sf_dir):
    from waybridge.sources.batches import doc_fields

    rows = doc_fields(V.docs(spark, sf_dir), ["total_packages", "gross_weight_kg"]).select(
        "batch_id", "doc_index", "field", "text")
    edits = rows.where("field = 'gross_weight_kg'").withColumn("text", F.lit("12000.0"))
    changed = FL.apply_edits(rows.withColumn("old_text", F.col("text")), edits)
    return changed.select("batch_id", "doc_index", "field", "old_text", "text", "changed")


@query("needs_review", f"SELECT batch_id, doc_index, doc_type, open_fields > 0 AS needs_review FROM ({_state_sql().replace('SELECT batch_id, doc_index,', 'SELECT batch_id, doc_index, doc_type,', 1)})")
def needs_review(spark, sf_dir):
    return FL.needs_review(FL.relevant_fields(V.docs(spark, sf_dir)))


@query("save_batches", f"""{V.duck_with('shipments')} SELECT batch_id, CASE WHEN st <> 'O' THEN 'new' ELSE 'old' END AS version FROM shipments""")
def save_batches(spark, sf_dir):
    """Batches of finished orders are verified again; the others keep their stored row."""
    rows = V.view(spark, sf_dir, "shipments")
    old = {"batches": rows.select("batch_id", F.lit("old").alias("version"))}
    new = {"batches": rows.where("st <> 'O'").select("batch_id", F.lit("new").alias("version"))}
    return sinks.save_batches(old, new)["batches"]

"""SQL that checks the verification queries; it sorts and counts where the engine aggregates."""

from __future__ import annotations

from demo import views as V
from waybridge import constants as C


def code(column: str) -> str:
    t = f"trim({column})"
    return (f"CASE WHEN {column} IS NULL OR {t} = '' THEN 'missing' "
            f"WHEN regexp_matches({t}, '{C.NUMBER_PATTERN}') THEN 'ok' "
            f"WHEN regexp_matches({t}, '{C.WITH_UNIT_PATTERN}') THEN 'with_unit' ELSE 'not_numeric' END")


def number(column: str) -> str:
    return f"TRY_CAST(replace(trim({column}), ',', '') AS DOUBLE)"


def squeeze(column: str) -> str:
    return f"trim(regexp_replace({column}, '\\s+', ' ', 'g'))"


def party(column: str) -> str:
    return f"translate(upper(regexp_replace({column}, '\\s+', '', 'g')), '10|', 'IOI')"


def filled(column: str) -> str:
    return f"trim(coalesce({column}, '')) <> ''"


def in_list(items: list[str]) -> str:
    return ", ".join(f"'{i}'" for i in items)


def majority(prefix: str, source: str) -> str:
    """Groups of equal text ``t`` per batch, and the most frequent, earliest one."""
    return f"""
{prefix}_g AS (SELECT batch_id, t, count(*) n, min(doc_index) f FROM ({source}) GROUP BY batch_id, t),
{prefix}_b AS (SELECT batch_id, t AS base, groups, vals FROM (
  SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY n DESC, f) r, count(*) OVER (PARTITION BY batch_id) groups,
         sum(n) OVER (PARTITION BY batch_id) vals FROM {prefix}_g) WHERE r = 1)"""


UNITS = "|".join(C.UNIT_WORDS)
NEG = " OR ".join(f"contains(lower({{x}}), '{w}')" for w in C.NEGATION_WORDS)


def specs(x: str) -> str:
    return (f"list_sort(list_distinct([regexp_replace(s, '\\s', '', 'g') FOR s IN "
            f"regexp_extract_all(lower({x}), '\\d+(?:\\.\\d+)?\\s*(?:{UNITS})')]))")


def numbers(x: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all({x}, '\\d+(?:\\.\\d+)?')))"


def plain(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '(\\d)\\.(\\d)', '\\1点\\2', 'g'), '[^\\w点]+', '', 'g')"


def rule_count(severity: str) -> str:
    parts = []
    for _, doc_type, name, kind, low, sev, on in C.DOC_RULES:
        if not on or sev != severity:
            continue
        column = "route_text" if name == "route_countries" else name
        if kind == "required":
            parts.append(f"(CASE WHEN doc_type = '{doc_type}' AND NOT ({filled(column)}) THEN 1 ELSE 0 END)")
        else:
            parts.append(f"(CASE WHEN doc_type = '{doc_type}' AND ({code(column)}) = 'ok' "
                         f"AND {number(column)} < {low} THEN 1 ELSE 0 END)")
    return " + ".join(parts)


ID_MISSING = " OR ".join(f"(doc_type = '{t}' AND NOT ({filled(f)}))" for t, f in C.IDENTITY_FIELDS.items())
SMGS, CIM = in_list(C.SMGS_COUNTRIES), in_list(C.CIM_COUNTRIES)
UNION = in_list(sorted(set(C.SMGS_COUNTRIES) | set(C.CIM_COUNTRIES)))

# fields that exist as columns of a document of the wide input
COLUMNS = [*V.TEXTS, "route_text"]

CHECKS = f"""
d AS (SELECT *, doc_type IN ('railway_waybill', 'smgs_rail_waybill') is_wb, doc_type = '{C.CUSTOMS}' is_cus,
  doc_type = 'invoice' is_inv, {code('total_packages')} pk0, {number('total_packages')} pkv,
  {code('gross_weight_kg')} wtc, {number('gross_weight_kg')} wtv, {code('total_amount')} amc, {number('total_amount')} amv,
  {code('declared_value')} dvc, {number('declared_value')} dvv, upper(coalesce({squeeze('currency')}, '')) cur,
  CASE WHEN doc_type = 'smgs_rail_waybill' AND NOT ({filled('waybill_type')}) THEN 'SMGS' ELSE waybill_type END wtype,
  string_split(route_text, '、') route FROM docs),
p AS (SELECT *, CASE WHEN pk0 = 'ok' AND pkv <= 0 THEN 'not_numeric' WHEN pk0 = 'ok' AND pkv <> floor(pkv) THEN 'with_unit'
  ELSE pk0 END pkc, wtc = 'ok' AND wtv > 0 wt_ok FROM d),
b AS (SELECT DISTINCT batch_id FROM docs),
s_doc1 AS (SELECT batch_id, 5 - (max(CASE WHEN doc_type = 'invoice' THEN 1 ELSE 0 END) + max(CASE WHEN doc_type = 'packing_list' THEN 1 ELSE 0 END)
  + max(CASE WHEN is_wb THEN 1 ELSE 0 END) + max(CASE WHEN is_cus THEN 1 ELSE 0 END)
  + max(CASE WHEN doc_type = 'certificate_of_origin' THEN 1 ELSE 0 END)) missing FROM p GROUP BY batch_id),
s_doc2 AS (SELECT batch_id, bool_or({ID_MISSING}) bad FROM p GROUP BY batch_id),
rule_docs AS (SELECT batch_id, doc_index, {rule_count('fail')} n_fail, {rule_count('warning')} n_warn FROM p),
{majority('go', f"SELECT batch_id, doc_index, {squeeze('goods_description')} t FROM p WHERE {filled('goods_description')}")},
go_p AS (SELECT DISTINCT base a, t b FROM go_g JOIN go_b USING (batch_id) WHERE t <> base),
go_n AS (SELECT a, b, {plain('a')} na, {plain('b')} nb FROM go_p),
go_x AS (SELECT a, b, 0 side, unnest([substr(na, i, 1) FOR i IN range(1, len(na) + 1)] || [substr(na, i, 2) FOR i IN range(1, len(na))]) gram FROM go_n
  UNION ALL SELECT a, b, 1, unnest([substr(nb, i, 1) FOR i IN range(1, len(nb) + 1)] || [substr(nb, i, 2) FOR i IN range(1, len(nb))]) FROM go_n),
go_c AS (SELECT a, b, gram, count(*) FILTER (WHERE side = 0) ca, count(*) FILTER (WHERE side = 1) cb FROM go_x GROUP BY ALL),
go_d AS (SELECT a, b, CASE WHEN sum(ca * cb) = 0 THEN 0 ELSE round(sum(ca * cb)::DOUBLE / (sqrt(sum(ca * ca)) * sqrt(sum(cb * cb))), 4) END cs FROM go_c GROUP BY a, b),
go_s AS (SELECT a, b, CASE WHEN na = nb THEN 1.0 ELSE cs END score,
  CASE WHEN {specs('a')} <> {specs('b')} THEN 'numeric_spec' WHEN {numbers('a')} <> {numbers('b')} THEN 'bare_number'
    WHEN ({NEG.format(x='a')}) <> ({NEG.format(x='b')}) THEN 'negation' ELSE '' END guard FROM go_n JOIN go_d USING (a, b)),
go_gr AS (SELECT *, CASE WHEN guard <> '' THEN 'mismatch' WHEN score >= 0.85 THEN 'match' WHEN score >= 0.60 THEN 'suspect' ELSE 'mismatch' END grade FROM go_s),
go_r AS (SELECT g.batch_id, go_b.base AS base_text, g.t AS other_text, g.n AS n_docs, x.score, x.guard, x.grade FROM go_g g JOIN go_b USING (batch_id)
  JOIN go_gr x ON x.a = go_b.base AND x.b = g.t),
s_c1 AS (SELECT b.batch_id, coalesce(go_b.groups, 0) groups, CASE WHEN coalesce(go_b.vals, 0) < 2 THEN 'WARNING'
  WHEN EXISTS (SELECT 1 FROM go_r r WHERE r.batch_id = b.batch_id AND grade = 'mismatch') THEN 'FAIL'
  WHEN EXISTS (SELECT 1 FROM go_r r WHERE r.batch_id = b.batch_id AND grade = 'suspect') THEN 'WARNING' ELSE 'PASS' END st
  FROM b LEFT JOIN go_b USING (batch_id)),
{majority('pk', "SELECT batch_id, doc_index, CAST(CAST(pkv AS BIGINT) AS VARCHAR) t FROM p WHERE pkc = 'ok'")},
s_c2 AS (SELECT batch_id, count(*) FILTER (WHERE pkc <> 'missing') n_vals,
  CASE WHEN count(*) FILTER (WHERE pkc <> 'missing') < 2 THEN 'WARNING' WHEN bool_or(pkc = 'not_numeric') THEN 'FAIL'
  WHEN bool_or(pkc = 'with_unit') THEN 'WARNING' WHEN count(DISTINCT CASE WHEN pkc = 'ok' THEN pkv END) > 1 THEN 'FAIL' ELSE 'PASS' END st FROM p GROUP BY batch_id),
wt_b AS (SELECT batch_id, wtv base FROM (SELECT batch_id, wtv, row_number() OVER (PARTITION BY batch_id ORDER BY CASE WHEN is_inv THEN 0 ELSE 1 END, doc_index) r
  FROM p WHERE wt_ok) WHERE r = 1),
s_c3 AS (SELECT batch_id, count(*) FILTER (WHERE wtc <> 'missing') n_vals, count(*) FILTER (WHERE wt_ok) n_legal,
  bool_or(wtc <> 'missing' AND NOT wt_ok AND wtc <> 'with_unit') illegal, bool_or(wtc = 'with_unit') review,
  coalesce(bool_or(wt_ok AND abs(wtv - base) / base > 0.01), false) over_,
  CASE WHEN count(*) FILTER (WHERE wtc <> 'missing') < 2 THEN 'WARNING' WHEN bool_or(wtc <> 'missing' AND NOT wt_ok AND wtc <> 'with_unit') THEN 'FAIL'
  WHEN count(*) FILTER (WHERE wt_ok) < 2 THEN 'WARNING' WHEN bool_or(wt_ok AND abs(wtv - base) / base > 0.01) THEN 'FAIL'
  WHEN bool_or(wtc = 'with_unit') THEN 'WARNING' ELSE 'PASS' END st FROM p LEFT JOIN wt_b USING (batch_id) GROUP BY batch_id),
{majority('cr', f"SELECT batch_id, doc_index, {party('consignor_name')} t FROM p WHERE {filled('consignor_name')}")},
{majority('ce', f"SELECT batch_id, doc_index, {party('consignee_name')} t FROM p WHERE {filled('consignee_name')}")},
{majority('cn', f"SELECT batch_id, doc_index, upper(replace({squeeze('container_no')}, ' ', '')) t FROM p WHERE {filled('container_no')}")},
s_c4 AS (SELECT b.batch_id, CASE WHEN coalesce(vals, 0) < 2 THEN 'WARNING' WHEN groups > 1 THEN 'FAIL' ELSE 'PASS' END st FROM b LEFT JOIN cr_b USING (batch_id)),
s_c5 AS (SELECT b.batch_id, CASE WHEN coalesce(vals, 0) < 2 THEN 'WARNING' WHEN groups > 1 THEN 'FAIL' ELSE 'PASS' END st FROM b LEFT JOIN ce_b USING (batch_id)),
s_c7 AS (SELECT b.batch_id, CASE WHEN coalesce(vals, 0) >= 2 AND groups > 1 THEN 'FAIL' ELSE 'PASS' END st FROM b LEFT JOIN cn_b USING (batch_id)),
wb_no AS (SELECT DISTINCT batch_id, upper({squeeze('waybill_no')}) t FROM p WHERE is_wb AND {filled('waybill_no')}),
s_c6 AS (SELECT p.batch_id, CASE WHEN NOT bool_or(is_wb) OR NOT bool_or(is_cus) THEN 'WARNING' WHEN NOT bool_or(is_wb AND {filled('waybill_no')}) THEN 'WARNING'
  WHEN bool_or(is_cus AND (NOT ({filled('waybill_no')}) OR w.t IS NULL)) THEN 'FAIL' ELSE 'PASS' END st
  FROM p LEFT JOIN wb_no w ON p.batch_id = w.batch_id AND upper({squeeze('waybill_no')}) = w.t GROUP BY p.batch_id),
inv1 AS (SELECT batch_id, amc iamc, amv iamv, cur icur, doc_index inv_index FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY doc_index) r FROM p WHERE is_inv) WHERE r = 1),
cus8 AS (SELECT p.batch_id, count(*) n, bool_or(NOT (dvc = 'ok' AND coalesce(dvv, 0) > 0)) illegal, bool_or(cur <> '') any_cur,
  bool_or(cur <> '' AND cur <> coalesce(icur, '')) other_cur, bool_or(abs(dvv - iamv) / iamv > 0.005) off
  FROM p LEFT JOIN inv1 USING (batch_id) WHERE is_cus GROUP BY p.batch_id),
s_c8 AS (SELECT b.batch_id, CASE WHEN iamc IS NULL OR n IS NULL THEN 'no_documents' WHEN iamc = 'with_unit' THEN 'invoice_review'
  WHEN iamc <> 'ok' OR iamv <= 0 THEN 'invoice_illegal' WHEN icur <> '' AND any_cur AND other_cur THEN 'currency_conflict'
  WHEN icur = '' OR NOT any_cur THEN 'currency_missing' WHEN illegal THEN 'declared_illegal' WHEN off THEN 'amount_differs' ELSE 'equal' END amount_case
  FROM b LEFT JOIN inv1 USING (batch_id) LEFT JOIN cus8 USING (batch_id)),
s_c8s AS (SELECT batch_id, amount_case, CASE WHEN amount_case IN ('no_documents', 'invoice_review', 'currency_missing') THEN 'WARNING' WHEN amount_case = 'equal' THEN 'PASS' ELSE 'FAIL' END st FROM s_c8),
route_docs AS (SELECT batch_id, doc_index, CASE WHEN NOT ({filled('wtype')}) OR NOT ({filled('route_text')}) THEN 'WARNING'
  WHEN NOT contains(upper(wtype), 'SMGS') AND NOT contains(upper(wtype), 'CIM') THEN 'FAIL'
  WHEN len([c FOR c IN route IF c NOT IN ({UNION})]) > 0 THEN 'FAIL'
  WHEN contains(upper(wtype), 'SMGS') AND contains(upper(wtype), 'CIM') THEN 'PASS'
  WHEN contains(upper(wtype), 'SMGS') AND len([c FOR c IN route IF c NOT IN ({SMGS})]) > 0 THEN 'WARNING'
  WHEN NOT contains(upper(wtype), 'SMGS') AND len([c FOR c IN route IF c NOT IN ({CIM})]) > 0 THEN 'WARNING' ELSE 'PASS' END st FROM p WHERE is_wb),
wb1 AS (SELECT batch_id, route wroute, doc_index wb_index FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY CASE WHEN {filled('route_text')} THEN 0 ELSE 1 END, doc_index) r FROM p WHERE is_wb) WHERE r = 1),
s_r2 AS (SELECT b.batch_id, CASE WHEN wb_index IS NULL OR n IS NULL THEN 'no_documents' WHEN wroute IS NULL THEN 'no_route' WHEN off THEN 'differs' ELSE 'equal' END ends_case
  FROM b LEFT JOIN wb1 USING (batch_id) LEFT JOIN (SELECT p.batch_id, count(*) n, bool_or(departure_country IS NULL OR destination_country IS NULL OR departure_country <> wroute[1]
  OR destination_country <> wroute[-1]) off FROM p LEFT JOIN wb1 USING (batch_id) WHERE is_cus GROUP BY p.batch_id) USING (batch_id)),
s_r2s AS (SELECT batch_id, ends_case, CASE ends_case WHEN 'equal' THEN 'PASS' WHEN 'differs' THEN 'FAIL' ELSE 'WARNING' END st FROM s_r2)"""

DECLARED_LONG = f"""
decl AS (SELECT batch_id, 'invoice' AS doc_type, n_invoice AS declared FROM declared WHERE is_declared = 1
  UNION ALL SELECT batch_id, 'packing_list', n_packing FROM declared WHERE is_declared = 1
  UNION ALL SELECT batch_id, 'railway_waybill', 1 FROM declared WHERE is_declared = 1
  UNION ALL SELECT batch_id, '{C.CUSTOMS}', 1 FROM declared WHERE is_declared = 1
  UNION ALL SELECT batch_id, 'certificate_of_origin', 1 FROM declared WHERE is_declared = 1),
act AS (SELECT batch_id, doc_type, count(*) actual FROM docs GROUP BY batch_id, doc_type),
compo AS (SELECT coalesce(d.batch_id, a.batch_id) batch_id, coalesce(d.doc_type, a.doc_type) doc_type, coalesce(d.declared, -1) declared, coalesce(a.actual, 0) actual,
  CASE WHEN d.declared IS NULL THEN 'undeclared' WHEN coalesce(a.actual, 0) < d.declared THEN 'short' WHEN a.actual > d.declared THEN 'surplus' ELSE 'equal' END verdict
  FROM decl d FULL JOIN (SELECT act.* FROM act JOIN declared ON act.batch_id = declared.batch_id WHERE is_declared = 1) a ON d.batch_id = a.batch_id AND d.doc_type = a.doc_type),
rep AS (SELECT act.batch_id, act.doc_type, act.actual FROM act LEFT JOIN decl ON act.batch_id = decl.batch_id AND act.doc_type = decl.doc_type WHERE actual > coalesce(declared, 1)),
cells AS (SELECT batch_id, doc_type, field, count(*) holders, count(DISTINCT v) variants FROM (
  UNPIVOT (SELECT batch_id, doc_type, doc_index, {", ".join(COLUMNS)} FROM docs) ON {", ".join(COLUMNS)} INTO NAME field VALUE v)
  GROUP BY batch_id, doc_type, field),
rep_c AS (SELECT r.batch_id, r.doc_type, r.actual n_docs, count(*) FILTER (WHERE holders = actual AND variants > 1) conflicting_fields
  FROM rep r LEFT JOIN cells c ON r.batch_id = c.batch_id AND r.doc_type = c.doc_type GROUP BY ALL),
s_doc3 AS (SELECT b.batch_id, count(r.doc_type) repeated_types, count(*) FILTER (WHERE conflicting_fields > 0) conflicting_types FROM b LEFT JOIN rep_c r USING (batch_id) GROUP BY b.batch_id),
s_doc4 AS (SELECT batch_id, bool_or(verdict <> 'equal') off FROM compo GROUP BY batch_id)"""

RESULTS = """
res AS (
  SELECT batch_id, 1 ord, -1 doc_index, 'SYS-001' check_id, 'PASS' st, 0 missing FROM b
  UNION ALL SELECT batch_id, 2, -1, 'DOC-001', CASE WHEN missing > 0 THEN 'FAIL' ELSE 'PASS' END, missing FROM s_doc1
  UNION ALL SELECT batch_id, 3, -1, 'DOC-002', CASE WHEN bad THEN 'WARNING' ELSE 'PASS' END, 0 FROM s_doc2
  UNION ALL SELECT batch_id, 4, -1, 'DOC-003', CASE WHEN conflicting_types > 0 THEN 'FAIL' WHEN repeated_types > 0 THEN 'WARNING' ELSE 'PASS' END, 0 FROM s_doc3
  UNION ALL SELECT batch_id, 5, -1, 'DOC-004', CASE WHEN off THEN 'WARNING' ELSE 'PASS' END, 0 FROM s_doc4
  UNION ALL SELECT batch_id, 6, doc_index, 'DOC-101', CASE WHEN n_fail > 0 THEN 'FAIL' WHEN n_warn > 0 THEN 'WARNING' ELSE 'PASS' END, 0 FROM rule_docs
  UNION ALL SELECT batch_id, 7, -1, 'CONS-001', st, 0 FROM s_c1
  UNION ALL SELECT batch_id, 8, -1, 'CONS-002', st, 0 FROM s_c2
  UNION ALL SELECT batch_id, 9, -1, 'CONS-003', st, 0 FROM s_c3
  UNION ALL SELECT batch_id, 10, -1, 'CONS-004', st, 0 FROM s_c4
  UNION ALL SELECT batch_id, 11, -1, 'CONS-005', st, 0 FROM s_c5
  UNION ALL SELECT batch_id, 12, -1, 'CONS-006', st, 0 FROM s_c6
  UNION ALL SELECT batch_id, 13, -1, 'CONS-007', st, 0 FROM s_c7
  UNION ALL SELECT batch_id, 14, -1, 'CONS-008', st, 0 FROM s_c8s
  UNION ALL SELECT batch_id, 15, -1, 'ROUTE-002', st, 0 FROM s_r2s
  UNION ALL SELECT batch_id, 16, doc_index, 'ROUTE-001', st, 0 FROM route_docs),
pts AS (SELECT *, CASE WHEN st = 'FAIL' AND check_id = 'DOC-001' THEN 30 + 5 * (missing - 1) WHEN st = 'FAIL' THEN 25 + 5 * coalesce(before, 0)
  WHEN st = 'WARNING' AND check_id = 'CONS-001' THEN 15 WHEN st = 'WARNING' AND check_id = 'ROUTE-001' THEN 10 WHEN st = 'WARNING' THEN 5 ELSE 0 END points
  FROM (SELECT *, sum(CASE WHEN st = 'FAIL' THEN 1 ELSE 0 END) OVER (PARTITION BY batch_id ORDER BY ord, doc_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before FROM res)),
risk AS (SELECT batch_id, CAST(least(100, sum(points)) AS INT) score, count(*) n_total, count(*) FILTER (WHERE st = 'PASS') n_pass,
  count(*) FILTER (WHERE st = 'WARNING') n_warning, count(*) FILTER (WHERE st = 'FAIL') n_fail FROM pts GROUP BY batch_id),
scored AS (SELECT *, CASE WHEN score <= 20 THEN 'low' WHEN score <= 50 THEN 'medium' ELSE 'high' END grade FROM risk)"""

# documents that take part in a result that did not pass
INVOLVED = f"""
inv AS (
  SELECT p.batch_id, p.doc_index, 'DOC-002' check_id, 'WARNING' st FROM p WHERE {ID_MISSING}
  UNION ALL SELECT p.batch_id, p.doc_index, 'DOC-003', CASE WHEN conflicting_types > 0 THEN 'FAIL' ELSE 'WARNING' END FROM p JOIN rep USING (batch_id, doc_type) JOIN s_doc3 USING (batch_id)
  UNION ALL SELECT batch_id, doc_index, 'DOC-101', CASE WHEN n_fail > 0 THEN 'FAIL' ELSE 'WARNING' END FROM rule_docs WHERE n_fail + n_warn > 0
  UNION ALL SELECT p.batch_id, p.doc_index, 'CONS-001', s.st FROM p JOIN go_b USING (batch_id) JOIN s_c1 s USING (batch_id) WHERE s.st <> 'PASS' AND vals >= 2 AND {filled('goods_description')} AND {squeeze('goods_description')} <> base
  UNION ALL SELECT p.batch_id, p.doc_index, 'CONS-002', s.st FROM p JOIN s_c2 s USING (batch_id) LEFT JOIN pk_b USING (batch_id) WHERE s.st <> 'PASS' AND n_vals >= 2 AND CASE
    WHEN EXISTS (SELECT 1 FROM p x WHERE x.batch_id = p.batch_id AND x.pkc IN ('not_numeric', 'with_unit')) THEN pkc <> 'missing' ELSE pkc = 'ok' AND CAST(CAST(pkv AS BIGINT) AS VARCHAR) <> base END
  UNION ALL SELECT p.batch_id, p.doc_index, 'CONS-003', s.st FROM p JOIN s_c3 s USING (batch_id) LEFT JOIN wt_b USING (batch_id) WHERE s.st <> 'PASS' AND n_vals >= 2 AND CASE WHEN illegal THEN wtc <> 'missing'
    WHEN n_legal < 2 THEN false WHEN over_ THEN wt_ok AND abs(wtv - base) / base > 0.01 ELSE wtc <> 'missing' END
  UNION ALL SELECT p.batch_id, p.doc_index, 'CONS-004', s.st FROM p JOIN cr_b USING (batch_id) JOIN s_c4 s USING (batch_id) WHERE s.st = 'FAIL' AND {filled('consignor_name')} AND {party('consignor_name')} <> base
  UNION ALL SELECT p.batch_id, p.doc_index, 'CONS-005', s.st FROM p JOIN ce_b USING (batch_id) JOIN s_c5 s USING (batch_id) WHERE s.st = 'FAIL' AND {filled('consignee_name')} AND {party('consignee_name')} <> base
  UNION ALL SELECT p.batch_id, p.doc_index, 'CONS-006', s.st FROM p JOIN s_c6 s USING (batch_id) WHERE s.st = 'FAIL' AND is_cus
  UNION ALL SELECT p.batch_id, p.doc_index, 'CONS-007', s.st FROM p JOIN cn_b USING (batch_id) JOIN s_c7 s USING (batch_id) WHERE s.st = 'FAIL' AND {filled('container_no')} AND upper(replace({squeeze('container_no')}, ' ', '')) <> base
  UNION ALL SELECT p.batch_id, p.doc_index, 'CONS-008', s.st FROM p JOIN s_c8s s USING (batch_id) JOIN inv1 USING (batch_id) WHERE s.st <> 'PASS' AND amount_case <> 'no_documents'
    AND (is_cus OR (amount_case <> 'amount_differs' AND p.doc_index = inv_index))
  UNION ALL SELECT p.batch_id, p.doc_index, 'ROUTE-002', s.st FROM p JOIN s_r2s s USING (batch_id) JOIN wb1 USING (batch_id) WHERE (ends_case = 'differs' AND is_cus) OR (ends_case = 'no_route' AND p.doc_index = wb_index)
  UNION ALL SELECT batch_id, doc_index, 'ROUTE-001', st FROM route_docs WHERE st <> 'PASS')"""


def checks(select: str) -> str:
    return f"{V.duck_with('docs')},\n{CHECKS}\n{select}"


def everything(select: str, involved: bool = False) -> str:
    more = f",\n{INVOLVED}" if involved else ""
    return f"{V.duck_with('docs', 'declared')},\n{CHECKS},\n{DECLARED_LONG},\n{RESULTS}{more}\n{select}"


def scenario(select: str, edited: str) -> str:
    """The whole chain over edited documents, without a declared composition."""
    none = ("SELECT batch_id, 1 AS n_packing, 1 AS n_invoice, 0 AS is_declared FROM shipments")
    base = V.duck_with("docs").replace("\ndocs AS (", "\nraw_docs AS (", 1)
    return f"{base},\ndocs AS ({edited}),\ndeclared AS ({none}),\n{CHECKS},\n{DECLARED_LONG},\n{RESULTS}\n{select}"

"""Queries on pages, lines, words, passages, labels, audit rows and arriving records."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from demo import views as V
from demo import verification  # noqa: F401  its SQL checks the streaming job too
from demo.registry import CHECK_SQL, query
from demo.verify_sql import in_list
from waybridge import constants as C
from waybridge.operators import audit as AU, boxes as B, evaluate as EV, extract as X, forms as FM, pages as PG, passages as PS
from waybridge.operators import sinks
from waybridge.session import drop_shuffles, shared_folder, written
from waybridge.functions import text as T
from waybridge.sources.batches import batch_versions, content_versions, docs_from_wide, explode_documents, parse_batches
from waybridge.streaming import jobs

# ---- pages to documents ----------------------------------------------------------

GROUPS = f"""{V.duck_with('page_rows')}, a AS (SELECT *, CASE WHEN lag(doc_type) OVER w IS NULL OR lag(doc_type) OVER w <> doc_type OR doc_type = 'unknown' THEN 1 ELSE 0 END starts FROM page_rows WINDOW w AS (PARTITION BY file ORDER BY page_no)),
r AS (SELECT *, sum(starts) OVER (PARTITION BY file ORDER BY page_no) run FROM a),
i AS (SELECT *, last_value(identity IGNORE NULLS) OVER (PARTITION BY file, run ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pi FROM r),
g AS (SELECT *, CAST(sum(CASE WHEN starts = 1 OR (identity IS NOT NULL AND pi IS NOT NULL AND identity <> pi) THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY page_no) AS BIGINT) group_no FROM i),
d AS (SELECT file, group_no, min(page_no) first_page, max(page_no) last_page, count(*) n_pages, arg_min(doc_type, page_no) doc_type, coalesce(arg_min(identity, page_no) FILTER (WHERE identity IS NOT NULL), '') identity,
  count(*) FILTER (WHERE identity IS NULL) - CASE WHEN bool_or(identity IS NULL AND page_no = fp) THEN 1 ELSE 0 END later_unnamed FROM (SELECT *, min(page_no) OVER (PARTITION BY file, group_no) fp FROM g) GROUP BY file, group_no)"""


@query("split_pages", f"{GROUPS} SELECT file, page_no, group_no FROM g")
def split_pages(spark, sf_dir):
    return PG.group_pages(V.view(spark, sf_dir, "page_rows")).select("file", "page_no", "group_no")


@query("document_ranges", f"{GROUPS} SELECT file, group_no, first_page, last_page, n_pages, doc_type, identity, later_unnamed FROM d")
def document_ranges(spark, sf_dir):
    rows = PG.document_groups(PG.group_pages(V.view(spark, sf_dir, "page_rows")))
    return rows.withColumn("identity", F.coalesce("identity", F.lit("")))


@query("split_review", f"""{GROUPS} SELECT file, count(*) AS n_groups, CASE WHEN bool_or(doc_type = 'unknown') THEN 'unknown_page' WHEN count(*) > 10 THEN 'many_documents' WHEN bool_or(n_pages > 1 AND later_unnamed > 0) THEN 'unnamed_page' ELSE '' END AS reason FROM d GROUP BY file""")
def split_review(spark, sf_dir):
    rows = PG.split_review(PG.document_groups(PG.group_pages(V.view(spark, sf_dir, "page_rows"))))
    return rows.select("file", "n_groups", F.coalesce("reason", F.lit("")).alias("reason"))


# documents carry wording of a document type after their whole text
MARKED = """SELECT doc_id, text || CASE lang WHEN 'en' THEN ' Commercial  Invoice 原产地' WHEN 'fr' THEN ' Packing
List' WHEN 'de' THEN ' 国 际货协运单' ELSE '' END AS text, source || CASE WHEN lang = 'en' THEN '-CCPIT.pdf' ELSE '.pdf' END AS file FROM documents"""


def _score_sql(doc_type: str) -> str:
    parts = []
    for w in C.TYPE_KEYWORDS[doc_type]:
        squashed = "".join(w.split()).upper()
        parts.append(f"2 * CAST(contains(t, '{squashed}') AS INT) + CAST(contains(upper(file), '{w.upper()}') AS INT)")
    return " + ".join(parts)


GENERAL = [t for t in C.TYPE_KEYWORDS if t != "smgs_rail_waybill"]
CLASSIFY = f"""WITH m AS (SELECT doc_id, file, upper(regexp_replace(text, '\\s+', '', 'g')) t FROM ({MARKED})), s AS (SELECT doc_id, {' OR '.join(f"contains(t, '{''.join(w.split()).upper()}')" for w in C.TYPE_KEYWORDS['smgs_rail_waybill'])} smgs, {', '.join(f'{_score_sql(t)} AS s{i}' for i, t in enumerate(GENERAL))} FROM m),
b AS (SELECT *, greatest({', '.join(f's{i}' for i in range(len(GENERAL)))}) best FROM s)
SELECT doc_id, CASE WHEN smgs THEN 'smgs_rail_waybill' WHEN best = 0 THEN 'unknown' {' '.join(f"WHEN s{i} = best THEN '{t}'" for i, t in enumerate(GENERAL))} END AS doc_type, CASE WHEN smgs THEN 6 ELSE best END AS score FROM b"""


@query("classify_docs", CLASSIFY)
def classify_docs(spark, sf_dir):
    V.tables(spark, sf_dir, "documents")
    return spark.sql(MARKED).select("doc_id", PG.classify(F.col("text"), F.col("file")).alias("k")).select("doc_id", "k.*")


# documents followed by captioned lines
CAPTIONED = """SELECT doc_id, CASE lang WHEN 'fr' THEN 'packing_list' WHEN 'es' THEN 'unknown' ELSE 'invoice' END AS doc_type, text || '
Invoice No. (export): INV-' || CAST(doc_id AS STRING) || '
SELLER: ' || source || ' trading
TOTAL PACKAGES: ' || CAST(n_chars AS STRING) || CASE lang WHEN 'de' THEN '.5' ELSE '' END || '
GROSS WEIGHT: ' || CAST(n_chars AS STRING) || CASE lang WHEN 'en' THEN ' kg' WHEN 'fr' THEN ' LB' ELSE '' END || '
TOTAL AMOUNT: USD ' || CAST(n_chars * 2 AS STRING) || '
BUYER:
' AS text FROM documents"""


def _extract_sql() -> str:
    parts = []
    for doc_type in ("invoice", "packing_list", "unknown"):
        for f, caps in C.CAPTIONS[doc_type].items():
            tries = ", ".join(
                "nullif(trim(regexp_extract(text, '" + X.caption_pattern(f, c).replace("(?iudU)", "(?i)") + "', 1)), '')" for c in caps)
            parts.append(f"SELECT doc_id, doc_type, '{f}' AS field, coalesce({tries}) AS raw FROM c WHERE doc_type = '{doc_type}'")
    return " UNION ALL ".join(parts)


@query("extract_fields", f"""WITH c AS ({CAPTIONED}), r AS ({_extract_sql()}) SELECT doc_id, doc_type, field, coalesce(raw, '') AS raw, CASE WHEN raw IS NULL THEN 'missing' WHEN field IN ('gross_weight_kg', 'net_weight_kg') THEN CASE WHEN lower(raw) LIKE '%lb' THEN 'review' ELSE 'high' END
 WHEN field = 'total_packages' AND raw LIKE '%.5' THEN 'review' ELSE 'high' END AS confidence FROM r""")
def extract_fields(spark, sf_dir):
    V.tables(spark, sf_dir, "documents")
    rows = X.finalize(X.extract_fields(spark.sql(CAPTIONED)))
    return rows.select("doc_id", "doc_type", "field", F.coalesce("raw", F.lit("")).alias("raw"), "confidence")


LINED = """SELECT doc_id, 'SELLER
' || text || '
件数 (total): ' || CAST(n_chars AS STRING) || ' pcs' AS text FROM documents"""
LINE_FIELDS = ["consignor_name", "total_packages"]
DUCK_CAPTIONS = FM.CAPTION.replace("(?iu)", "(?i)")
EDGE = r"[ :：\t\r\n/|、,，;；]+"


def _plausible(t: str) -> str:
    bare = f"regexp_replace({t}, '^{EDGE}|{EDGE}$', '', 'g')"
    return (f"({bare} <> '' AND NOT regexp_matches({bare}, '^[（(【]') AND NOT (regexp_matches({bare}, '{DUCK_CAPTIONS}') AND len({bare}) <= 45) "
            f"AND NOT regexp_matches({bare}, '^\\d{{1,2}}[.\\s]*$'))")


LINES_SQL = f"""WITH l AS (SELECT doc_id, CAST(n AS BIGINT) line_no, x AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) n FROM ({LINED}))),
n AS (SELECT l.*, lead(text) OVER (PARTITION BY doc_id ORDER BY line_no) nxt FROM l),
h AS (""" + " UNION ALL ".join(
    f"""SELECT doc_id, line_no, '{f}' field, nxt, trim(regexp_replace(regexp_replace(regexp_extract(text, '(?i)^.*?{FM.any_of(C.LINE_CAPTIONS[f]).replace('(?iu)', '')}(.*)$', 1), '^{EDGE}|{EDGE}$', '', 'g'), '^[—-]+', '')) tail FROM n WHERE regexp_matches(text, '{FM.any_of(C.LINE_CAPTIONS[f]).replace('(?iu)', '(?i)')}')"""
    for f in LINE_FIELDS) + f"""),
c AS (SELECT *, CASE WHEN tail LIKE '(total)%' THEN tail WHEN {_plausible('tail')} THEN tail WHEN NOT (regexp_matches(trim(nxt), '{DUCK_CAPTIONS}') AND len(trim(nxt)) < 48) AND {_plausible('nxt')} THEN trim(nxt) END raw FROM h),
p AS (SELECT *, trim(regexp_replace(raw, '^[（(【][^）)】]*[）)】]\\s*[:：]?\\s*', '')) r2 FROM c),
v AS (SELECT *, CASE WHEN field = 'total_packages' THEN replace(list_extract(regexp_extract_all(r2, '((?:\\d{{1,3}}(?:,\\d{{3}})+|\\d+)(?:\\.\\d+)?)', 1), -1), ',', '') ELSE nullif(r2, '') END val FROM p)
SELECT doc_id, field, arg_min(val, line_no) AS value, min(line_no) AS line_no FROM v WHERE val IS NOT NULL GROUP BY doc_id, field"""


def document_lines(spark, sf_dir):
    V.tables(spark, sf_dir, "documents")
    return spark.sql(LINED).select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("p", "text")).select(
        "file", (F.col("p") + 1).cast("long").alias("line_no"), "text")


@query("label_next_line", LINES_SQL)
def label_next_line(spark, sf_dir):
    found = FM.line_values(document_lines(spark, sf_dir), {f: C.LINE_CAPTIONS[f] for f in LINE_FIELDS})
    return found.select(F.col("file").alias("doc_id"), "field", "value", "line_no")


# ---- consignment forms --------------------------------------------------------------

# Every order is a form of one page. (text by o_orderkey % 6, place); null leaves the line out.
# What has to come out stands beside it as SQL, written from the cases and not from the patterns.
FORM = [
    # x0, top, x1, six texts
    (10, 10, 120, ["1 发货人—Отправитель"] * 6),
    (10, 22, 120, ["芜湖汽车技术有限公司 安徽省芜湖市", "ABC Trading Ltd road 5", "Минская область, 220000", "ООО", "签字—Подпись", "Sender:"]),
    (10, 34, 120, ["安徽省 12号", "12 road", 'OOO СТС-ЛОГИСТИКА, УНП 1', None, "Фирма Север", "Торговый дом Восток"]),
    (300, 10, 420, ["5 到站—Станция назначения"] * 6),
    (300, 22, 420, ["中铁(КЖД)/新筑 Синьчжу", "莫斯科 Москва", "Ulan-Ude", "莫斯科", "中铁/明斯克", "6 发站 Departure Station"]),
    (10, 110, 120, ["15 货物名称 Description of Goods"] * 6),
    (10, 122, 120, ["HS CODE: 691090", "陶瓷洁具 Керамика", "ceramic ware", "数量 knot", "记号—знаки", "ceramic"]),
    (10, 134, 120, ["陶瓷 Керамика", "HS CODE 69109000", None, "tiles", "steel", None]),
    (300, 110, 420, ["22 承运人—Перевозчик"] * 6),
    (300, 122, 420, ["КЖД", "КЖД", "КЖД", "1234567", "КЖД", "КЖД"]),
    (300, 134, 420, ["123456", "РЖД", None, "РЖД", "123", "РЖД"]),
    (10, 230, 120, ["18 重量 Масса", "18 重量 Масса", "18 重量 Масса", "18 重量 Масса", "8 重量 Масса", "13 毛重 12300.5 kg"]),
    (10, 242, 120, ["95.40", "99999.5", "毛重 12300", "毛重 12300", "12300", None]),
    (10, 254, 120, [None, "100000", "净重 10800", None, None, "10800"]),
    (300, 500, 420, [None, None, None, "10800 kg", None, "12300.5 kg"]),
    (300, 230, 420, ["货值 Cargo Value 1,234.50 USD", "货值 Cargo Value", "Cargo Value", "Стоимость груза: 77", "货值", "Value of Goods 5"]),
    (300, 242, 420, [None, "USD 500", "EUR", "KZT", "знаки USD", None]),
    (300, 254, 420, [None, None, "900", None, None, None]),
    (300, 325, 420, [None, None, None, None, "币种 Currency: RUB", "Валюта CHF"]),
    (10, 330, 30, ["17"] * 6),
    (40, 334, 120, ["件数 Number of Packages", "件数 12", "Число мест 1,200 (12)", "件数", "件数", "件数"]),
    (40, 346, 120, ["480 ctn", "7", None, "签字—Подпись", None, "x"]),
    (40, 358, 120, [None, None, None, "33", None, "44 of 45"]),
    (10, 420, 120, ["MSKU1234567", "7 集装箱 Container TGHU7654321 45G1", "MSKU1234567", "AAAA1111111", "no number", "MSKU12345678"]),
    (300, 422, 420, ["22G1", None, "45G1 x", "BBBB2222222 20R0", None, None]),
]


def form_lines(spark, sf_dir):
    V.tables(spark, sf_dir, "orders")
    case = (F.col("o_orderkey") % 6).cast("int")
    entries = F.array(*[
        F.struct(F.lit(n + 1).alias("line_no"), F.lit(float(x0)).alias("x0"), F.lit(float(top)).alias("top"), F.lit(float(x1)).alias("x1"),
                 F.get(F.array(*[F.lit(t).cast("string") for t in texts]), case).alias("text"))
        for n, (x0, top, x1, texts) in enumerate(FORM)])
    rows = spark.table("orders").select(F.col("o_orderkey").alias("file"), F.lit(1).alias("page"), F.inline(entries))
    return rows.where("text is not null").withColumn("text", F.replace("text", F.lit("{k}"), F.col("file").cast("string")))


def planted(cases: dict[str, list]) -> str:
    """Rows (o_orderkey, field, value) of the checking engine from the six expected values of each field."""
    one = lambda v: "''" if v is None else "'" + str(v).replace("'", "''").replace("{k}", "' || o_orderkey || '") + "'"
    return " UNION ALL ".join(
        f"SELECT o_orderkey, '{f}' AS field, CASE o_orderkey % 6 {' '.join(f'WHEN {i} THEN {one(v)}' for i, v in enumerate(values))} END AS value FROM orders"
        for f, values in cases.items())


FORM_FIELDS = planted({
    "consignor_name": ["芜湖汽车技术有限公司", "ABC Trading Ltd", 'ООО "СТС-ЛОГИСТИКА"', "ООО", "Фирма Север", "Торговый дом Восток"],
    "destination_station": ["新筑", "莫斯科", "Ulan-Ude", "莫斯科", "明斯克", None],
    "goods_description": ["陶瓷", "陶瓷洁具", "ceramic ware", "tiles", "steel", "ceramic"],
    "hs_code": ["691090", "69109000", None, None, None, None],
    "carrier_segments": ["КЖД", "КЖД РЖД", "КЖД", "РЖД", "КЖД", "КЖД РЖД"],
    "total_packages": ["480", "12", "12", "33", None, "45"],
    "container_no": ["MSKU1234567", "TGHU7654321", "MSKU1234567", "BBBB2222222", None, None],
    "container_type": ["22G1", "45G1", "45G1", "20R0", None, None],
})


@query("form_fields", f"SELECT o_orderkey, field, value, CASE WHEN field = 'consignor_name' AND o_orderkey % 6 = 3 THEN 'needs_review' ELSE 'recognized' END AS state FROM ({FORM_FIELDS}) WHERE value <> ''")
def form_fields(spark, sf_dir):
    names = ["consignor_name", "destination_station", "goods_description", "hs_code", "carrier_segments", "total_packages", "container_no", "container_type"]
    return FM.form_fields(form_lines(spark, sf_dir)).where(F.col("field").isin(*names) & F.col("value").isNotNull()).select(
        F.col("file").alias("o_orderkey"), "field", "value", "state")


@query("form_weights", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 95.4 WHEN 1 THEN 99999.5 WHEN 4 THEN -1 WHEN 5 THEN 12300.5 ELSE 12300 END::DOUBLE AS gross_weight_kg, CASE o_orderkey % 6 WHEN 4 THEN 'not_found' ELSE 'recognized' END AS gross_state,
 CASE o_orderkey % 6 WHEN 2 THEN 10800 ELSE -1 END::DOUBLE AS net_weight_kg, CASE o_orderkey % 6 WHEN 2 THEN 'recognized' WHEN 3 THEN 'needs_review' ELSE 'not_found' END AS net_state FROM orders""")
def form_weights(spark, sf_dir):
    """95.40 and 99999.5 are weights, 100000 is none; box 8 is no weight box; a kilogram number elsewhere asks for review."""
    rows = FM.weights(written(FM.described(form_lines(spark, sf_dir))))
    return rows.withColumnRenamed("file", "o_orderkey").fillna(-1.0, ["gross_weight_kg", "net_weight_kg"])


@query("form_value", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 1234.5 WHEN 1 THEN 500 WHEN 2 THEN 900 WHEN 3 THEN 77 ELSE -1 END::DOUBLE AS value,
 CASE o_orderkey % 6 WHEN 0 THEN 'USD' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' WHEN 3 THEN 'KZT' WHEN 4 THEN 'RUB' ELSE 'CHF' END AS currency FROM orders""")
def form_value(spark, sf_dir):
    return FM.cargo_value(written(FM.described(form_lines(spark, sf_dir)))).withColumnRenamed("file", "o_orderkey").fillna(-1.0, ["value"])


COMPANIES = ["{n} Trading Ltd road 5", "{n}有限公司 北京市", 'г. Минск; OOO "Восток", УНП 1', "АО «Север» 12", "{n} Gmbh", "{n} 12 Ltd", "Company"]
COMPANY_NAMES = ["{n} Trading Ltd", "{n}有限公司", 'ООО "Восток"', 'АО "Север"', "{n} Gmbh", "{n} 12 Ltd", "Company"]


@query("company_names", f"""SELECT c_custkey, CASE c_custkey % 7 {' '.join(f"WHEN {i} THEN '" + v.replace("{n}", "' || replace(c_name, '#', 'x') || '") + "'" for i, v in enumerate(COMPANY_NAMES)).replace("replace(c_name, '#', 'x')", "regexp_replace(c_name, '[^A-Za-z]', '', 'g')")} END AS name, c_custkey % 7 = 6 AS only_form FROM customer""")
def company_names(spark, sf_dir):
    V.tables(spark, sf_dir, "customer")
    text = F.get(F.array(*[F.lit(t) for t in COMPANIES]), (F.col("c_custkey") % 7).cast("int"))
    rows = spark.table("customer").withColumn("t", F.replace(text, F.lit("{n}"), F.regexp_replace("c_name", "[^A-Za-z]", "")))
    name = FM.company(F.array("t"))
    return rows.select("c_custkey", name.alias("name"), FM.only_a_form(name).alias("only_form"))


# ---- boxes ------------------------------------------------------------------------

# a line item is a word on the page of its line number; most pages carry a caption
WORDS = """SELECT CAST(l_orderkey AS STRING) AS file, l_linenumber AS page, 100 + ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS word_no,
 CASE WHEN l_quantity < 5 THEN 'ab' ELSE CAST(5000000 + l_partkey AS STRING) END AS text, 80.0 + l_quantity * 4 AS x0, 110.0 + l_quantity * 4 AS x1, 55.0 + l_suppkey % 100 AS top, 63.0 + l_suppkey % 100 AS bottom FROM lineitem
UNION ALL SELECT DISTINCT CAST(l_orderkey AS STRING), l_linenumber, 1, CASE WHEN l_linenumber <= 4 THEN '车辆—Вагон' ELSE 'Вагон' END, 100.0, 140.0, 50.0, 60.0 FROM lineitem WHERE l_linenumber <= 6
UNION ALL SELECT DISTINCT CAST(l_orderkey AS STRING), l_linenumber, 2, 'предоставлен', 150.0, 200.0, 51.0, 60.0 FROM lineitem WHERE l_linenumber = 6"""


@query("box_lookup", f"""WITH w AS ({WORDS}), pg AS (SELECT DISTINCT file, page FROM w),
c AS (SELECT w.file, w.page, count(*) n, arg_min(text, (top, x0, text)) FILTER (WHERE regexp_matches(text, '^\\d{{7,8}}$')) v, count(DISTINCT text) FILTER (WHERE regexp_matches(text, '^\\d{{7,8}}$')) k FROM w WHERE page <= 5 AND word_no > 2 AND x0 >= 73 AND x1 <= 227 AND top >= 57 AND bottom <= 147 GROUP BY w.file, w.page)
SELECT pg.file, pg.page, CASE WHEN pg.page > 5 THEN 'anchor_missing' WHEN n IS NULL THEN 'not_found' WHEN v IS NULL THEN 'format_anomaly' WHEN k > 1 THEN 'ambiguous' ELSE 'ok' END AS status, coalesce(v, '') AS value, coalesce(n, 0) AS n_candidates FROM pg LEFT JOIN c ON pg.file = c.file AND pg.page = c.page""")
def box_lookup(spark, sf_dir):
    V.tables(spark, sf_dir, "lineitem")
    words = spark.sql(WORDS)
    pages = words.select("file", "page").distinct()
    found = B.band_values(pages, words, B.with_band(B.wagon_anchors(words), C.WAGON_BAND), C.WAGON_PATTERN)
    return found.select("file", "page", "status", F.coalesce("value", F.lit("")).alias("value"), "n_candidates")


# ---- passages -----------------------------------------------------------------------

def gram_sql(source: str, key: str) -> str:
    plain = "regexp_replace(regexp_replace(lower(text), '(\\d)\\.(\\d)', '\\1点\\2', 'g'), '[^\\w\\p{L}\\p{M}\\p{N}]+', '', 'g')"
    return (f"SELECT {key}, gram, count(*) n FROM (SELECT {key}, unnest([substr(p, i, 1) FOR i IN range(1, len(p) + 1)] || [substr(p, i, 2) FOR i IN range(1, len(p))]) gram "
            f"FROM (SELECT {key}, {plain} p FROM {source})) GROUP BY {key}, gram")


PASSAGES = "SELECT DISTINCT p_name AS passage, p_name AS text FROM part"


@query("passage_topk", f"""WITH q AS ({gram_sql('documents', 'doc_id')}), p AS ({gram_sql(f'({PASSAGES})', 'passage')}), qn AS (SELECT doc_id, sum(n * n)::DOUBLE q2 FROM q GROUP BY doc_id), pn AS (SELECT passage, sum(n * n)::DOUBLE p2 FROM p GROUP BY passage),
s AS (SELECT doc_id, passage, round(dot / (sqrt(q2) * sqrt(p2)), 4) score FROM (SELECT doc_id, passage, sum(q.n * p.n)::DOUBLE dot FROM q JOIN p ON q.gram = p.gram GROUP BY doc_id, passage) JOIN qn USING (doc_id) JOIN pn USING (passage))
SELECT doc_id, passage, CAST(round(CAST(score AS DECIMAL(10,4)), 3) AS DOUBLE) AS score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, passage) r FROM s WHERE score >= 0.12) WHERE r <= 2""")
def passage_topk(spark, sf_dir):
    V.tables(spark, sf_dir, "documents", "part")
    scores = PS.passage_scores(spark.table("documents"), spark.sql(PASSAGES), "doc_id", "passage")
    return PS.top_passages(scores, "doc_id", "passage")


# ---- evaluation ------------------------------------------------------------------------

TRUTH = "SELECT doc_id AS batch_id, CASE WHEN toxic = 1 THEN 'high' WHEN quality = 1 THEN 'low' ELSE 'medium' END AS ground_truth FROM labels"
# batches of one source could not be verified and have no result
SCORED = """SELECT batch_id, CASE WHEN ok THEN score END AS score, CASE WHEN ok THEN grade END AS grade, CASE WHEN ok THEN n_fail END AS n_fail, CASE WHEN ok THEN n_warning END AS n_warning
 FROM (SELECT doc_id AS batch_id, source <> 'src0' AS ok, CAST(n_chars AS INT) AS score, CASE WHEN n_chars > 3000 THEN 'high' WHEN n_chars > 1500 THEN 'medium' ELSE 'low' END AS grade,
 CASE WHEN n_chars > 3000 THEN 2 WHEN n_chars > 1500 THEN 1 ELSE 0 END AS n_fail, CASE WHEN lang = 'fr' THEN 2 ELSE 0 END AS n_warning FROM documents)"""
GRADED = f"""WITH t AS ({TRUTH}), s AS ({SCORED}), g AS (SELECT t.batch_id, ground_truth stored, s.grade model, CASE WHEN n_fail >= 2 OR (n_fail = 1 AND n_warning >= 2) THEN 'high' WHEN n_fail = 1 OR n_warning >= 2 THEN 'medium' ELSE 'low' END rubric, s.grade IS NULL failed FROM t LEFT JOIN s ON t.batch_id = s.batch_id),
k AS (SELECT *, CASE stored WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END a, CASE model WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END b FROM g)"""


@query("grade_eval", f"""{GRADED} SELECT count(*) AS total, count(*) FILTER (WHERE NOT failed AND stored = rubric AND rubric = model) AS agree, count(*) FILTER (WHERE failed) AS n_failed, count(*) FILTER (WHERE NOT failed AND b < a) AS under, count(*) FILTER (WHERE NOT failed AND b > a) AS over,
 round(count(*) FILTER (WHERE NOT failed AND stored = rubric AND rubric = model) / count(*), 4) AS agree_rate, round(count(*) FILTER (WHERE NOT failed AND b < a) / count(*) FILTER (WHERE NOT failed), 4) AS under_rate,
 round(count(*) FILTER (WHERE NOT failed AND b > a) / count(*) FILTER (WHERE NOT failed), 4) AS over_rate, round(count(*) FILTER (WHERE failed) / count(*), 4) AS failed_rate FROM k""")
def grade_eval(spark, sf_dir):
    V.tables(spark, sf_dir, "documents", "labels")
    return EV.agreement(EV.graded(spark.sql(SCORED), spark.sql(TRUTH)))


@query("graded_batches", f"{GRADED} SELECT batch_id, stored, CASE WHEN failed THEN 'low' ELSE rubric END AS rubric, coalesce(model, '') AS model, NOT failed AND stored = rubric AND rubric = model AS ok FROM k")
def graded_batches(spark, sf_dir):
    V.tables(spark, sf_dir, "documents", "labels")
    return EV.graded(spark.sql(SCORED), spark.sql(TRUTH)).select(
        "batch_id", "stored", "rubric", F.coalesce("model", F.lit("")).alias("model"), "ok")


@query("extraction_rates", """WITH e AS (SELECT doc_id AS file, f AS field FROM (SELECT doc_id, unnest(['a', 'b']) f FROM documents)), x AS (SELECT doc_id, 'a' field, CASE WHEN lang = 'en' THEN 'high' ELSE 'review' END confidence FROM documents)
SELECT count(*) AS expected, count(*) FILTER (WHERE confidence = 'high') AS identified, count(*) FILTER (WHERE confidence = 'review') AS review, round(count(*) FILTER (WHERE confidence = 'high') / count(*), 4) AS identification_rate, round(count(*) FILTER (WHERE confidence = 'review') / count(*), 4) AS review_rate
FROM e LEFT JOIN x ON e.file = x.doc_id AND e.field = x.field""")
def extraction_rates(spark, sf_dir):
    docs = V.read(spark, sf_dir, "documents")
    expected = docs.select(F.col("doc_id").alias("file"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("field"))
    found = docs.select(F.col("doc_id").alias("file"), F.lit("a").alias("field"),
                        F.when(F.col("lang") == "en", "high").otherwise("review").alias("confidence"))
    return EV.extraction_rates(expected, found)


# ---- audit ----------------------------------------------------------------------------------

def audit_log(spark, sf_dir):
    return V.read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("username"), F.col("event_type").alias("action"),
        F.col("ts").alias("created_at"))


AUDIT = "FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts < TIMESTAMP '2024-01-21 00:00:00'"


@query("audit_query", f"SELECT event_id AS id, CAST(user_id AS VARCHAR) AS username {AUDIT} ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET 50")
def audit_query(spark, sf_dir):
    page = AU.audit_page(audit_log(spark, sf_dir), 100, 50, action="error", since=dt.datetime(2024, 1, 3), until=dt.date(2024, 1, 20))
    return page.select("id", "username")


@query("audit_count", f"SELECT count(*) AS c {AUDIT}")
def audit_count(spark, sf_dir):
    return AU.audit_count(audit_log(spark, sf_dir), action="error", since=dt.datetime(2024, 1, 3), until=dt.date(2024, 1, 20))


# ---- JSON records and streams -----------------------------------------------------------------

# one record per shipment with two documents; by month: elements that are no documents, a numeric type, fields
# that are no object, broken JSON, no documents at all, no batch id
RECORD = """SELECT batch_id, CASE mo WHEN 1 THEN replace(r, '"documents":[', '"documents":[null,5,"x",') WHEN 2 THEN replace(r, '"doc_type":"packing_list"', '"doc_type":7')
 WHEN 3 THEN replace(r, '"fields":', '"fields":"none","more":') WHEN 4 THEN substr(r, 1, 40) WHEN 5 THEN replace(r, '"documents":', '"papers":') WHEN 6 THEN replace(r, '"batch_id":', '"id":') ELSE r END AS raw
FROM (SELECT batch_id, mo, to_json(named_struct('batch_id', batch_id, 'documents', array(
  named_struct('doc_type', 'invoice', 'doc_id', 'I' || batch_id, 'fields', named_struct('total_packages', 100 + p_size, 'total_amount', CAST(amt AS DOUBLE), 'consignee_name', c_name)),
  named_struct('doc_type', 'packing_list', 'doc_id', 'P' || batch_id, 'fields', named_struct('total_packages', 100 + p_size, 'total_amount', CAST(NULL AS DOUBLE), 'consignee_name', c_name))))) AS r FROM shipments)"""


def records(spark, sf_dir):
    V.view(spark, sf_dir, "shipments")
    return spark.sql(RECORD)


@query("json_documents", f"""{V.duck_with('shipments')}, k AS (SELECT *, unnest([0, 1]) AS d FROM shipments) SELECT batch_id, d + CASE mo WHEN 1 THEN 3 ELSE 0 END AS doc_index, CASE WHEN d = 0 THEN 'invoice' WHEN mo = 2 THEN '7' ELSE 'packing_list' END AS doc_type,
 CASE WHEN mo = 3 THEN 0 WHEN d = 0 THEN 3 ELSE 2 END AS n_fields, CASE mo WHEN 3 THEN '' ELSE CAST(100 + p_size AS VARCHAR) END AS packages, CASE mo WHEN 3 THEN '' ELSE 'BIGINT' END AS kind,
 CASE mo WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS structure_problems FROM k WHERE mo NOT IN (4, 5, 6)""")
def json_documents(spark, sf_dir):
    batches = parse_batches(records(spark, sf_dir))
    docs = explode_documents(batches)
    pkg = F.try_element_at("fields", F.lit("total_packages"))
    return docs.join(batches.select("batch_id", "structure_problems"), "batch_id").select(
        "batch_id", "doc_index", "doc_type", F.size("fields").alias("n_fields"), F.coalesce(pkg["text"], F.lit("")).alias("packages"),
        F.coalesce(pkg["kind"], F.lit("")).alias("kind"), "structure_problems")


@query("record_structure", f"""{V.duck_with('shipments')} SELECT batch_id, CASE mo WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 5 THEN 1 ELSE 0 END AS structure_problems, mo IN (1, 2, 3, 5) AS fails FROM shipments WHERE mo NOT IN (4, 6)""")
def record_structure(spark, sf_dir):
    """Records that can be read and name a batch, and whether their structure fails them."""
    rows = parse_batches(records(spark, sf_dir)).select("batch_id", "structure_problems")
    return rows.withColumn("fails", F.col("structure_problems") > 0)


_ENTRIES = ", ".join(f"""CASE WHEN "{f}" IS NOT NULL THEN '{{"f":"{f}","v":"STRING:' || CAST("{f}" AS VARCHAR) || '"}}' END""" for f in V.TEXTS)
VERSIONS = f"""{V.duck_with('docs')}, v AS (SELECT batch_id, doc_index, substr(sha256(doc_type || '|' || doc_id || '|' || array_to_string(list_sort(list_filter([{_ENTRIES}], lambda x: x IS NOT NULL)), ',')), 1, 16) AS doc_version FROM docs)"""


def worded(spark, sf_dir):
    """Documents with their text fields."""
    return docs_from_wide(V.view(spark, sf_dir, "docs"), V.TEXTS)


@query("content_versions", f"{VERSIONS} SELECT * FROM v")
def content_version_rows(spark, sf_dir):
    return content_versions(worded(spark, sf_dir))


@query("batch_versions", f"""{VERSIONS}, p AS (SELECT batch_id, doc_index // 2 AS piece, count(*) AS n, sha256(string_agg(doc_version, ',' ORDER BY doc_index)) AS h FROM v GROUP BY batch_id, doc_index // 2)
SELECT batch_id, CAST(sum(n) AS BIGINT) AS n_docs, substr(sha256(CAST(sum(n) AS BIGINT) || '|' || string_agg(h, ',' ORDER BY piece)), 1, 16) AS batch_version FROM p GROUP BY batch_id""")
def batch_version_rows(spark, sf_dir):
    """Pieces of two documents, so that every batch has several."""
    return batch_versions(worded(spark, sf_dir), 2)


def _arrivals(spark, sf_dir, rows) -> str:
    """Write records as JSON lines into a new folder of the cluster's shared space."""
    folder = f"{shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    rows.select(F.col("raw").alias("value")).write.option("compression", "gzip").text(f"{folder}/in")
    return folder


def _stream(spark, folder):
    lines = spark.readStream.text(f"{folder}/in")
    return lines.select(F.lit("").alias("file"), F.col("value").alias("raw"),
                        F.col("_metadata.file_modification_time").alias("arrived"))


def full_records(spark, sf_dir):
    """Every shipment with all its documents and its declared composition as one JSON line."""
    docs = V.view(spark, sf_dir, "docs").withColumn("route_countries", T.country_list(F.col("route_text")))
    document = F.struct("doc_index", "doc_type", "doc_id", F.struct(*V.TEXTS, "route_countries").alias("fields"))
    per_batch = docs.groupBy("batch_id").agg(F.sort_array(F.collect_list(document)).alias("documents"))
    declared = V.batches(spark, sf_dir).select("batch_id", F.col("declared").alias("declared_composition"))
    return per_batch.join(declared, "batch_id").select(F.to_json(F.struct("batch_id", "declared_composition", "documents")).alias("raw"))


@query("stream_verify", f"SELECT batch_id, score, grade, n_pass, n_warning, n_fail FROM ({CHECK_SQL['verify_all_risk']})")
def stream_verify(spark, sf_dir):
    """All documents of all shipments arrive as records; the stream has to score them as the batch job does."""
    folder = _arrivals(spark, sf_dir, full_records(spark, sf_dir))
    drop_shuffles(spark)
    jobs.verify_stream(_stream(spark, folder), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("batch_id", "score", "grade", "n_pass", "n_warning", "n_fail")


@query("stream_dedupe", "SELECT c_mktsegment AS segment, c_nationkey AS nation FROM customer GROUP BY ALL")
def stream_dedupe(spark, sf_dir):
    """Customers announce segment and nation; repeated announcements are dropped."""
    V.tables(spark, sf_dir, "customer")
    rows = spark.sql("SELECT to_json(named_struct('s', c_mktsegment, 'n', c_nationkey)) AS raw FROM customer")
    folder = _arrivals(spark, sf_dir, rows)
    once = jobs.without_repeats(_stream(spark, folder))
    jobs.append_stream(once.select("raw"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema("raw string").parquet(f"{folder}/out").select(
        F.get_json_object("raw", "$.s").alias("segment"), F.get_json_object("raw", "$.n").cast("int").alias("nation"))


@query("audit_append", "SELECT event_id AS object_id, user_id AS user FROM events")
def audit_append(spark, sf_dir):
    """Events appended to an audit table, read back."""
    folder = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    events = V.read(spark, sf_dir, "events")
    sinks.append_audit(sinks.audit_rows(events, "importer", "append", "event", "event_id", ["user_id", "event_type"]), folder)
    return spark.read.parquet(folder).select(
        F.col("object_id").cast("long").alias("object_id"),
        F.get_json_object("detail", "$.user_id").cast("long").alias("user"))

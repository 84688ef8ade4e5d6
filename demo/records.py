"""Queries on stored tables, small lookups and text helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from demo import views as V
from demo.registry import query
from waybridge.functions import text as T
from waybridge.functions.canonical import pair_signature
from waybridge.functions.dates import business_time
from waybridge.functions.numbers import edited_number
from waybridge.operators import boxes as B, funds as FU, lookup as L, numbering as N, pairing as PR, recon as RC, scenario as SC
from waybridge.operators import sinks as SK, tables as TB
from waybridge.sources import refdata
from waybridge.sources.batches import META_TYPE, assemble_batch
from waybridge.functions.canonical import FIELD_TYPE

# ---- tables ----------------------------------------------------------------------

# stored customers, and rows that arrive for some of them and for new ones
OLD = "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 3 <> 0"
NEW = "SELECT c_custkey, c_name || '!' AS c_name, c_nationkey FROM customer WHERE c_custkey % 2 = 0"


def _rows(spark, sf_dir, sql):
    V.tables(spark, sf_dir, "customer")
    return spark.sql(sql)


@query("insert_absent", f"SELECT * FROM ({OLD}) UNION ALL SELECT * FROM ({NEW}) WHERE c_custkey % 3 = 0")
def insert_absent(spark, sf_dir):
    return TB.insert_absent(_rows(spark, sf_dir, OLD), spark.sql(NEW), ["c_custkey"])


@query("rejected_creates", "SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND c_nationkey > 10")
def rejected_creates(spark, sf_dir):
    mode = F.when(F.col("c_nationkey") > 10, "create").otherwise("upsert")
    return TB.rejected_creates(_rows(spark, sf_dir, OLD), spark.sql(NEW).withColumn("mode", mode), ["c_custkey"]).select("c_custkey")


@query("replace_keys", f"SELECT * FROM ({OLD}) WHERE c_nationkey >= 5 UNION ALL SELECT * FROM ({NEW}) WHERE c_nationkey < 5")
def replace_keys(spark, sf_dir):
    """Customers of some nations are written again as a whole."""
    return TB.replace_keys(_rows(spark, sf_dir, OLD), spark.sql(f"SELECT * FROM ({NEW}) WHERE c_nationkey < 5"), ["c_nationkey"])


@query("point_read", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7")
def point_read(spark, sf_dir):
    return RC.point_read(V.read(spark, sf_dir, "customer"), "c_nationkey", 7, "c_custkey").select("c_custkey", "c_name")


CREATED = "SELECT CAST(o_orderkey AS {text}) AS batch_id, o_orderdate AS created_at, o_custkey FROM orders"


@query("recent_batches", f"SELECT batch_id FROM ({CREATED.format(text='VARCHAR')}) ORDER BY created_at DESC, batch_id LIMIT 20")
def recent_batches(spark, sf_dir):
    V.tables(spark, sf_dir, "orders")
    return SK.recent(spark.sql(CREATED.format(text="STRING"))).select("batch_id")


@query("newest_hits", f"SELECT o_custkey AS query_id, batch_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY created_at DESC, batch_id) AS r FROM ({CREATED.format(text='VARCHAR')})) WHERE r <= 5")
def newest_hits(spark, sf_dir):
    """The newest batches that each customer's query names."""
    V.tables(spark, sf_dir, "orders")
    batches = spark.sql(CREATED.format(text="STRING"))
    return L.newest(batches.select(F.col("o_custkey").alias("query_id"), "batch_id"), batches).select("query_id", "batch_id")


# ---- estimates and funds ------------------------------------------------------------

ESTIMATES = """SELECT 'EST-' || CAST(o_orderkey AS {text}) AS est_no, CASE WHEN o_orderstatus = 'F' THEN 'T' || CAST(o_custkey AS {text}) END AS official_no, o_orderdate AS created_at FROM orders"""


@query("list_estimates", f"SELECT est_no FROM ({ESTIMATES.format(text='VARCHAR')}) WHERE official_no IS NULL ORDER BY created_at DESC, est_no LIMIT 200")
def list_estimates(spark, sf_dir):
    V.tables(spark, sf_dir, "orders")
    return N.list_estimates(spark.sql(ESTIMATES.format(text="STRING")), locked=False).select("est_no")


@query("number_history", f"SELECT 'T' || c_custkey AS trip_no, est_no FROM customer JOIN ({ESTIMATES.format(text='VARCHAR')}) ON official_no = 'T' || c_custkey")
def number_history(spark, sf_dir):
    V.tables(spark, sf_dir, "orders", "customer")
    trips = spark.table("customer").select(F.concat(F.lit("T"), "c_custkey").alias("trip_no"))
    return N.number_history(trips, spark.sql(ESTIMATES.format(text="STRING"))).select("trip_no", "est_no")


@query("list_fund_batches", "SELECT CAST(o_orderkey AS VARCHAR) AS batch_id FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS d FROM orders) ORDER BY d DESC NULLS LAST, CAST(o_orderkey AS VARCHAR) LIMIT 200")
def list_fund_batches(spark, sf_dir):
    rows = V.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("batch_id"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("paid_at"))
    return FU.list_batches(rows).select("batch_id")


@query("subsidy_anomalies", "SELECT o_orderkey, count(l_orderkey) AS n, coalesce(string_agg(l_linestatus || l_linenumber, ',' ORDER BY l_linestatus, l_linenumber), '') AS fields FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def subsidy_anomalies(spark, sf_dir):
    """Flags of returned line items kept beside the order they belong to."""
    V.tables(spark, sf_dir, "orders", "lineitem")
    flags = spark.sql("SELECT l_orderkey AS o_orderkey, l_linestatus || CAST(l_linenumber AS STRING) AS field, l_quantity AS value, l_partkey AS other_key, l_shipdate AS other_date FROM lineitem WHERE l_returnflag = 'R'")
    rows = RC.anomaly_snapshot(spark.table("orders").select("o_orderkey"), flags, "o_orderkey")
    return rows.select("o_orderkey", F.coalesce(F.size("anomalies"), F.lit(0)).cast("long").alias("n"),
                       F.coalesce(F.concat_ws(",", "anomalies.field"), F.lit("")).alias("fields"))


# ---- small tables ----------------------------------------------------------------------


@query("code_countries", "SELECT 'N' || n_nationkey % 9 AS code, count(DISTINCT CASE WHEN n_nationkey >= 18 THEN 'same' ELSE n_name END) AS n FROM nation GROUP BY n_nationkey % 9 HAVING count(DISTINCT CASE WHEN n_nationkey >= 18 THEN 'same' ELSE n_name END) > 1")
def code_countries(spark, sf_dir):
    V.tables(spark, sf_dir, "nation")
    return PR.check_countries(spark.sql("SELECT 'dest' AS category, 'N' || CAST(n_nationkey % 9 AS STRING) AS code, n_name AS name, CASE WHEN n_nationkey >= 18 THEN 'same' ELSE n_name END AS country FROM nation"))


@query("preset_opinions", """WITH c AS (SELECT p_partkey, substr(sha1('CONS-001|' || least(trim(p_name), trim(p_type)) || '||' || greatest(trim(p_name), trim(p_type))), 1, 16) AS signature, p_size FROM part), o AS (SELECT DISTINCT signature FROM c WHERE p_size < 20)
SELECT p_partkey, c.signature, CASE WHEN o.signature IS NULL THEN '' ELSE 'same goods' END AS verdict, CASE WHEN o.signature IS NULL THEN '' ELSE 'preset' END AS source FROM c LEFT JOIN o ON c.signature = o.signature""")
def preset_opinions(spark, sf_dir):
    """Opinions stored for the signatures of some pairs of texts."""
    cases = V.read(spark, sf_dir, "part").withColumn("signature", pair_signature(F.col("p_type"), F.col("p_name")))
    presets = cases.where("p_size < 20").select("signature", F.lit("same goods").alias("verdict")).distinct()
    out = refdata.with_preset_opinion(cases.select("p_partkey", "signature"), presets)
    return out.select("p_partkey", "signature", F.coalesce("verdict", F.lit("")).alias("verdict"), F.coalesce("source", F.lit("")).alias("source"))


@query("risk_change", "SELECT CAST(o_orderkey AS VARCHAR) AS batch_id, 's' || n AS scenario_id, o_custkey % 100 AS score, (o_custkey + n) % 100 AS new_score FROM orders, range(0, 2) t(n)")
def risk_change(spark, sf_dir):
    """Scores of two scenarios beside the score before the edit."""
    base = V.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("batch_id"), (F.col("o_custkey") % 100).alias("score"), F.lit("low").alias("grade"), "o_custkey")
    edited = base.select("grade", "o_custkey", "batch_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("n")).select(
        F.concat("batch_id", F.lit("#s"), "n").alias("batch_id"), ((F.col("o_custkey") + F.col("n")) % 100).alias("score"), "grade")
    return SC.risk_change(base, edited).select("batch_id", "scenario_id", "score", "new_score")


@query("assembled_documents", """SELECT CAST(l_orderkey AS VARCHAR) AS batch_id, l_linenumber AS doc_index, 'PDF-' || substr('scan of order ' || l_orderkey || ' and more pages', 1, 24) || CASE WHEN l_quantity > 25 THEN '-P' || l_partkey ELSE '' END AS doc_id FROM lineitem WHERE l_returnflag <> 'R'""")
def assembled_documents(spark, sf_dir):
    """Line items as files of a batch; returned ones could not be read."""
    rows = V.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("batch_id"), F.concat(F.lit("scan of order "), "l_orderkey", F.lit(" and more pages.pdf")).alias("file"),
        F.col("l_partkey").alias("page_no"), F.lit("invoice").alias("doc_type"), F.lit(None).cast(f"map<string,{FIELD_TYPE}>").alias("fields"),
        F.lit(None).cast(META_TYPE).alias("field_meta"), F.when(F.col("l_returnflag") == "R", "unreadable").alias("error"),
        (F.col("l_quantity") > 25).alias("multi"), F.col("l_linenumber").alias("upload_order"))
    return assemble_batch(rows).select("batch_id", "doc_index", "doc_id")


# ---- texts ----------------------------------------------------------------------------------


@query("business_times", "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') AS t FROM events")
def business_times(spark, sf_dir):
    return V.read(spark, sf_dir, "events").select("event_id", business_time(F.col("ts")).alias("t"))


@query("one_line_texts", "SELECT doc_id, CASE WHEN length(t) > 60 THEN substr(t, 1, 60) || '…' ELSE t END AS line FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def one_line_texts(spark, sf_dir):
    return V.read(spark, sf_dir, "documents").select("doc_id", T.one_line(F.col("text")).alias("line"))


@query("money_texts", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '未填写' ELSE format('{:,}', c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') END AS shown
 FROM (SELECT o_orderkey, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS c FROM orders)""")
def money_texts(spark, sf_dir):
    amount = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("decimal(18,2)"))
    return V.read(spark, sf_dir, "orders").select("o_orderkey", T.money_text(amount).alias("shown"))


_IDS = """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'B-' || CAST(o_orderkey AS {text}) WHEN 'O' THEN CAST(o_orderkey AS {text}) || '#' ELSE CAST(o_orderkey AS {text}) || '_' || o_orderpriority END AS batch_id FROM orders"""


@query("usable_batch_ids", f"SELECT o_orderkey, regexp_matches(batch_id, '^[A-Za-z0-9_-]{{4,64}}$') AS usable FROM ({_IDS.format(text='VARCHAR')})")
def usable_batch_ids(spark, sf_dir):
    V.tables(spark, sf_dir, "orders")
    return spark.sql(_IDS.format(text="STRING")).select("o_orderkey", T.is_batch_id(F.col("batch_id")).alias("usable"))


EDITS = ["{n}", " {n}.456 ", "1,{n}.5", "about {n}", " ", "-{n}.005"]


@query("edited_numbers", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN k || '.00' WHEN 1 THEN k || '.46' WHEN 2 THEN '1' || k || '.50' WHEN 3 THEN 'about ' || k WHEN 4 THEN '' ELSE '-' || k || '.01' END AS value FROM (SELECT o_orderkey, CAST(100 + o_orderkey % 900 AS VARCHAR) AS k FROM orders)""")
def edited_numbers(spark, sf_dir):
    text = F.replace(F.get(F.array(*[F.lit(t) for t in EDITS]), (F.col("o_orderkey") % 6).cast("int")), F.lit("{n}"),
                     (100 + F.col("o_orderkey") % 900).cast("string"))
    return V.read(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(edited_number(text), F.lit("")).alias("value"))


WORDS = "SELECT CAST(l_orderkey AS {text}) AS file, l_linenumber % 2 AS page, l_partkey * 1000 + l_suppkey AS word_no, CASE WHEN l_quantity < 10 THEN 'none' ELSE 'x MSKU' || lpad(CAST(l_partkey AS {text}), 7, '0') END AS text, CAST(l_suppkey % 100 * 8 AS DOUBLE) AS top FROM lineitem"


@query("page_containers", f"""WITH w AS ({WORDS.format(text='VARCHAR')}), h AS (SELECT file, page, substr(text, 3) AS value, top, word_no FROM w WHERE text <> 'none')
SELECT w.file, w.page, coalesce(v, '') AS value, coalesce(n, 0) AS n_candidates, CASE WHEN v IS NULL THEN 'not_found' ELSE 'ok' END AS status FROM (SELECT DISTINCT file, page FROM w) w LEFT JOIN (SELECT file, page, arg_min(value, (CASE WHEN top <= 800 * {{lower}} THEN 1 ELSE 0 END) * 1000000000 + word_no) AS v, count(DISTINCT value) AS n FROM h GROUP BY file, page) x ON w.file = x.file AND w.page = x.page""".replace("{lower}", str(B.C.LOWER_PAGE)))
def page_containers(spark, sf_dir):
    """Container numbers on pages of 800 points; those in the lower part come first."""
    V.tables(spark, sf_dir, "lineitem")
    words = spark.sql(WORDS.format(text="STRING"))
    pages = words.select("file", "page").distinct().withColumn("height", F.lit(800.0))
    return B.container_values(pages, words).withColumn("value", F.coalesce("value", F.lit("")))


# ---- input checks and details of trips -----------------------------------------------------

# settlements and subsidies that arrive for orders; finished orders are the known trips
ENTRIES = """SELECT o_orderkey, CAST(o_orderkey AS {text}) AS trip_no, CASE month(o_orderdate) WHEN 1 THEN 'x1' WHEN 2 THEN ' ' ELSE CAST(o_custkey AS {text}) END AS settle_total,
 CASE month(o_orderdate) WHEN 3 THEN '1,000.5' WHEN 4 THEN '--' END AS actual_freight, CASE month(o_orderdate) WHEN 5 THEN 'open' WHEN 6 THEN 'pending' END AS record_status,
 CASE month(o_orderdate) WHEN 7 THEN 'odd' WHEN 8 THEN 'suspect' END AS review_status, o_orderstatus AS st FROM orders"""
_PROBLEMS = "CASE WHEN st <> 'F' THEN 'unknown number' END, CASE month WHEN 1 THEN 'settle_total not numeric' {missing} END, CASE month WHEN 4 THEN 'actual_freight not numeric' END, CASE month WHEN 5 THEN 'bad record_status' END{more}"


def _problem_sql(missing: str, more: str, also: str) -> str:
    said = _PROBLEMS.format(missing=missing, more=more)
    return f"SELECT o_orderkey, concat_ws(',', {said}) AS problems FROM (SELECT o_orderkey, o_orderstatus AS st, month(o_orderdate) AS month FROM orders) WHERE st <> 'F' OR month IN (1, 4, 5{also})"


def _entries(spark, sf_dir):
    V.tables(spark, sf_dir, "orders")
    rows = spark.sql(ENTRIES.format(text="STRING"))
    return rows, rows.where("st = 'F'").select("trip_no")


@query("settlement_problems", _problem_sql("WHEN 2 THEN 'settle_total missing'", "", ", 2"))
def settlement_problems(spark, sf_dir):
    rows, trips = _entries(spark, sf_dir)
    out = RC.entry_problems(rows.drop("review_status"), trips, ["settle_total", "actual_freight"], ["settle_total"])
    return out.select("o_orderkey", F.concat_ws(",", "problems").alias("problems"))


@query("subsidy_problems", _problem_sql("", ", CASE month WHEN 7 THEN 'bad review_status' END", ", 7"))
def subsidy_problems(spark, sf_dir):
    rows, trips = _entries(spark, sf_dir)
    out = RC.entry_problems(rows, trips, ["settle_total", "actual_freight"])
    return out.select("o_orderkey", F.concat_ws(",", "problems").alias("problems"))


@query("trip_entries", """SELECT o_custkey AS trip_no, 'estimate' AS kind, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, 'EST-' || o_orderkey AS entry FROM orders
 UNION ALL SELECT l_suppkey, 'prepayment', row_number() OVER (PARTITION BY l_suppkey ORDER BY n), CAST(n AS VARCHAR) FROM (SELECT DISTINCT l_suppkey, l_orderkey * 10 + l_linenumber AS n FROM lineitem)
 UNION ALL SELECT l_suppkey, 'flag', row_number() OVER (PARTITION BY l_suppkey ORDER BY n), 'R' || n FROM (SELECT DISTINCT l_suppkey, l_orderkey * 10 + l_linenumber AS n FROM lineitem WHERE l_returnflag = 'R')""")
def trip_entries(spark, sf_dir):
    """Suppliers as trips with hundreds of prepayments each."""
    V.tables(spark, sf_dir, "orders", "lineitem")
    paid = spark.sql("SELECT DISTINCT l_suppkey AS trip_no, l_orderkey * 10 + l_linenumber AS `order`, l_returnflag FROM lineitem")
    prepayments = paid.select("trip_no", "order").distinct().withColumn("entry", F.col("order").cast("string"))
    flags = paid.where("l_returnflag = 'R'").select("trip_no", "order").withColumn("entry", F.concat(F.lit("R"), "order"))
    estimates = spark.sql("SELECT o_custkey AS trip_no, o_orderkey AS `order`, 'EST-' || CAST(o_orderkey AS STRING) AS entry FROM orders")
    return RC.trip_entries(prepayments, flags, estimates)


# ---- stored batches ------------------------------------------------------------------------

# a stored batch is an order with its lines as documents and its returned lines as issues; finished orders are verified again
def _tables(spark, sf_dir, mark, where):
    V.tables(spark, sf_dir, "orders", "lineitem")
    batches = spark.sql(f"SELECT CAST(o_orderkey AS STRING) AS batch_id, '{mark}' AS version FROM orders WHERE {where}")
    lines = spark.sql("SELECT CAST(l_orderkey AS STRING) AS batch_id, l_linenumber AS doc_index, CAST(l_partkey AS STRING) AS doc_id, 'invoice' AS doc_type, CAST(l_returnflag = 'R' AS INT) AS fail_count, CAST(l_returnflag = 'A' AS INT) AS warning_count FROM lineitem")
    lines = lines.join(batches.select("batch_id"), "batch_id", "left_semi")
    return {"batches": batches, "documents": SK.stored_documents(lines).withColumn("version", F.lit(mark)),
            "issues": lines.where("fail_count > 0").select("batch_id", "doc_index", F.lit(mark).alias("version"))}


_COUNTED = """SELECT name, version, count(*) AS n FROM (SELECT 'batches' AS name, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE 'old' END AS version FROM orders
 UNION ALL SELECT 'documents', CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE 'old' END FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 UNION ALL SELECT 'issues', CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE 'old' END FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R') GROUP BY name, version"""


@query("save_batches_twice", _COUNTED)
def save_batches_twice(spark, sf_dir):
    """All three tables of a verified batch; saving again changes nothing."""
    old, new = _tables(spark, sf_dir, "old", "true"), _tables(spark, sf_dir, "new", "o_orderstatus = 'F'")
    saved = SK.save_batches(SK.save_batches(old, new), new)
    out = None
    for name, rows in saved.items():
        part = rows.groupBy("version").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "version", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("stored_batch", "SELECT CAST(l_orderkey AS VARCHAR) AS batch_id, l_linenumber AS doc_index, CAST(l_partkey AS VARCHAR) AS doc_id, CASE l_returnflag WHEN 'R' THEN 'FAIL' WHEN 'A' THEN 'WARNING' ELSE 'PASS' END AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def stored_batch(spark, sf_dir):
    stored = _tables(spark, sf_dir, "old", "true")
    return SK.assemble(stored["batches"], stored["documents"].drop("version")).select("batch_id", "doc_index", "doc_id", "status")

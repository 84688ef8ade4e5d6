"""Inputs derived from the given tables.

The SQL here prepares inputs only and is written in the common part of both dialects,
so that a query and its check start from the same rows. Every row of the tables is
used; what varies between shipments follows from their own attributes (status,
priority, month, segment, region).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from waybridge.functions import text as T
from waybridge.sources.batches import docs_from_wide

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

TEXTS = ["invoice_no", "packing_list_no", "waybill_no", "declaration_no", "co_no", "consignor_name",
         "consignee_name", "goods_description", "total_packages", "gross_weight_kg", "net_weight_kg",
         "total_amount", "declared_value", "currency", "container_no", "waybill_type", "departure_station",
         "destination_station", "departure_country", "destination_country", "issuer"]

SHIPMENTS = """
SELECT CAST(o_orderkey AS STRING) AS batch_id, o_orderkey, o_custkey, o_orderstatus AS st,
       CAST(substr(o_orderpriority, 1, 1) AS INT) AS pr, month(o_orderdate) AS mo,
       CAST(o_totalprice AS DECIMAL(18,2)) AS amt, c_name, c_mktsegment AS seg, n_nationkey, n_name,
       n_regionkey AS rk, p_name, p_size, p_type
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
     JOIN part ON p_partkey = o_custkey
"""

# a shipment has five documents; some lack the certificate, some carry a second invoice
KINDS = ["invoice", "packing_list", "waybill", "export_customs_declaration", "certificate_of_origin", "second"]

DOCUMENTS = """
SELECT batch_id,
 CASE kind WHEN 'invoice' THEN 0 WHEN 'packing_list' THEN 1 WHEN 'waybill' THEN 2
   WHEN 'export_customs_declaration' THEN 3 WHEN 'certificate_of_origin' THEN 4 ELSE 5 END AS doc_index,
 CASE WHEN kind = 'waybill' AND rk = 4 AND pr >= 4 THEN 'smgs_rail_waybill' WHEN kind = 'waybill' THEN 'railway_waybill'
   WHEN kind = 'second' THEN 'invoice' ELSE kind END AS doc_type,
 kind || '-' || batch_id AS doc_id,
 CASE WHEN kind = 'invoice' AND pr = 2 AND mo = 5 THEN ' ' WHEN kind = 'invoice' OR (kind = 'second' AND mo = 9)
   THEN 'INV-' || batch_id WHEN kind = 'second' THEN 'INV2-' || batch_id END AS invoice_no,
 CASE WHEN kind = 'packing_list' THEN 'PL-' || batch_id END AS packing_list_no,
 CASE WHEN kind = 'waybill' THEN 'SMU/' || batch_id
   WHEN kind = 'export_customs_declaration' AND mo = 3 AND st = 'F' THEN 'SMU/W' || batch_id
   WHEN kind = 'export_customs_declaration' AND mo = 3 AND st = 'P' THEN NULL
   WHEN kind = 'export_customs_declaration' THEN 'smu/' || batch_id END AS waybill_no,
 CASE WHEN kind = 'export_customs_declaration' THEN 'DEC' || batch_id END AS declaration_no,
 CASE WHEN kind = 'certificate_of_origin' THEN 'CO-' || batch_id END AS co_no,
 CASE WHEN kind = 'invoice' AND mo = 6 AND st = 'P' THEN NULL ELSE n_name END AS consignor_name,
 CASE WHEN kind = 'export_customs_declaration' AND seg = 'MACHINERY' AND mo = 2 THEN c_name || '.'
   WHEN kind = 'waybill' THEN upper(replace(c_name, '#', ' # ')) ELSE c_name END AS consignee_name,
 CASE WHEN kind = 'export_customs_declaration' AND st = 'F' AND mo = 4 THEN CAST(p_size AS STRING) || 'mm ' || p_name
   WHEN kind = 'export_customs_declaration' AND mo = 6 THEN p_name || ' ' || CAST(p_size + 1 AS STRING) || 'mm'
   WHEN kind = 'export_customs_declaration' AND mo = 8 THEN p_type || ' item ' || CAST(p_size AS STRING) || 'mm'
   WHEN kind = 'export_customs_declaration' AND mo = 9 THEN p_name || ' without box ' || CAST(p_size AS STRING) || 'mm'
   WHEN kind = 'packing_list' THEN p_name || '  ' || CAST(p_size AS STRING) || 'mm '
   ELSE p_name || ' ' || CAST(p_size AS STRING) || 'mm' END AS goods_description,
 CASE WHEN kind = 'export_customs_declaration' AND pr = 2 AND st = 'F' THEN CAST(100 + p_size - 5 AS STRING)
   WHEN kind = 'packing_list' AND mo = 12 AND st = 'F' THEN CAST(100 + p_size AS STRING) || '.5'
   WHEN kind = 'waybill' AND mo = 12 AND st = 'O' AND pr = 1 THEN '-1'
   ELSE CAST(100 + p_size AS STRING) END AS total_packages,
 CASE WHEN kind = 'certificate_of_origin' THEN NULL
   WHEN kind = 'invoice' AND mo = 10 AND st = 'O' THEN '12000kg'
   WHEN kind = 'waybill' AND mo = 11 AND st = 'O' AND pr = 1 THEN 'NaN'
   WHEN kind = 'packing_list' THEN CAST(12000 + 48 * (pr - 1) AS STRING)
   WHEN kind = 'waybill' THEN '12,000' ELSE '12000' END AS gross_weight_kg,
 CASE WHEN kind = 'packing_list' AND mo <> 1 THEN '10800' END AS net_weight_kg,
 CASE WHEN kind = 'invoice' AND mo = 1 AND pr = 1 THEN CAST(amt AS STRING) || 'USD'
   WHEN kind = 'invoice' AND mo = 1 AND pr = 2 THEN '0'
   WHEN kind IN ('invoice', 'second') THEN CAST(amt AS STRING) END AS total_amount,
 CASE WHEN kind = 'export_customs_declaration' THEN CASE
   WHEN mo = 11 THEN CAST(CAST(amt * 0.984 AS DECIMAL(18,2)) AS STRING)
   WHEN mo = 3 THEN CAST(CAST(amt * 0.996 AS DECIMAL(18,2)) AS STRING)
   WHEN mo = 2 AND pr = 3 THEN CAST(amt AS STRING) || ' USD'
   ELSE CAST(amt AS STRING) END END AS declared_value,
 CASE WHEN kind IN ('invoice', 'second') THEN 'usd' WHEN kind = 'export_customs_declaration' THEN CASE
   WHEN mo = 5 AND st = 'P' THEN NULL WHEN mo = 7 AND st = 'O' THEN 'EUR' ELSE 'USD' END END AS currency,
 CASE WHEN kind = 'export_customs_declaration' AND mo = 2 AND st = 'O' AND pr = 3 THEN 'TCLU9999999'
   WHEN kind IN ('packing_list', 'waybill', 'export_customs_declaration')
   THEN 'MSKU' || lpad(CAST(o_custkey AS STRING), 7, '0') END AS container_no,
 CASE WHEN kind = 'waybill' THEN CASE WHEN rk = 4 AND pr >= 4 THEN NULL WHEN rk = 2 THEN 'CIM/SMGS统一运单'
   WHEN rk = 3 THEN 'CIM国际铁路运单' WHEN rk = 4 AND pr = 1 THEN 'AIR WAYBILL' ELSE 'SMGS国际货协运单' END END AS waybill_type,
 CASE WHEN kind = 'waybill' THEN '中国 西安新筑站' END AS departure_station,
 CASE WHEN kind = 'waybill' AND mo <> 2 THEN '德国 杜伊斯堡' END AS destination_station,
 CASE WHEN kind = 'export_customs_declaration' THEN '中国' END AS departure_country,
 CASE WHEN kind = 'export_customs_declaration' THEN CASE WHEN mo = 1 AND st = 'F' THEN '法国' WHEN mo = 1 AND st = 'P' THEN NULL
   WHEN rk IN (1, 2) THEN '土耳其' ELSE '德国' END END AS destination_country,
 CASE WHEN kind = 'certificate_of_origin' THEN 'CCPIT' END AS issuer,
 CASE WHEN kind = 'waybill' THEN CASE WHEN mo = 8 AND st = 'P' THEN NULL WHEN rk IN (1, 2) THEN '中国、哈萨克斯坦、阿塞拜疆、格鲁吉亚、土耳其'
   WHEN rk = 4 AND mo = 12 THEN '中国、美国、德国' ELSE '中国、哈萨克斯坦、俄罗斯、白俄罗斯、波兰、德国' END END AS route_text
FROM kinds
WHERE NOT (kind = 'certificate_of_origin' AND pr = 5 AND seg = 'BUILDING')
  AND NOT (kind = 'second' AND NOT (st = 'P' AND mo IN (9, 10)))
"""

# declared composition of a shipment: one of each, two invoices where a second one came with priority 1 or 2
DECLARED = """
SELECT batch_id, 1 AS n_packing, CASE WHEN st = 'P' AND mo IN (9, 10) AND pr <= 2 THEN 2 ELSE 1 END AS n_invoice,
       CASE WHEN seg = 'FURNITURE' THEN 0 ELSE 1 END AS is_declared
FROM shipments
"""

TRIPS = """
SELECT o_orderkey, o_orderstatus AS st, c_mktsegment AS seg, n_name, month(o_orderdate) AS mo,
       CAST(substr(o_orderpriority, 1, 1) AS INT) AS pr, n_regionkey AS rk, n_nationkey AS nk,
       CAST(o_orderdate AS DATE) AS order_date,
       CAST(year(o_orderdate) AS STRING) || '-' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '-01' AS dep_date,
       substr(c_mktsegment, 1, 2) AS station, 'P' || substr(o_orderpriority, 1, 1) AS port,
       'R' || CAST(n_regionkey AS STRING) AS dest, CASE WHEN o_orderstatus = 'P' THEN 'L' ELSE 'T' END AS train_type,
       CAST(o_totalprice AS DECIMAL(18,2)) AS amt, o_custkey
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""

BASES = """
SELECT *, replace(dep_date, '-', '') || '-' || station || '-' || port || '-' || dest || '-' || train_type AS base
FROM trips
"""

LINE_SUMS = """
SELECT l_orderkey, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS line_sum, COUNT(*) AS n_lines
FROM lineitem GROUP BY l_orderkey
"""

SETTLEMENTS = """
SELECT CAST(o_orderkey AS STRING) AS trip_no, t.st, t.mo, t.pr, t.order_date, t.o_custkey,
  CASE WHEN t.st = 'P' AND t.mo = 2 THEN NULL WHEN t.st = 'O' THEN s.line_sum ELSE t.amt END AS settle_total,
  CASE WHEN t.mo = 9 THEN NULL ELSE CAST(t.amt * 0.7 AS DECIMAL(18,2)) END AS rail_freight,
  CAST(t.amt * 0.1 AS DECIMAL(18,2)) AS customs_fee, CAST(t.amt * 0.1 AS DECIMAL(18,2)) AS service_fee,
  CAST(t.amt * 0.1 AS DECIMAL(18,2)) AS other_fee,
  CASE WHEN t.pr = 1 THEN t.amt + 10 WHEN t.pr = 2 AND t.mo = 4 THEN NULL ELSE t.amt END AS actual_freight,
  CASE WHEN t.mo >= 10 THEN 'agreed' WHEN t.mo = 7 THEN '  ' END AS diff_reason,
  t.amt AS dt_supply_100, CAST(t.amt * (1 + 0.0125 * t.pr) AS DECIMAL(18,2)) AS ly_advance_100,
  CASE WHEN t.st = 'P' AND t.mo = 1 THEN NULL ELSE CAST(t.amt * 0.97 AS DECIMAL(18,2)) END AS auth_confirm_100
FROM trips t LEFT JOIN line_sums s ON t.o_orderkey = s.l_orderkey
"""

# customers as fund batches, their orders as linked trips
FUNDS = """
SELECT c_custkey AS custkey, 'BATCH-' || CAST(c_custkey AS STRING) AS batch_id,
  CASE WHEN n_regionkey = 1 THEN 'cost' ELSE 'prepay' END AS batch_type,
  CASE WHEN n_regionkey = 1 AND c_mktsegment = 'BUILDING' THEN '铁路运费' WHEN n_regionkey = 1 AND c_mktsegment = 'MACHINERY' THEN '报关费'
    WHEN n_regionkey = 1 THEN '其他' END AS cost_category,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '预付运费' WHEN 'BUILDING' THEN '尾款结算' WHEN 'FURNITURE' THEN '补贴回款'
    WHEN 'HOUSEHOLD' THEN '保证金' ELSE '其他' END AS fund_purpose,
  CASE WHEN n_regionkey = 3 THEN 'fares' END AS remark, c_acctbal, n_regionkey AS rk
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

LINKS = """
SELECT 'BATCH-' || CAST(o_custkey AS STRING) AS batch_id,
  CASE WHEN st = 'P' AND mo = 8 THEN 'X' ELSE '' END || CAST(o_orderkey AS STRING) AS trip_no,
  CASE WHEN pr = 1 THEN amt END AS allocated_amount
FROM trips
"""

FUND_TOTALS = """
SELECT f.*, COALESCE(x.total, 0) + CASE WHEN f.rk = 0 THEN 500 WHEN f.rk = 2 THEN -500 ELSE 0 END AS total_amount
FROM funds f LEFT JOIN (SELECT l.batch_id, SUM(s.settle_total) AS total FROM links l JOIN settlements s
  ON l.trip_no = s.trip_no GROUP BY l.batch_id) x ON f.batch_id = x.batch_id
"""

OWN = """
SELECT o_orderkey AS row_index, order_date AS dep_date, station AS station_code, port AS port_code,
  'N' || CAST(nk AS STRING) AS dest_code, CASE WHEN rk = 4 THEN '' ELSE 'R' || CAST(rk AS STRING) END AS dest_country,
  CASE WHEN st = 'P' AND mo = 3 THEN NULL ELSE CAST(amt AS STRING) END AS total, CAST(amt AS STRING) AS prepay
FROM trips
"""

# the agent leaves rows out, writes some destinations on country level, and adds rows of the next day
AGENT = """
SELECT o_orderkey * 2 + extra AS row_index, CASE WHEN extra = 1 THEN order_date + INTERVAL 1 DAY ELSE order_date END AS dep_date,
  station AS station_code, port AS port_code,
  CASE WHEN pr IN (2, 4) THEN 'R' || CAST(rk AS STRING) ELSE 'N' || CAST(nk AS STRING) END AS dest_code,
  CASE WHEN rk = 4 THEN '' ELSE 'R' || CAST(rk AS STRING) END AS dest_country,
  CASE WHEN st = 'P' AND mo = 3 AND pr = 1 THEN NULL WHEN mo = 4 THEN CAST(amt + 100 AS STRING) ELSE CAST(amt AS STRING) END AS total
FROM agent_rows
WHERE NOT (st = 'P' AND mo = 6) AND (extra = 0 OR (mo = 7 AND st = 'O'))
"""

PAGES = """
SELECT CAST(l_orderkey AS STRING) AS file,
  CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS page_no,
  CASE WHEN l_tax >= 0.08 THEN 'unknown' WHEN l_linestatus = 'F' THEN 'invoice' ELSE 'packing_list' END AS doc_type,
  CASE WHEN l_tax < 0.03 THEN 'ID-' || l_returnflag END AS identity
FROM lineitem
"""

PACKING = """
SELECT CAST(o_orderkey AS INT) AS row_no, CAST(o_orderkey AS STRING) AS seq,
  CASE WHEN mo = 5 THEN NULL ELSE CAST(5000000 + o_orderkey AS STRING) END AS wagon_no,
  'MSKU' || lpad(CAST(CASE WHEN mo = 2 THEN o_custkey ELSE o_orderkey END AS STRING), 7, '0') AS container_no,
  CAST(260000 + o_orderkey AS STRING) || '.0' AS seal_no
FROM trips
"""

WAYBILLS = """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(page_no AS STRING) AS filename,
  CASE WHEN l_quantity = 2 THEN NULL ELSE 'msku' || lpad(CAST(l_orderkey AS STRING), 7, '0') END AS container_value,
  CASE WHEN l_quantity = 2 THEN 'not_found' ELSE 'ok' END AS container_status,
  'No ' || CAST(5000000 + l_orderkey + CASE WHEN l_discount > 0.06 THEN 1 ELSE 0 END AS STRING) AS wagon_value,
  CASE WHEN l_quantity = 1 THEN 'ambiguous' WHEN l_quantity = 3 THEN 'anchor_missing' ELSE 'ok' END AS wagon_status,
  CAST(260000 + l_orderkey + CASE WHEN l_tax > 0.06 THEN 1 ELSE 0 END AS STRING) || CASE WHEN l_tax > 0.01 THEN '0' ELSE '' END AS seal_value,
  CASE WHEN l_quantity = 4 THEN 'format_anomaly' ELSE 'ok' END AS seal_status
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS page_no FROM lineitem) x
"""


def duck_kinds() -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"SELECT *, unnest([{names}]) AS kind FROM shipments"


def spark_kinds() -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"SELECT *, explode(array({names})) AS kind FROM shipments"


DUCK_AGENT_ROWS = "SELECT *, unnest([0, 1]) AS extra FROM trips"
SPARK_AGENT_ROWS = "SELECT *, explode(array(0, 1)) AS extra FROM trips"

NEEDS = {
    "shipments": [], "kinds": ["shipments"], "docs": ["kinds"], "declared": ["shipments"], "trips": [],
    "bases": ["trips"], "line_sums": [], "settlements": ["trips", "line_sums"], "funds": [], "links": ["trips"],
    "fund_totals": ["funds", "links", "settlements"], "own": ["trips"], "agent_rows": ["trips"],
    "agent": ["agent_rows"], "page_rows": [], "packing": ["trips"], "waybills": [],
}
SQL = {
    "shipments": SHIPMENTS, "docs": DOCUMENTS, "declared": DECLARED, "trips": TRIPS, "bases": BASES,
    "line_sums": LINE_SUMS, "settlements": SETTLEMENTS, "funds": FUNDS, "links": LINKS,
    "fund_totals": FUND_TOTALS, "own": OWN, "agent": AGENT, "page_rows": PAGES, "packing": PACKING,
    "waybills": WAYBILLS,
}


def _order(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS[name]:
            visit(need)
        if name not in out:
            out.append(name)

    for name in names:
        visit(name)
    return out


def duck_with(*names: str) -> str:
    """``WITH`` clause that defines the named inputs for the checking engine."""
    special = {"kinds": duck_kinds(), "agent_rows": DUCK_AGENT_ROWS}
    return "WITH " + ",\n".join(f"{n} AS ({special.get(n) or SQL[n]})" for n in _order(list(names)))


KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey", "documents": "doc_id", "pages": "page_id", "events": "event_id"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. A file too small to be split is spread over the cores by its key;
    a table that already has a scan task per core is left as it is stored."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in KEYS and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores, KEYS[name])
    return df


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names or TABLES:
        read(spark, sf_dir, name).createOrReplaceTempView(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input as a DataFrame."""
    tables(spark, sf_dir, "orders", "customer", "nation", "part", "lineitem")
    special = {"kinds": spark_kinds(), "agent_rows": SPARK_AGENT_ROWS}
    out = None
    for n in _order([name]):
        out = spark.sql(special.get(n) or SQL[n])
        out.createOrReplaceTempView(n)
    return out


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = view(spark, sf_dir, "docs").withColumn("route_countries", T.country_list(F.col("route_text")))
    return docs_from_wide(wide, TEXTS, ["route_countries"])


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch records with a declared composition."""
    rows = view(spark, sf_dir, "declared")
    declared = F.create_map(
        F.lit("invoice"), F.col("n_invoice"), F.lit("packing_list"), F.col("n_packing"),
        F.lit("railway_waybill"), F.lit(1), F.lit("export_customs_declaration"), F.lit(1),
        F.lit("certificate_of_origin"), F.lit(1))
    return rows.select("batch_id", F.when(F.col("is_declared") == 1, declared).alias("declared"),
                       F.lit(0).alias("structure_problems"))

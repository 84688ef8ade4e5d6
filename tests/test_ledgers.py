import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from waybridge import constants as C
from waybridge.functions.dates import ledger_date, ledger_type_hint
from waybridge.functions.similarity import contradiction, similarity
from waybridge.operators import funds, listcompare, numbering as N, pairing, recon
from waybridge.operators.ordered import position, running_total
from waybridge.sources import grids, refdata


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_running_total_across_pieces(spark):
    random.seed(3)
    rows = [(k, i, random.randint(0, 5)) for k in "ab" for i in range(40)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = {(r.k, r.i): r.t for r in running_total(df, ["k"], ["i"], F.col("v"), F.floor(F.col("i") / 7), "t").collect()}
    want, sums = {}, {}
    for k, i, v in rows:
        want[(k, i)] = sums.get(k, 0)
        sums[k] = sums.get(k, 0) + v
    assert got == want
    places = {(r.k, r.i): r.n for r in position(df, ["k"], ["i"], F.floor(F.col("i") / 7), "n").collect()}
    assert places == {(k, i): i + 1 for k, i, _ in rows}


def test_numbers_of_the_ledger_fixture(spark):
    rows = [("2025-07-18", "PW", "MZL", "RU", "T"), ("20251010", "pw", "MZL", "RU", "临"), ("2025-13-01", "PW", "MZL", "RU", "T"),
            ("2025-10-10", "QQ", "MZL", "RU", "T"), ("2025-10-10", "P-W", "MZL", "RU", "T"), ("2025-10-10", "PW", "MZL", "RU", "x")]
    df = spark.createDataFrame(rows, "dep_date string, station string, port string, dest string, train_type string")
    out = N.with_base_number(df, refdata.seed_codes(spark)).collect()
    got = {(r.dep_date, r.station, r.train_type): r.base or r.number_error for r in out}
    assert got == {
        ("2025-07-18", "PW", "T"): "20250718-PW-MZL-RU-T", ("20251010", "pw", "临"): "20251010-PW-MZL-RU-L",
        ("2025-13-01", "PW", "T"): "bad date", ("2025-10-10", "QQ", "T"): "unknown station code",
        ("2025-10-10", "P-W", "T"): "bad station code", ("2025-10-10", "PW", "x"): "bad train type"}


def test_suffixes_go_on_past_a_hundred(spark, monkeypatch):
    monkeypatch.setattr(N, "PIECE", 16)
    random.seed(3)
    used = {"b": {0, 2} | set(random.sample(range(400), 120)), "c": {5_000_000}}
    taken = spark.createDataFrame([(b, s) for b, t in used.items() for s in t] + [("d", 0)], "base string, suffix int")
    requests = spark.createDataFrame([("b", i) for i in range(300)] + [("c", 500), (None, 1), (None, 2)], "base string, o int")
    out = {(r.base, r.o): (r.suffix, r.number) for r in N.assign_numbers(requests, taken, "o").collect()}
    free = [s for s in range(1_000) if s not in used["b"]]
    for i in range(300):
        assert out[("b", i)] == (free[i], f"b-{free[i]:02d}" if free[i] else "b")
    assert out[("c", 500)] == (0, "c") and out[(None, 2)][0] == 1 and len(out) == 303
    read = spark.range(1).select(N.parsed_number(F.lit("20250101-AA-BB-CC-T-123")).alias("n")).first().n
    assert read.suffix == 123


def test_batch_numbers_of_a_day_end_at_99(spark):
    rows = spark.createDataFrame([(i, dt.date(2025, 1, 1), "cost") for i in range(101)], "request_order int, paid_at date, batch_type string")
    none = spark.createDataFrame([("BATCH-20250101-COST-07",)], "batch_id string")
    out = {r.request_order: (r.batch_id, r.number_error) for r in funds.assign_batch_ids(rows, none).collect()}
    assert out[5] == ("BATCH-20250101-COST-06", None) and out[6][0] == "BATCH-20250101-COST-08"
    assert out[97][0] == "BATCH-20250101-COST-99" and out[98] == (None, "no free suffix")


def test_sheets_without_a_header_leave_an_error(spark):
    sheets = grid(spark, 1, [["发运日期", "发站", "口岸", "目的地", "车数", "合计"], ["2025-07-18", "PW", "MZL", "RU", "3", "5"]]).unionByName(
        grid(spark, 2, [["nothing", "known"], ["here", "x"]]))
    assert [(r.sheet, r.error) for r in grids.read_trip_sheet(sheets).orderBy("sheet").collect()] == [(1, None), (2, grids.NO_HEADER)]
    assert {(r.sheet, r.error) for r in grids.read_agent_statement(sheets).collect()} >= {(2, grids.NO_HEADER)}
    files = spark.createDataFrame([("f", 1, 1, ["a"]), ("g", 1, 1, ["箱号", "封号"]), ("g", 1, 2, ["TKRU4625794", "1"]), ("g", 2, 1, ["x"])],
                                  "file string, sheet int, row_index int, cells array<string>")
    assert sorted((r.file, r.error) for r in grids.read_packing_lists(files).collect()) == [("f", grids.NO_HEADER), ("g", None)]


def test_thresholds_with_repeated_and_unreadable_keys(spark):
    rows = [("datacheck.recon_warn_pct", "3"), ("datacheck.recon_warn_pct", "x"), ("datacheck.recon_warn_pct", "2"), ("other", "1")]
    out = refdata.thresholds(spark.createDataFrame(rows, "key string, value string")).first()
    assert (float(out.pct), float(out.amount)) == (3.0, 5000.0)
    assert refdata.thresholds(spark.createDataFrame([], "key string, value string")).count() == 1


def test_ledger_dates(spark):
    cells = ["2025.7.18", "2025/10/10临", "2025年10月10日(图)", "45856", "2025-10-10", "2025.13.1", "合计", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").orderBy("i")
    assert values(df, ledger_date(F.col("c"))) == [dt.date(2025, 7, 18), dt.date(2025, 10, 10), dt.date(2025, 10, 10),
                                                  dt.date(2025, 7, 18), dt.date(2025, 10, 10), None, None, None]
    assert values(df, ledger_type_hint(F.col("c"))) == [None, "L", "T", None, None, None, None, None]


def test_similarity_pairs(spark):
    df = spark.createDataFrame([("陶瓷卫浴洁具", "卫浴陶瓷制品"), ("陶瓷卫浴洁具", "卫浴洁具陶瓷制品")], "a string, b string")
    assert values(df, similarity(F.col("a"), F.col("b"))) == [0.5455, 0.7785]
    guards = spark.createDataFrame([("1.5mm", "15mm"), ("型号12", "型号13"), ("含木", "不含木"), ("box", "box")], "a string, b string")
    assert values(guards, contradiction(F.col("a"), F.col("b"))) == ["numeric_spec", "bare_number", "negation", None]


def test_neighbours_equal_a_sequential_pass(spark):
    random.seed(5)
    rows = [(dt.date(2025, 1, 1) + dt.timedelta(days=random.choice([0, 0, 0, i % 9])), f"t{i:03d}", Decimal(random.choice([1, 1, 2, 3])))
            for i in range(200)]
    df = spark.createDataFrame(rows, "dep_date date, trip_no string, x decimal(14,2)")
    got = {(r.trip_no, r.other_key) for r in recon.neighbour_duplicates(df, fields=["x"]).collect()}
    ordered = sorted(rows)
    want = set()
    for a, b in zip(ordered, ordered[1:]):
        if a[2] == b[2]:
            want |= {(a[1], b[1]), (b[1], a[1])}
    assert got == want


def test_three_way_edges(spark):
    df = spark.createDataFrame([("a", "100.00", "95.00", "94.99")], "k string, dt_supply_100 string, ly_advance_100 string, auth_confirm_100 string")
    got = {(r.a_field, r.b_field): r.flag for r in recon.three_way(df, ["k"]).collect()}
    assert got == {("dt_supply_100", "ly_advance_100"): False, ("dt_supply_100", "auth_confirm_100"): True,
                   ("ly_advance_100", "auth_confirm_100"): False}


def test_prepay_verdicts(spark):
    settle = spark.createDataFrame([("a", "10"), ("b", "10"), ("c", "10"), ("d", None)], "trip_no string, settle_total string")
    paid = spark.createDataFrame([("a", "4"), ("a", "6"), ("b", "¥1,000"), ("d", "x")], "trip_no string, amount string")
    got = {r.trip_no: r.verdict for r in recon.prepay_coverage(settle, paid).collect()}
    assert got == {"a": "covered", "b": "overpaid", "c": "shortage", "d": "unknown"}


def grid(spark, sheet, rows):
    return spark.createDataFrame([(sheet, i + 1, r) for i, r in enumerate(rows)], "sheet int, row_index int, cells array<string>")


def test_two_ledgers_end_to_end(spark):
    own = grids.read_own_ledger(grid(spark, 1, [
        ["序号", "发运日期", "班列路线", "预付金额", "结算金额合计"],
        ["1", "2025.7.18", "平旺-满洲里-谢利亚季诺", "1", "2793440.46"],
        ["2", "2025.8.8", "大同-二连-莫斯科混编（电煤/谢利）", "", "2581233.30"],
        ["3", "2025.8.9", "中鼎-霍尔果斯-火星", "", "5"], ["4", "2025.8.9", "中鼎-霍尔果斯", "", "5"],
        ["", "", "合计", "", "9"], ["5", "2025.9.1", "平旺-满洲里-莫斯科", "", "7"]]))
    agent = grids.read_agent_statement(grid(spark, 1, [
        ["开行日期", "发站", "口岸", "到站", "合计"], ["2025-07-18", "平旺", "满洲里", "俄罗斯", "2793440.46"],
        ["2025-08-08", "大同", "二连浩特", "俄罗斯", "2581233.31"], ["2025-09-02", "平旺", "满洲里", "俄罗斯", "7"], ["总计", "", "", "", "9"]]))
    lookup = refdata.name_lookup(refdata.seed_codes(spark))
    own, agent = pairing.resolve_places(own, lookup), pairing.resolve_places(agent, lookup)
    assert [(r.category, r.name) for r in pairing.unresolved_names(own.where("error is null"), "own").collect()] == [("dest", "火星")]
    assert own.where("error is not null").count() == 1
    good = lambda df: df.where("error is null and size(unresolved) = 0")
    got = sorted((r.status, r.own_row_index, r.agent_row_index) for r in pairing.pair(good(own), good(agent)).collect()
                 if r.own_row_index and r.agent_row_index)
    assert got == [("confirmed", 2, 2), ("pending", 3, 3)]
    left = sorted(r.status for r in pairing.pair(good(own), good(agent)).collect() if not (r.own_row_index and r.agent_row_index))
    assert left == ["agent_missing", "own_missing"]


def test_pairing_equals_the_greedy_loop(spark):
    random.seed(11)
    make = lambda: [(i, "2025-01-01", "S", "P", d, c, str(random.randint(1, 3)))
                    for i in range(60) for d, c in [random.choice([("MSK", "俄"), ("XLY", "俄"), ("RU", "俄"), ("Q", ""), ("Z", "")])]]
    a, b = make(), make()
    schema = "row_index int, dep_date string, station_code string, port_code string, dest_code string, dest_country string, total string"
    got = {(r.own_row_index, r.agent_row_index) for r in pairing.pair(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()
           if r.own_row_index is not None and r.agent_row_index is not None}
    used, want = set(), set()
    for o in a:
        for g in b:
            if g[0] not in used and (o[4] == g[4] or (o[5] and o[5] == g[5])):
                used.add(g[0])
                want.add((o[0], g[0]))
                break
    assert got == want


def test_fund_inputs(spark):
    rows = [("1", "prepay", "预付运费", None, None, "5", ["20250718-PW-MZL-RU-T"]), ("2", "cost", "其他", "", "", None, []),
            ("3", "prepay", "x", None, None, "5", ["bad"])]
    df = spark.createDataFrame(rows, "id string, batch_type string, fund_purpose string, cost_category string, remark string, total_amount string, trip_nos array<string>")
    got = {r.id: r.problems for r in funds.input_problems(df).collect()}
    assert got["1"] == [] and got["3"] == ["bad purpose", "bad trip number"]
    assert got["2"] == ["purpose needs a remark", "cost category missing", "no trips", "amount missing"]


def test_list_comparison(spark):
    packing = spark.createDataFrame([(48, "48", "5480825", "TKRU4625794", "260281"), (49, "49", "1", "TKRU4625794", "2"), (50, "50", "1", "AAAA1111111", "2")],
                                    "row_no int, seq string, wagon_no string, container_no string, seal_no string")
    field = "struct<value:string,status:string>"
    waybills = spark.createDataFrame(
        [("a", ("TKRU4625794", "ok"), ("5480825", "ok"), ("260281", "ok")), ("b", ("TKRU4625794", "ok"), ("5480826", "ok"), ("260282", "ok")),
         ("c", ("ZZZZ1111111", "ok"), ("1", "ok"), ("2", "ok")), ("d", (None, "not_found"), ("1", "ok"), ("2", "ok")),
         ("e", ("TKRU4625794", "ok"), (None, "anchor_missing"), ("2", "ok"))],
        f"filename string, container {field}, wagon {field}, seal {field}")
    got = sorted((r.filename or "", r.row_no or 0, r.status) for r in listcompare.compare_lists(packing, waybills).collect())
    assert got == [("", 49, "excel_unmatched"), ("", 50, "excel_unmatched"), ("a", 48, "match"), ("b", 48, "both_mismatch"),
                   ("c", 0, "pdf_unmatched"), ("d", 0, "extraction_anomaly"), ("e", 48, "extraction_anomaly")]


def test_packing_list_takes_the_sheet_with_containers(spark):
    rows = [("f", 1, 1, ["箱号", "封号"]), ("f", 2, 1, ["现场清单", None, None, None]), ("f", 2, 2, ["序号", "车底号", "箱号", "铅封号"]),
            ("f", 2, 3, ["48", "5480825", "tkru 4625794", "260281.0"]), ("f", 2, 4, [None, None, None, None])]
    out = grids.read_packing_lists(spark.createDataFrame(rows, "file string, sheet int, row_index int, cells array<string>")).collect()
    assert [(r.seq, r.wagon_no, r.container_no, r.seal_no, r.row_no) for r in out] == [("48", "5480825", "TKRU4625794", "260281", 3)]


def test_links_of_a_batch_request_are_rows(spark):
    rows = [("a", 1, "y"), ("a", 2, "x"), ("a", 3, "y"), ("a", 9000, "z"), ("a", 9001, "x"), ("b", 5, "x")]
    rows += [("big", (7 * i) % 20_011, f"t{i}") for i in range(20_011)]
    out = funds.link_rows(spark.createDataFrame(rows, "batch_id string, position long, trip_no string"))
    assert not any(name in out._jdf.queryExecution().toString() for name in ("collect_list", "posexplode"))
    got = {}
    for r in out.collect():
        got.setdefault(r.batch_id, {})[r.seq] = r.trip_no
    assert got["a"] == {0: "y", 1: "x", 2: "z"} and got["b"] == {0: "x"}
    assert got["big"] == {(7 * i) % 20_011: f"t{i}" for i in range(20_011)}

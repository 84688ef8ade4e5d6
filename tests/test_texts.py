import random

from pyspark.sql import functions as F

from tests.batches import batch, load
from waybridge import constants as C
from waybridge.operators import boxes as B, extract as X, forms as FM, lookup as L, pages as PG, rules as R, tables as TB
from waybridge.sources.batches import doc_fields, docs_from_wide


def test_three_single_page_waybills(spark):
    pages = spark.createDataFrame([("f", i + 1, f"RAILWAY CONSIGNMENT NOTE\nWAYBILL NO: SMU/78945{6 + i}/2026") for i in range(3)],
                                  "file string, page_no int, text string")
    groups = PG.document_groups(PG.group_pages(PG.with_page_facts(pages))).orderBy("group_no").collect()
    assert [(g.doc_type, g.identity) for g in groups] == [("railway_waybill", f"SMU/78945{6 + i}/2026") for i in range(3)]


def test_page_groups_equal_the_sequential_rule(spark, monkeypatch):
    monkeypatch.setattr(PG, "PIECE", 4)
    random.seed(2)
    rows = [("f", i + 1, random.choice(["a", "a", "b", "unknown"]), random.choice([None, None, "x", "y"])) for i in range(120)]
    got = {r.page_no: r.group_no for r in PG.group_pages(spark.createDataFrame(rows, "file string, page_no int, doc_type string, identity string")).collect()}
    want, group, kind, ident = {}, 0, None, None
    for _, page, t, i in rows:
        if group and t != "unknown" and t == kind and (i is None or ident is None or i == ident):
            ident = ident or i
        else:
            group, kind, ident = group + 1, t, i
        want[page] = group
    assert got == want


def test_field_extraction_keeps_to_the_line(spark):
    text = "INVOICE NO:\nSELLER: ACME Co.\nTOTAL PACKAGES: 480.5\nGROSS WEIGHT: 12,300 LB\nTOTAL AMOUNT: USD 86,400.00"
    df = spark.createDataFrame([("f", 1, "invoice", text)], "file string, group_no int, doc_type string, text string")
    got = {r.field: (r.value, r.confidence) for r in X.finalize(X.extract_fields(df)).collect()}
    assert got["invoice_no"] == (None, "missing")
    assert got["consignor_name"] == ("ACME Co.", "high")
    assert got["total_packages"] == ("480.5", "review") and got["gross_weight_kg"] == ("12,300 LB", "review")
    assert got["total_amount"] == ("86400.0000", "high")


def test_caption_on_its_own_line(spark):
    rows = ["SELLER:", "山西洁康", "件数 (total): 480", "收货人", "发货人"]
    lines = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(rows)], "file string, line_no long, text string")
    got = {r.field: r.value for r in FM.line_values(lines).collect()}
    assert got == {"consignor_name": "山西洁康", "total_packages": "480"}


def test_weights_need_a_label_for_net(spark):
    line = lambda n, text, top: ("f", 1, n, text, 10.0, float(top), 120.0)
    schema = "file string, page int, line_no int, text string, x0 double, top double, x1 double"
    bare = spark.createDataFrame([line(1, "18 重量 Масса", 10), line(2, "12300", 30), line(3, "10800", 50)], schema)
    r = FM.weights(FM.described(bare)).collect()[0]
    assert (r.gross_weight_kg, r.net_weight_kg, r.net_state) == (12300.0, None, "needs_review")
    named = spark.createDataFrame([line(1, "18 重量 Масса", 10), line(2, "毛重 12300", 30), line(3, "净重 10800", 50)], schema)
    r = FM.weights(FM.described(named)).collect()[0]
    assert (r.gross_weight_kg, r.net_weight_kg, r.net_state) == (12300.0, 10800.0, "recognized")


def test_value_normalisers(spark):
    df = spark.createDataFrame([("中铁(КЖД)/新筑 Синьчжу", "陶瓷洁具 Керамика", "OOO СТС-ЛОГИСТИКА, Москва", "芜湖汽车技术有限公司 安徽省")],
                               "s string, g string, o string, c string")
    r = df.select(FM.station(F.col("s")), FM.goods(F.array("g"))["name"], FM.company(F.array("o")), FM.company(F.array("c"))).collect()[0]
    assert tuple(r) == ("新筑", "陶瓷洁具", 'ООО "СТС-ЛОГИСТИКА"', "芜湖汽车技术有限公司")


def test_box_between_rulings(spark):
    words = spark.createDataFrame([("f", 1, 1, "车辆—Вагон", 100.0, 150.0, 50.0, 60.0), ("f", 1, 2, "5480825", 110.0, 145.0, 70.0, 80.0),
                                   ("f", 1, 3, "9999999", 190.0, 210.0, 70.0, 80.0), ("f", 2, 1, "x", 0.0, 1.0, 0.0, 1.0)],
                                  "file string, page int, word_no int, text string, x0 double, x1 double, top double, bottom double")
    pages = words.select("file", "page").distinct()
    lines = spark.createDataFrame([("f", 1, 95.0, 40.0, 200.0), ("f", 1, 160.0, 40.0, 200.0)], "file string, page int, x double, top double, bottom double")
    run = lambda rulings: {r.page: (r.status, r.value) for r in B.band_values(
        pages, words, B.with_band(B.wagon_anchors(words), C.WAGON_BAND, rulings), C.WAGON_PATTERN).collect()}
    assert run(lines) == {1: ("ok", "5480825"), 2: ("anchor_missing", None)}
    assert run(None)[1] == ("ambiguous", "5480825")


def test_lookup_by_containment(spark):
    _, docs = load(spark, [batch("B-ONE"), batch("B-TWO", {"invoice.invoice_no": "A1"})])
    index = L.identity_index(docs)
    queries = spark.createDataFrame([("id", "b-one"), ("inside", "RE:smu/eval/2026 x"), ("part", "8765432"), ("short", "A1"), ("tiny", "1"), ("none", "zzzz9")],
                                    "query_id string, query string")
    got = {}
    for r in L.batch_lookup(queries, index, docs.select("batch_id").distinct()).collect():
        got.setdefault(r.query_id, set()).add(r.batch_id)
    both = {"B-ONE", "B-TWO"}
    assert got == {"id": {"B-ONE"}, "inside": both, "part": both, "short": {"B-TWO"}}


def test_lookup_candidates_grow_with_the_tables(spark, monkeypatch):
    """Numbers that share their beginning do not meet all queries."""
    def candidates(n):
        numbers = spark.range(n).select(F.concat(F.lit("B"), "id").alias("batch_id"), F.lit("x").alias("field"),
                                        F.concat(F.lit("msku"), F.lpad((F.col("id") * 7919 + 1000003).cast("string"), 9, "0")).alias("number"))
        queries = numbers.select(F.col("batch_id").alias("query_id"), F.concat(F.lit("re "), "number").alias("query"))
        sizes = []
        whole = L._by_rarest_part

        def counted(*args):
            out = whole(*args)
            sizes.append(out.count())
            return out

        monkeypatch.setattr(L, "_by_rarest_part", counted)
        assert L.batch_lookup(queries, numbers, numbers.select("batch_id")).count() == n
        monkeypatch.setattr(L, "_by_rarest_part", whole)
        return sum(sizes)

    assert candidates(2_000) < 25 * candidates(200)


def test_form_values(spark):
    """What a form's boxes hold, with several lines, headings, a lent number and an HS line in front."""
    line = lambda n, text, x0, top: ("f", 1, n, text, float(x0), float(top), float(x0 + 110))
    lines = spark.createDataFrame([
        line(1, "1 发货人—Отправитель", 10, 10), line(2, "签字—Подпись", 10, 22), line(3, "ABC Trading Ltd road 5", 10, 34), line(4, "4 收货人", 10, 60),
        line(5, "ООО", 10, 72), line(6, "22 承运人", 300, 10), line(7, "КЖД", 400, 22), line(8, "690007", 300, 34), line(9, "РЖД", 300, 46),
        line(10, "15 货物名称", 10, 110), line(11, "HS CODE: 691090", 10, 122), line(12, "陶瓷洁具 Керамика", 10, 134), line(13, "17", 10, 200), line(14, "件数", 40, 203),
        line(15, "480 ctn", 40, 215), line(16, "18 重量", 10, 300), line(17, "毛重 12300", 10, 312), line(18, "10800 kg", 300, 600)],
        "file string, page int, line_no int, text string, x0 double, top double, x1 double")
    got = {r.field: (r.value, r.state) for r in FM.form_fields(lines).collect()}
    assert got["consignor_name"] == ("ABC Trading Ltd", "recognized") and got["consignee_name"] == ("ООО", "needs_review")
    assert got["carrier_segments"] == ("КЖД РЖД", "recognized")
    assert got["goods_description"][0] == "陶瓷洁具" and got["hs_code"][0] == "691090" and got["total_packages"][0] == "480"
    assert got["gross_weight_kg"] == ("12300", "recognized") and got["net_weight_kg"] == (None, "needs_review")


def test_rule_problems(spark):
    raw = [{"rule_id": "a", "doc_type": "invoice", "field": "x", "rule_type": "format", "pattern": "("}, {"rule_id": "b", "rule_type": "required"},
           {"rule_id": "c", "doc_type": "invoice", "field": "x", "rule_type": "odd"}, {"rule_id": "d", "enabled": False},
           {"rule_id": "e", "doc_type": "invoice", "field": "invoice_no", "rule_type": "format", "pattern": r"INV-\d+"}]
    rules = R.rule_rows(spark, raw)
    assert {r.rule_id for r in R.rule_problems(rules).collect()} == {"a", "b", "c"}
    _, docs = load(spark, [batch("ok"), batch("bad", {"invoice.invoice_no": "INV-1x"})])
    got = {r.batch_id: len(r.rule_issues) for r in R.with_rule_issues(docs, rules).where("doc_type = 'invoice'").collect()}
    assert got == {"ok": 0, "bad": 1}


def test_patch_changes_only_named_fields(spark):
    old = spark.createDataFrame([(1, "a", "b")], "k int, x string, y string")
    patch = spark.createDataFrame([(1, None, "z", ["x"]), (2, "n", "m", ["x", "y"])], "k int, x string, y string, provided array<string>")
    got = sorted(tuple(r) for r in TB.patch_upsert(old, patch, ["k"], ["x", "y"]).collect())
    assert got == [(1, None, "b"), (2, "n", "m")]


def described_form(spark):
    lines = [("f", 1, 1, 300.0, 230.0, 420.0, "货值 Cargo Value"), ("f", 1, 2, 300.0, 242.0, 420.0, "USD 500"), ("f", 1, 3, 300.0, 325.0, 420.0, "Валюта CHF"),
             ("f", 1, 4, 10.0, 230.0, 120.0, "18 重量 Масса"), ("f", 1, 5, 10.0, 242.0, 120.0, "毛重 12300")]
    return FM.written(FM.described(spark.createDataFrame(lines, "file string, page int, line_no int, x0 double, top double, x1 double, text string")))


def test_forms_are_joined_without_a_broadcast(spark):
    """A written table's size on disk says little of it in memory, so no side of a form's joins goes to the driver."""
    plan = FM.form_fields(described_form(spark).select("file", "page", "line_no", "x0", "top", "x1", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_captions_are_found_by_their_first_letter(spark):
    texts = ["", "x", "ПОЛУЧАТЕЛЬ", "a consignee b", "件数", "数 件", "G", "gross weight 5", "Gros", "описание товара", "1 Sender:", "место назначения", "Вес Нетто"]
    rows = spark.createDataFrame([(t,) for t in texts + [w.swapcase() for w in FM.CAPTION_WORDS]], "t string")
    for words in (FM.CAPTION_WORDS, C.GROSS_WORDS, C.NET_WORDS + C.WEIGHT_WORDS, C.BOX_HEADINGS, [r"\d+", "x"]):
        assert all(r[0] == r[1] for r in rows.select(F.col("t").rlike(FM.holds(words)), F.col("t").rlike(FM.any_of(words))).collect())
    assert "(?=[" in FM.holds(FM.CAPTION_WORDS) and "(?=[" not in FM.holds([r"\d+", "x"])


def test_captions_are_described_once(spark):
    """What a caption holds is written before it is read several times; the plan of a field has none of the steps behind it."""
    facts = described_form(spark)
    value, weight = FM.cargo_value(facts), FM.weights(facts)
    assert [(r.value, r.currency) for r in value.collect()] == [(500.0, "USD")]
    assert [(r.gross_weight_kg, r.net_state) for r in weight.collect()] == [(12300.0, "not_found")]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(value).count("Generate ") == 0 and plan(weight).count("Generate ") <= 3


def test_named_fields_are_read_without_the_map(spark):
    wide = spark.createDataFrame([("b", 0, "invoice", "i", "INV 1", None, "7", " "), ("b", 1, "packing_list", "p", None, "mu 2", None, "x"), ("c", 0, None, None, None, None, None, None)],
                                 "batch_id string, doc_index int, doc_type string, doc_id string, invoice_no string, container_no string, total_packages string, issuer string")
    docs = docs_from_wide(wide, ["invoice_no", "container_no", "total_packages", "issuer"])
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda df: sorted(map(str, df.collect()))
    names = ["total_packages", "invoice_no"]
    some, every = doc_fields(docs, names), doc_fields(docs).where(F.col("field").isin(*names))
    assert rows(some) == rows(every) == rows(doc_fields(docs.drop("known"), names)) and some.count() == 2
    assert rows(doc_fields(docs, ["issuer"])) == rows(doc_fields(docs).where("field = 'issuer'"))
    index = L.identity_index(docs)
    assert rows(index) == rows(L.identity_index(docs.drop("known"))) and index.count() == 2
    assert "map_from_entries" in plan(every) and "map_from_entries" not in plan(some) + plan(index)


def test_rules_reach_the_documents_without_dealing_them_out_by_type(spark):
    """The rule list has no size that Spark knows; documents have few types, so a shuffle by type gives a task most of them."""
    _, docs = load(spark, [batch("x")])
    rows = R.with_rule_issues(docs, R.default_rules(spark))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(doc_type" not in plan
    assert all(not r.rule_issues for r in rows.collect())

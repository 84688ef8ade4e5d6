import pytest

from tests.batches import GOLDEN, batch, load
from waybridge.operators import checks as K
from waybridge.operators.rules import default_rules, rule_rows, with_rule_issues
from waybridge.plans import verify as V
from waybridge.sources.batches import docs_from_wide


@pytest.fixture(scope="module")
def golden(spark):
    batches, docs = load(spark, [g[0] for g in GOLDEN])
    rules = default_rules(spark)
    checked = K.statuses(docs, batches, rules).cache()
    return batches, docs, rules, checked


def test_golden_scores(golden):
    _, _, _, checked = golden
    got = {r.batch_id: (r.grade, r.score, r.n_fail, r.n_warning)
           for r in V.summary(checked).select("batch_id", "grade", "score", "n_fail", "n_warning").collect()}
    want = {g[0]["batch_id"]: g[1:] for g in GOLDEN}
    assert got == want


def test_points_add_up_to_the_score(golden):
    batches, docs, rules, checked = golden
    flat = K.prepare(docs, rules)
    points = V.scored_results(V.results(checked, flat), checked)
    sums = {r[0]: min(100, r[1]) for r in points.groupBy("batch_id").sum("points").collect()}
    scores = {r.batch_id: r.score for r in V.summary(checked).select("batch_id", "score").collect()}
    assert sums == scores


def test_clean_batch_has_nineteen_passes(spark, golden):
    _, docs, rules, checked = golden
    flat = K.prepare(docs, rules)
    rows = V.results(checked, flat).where("batch_id = 'eval01_clean'").collect()
    assert len(rows) == 19 and {r.status for r in rows} == {"PASS"}


def test_document_groups(golden):
    batches, docs, rules, checked = golden
    flat = K.prepare(docs, rules)
    repeated = K.duplicate_types(docs, batches)
    rows = V.document_groups(flat, checked, repeated).where("batch_id = 'eval16_full_mess'").collect()
    got = {r.doc_type: [i.check_id for i in r.issues] for r in rows}
    assert got["export_customs_declaration"] == ["CONS-001", "CONS-002"]
    assert got["packing_list"] == ["CONS-003"]
    assert got["invoice"] == []
    left = V.batch_level_issues(checked).where("batch_id = 'eval16_full_mess'").collect()
    assert [r.check_id for r in left] == ["DOC-001"]


CASES = [
    ("one_percent_ok", batch("x", {"packing.gross_weight_kg": 12423}), "cons_003", "PASS"),
    ("over_one_percent", batch("x", {"packing.gross_weight_kg": 12424}), "cons_003", "FAIL"),
    ("weight_nan", batch("x", {"packing.gross_weight_kg": "NaN"}), "cons_003", "FAIL"),
    ("weight_zero", batch("x", {"invoice.gross_weight_kg": 0}), "cons_003", "FAIL"),
    ("weight_unit", batch("x", {"packing.gross_weight_kg": "12300kg"}), "cons_003", "WARNING"),
    ("weight_grouped", batch("x", {"packing.gross_weight_kg": "12,300"}), "cons_003", "PASS"),
    ("weight_bool", batch("x", {"packing.gross_weight_kg": True}), "cons_003", "FAIL"),
    ("packages_fraction", batch("x", {"customs.total_packages": 480.5}), "cons_002", "WARNING"),
    ("packages_negative", batch("x", {"customs.total_packages": -1}), "cons_002", "FAIL"),
    ("spec_guard", batch("x", {f"{d}.goods_description": "钢板厚度1.5mm" for d in ("invoice", "packing", "waybill", "coo")}
                         | {"customs.goods_description": "钢板厚度15mm"}), "cons_001", "FAIL"),
    ("party_fold", batch("x", {"customs.consignee_name": "RHE1NBAU  HANDEL GMBH"}), "cons_005", "PASS"),
    ("waybill_no_missing", batch("x", {"customs.waybill_no": None}), "cons_006", "FAIL"),
    ("no_waybill_numbers", batch("x", {"waybill.waybill_no": " "}), "cons_006", "WARNING"),
    ("currency_conflict", batch("x", {"customs.currency": "EUR"}), "cons_008", "FAIL"),
    ("currency_missing", batch("x", {"customs.currency": None}), "cons_008", "WARNING"),
    ("amount_edge", batch("x", {"customs.declared_value": 86832.0}), "cons_008", "PASS"),
    ("declared_unit", batch("x", {"customs.declared_value": "86400 USD"}), "cons_008", "FAIL"),
    ("invoice_unit", batch("x", {"invoice.total_amount": "86400USD"}), "cons_008", "WARNING"),
    ("ends", batch("x", {"customs.destination_country": "法国"}), "route_002", "FAIL"),
    ("route_text", batch("x", {"waybill.route_countries": "中国,德国"}), "route_002", "WARNING"),
    ("duplicate_same", batch("x", extra=[{"doc_type": "invoice", "doc_id": "i2", "fields": {"invoice_no": "INV-1"}}]),
     "doc_003", "WARNING"),
    ("duplicate_conflict", batch("x", extra=[{"doc_type": "invoice", "doc_id": "i2", "fields": {"invoice_no": "INV-2"}}]),
     "doc_003", "FAIL"),
    ("declared_two", batch("x", extra=[{"doc_type": "invoice", "doc_id": "i2", "fields": {"invoice_no": "INV-2"}}],
                           declared={"invoice": 2, "packing_list": 1, "railway_waybill": 1,
                                     "export_customs_declaration": 1, "certificate_of_origin": 1}), "doc_003", "PASS"),
    ("declared_equal", batch("x", declared={"invoice": 1, "packing_list": 1, "railway_waybill": 1,
                                            "export_customs_declaration": 1, "certificate_of_origin": 1}), "doc_004", "PASS"),
    ("declared_short", batch("x", declared={"invoice": 2, "packing_list": 1, "railway_waybill": 1,
                                            "export_customs_declaration": 1, "certificate_of_origin": 1}), "doc_004", "WARNING"),
    ("undeclared", batch("x", declared={"invoice": 1}), "doc_004", "WARNING"),
    ("not_declared", batch("x"), "doc_004", None),
    ("empty_doc", batch("x", extra=[{"doc_type": "invoice", "doc_id": "i2", "fields": {}}]), "doc_002", "FAIL"),
    ("unknown_doc", batch("x", extra=[{"doc_type": "unknown", "doc_id": "u"}]), "doc_002", "WARNING"),
    ("identity_missing", batch("x", {"invoice.invoice_no": None}), "doc_002", "WARNING"),
    ("bad_structure", batch("x", extra=["text", {"doc_type": "invoice", "fields": [1]}]), "sys_001", "FAIL"),
    ("smgs_seat", batch("x", drop=["waybill"], extra=[{"doc_type": "smgs_rail_waybill", "doc_id": "s",
                                                       "fields": {"waybill_no": "SMU/EVAL/2026"}}]), "doc_001", "PASS"),
]


def test_single_edits(spark):
    records = []
    for name, record, _, _ in CASES:
        records.append({**record, "batch_id": name})
    batches, docs = load(spark, records)
    rows = {r.batch_id: r for r in K.statuses(docs, batches, default_rules(spark)).collect()}
    got = {name: rows[name][column] for name, _, column, _ in CASES}
    assert got == {name: want for name, _, _, want in CASES}


def test_air_waybill_and_outside_country(spark):
    batches, docs = load(spark, [
        {**batch("air", {"waybill.waybill_type": "AIR WAYBILL"})},
        {**batch("usa", route=["中国", "美国"])},
    ])
    rows = {r.batch_id: r.route_state for r in K.prepare(docs).where("is_waybill").collect()}
    assert rows == {"air": "FAIL", "usa": "FAIL"}


def test_rules_follow_evidence(spark):
    record = batch("m", {"invoice.consignor_name": None})
    record["documents"][0]["field_meta"] = {"consignor_name": {"status": "not_found"}}
    confirmed = batch("n", {"invoice.consignor_name": None})
    confirmed["documents"][0]["field_meta"] = {"consignor_name": {"status": "business_missing"}}
    _, docs = load(spark, [record, confirmed, batch("o", {"invoice.consignor_name": None})])
    rows = {r.batch_id: r.rule_state for r in K.prepare(docs, default_rules(spark)).where("is_invoice").collect()}
    assert rows == {"m": "PASS", "n": "FAIL", "o": "FAIL"}


def test_unreadable_records_are_skipped(spark):
    batches, _ = load(spark, ["{not json", '{"documents": []}', batch("ok")])
    assert [r.batch_id for r in batches.select("batch_id").collect()] == ["ok"]


def test_instance_labels(spark):
    extra = [{"doc_type": "railway_waybill", "doc_id": f"w{i}", "fields": {}} for i in range(3)]
    _, docs = load(spark, [batch("b", extra=extra)])
    labels = [r.label for r in V.instance_labels(docs).where("doc_type = 'railway_waybill'").orderBy("doc_index").collect()]
    assert labels == ["运单#1", "运单#2", "运单#3", "运单#4"]


def test_edited_documents_are_shuffled_once(spark):
    from waybridge.operators.scenario import scenario_documents

    docs = load(spark, [batch("a"), batch("b")])[1]
    rows = [("count", "a", "invoice", "total_packages", "1", 0), ("count", "a", "invoice", "total_packages", "2", 1), ("count", "a", "invoice-1", "currency", "EUR", 0),
            ("count", "a", None, "currency", "X", 0), ("none", "a", "nothing", "currency", "X", 0), (None, "a", "invoice", "currency", "X", 0)]
    edits = spark.createDataFrame(rows, "scenario_id string, batch_id string, target string, field string, text string, edit_order int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = scenario_documents(docs, edits)
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
        got = {(r.batch_id, r.doc_type): {k: v.text for k, v in r.fields.items()} for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {b for b, _ in got} == {"a#count", "a#none", None} and len(got) == 15
    edited, left = got["a#count", "invoice"], got["a#none", "invoice"]
    assert (edited["total_packages"], edited["currency"]) == ("2", "EUR") and left == got[None, "invoice"]
    assert {k: v for k, v in edited.items() if k not in ("total_packages", "currency")} == {
        k: v for k, v in left.items() if k not in ("total_packages", "currency")}
    assert (left["total_packages"], left["currency"]) == ("480", "USD")


def test_arriving_records_stay_out_of_memory(spark, tmp_path, monkeypatch):
    import json

    from tests.batches import PKG
    from waybridge.streaming import jobs

    kept, verify = [], jobs.verify
    monkeypatch.setattr(jobs, "verify", lambda docs, batches, rules: kept.extend(
        df.storageLevel.useMemory for df in (docs, batches)) or verify(docs, batches, rules))
    records = [json.dumps(r, ensure_ascii=False) for r in (batch("one"), batch("two", PKG))] + ["{not json"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(records))
    jobs.verify_stream(jobs.batch_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = {r.batch_id: (r.score, r.grade) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"one": (0, "low"), "two": (25, "medium")} and kept == [False, False]


def test_fields_are_built_for_documents_of_repeated_types_only(spark):
    from waybridge.sources.batches import docs_from_wide
    rows = [("a", i, kind, f"{kind}{i}", no) for i, (kind, no) in enumerate(
        [("invoice", "1"), ("invoice", "2"), ("waybill", "3"), (None, "4"), (None, "4")])]
    rows += [("b", 0, "invoice", "x", "1"), ("c", 0, "invoice", "y", None), ("c", 1, "invoice", "z", None), (None, 0, "invoice", "n", "1"), (None, 1, "invoice", "m", "2")]
    wide = spark.createDataFrame(rows, "batch_id string, doc_index int, doc_type string, doc_id string, invoice_no string")
    docs = docs_from_wide(wide, ["invoice_no"])
    repeated = K.duplicate_types(docs)
    got = {(r.batch_id, r.doc_type): (r.n_docs, r.conflicting_fields) for r in repeated.collect()}
    assert got == {("a", "invoice"): (2, 1), ("a", "unknown"): (2, 0), ("c", "invoice"): (2, 0), (None, "invoice"): (2, 0)}
    plan = repeated._jdf.queryExecution().optimizedPlan().toString()
    # a plan lists what is worked out later first
    assert 0 < plan.index("map_from_entries") < plan.index("LeftSemi")


def test_batches_are_judged_once(golden):
    """Reports read the statuses several times, and documents meet their batch's facts in one shuffle; both plans stay short."""
    batches, docs, rules, _ = golden
    repeated = K.duplicate_types(docs, batches)
    flat, checked = V.checked(docs, batches, rules, repeated)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    points = V.scored_results(V.results(checked, flat), checked)
    assert "aggregate(" not in plan(points) and plan(points).count("Join ") == 2
    groups = V.document_groups(flat, checked, repeated)
    assert plan(groups).count("Join ") == 2 and plan(V.batch_level_issues(checked)).count("Join ") == 0
    assert groups.count() == docs.count()


def test_issues_of_a_document_start_with_its_fails(spark):
    """Fails first, then as defined; the entries of a document's fields are compiled, not interpreted inside a lambda."""
    raw = [{"rule_id": r, "doc_type": "invoice", "field": f, "rule_type": "required", "severity": s} for r, f, s in (
        ("a", "hs_code", "warning"), ("b", "incoterm", "fail"), ("c", "invoice_no", "fail"), ("d", "unit_price", None), ("e", "marks", "fail"))]
    raw.append({"rule_id": "f", "doc_type": "invoice", "field": "total_amount", "rule_type": "range", "min": 5.0, "severity": "fail"})
    wide = spark.createDataFrame([("b", 0, "invoice", "i", "INV 1", "4"), ("c", 0, "invoice", "i", "　", None), ("d", 0, "packing_list", "p", None, "x"), ("e", 0, "invoice", "i", " \x7f", "6")],
                                 "batch_id string, doc_index int, doc_type string, doc_id string, invoice_no string, total_amount string")
    rows = with_rule_issues(docs_from_wide(wide, ["invoice_no", "total_amount"]), rule_rows(spark, raw))
    got = {r.batch_id: [i.rule_id for i in r.rule_issues] for r in rows.collect()}
    assert got == {"b": ["b", "e", "f", "a", "d"], "c": ["b", "c", "e", "a", "d"], "d": [], "e": ["b", "e", "a", "d"]}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(array(" not in plan and "filter(_entries" in plan


def test_arriving_records_leave_no_tables_behind(spark, tmp_path):
    """What an epoch writes for itself is deleted when it is done, so the disk holds the input and the outcome."""
    import json
    import os

    from tests.batches import PKG
    from waybridge.session import shared_folder
    from waybridge.streaming import jobs

    tables = lambda: {n for n in os.listdir(shared_folder(spark).removeprefix("file:")) if n.startswith("table-")}
    before = tables()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in (batch("one"), batch("two", PKG))))
    stream = jobs.batch_stream(spark, str(tmp_path / "in"))
    jobs.verify_stream(stream, str(tmp_path / "out"), str(tmp_path / "a")).awaitTermination()
    store = jobs.batch_store(spark, str(tmp_path / "store"))
    jobs.verify_into(stream, store, "s", str(tmp_path / "b")).awaitTermination()
    assert tables() == before
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert {(r.batch_id, r.score) for r in store.read()["batches"].collect()} == {("one", 0), ("two", 25)}

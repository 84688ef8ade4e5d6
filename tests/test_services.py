import random

import pytest
from pyspark.sql import functions as F

from waybridge import constants as C
from waybridge.operators import evaluate as EV, recon as RC, refresh as RF, subsets as SB

FIELDS = C.SUBSIDY_FIELDS[:2]


def trips(spark, rows):
    return spark.createDataFrame(rows, "dep_date string, trip_no string, " + ", ".join(f"{f} string" for f in FIELDS)).withColumn(
        "dep_date", F.col("dep_date").cast("date"))


def flags_of(df, date, key):
    return sorted((str(r[date]), r[key], r.field, float(r.value), r.other_key, str(r.other_date)) for r in df.collect())


def record(rng, i):
    return (f"2024-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"T{i:04}", *[rng.choice(["1", "2", "3", "", "x"]) for _ in FIELDS])


def test_refreshed_flags_equal_a_full_pass(spark, tmp_path, monkeypatch):
    # small slices: many records lie at their edges
    monkeypatch.setattr(RF, "sliced", lambda df, order: df.repartitionByRange(12, *order).withColumn("_slice", F.spark_partition_id()).checkpoint())
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    rng = random.Random(4)
    rows = {i: record(rng, i) for i in range(240)}
    store = RF.flag_store(spark, str(tmp_path / "flags"), FIELDS)
    RF.build_flags(store, trips(spark, list(rows.values())), FIELDS)
    reports = []
    for turn, n in enumerate((1, 3, 12)):
        picked = rng.sample(sorted(rows), n)
        gone = [rows.pop(i) for i in picked]
        if turn == 2:
            # a whole stretch goes, so that slices run empty
            stretch = [i for i, r in rows.items() if "2024-05" <= r[0] < "2024-08"]
            gone += [rows.pop(i) for i in stretch]
        new = {(i if rng.random() < 0.6 else 1000 * (turn + 1) + i): None for i in picked}
        new = {i: record(rng, i) for i in new}
        rows.update(new)
        reports.append(RF.refresh_flags(store, trips(spark, gone), trips(spark, list(new.values())), FIELDS))
        want = RC.neighbour_duplicates(trips(spark, list(rows.values())), fields=FIELDS)
        assert flags_of(store.read()["flags"], "day", "trip_no") == flags_of(want, "dep_date", "trip_no")
        assert store.read()["records"].count() == len(rows)
    assert reports[0]["records"] == 240 and reports[0]["records_read"] <= 6 * 240 // 12 + 30
    assert reports[0]["slices_read"] <= 6 < reports[0]["slices"]


def test_changes_before_the_first_and_in_an_empty_store(spark, tmp_path):
    store = RF.flag_store(spark, str(tmp_path / "flags"), FIELDS)
    nothing = trips(spark, [])
    assert RF.refresh_flags(store, nothing, trips(spark, [("2024-01-02", "B", "1", "5"), ("2024-01-03", "C", "1", "6")]), FIELDS)["records"] == 0
    RF.refresh_flags(store, nothing, trips(spark, [("2023-01-02", "A", "1", "5")]), FIELDS)
    assert sorted((r.trip_no, r.field, r.other_key) for r in store.read()["flags"].collect()) == [
        ("A", FIELDS[0], "B"), ("A", FIELDS[1], "B"), ("B", FIELDS[0], "A"), ("B", FIELDS[0], "C"), ("B", FIELDS[1], "A"), ("C", FIELDS[0], "B")]


@pytest.mark.parametrize("limit", [1, 100])
def test_number_lookup_by_any_subset(spark, limit):
    rng = random.Random(6)
    keys = lambda null: tuple(None if rng.random() < null else rng.choice(v) for v in ("ab", "cd", "ef", "gh"))
    places = [(f"E{i:03}", rng.choice([None, "x"]), i % 7, *keys(0.05)) for i in range(80)]
    official = [keys(0.05) for _ in range(40)]
    asked = [(i, *keys(0.5)) for i in range(30)] + [(30, None, None, None, None), (31, "a", "c", "e", "g"), (32, "z", None, None, None)]
    names = ", ".join(f"{k} string" for k in SB.NUMBER_KEYS)
    counted, listed = SB.number_lookup(
        spark.createDataFrame(asked, f"q long, {names}"), spark.createDataFrame(official, names),
        spark.createDataFrame(places, f"est_no string, official_no string, created_at int, {names}"), limit=limit)
    fits = lambda q, row: all(a is None or a == b for a, b in zip(q[1:], row))
    got = {r.q: (r.n_trips, r.n_open, r.only_estimated) for r in counted.collect()}
    lists = {q[0]: [] for q in asked}
    for r in listed.orderBy("q", "place").collect():
        lists[r.q].append(r.est_no)
    for q in asked:
        met = sorted((p for p in places if fits(q, p[3:])), key=lambda p: (p[2], p[0]))
        n, open_ = sum(fits(q, o) for o in official), sum(p[1] is None for p in met)
        assert got[q[0]] == (n, open_, n == 0 and open_ > 0)
        assert lists[q[0]] == [p[0] for p in met[:limit] if p[1] is None]


def test_nobody_asks(spark):
    names = ", ".join(f"{k} string" for k in SB.NUMBER_KEYS)
    none = spark.createDataFrame([], names)
    counted, listed = SB.number_lookup(none, none, none.selectExpr("*", "'x' AS est_no", "'x' AS official_no", "1 AS created_at"))
    assert counted.count() == 0 and listed.count() == 0


def test_evaluation_report(spark):
    files = spark.createDataFrame([("f1", "invoice", None), ("f2", "invoice", None), ("f3", "waybill", "broken")], "file string, doc_type string, error string")
    expected = spark.createDataFrame([(f, x) for f in ("f1", "f2", "f3") for x in ("a", "b")], "file string, field string")
    extracted = spark.createDataFrame([("f1", "a", "high"), ("f1", "b", "review"), ("f2", "a", "missing"), ("f1", "c", "high")], "file string, field string, confidence string")
    got = {(r.level, r.key): (r.total, r.hits, r.doubtful, r.failed, r.hit_rate) for r in EV.extraction_report(expected, extracted, files).collect()}
    assert got == {
        ("file", "f1"): (2, 1, 1, 0, 0.5), ("file", "f2"): (2, 0, 1, 0, 0.0), ("file", "f3"): (0, 0, 0, 1, 0.0), ("doc_type", "invoice"): (4, 1, 2, 0, 0.25),
        ("doc_type", "waybill"): (0, 0, 0, 1, 0.0), ("field", "a"): (2, 1, 1, 0, 0.5), ("field", "b"): (2, 0, 1, 0, 0.0), ("total", ""): (4, 1, 2, 1, 0.25)}
    assert EV.extraction_report(expected.limit(0), extracted, files.limit(0)).count() == 0


def test_record_folders_and_frozen_sets(spark, tmp_path):
    from waybridge.sources import folders as FO
    folder = tmp_path / "records"
    (folder / "more").mkdir(parents=True)
    for name, content in {
            "a.json": '{"batch_id": "B1",\n "n": 3}', "b.json": '{"batch_id": "B2", "n"', "c.json": '{"n": 4}', "d.json.tmp": '{"batch_id": "B3"}',
            "more/e.json": '{"batch_id": "B4", "n": "x"}', "f.json": '{"batch_id": " "}', "g.json": '{"batch_id": "B1", "n": 5}'}.items():
        (folder / name).write_text(content)
    good, left = FO.read_records(spark, str(folder), "batch_id string, n long")
    assert {(r.batch_id, r.n) for r in good.collect()} == {("B1", 5)}
    assert {(r.file.split("/")[-1], r.reason) for r in left.collect()} == {
        ("a.json", "repeated"), ("b.json", "unreadable"), ("c.json", "unnamed"), ("e.json", "unreadable"), ("f.json", "unnamed")}
    import hashlib
    found = FO.file_signatures(spark, str(folder))
    assert {r.file: r.signature for r in found.collect()}["c.json"] == hashlib.sha256(b'{"n": 4}').hexdigest()[:16]
    stored = spark.createDataFrame([(r.file, "other" if r.file == "a.json" else r.signature) for r in found.collect() if r.file != "c.json"] + [("z.json", "x")], "file string, signature string")
    assert {r.file: r.state for r in FO.frozen_state(found, stored).collect()} == {
        "a.json": "changed", "b.json": "same", "c.json": "new", "e.json": "same", "f.json": "same", "g.json": "same", "z.json": "missing"}
    FO.require_frozen(found, found.select("file", "signature"))
    with pytest.raises(ValueError, match="changed"):
        FO.require_frozen(found, stored)


def test_passages_by_bounds_equal_all_pairs(spark, monkeypatch):
    from waybridge.operators import passages as PS
    monkeypatch.setattr(PS, "TILE", 40)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(120)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [(i, text(rng.randint(4, 40))) for i in range(150)] + [(900, ""), (901, None), (902, "東京"), (903, "a")]
    queries = [(f"q{i}", text(rng.randint(2, 9))) for i in range(50)] + [("copy", passages[3][1]), ("none", ""), ("null", None), ("far", "東京 大阪")]
    q = spark.createDataFrame(queries, "looking string, text string")
    p = spark.createDataFrame(passages, "passage long, text string")
    want = PS.top_passages(PS.passage_scores(q, p, "looking", "passage"), "looking", "passage")
    key = lambda df: sorted((r.looking, r["rank"], r.passage, r.score) for r in df.select("looking", "rank", "passage", "score").collect())
    assert key(PS.nearest_passages(q, p, "looking", "passage")) == key(want)
    assert PS.nearest_passages(q, p.limit(0), "looking", "passage").count() == 0
    assert PS.nearest_passages(q.limit(0), p, "looking", "passage").count() == 0


def test_bounds_leave_few_pairs_of_real_lines(spark):
    from waybridge.operators import passages as PS
    folder = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{folder}/documents.parquet").select(F.explode(F.split("text", "\n")).alias("passage")).where(
        "length(passage) >= 20").distinct().withColumn("text", F.col("passage"))
    looking = spark.read.parquet(f"{folder}/benchmark.parquet").select(F.col("item_id").alias("looking"), "text")
    q, p = PS.gram_counts(looking, "looking", "text"), PS.gram_counts(lines, "passage", "text")
    n = PS.candidates(q, p, "looking", "passage").count()
    assert 0 < n < looking.count() * lines.count() / 10


def test_opinions_from_files(spark, tmp_path):
    import hashlib
    import json

    from tests.batches import GOODS, TURKEY, batch, load
    from waybridge.operators import checks as K, opinions as OP
    from waybridge.sources import refdata

    suspect = "卫浴洁具陶瓷制品"
    _, docs = load(spark, [batch("clean"), batch("goods", {"customs.goods_description": suspect}), batch("route", route=TURKEY),
                           batch("other", {"customs.goods_description": "陶瓷洁具卫浴"})])
    signed = lambda text: hashlib.sha1(text.encode()).hexdigest()[:16]
    goods = signed("CONS-001|" + "||".join(sorted([GOODS, suspect])))
    route = signed("ROUTE-001|SMGS国际货协运单|" + ",".join(TURKEY))
    (tmp_path / "presets.json").write_text(json.dumps({
        goods: {"verdict": "same_goods", "confidence": "high", "llm": "x"}, route: {"verdict": "needs_document_change", "action": "ask"}}, ensure_ascii=False))
    (tmp_path / "passages.json").write_text(json.dumps([
        {"id": "K1", "title": "SMGS 运单类型", "text": "SMGS CIM 覆盖的路线", "tags": ["route"]}, {"id": "K2", "title": "品名归类", "text": "货物描述与品名归类应一致", "tags": []},
        {"id": "K3", "title": "weather", "text": "sunny", "tags": ["none"]}, {"title": "no id"}], ensure_ascii=False))
    presets, passages = refdata.read_presets(spark, str(tmp_path / "presets.json")), refdata.read_passages(spark, str(tmp_path / "passages.json"))
    got = {r.batch_id: r for r in OP.opinions(K.prepare(docs), presets, refdata.check_hints(spark), passages).collect()}
    assert set(got) == {"goods", "route", "other"}
    assert (got["goods"].verdict, got["goods"].source, got["goods"].signature) == ("same_goods", "preset", goods)
    assert (got["route"].verdict, got["route"].signature) == ("needs_document_change", route) and got["route"].action == "ask"
    assert got["other"].verdict is None and got["other"].source is None
    assert got["goods"].basis[0] == "K2" and got["route"].basis[0] == "K1" and "K3" not in got["goods"].basis


def test_passages_whose_key_has_any_name(spark):
    """Keys may be called ``id`` or ``text``, and need not be numbers."""
    from waybridge.operators import passages as PS

    asked = spark.createDataFrame([("P1", "rail waybill"), ("P2", "goods and boxes")], "k string, words string")
    known = spark.createDataFrame([("K01", "waybill of the rail"), ("K02", "boxes of goods"), (None, "rail waybill")], "k string, words string")
    want = [("P1", "K01", 1), ("P2", "K02", 1)]
    for q, p in (("id", "passage"), ("query", "id"), ("text", "id"), ("query", "text")):
        got = PS.nearest_passages(asked.toDF(q, "words"), known.toDF(p, "words"), q, p, "words", 1)
        assert sorted((r[q], r[p], r["rank"]) for r in got.collect()) == want


def test_a_similarity_that_is_given(spark):
    import pandas as pd

    from tests.batches import batch, load
    from waybridge.operators import checks as K

    other = "卫浴陶瓷制品"
    _, docs = load(spark, [batch(f"b{i}", {"customs.goods_description": other}) for i in range(5)] + [batch("c", {"customs.goods_description": "钢"})])
    asked = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def model(a: pd.Series, b: pd.Series) -> pd.Series:
        asked.add(len(a))
        return pd.Series([None if len(y) < 2 else 1.7 for y in b])

    flat = K.prepare(docs)
    plain = {r.batch_id: r.score for r in K.goods_scores(flat).collect()}
    got = {r.batch_id: (r.score, r.grade) for r in K.goods_scores(flat, similarity=model).collect()}
    assert {k: v for k, v in got.items() if k != "c"} == {f"b{i}": (1.0, "match") for i in range(5)}
    # nothing was said about the short text, and each different pair was asked about once
    assert got["c"][0] == plain["c"] and asked.value == 2
    state = {r.batch_id: r.cons_001 for r in K.statuses(docs, checks=["CONS-001"], similarity=model).collect()}
    assert state["b0"] == "PASS" and state["c"] == "FAIL"
    by_columns = K.goods_scores(flat, similarity=lambda a, b: F.when(F.length(b) > 1, F.lit(0.7)))
    assert {r.batch_id: r.grade for r in by_columns.collect()} == {**{f"b{i}": "suspect" for i in range(5)}, "c": "mismatch"}


def test_arriving_batches_in_the_store(spark, tmp_path):
    import json

    from tests.batches import PKG, batch
    from waybridge.streaming import jobs

    store = jobs.batch_store(spark, str(tmp_path / "batches"))
    def epoch(number, records):
        rows = spark.createDataFrame([(f"f{number}", r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) for r in records], "file string, raw string")
        return jobs.store_epoch(store, "s", rows.withColumn("arrived", F.lit(number).cast("timestamp")), number)

    def stored(name, *columns):
        return sorted((tuple(r) for r in store.read()[name].select(*columns).collect()), key=str)

    assert epoch(0, [batch("one"), batch("two", PKG), "{not json", json.dumps({"documents": []})])
    assert stored("batches", "batch_id", "score", "grade", "epoch") == [("one", 0, "low", 0), ("two", 25, "medium", 0)]
    assert len(stored("documents", "batch_id")) == 10 and ("two", "CONS-002", "FAIL") in stored("issues", "batch_id", "check_id", "status")
    assert len(stored("rejected", "raw")) == 2
    # the same epoch again does nothing; a repeated batch stays, a changed one is replaced with all its rows
    assert not epoch(0, [batch("three")])
    two = batch("two", drop=["coo"])
    assert epoch(1, [dict(reversed(list(batch("one").items()))), two])
    assert stored("batches", "batch_id", "score", "epoch") == [("one", 0, 0), ("two", 30, 1)]
    assert len(stored("documents", "batch_id")) == 9
    assert not any(i[:2] == ("two", "CONS-002") for i in stored("issues", "batch_id", "check_id"))
    assert store.version() == 1


def test_grams_travel_under_numbers_and_texts_without_a_key_do_not_count(spark, monkeypatch):
    from waybridge.operators import passages as PS
    stored = []
    monkeypatch.setattr(PS, "written", lambda df, real=PS.written: stored.append(df) or real(df))
    line = "one line that is its own key"
    q = spark.createDataFrame([("q", line), (None, line)], "looking string, text string")
    p = spark.createDataFrame([(None, line), (None, line + "!"), ("far one line", "far one line"), ("own", "a key of its"), ("own", "line")],
                              "passage string, text string")
    rows = lambda df: sorted(map(tuple, df.select("looking", "rank", "passage", "score").collect()))
    got = rows(PS.nearest_passages(q, p, "looking", "passage"))
    assert [r[:3] for r in got] == [("q", 1, "own"), ("q", 2, "far one line")] or [r[:3] for r in got] == [("q", 1, "far one line"), ("q", 2, "own")]
    assert got == rows(PS.top_passages(PS.passage_scores(q, p, "looking", "passage"), "looking", "passage"))
    counts = [df for df in stored if "gram" in df.columns]
    assert counts and all(kind == "bigint" for df in counts for name, kind in df.dtypes if name != "gram")

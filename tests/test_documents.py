from waybridge.operators import checks as K
from waybridge.sources.batches import doc_fields, docs_from_wide


def test_a_check_reads_the_fields_it_compares_only(spark):
    wide = spark.createDataFrame(
        [("b", 0, "invoice", "i", " 1,200 ", "tiles", "ACME 10|"), ("b", 1, "packing_list", "p", None, None, None)],
        "batch_id string, doc_index int, doc_type string, doc_id string, total_packages string, goods_description string, consignee_name string")
    docs = docs_from_wide(wide, ["total_packages", "goods_description", "consignee_name"])
    packages = K.prepare(docs).select("batch_id", "doc_index", "has_packages", "packages.value", "packages.code")
    assert [tuple(r) for r in packages.orderBy("doc_index").collect()] == [("b", 0, True, 1200.0, "ok"), ("b", 1, False, None, "missing")]
    assert "known" not in packages._jdf.queryExecution().optimizedPlan().toString()
    # an absent field stays absent where fields are read by name
    named = doc_fields(docs, ["total_packages", "consignee_name"]).select("doc_index", "field", "text").collect()
    assert sorted(map(tuple, named)) == [(0, "consignee_name", "ACME 10|"), (0, "total_packages", " 1,200 ")]

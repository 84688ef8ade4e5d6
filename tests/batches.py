"""Literal batches for the tests: one clean shipment and edits of it."""

import copy
import json

CONSIGNOR = "山西洁康陶瓷制品有限公司"
CONSIGNEE = "RHEINBAU HANDEL GMBH"
GOODS = "陶瓷卫浴洁具"
NORTH = ["中国", "哈萨克斯坦", "俄罗斯", "白俄罗斯", "波兰", "德国"]
TURKEY = ["中国", "哈萨克斯坦", "阿塞拜疆", "格鲁吉亚", "土耳其"]
KEYS = {"invoice": "invoice", "packing": "packing_list", "waybill": "railway_waybill",
        "customs": "export_customs_declaration", "coo": "certificate_of_origin"}


def clean_documents(route=None):
    route = route or NORTH
    common = {"consignor_name": CONSIGNOR, "consignee_name": CONSIGNEE,
              "goods_description": GOODS, "total_packages": 480}

    def doc(kind, number_field, number, **more):
        return {"doc_type": kind, "doc_id": f"{kind}-1", "title": kind,
                "fields": {number_field: number, **common, **more}}

    return [
        doc("invoice", "invoice_no", "INV-1", gross_weight_kg=12300, total_amount=86400.0, currency="USD"),
        doc("packing_list", "packing_list_no", "PL-1", gross_weight_kg=12300, net_weight_kg=10800,
            container_no="MSKU8765432"),
        doc("railway_waybill", "waybill_no", "SMU/EVAL/2026", waybill_type="SMGS国际货协运单",
            departure_station="中国 西安新筑站", destination_station="德国 杜伊斯堡 DIT场站",
            route_countries=route, gross_weight_kg=12300, container_no="MSKU8765432"),
        doc("export_customs_declaration", "declaration_no", "29152026000199999", gross_weight_kg=12300,
            declared_value=86400.0, currency="USD", waybill_no="SMU/EVAL/2026",
            container_no="MSKU8765432", departure_country="中国", destination_country=route[-1]),
        doc("certificate_of_origin", "co_no", "CO-1", issuer="中国国际贸易促进委员会（CCPIT）"),
    ]


def batch(batch_id, edits=None, drop=(), route=None, extra=(), declared=None, truth=None):
    """``edits``: {"customs.total_packages": 475}; a ``None`` value removes the field."""
    docs = clean_documents(route)
    for key, value in (edits or {}).items():
        short, field = key.split(".")
        for d in docs:
            if d["doc_type"] == KEYS[short]:
                if value is None:
                    d["fields"].pop(field, None)
                else:
                    d["fields"][field] = value
    docs = [d for d in docs if d["doc_type"] not in [KEYS[x] for x in drop]] + copy.deepcopy(list(extra))
    record = {"batch_id": batch_id, "batch_name": batch_id, "documents": docs}
    if declared is not None:
        record["declared_composition"] = declared
    if truth is not None:
        record["ground_truth"] = truth
    return record


PKG = {"customs.total_packages": 475}
WEIGHT = {"packing.gross_weight_kg": 12500}
BAD_GOODS = {"customs.goods_description": "卫浴陶瓷制品"}
TYPO = {"customs.consignee_name": CONSIGNEE + "."}
LOW = {"customs.declared_value": 85000.0}

# (batch, grade, score, fails, warnings)
GOLDEN = [
    (batch("eval01_clean"), "low", 0, 0, 0),
    (batch("eval02_route_smgs_turkey", route=TURKEY), "low", 10, 0, 1),
    (batch("eval03_route_composite_ok", {"waybill.waybill_type": "CIM/SMGS统一运单"}, route=TURKEY), "low", 0, 0, 0),
    (batch("eval04_desc_suspect", {"customs.goods_description": "卫浴洁具陶瓷制品"}), "low", 15, 0, 1),
    (batch("eval05_cim_on_cis_route", {"waybill.waybill_type": "CIM国际铁路运单"}), "low", 10, 0, 1),
    (batch("eval06_weight_only_invoice", {"packing.gross_weight_kg": None, "waybill.gross_weight_kg": None,
                                          "customs.gross_weight_kg": None}), "high", 95, 3, 1),
    (batch("eval07_pkg_mismatch", PKG), "medium", 25, 1, 0),
    (batch("eval08_weight_drift", WEIGHT), "medium", 25, 1, 0),
    (batch("eval09_desc_mismatch", BAD_GOODS), "medium", 25, 1, 0),
    (batch("eval10_missing_coo", drop=["coo"]), "medium", 30, 1, 0),
    (batch("eval11_consignee_typo", TYPO), "medium", 25, 1, 0),
    (batch("eval12_amount_mismatch", LOW), "medium", 25, 1, 0),
    (batch("eval13_pkg_and_weight", {**PKG, **WEIGHT}), "high", 55, 2, 0),
    (batch("eval14_desc_and_pkg", {**BAD_GOODS, **PKG}), "high", 55, 2, 0),
    (batch("eval15_coo_and_route", drop=["coo"], route=TURKEY), "medium", 40, 1, 1),
    (batch("eval16_full_mess", {**BAD_GOODS, **PKG, **WEIGHT}, drop=["coo"]), "high", 100, 4, 0),
    (batch("eval17_party_and_waybillno", {**TYPO, "customs.waybill_no": "SMU/W-RONG/2026"}), "high", 55, 2, 0),
    (batch("eval18_container_and_amount", {**LOW, "customs.container_no": "TCLU9999999"}), "high", 55, 2, 0),
    (batch("eval19_desc_and_coo", BAD_GOODS, drop=["coo"]), "high", 60, 2, 0),
]


def load(spark, records):
    """(batches, docs) for JSON records."""
    from waybridge.sources.batches import explode_documents, parse_batches

    raw = spark.createDataFrame(
        [(f"f{i}.json", r if isinstance(r, str) else json.dumps(r, ensure_ascii=False))
         for i, r in enumerate(records)], "file string, raw string")
    batches = parse_batches(raw)
    return batches, explode_documents(batches)

"""Word lists, lookup tables, thresholds and patterns.

Everything here has to equal the published business definitions for results to
be right; it is stated plainly and in natural order. Nothing in this module
computes anything.
"""

# ---- document types -------------------------------------------------------
DOC_TYPES = [
    "invoice",
    "packing_list",
    "railway_waybill",
    "smgs_rail_waybill",
    "export_customs_declaration",
    "certificate_of_origin",
]
UNKNOWN = "unknown"
WAYBILL_TYPES = ["railway_waybill", "smgs_rail_waybill"]
CUSTOMS = "export_customs_declaration"
REQUIRED_DOC_TYPES = [
    "invoice",
    "packing_list",
    "railway_waybill",
    "export_customs_declaration",
    "certificate_of_origin",
]
SHORT_NAMES = {
    "invoice": "发票",
    "packing_list": "装箱单",
    "railway_waybill": "运单",
    "smgs_rail_waybill": "运单",
    "export_customs_declaration": "报关单",
    "certificate_of_origin": "产地证",
    "unknown": "单据",
}
TYPE_TITLES = {
    "invoice": "商业发票 Commercial Invoice",
    "packing_list": "装箱单 Packing List",
    "railway_waybill": "国际铁路运单 Railway Consignment Note",
    "smgs_rail_waybill": "国际货协运单（СМГС）SMGS Rail Waybill",
    "export_customs_declaration": "出口报关单 Export Customs Declaration",
    "certificate_of_origin": "原产地证书 Certificate of Origin",
}
IDENTITY_FIELDS = {
    "invoice": "invoice_no",
    "packing_list": "packing_list_no",
    "railway_waybill": "waybill_no",
    "smgs_rail_waybill": "waybill_no",
    "export_customs_declaration": "declaration_no",
    "certificate_of_origin": "co_no",
}
INDEX_FIELDS = [
    "invoice_no", "packing_list_no", "waybill_no", "declaration_no", "co_no", "container_no",
]
REQUIRED_FIELDS = {
    "invoice": ["invoice_no", "consignor_name", "consignee_name", "goods_description",
                "total_packages", "gross_weight_kg", "total_amount", "currency"],
    "packing_list": ["packing_list_no", "consignor_name", "consignee_name", "goods_description",
                     "total_packages", "gross_weight_kg", "container_no"],
    "railway_waybill": ["waybill_no", "waybill_type", "consignor_name", "consignee_name",
                        "route_countries", "goods_description", "total_packages",
                        "gross_weight_kg", "container_no"],
    "smgs_rail_waybill": ["waybill_no", "consignor_name", "consignee_name", "goods_description",
                          "total_packages", "gross_weight_kg", "container_no"],
    "export_customs_declaration": ["declaration_no", "consignor_name", "consignee_name",
                                   "goods_description", "total_packages", "gross_weight_kg",
                                   "declared_value", "currency", "waybill_no", "container_no",
                                   "departure_country", "destination_country"],
    "certificate_of_origin": ["co_no", "consignor_name", "consignee_name", "goods_description",
                              "total_packages"],
    "unknown": [],
}
NOT_APPLICABLE_FIELDS = {
    "smgs_rail_waybill": ["waybill_type", "route_countries", "total_amount", "declared_value",
                          "packing_list_no", "invoice_no", "declaration_no", "co_no",
                          "departure_country", "origin_country", "hs_code", "incoterm",
                          "contract_no", "reference_invoice_no", "marks"],
    "railway_waybill": ["total_amount", "declared_value", "packing_list_no", "invoice_no",
                        "declaration_no", "co_no", "origin_country", "hs_code", "incoterm",
                        "contract_no", "reference_invoice_no"],
    "invoice": ["waybill_no", "waybill_type", "route_countries", "departure_station",
                "destination_station", "seal_no", "attached_documents", "carrier_segments",
                "packing_type", "container_no", "declaration_no", "co_no"],
    "packing_list": ["total_amount", "currency", "waybill_type", "route_countries",
                     "departure_station", "destination_station", "seal_no", "declaration_no",
                     "co_no", "declared_value"],
    "certificate_of_origin": ["waybill_no", "waybill_type", "route_countries", "gross_weight_kg",
                              "seal_no", "total_amount", "declaration_no"],
}
NUMERIC_FIELDS = ["total_packages", "gross_weight_kg", "net_weight_kg", "total_amount",
                  "declared_value", "cargo_value"]

# ---- field states -----------------------------------------------------------
RECOGNIZED = "recognized"
NEEDS_REVIEW = "needs_review"
NOT_FOUND = "not_found"
BUSINESS_MISSING = "business_missing"
NOT_APPLICABLE = "not_applicable"
FIELD_STATES = [RECOGNIZED, NEEDS_REVIEW, NOT_FOUND, BUSINESS_MISSING, NOT_APPLICABLE]
OPEN_STATES = [NEEDS_REVIEW, NOT_FOUND, BUSINESS_MISSING]

# ---- statuses, tolerances, weights ---------------------------------------
PASS, WARNING, FAIL = "PASS", "WARNING", "FAIL"
WEIGHT_TOLERANCE = 0.01
AMOUNT_TOLERANCE = 0.005
POINTS_MISSING_DOC = 30
POINTS_FAIL = 25
POINTS_ESCALATION = 5
POINTS_SUSPECT = 15
POINTS_ROUTE = 10
POINTS_MINOR = 5
SCORE_CAP = 100
LOW_MAX = 20
MEDIUM_MAX = 50

# ---- text similarity ------------------------------------------------------
MATCH_SCORE = 0.85
SUSPECT_SCORE = 0.60
UNIT_WORDS = ["mm", "cm", "m", "km", "kg", "g", "mg", "lb", "oz", "t", "ton", "s", "h", "min",
              "v", "mv", "kv", "w", "kw", "mah", "ah", "wh", "kwh", "hz", "pcs", "mm2", "mm3",
              "m2", "m3", "l", "ml", "%"]
NEGATION_WORDS = ["不含", "无", "不带", "非", "禁止", "without", "non-", "not ", "no ", "free from"]

# ---- number patterns ------------------------------------------------------
GROUPED = r"[+-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?"
PLAIN = r"[+-]?\d+(?:\.\d+)?"
NUMBER_PATTERN = f"^(?:{GROUPED}|{PLAIN})$"
WITH_UNIT_PATTERN = f"^{GROUPED}[^\\s\\d]|^{PLAIN}\\s*[A-Za-z一-龥]"
KG_UNITS = ["kg", "kgs", "kilo", "kilos", "kilogram", "kilograms", "公斤", "千克"]

# ---- route coverage -------------------------------------------------------
SMGS_COUNTRIES = [
    "中国", "蒙古", "越南", "哈萨克斯坦", "乌兹别克斯坦", "土库曼斯坦", "吉尔吉斯斯坦",
    "塔吉克斯坦", "俄罗斯", "白俄罗斯", "乌克兰", "摩尔多瓦", "拉脱维亚", "立陶宛", "爱沙尼亚",
    "波兰", "德国", "捷克", "斯洛伐克", "匈牙利", "罗马尼亚", "保加利亚", "阿塞拜疆",
    "格鲁吉亚", "伊朗",
]
CIM_COUNTRIES = [
    "德国", "法国", "波兰", "捷克", "斯洛伐克", "匈牙利", "奥地利", "瑞士", "意大利", "荷兰",
    "比利时", "西班牙", "土耳其", "塞尔维亚", "罗马尼亚", "保加利亚", "希腊", "格鲁吉亚",
]

# ---- per-document rules: (id, type, field, kind, min, severity, enabled) ------
DOC_RULES = [
    ("smgs_waybill_no_required", "smgs_rail_waybill", "waybill_no", "required", None, "fail", True),
    ("smgs_waybill_consignor_required", "smgs_rail_waybill", "consignor_name", "required", None, "fail", True),
    ("smgs_waybill_consignee_required", "smgs_rail_waybill", "consignee_name", "required", None, "fail", True),
    ("smgs_waybill_goods_required", "smgs_rail_waybill", "goods_description", "required", None, "fail", True),
    ("smgs_waybill_packages_required", "smgs_rail_waybill", "total_packages", "required", None, "fail", True),
    ("smgs_waybill_gross_weight_required", "smgs_rail_waybill", "gross_weight_kg", "required", None, "fail", True),
    ("smgs_waybill_container_required", "smgs_rail_waybill", "container_no", "required", None, "warning", True),
    ("waybill_consignee_required", "railway_waybill", "consignee_name", "required", None, "fail", True),
    ("waybill_consignor_required", "railway_waybill", "consignor_name", "required", None, "fail", True),
    ("waybill_no_required", "railway_waybill", "waybill_no", "required", None, "fail", True),
    ("waybill_type_required", "railway_waybill", "waybill_type", "required", None, "fail", True),
    ("waybill_departure_station_required", "railway_waybill", "departure_station", "required", None, "fail", True),
    ("waybill_destination_station_required", "railway_waybill", "destination_station", "required", None, "fail", True),
    ("waybill_description_required", "railway_waybill", "goods_description", "required", None, "fail", True),
    ("waybill_packages_required", "railway_waybill", "total_packages", "required", None, "fail", True),
    ("waybill_gross_weight_required", "railway_waybill", "gross_weight_kg", "required", None, "fail", True),
    ("waybill_route_countries_required", "railway_waybill", "route_countries", "required", None, "warning", True),
    ("invoice_consignor_required", "invoice", "consignor_name", "required", None, "fail", True),
    ("invoice_consignee_required", "invoice", "consignee_name", "required", None, "fail", True),
    ("invoice_no_required", "invoice", "invoice_no", "required", None, "fail", True),
    ("invoice_description_required", "invoice", "goods_description", "required", None, "fail", True),
    ("invoice_packages_required", "invoice", "total_packages", "required", None, "fail", True),
    ("invoice_total_amount_required", "invoice", "total_amount", "required", None, "fail", True),
    ("invoice_total_amount_positive", "invoice", "total_amount", "range", 0.01, "fail", True),
    ("invoice_currency_required", "invoice", "currency", "required", None, "warning", True),
    ("invoice_date_required", "invoice", "invoice_date", "required", None, "fail", False),
    ("invoice_unit_price_required", "invoice", "unit_price", "required", None, "warning", False),
    ("invoice_incoterm_required", "invoice", "incoterm", "required", None, "warning", False),
    ("invoice_contract_no_required", "invoice", "contract_no", "required", None, "warning", False),
    ("packing_list_consignor_required", "packing_list", "consignor_name", "required", None, "fail", True),
    ("packing_list_consignee_required", "packing_list", "consignee_name", "required", None, "fail", True),
    ("packing_list_description_required", "packing_list", "goods_description", "required", None, "fail", True),
    ("packing_list_packages_required", "packing_list", "total_packages", "required", None, "fail", True),
    ("packing_list_gross_weight_required", "packing_list", "gross_weight_kg", "required", None, "fail", True),
    ("packing_list_net_weight_required", "packing_list", "net_weight_kg", "required", None, "warning", True),
    ("packing_list_package_type_required", "packing_list", "package_type", "required", None, "warning", False),
    ("packing_list_marks_required", "packing_list", "marks", "required", None, "warning", False),
    ("packing_list_reference_invoice_required", "packing_list", "reference_invoice_no", "required", None, "warning", False),
    ("customs_consignor_required", "export_customs_declaration", "consignor_name", "required", None, "fail", True),
    ("customs_consignee_required", "export_customs_declaration", "consignee_name", "required", None, "fail", True),
    ("customs_description_required", "export_customs_declaration", "goods_description", "required", None, "fail", True),
    ("customs_packages_required", "export_customs_declaration", "total_packages", "required", None, "fail", True),
    ("customs_gross_weight_required", "export_customs_declaration", "gross_weight_kg", "required", None, "fail", True),
    ("customs_declared_value_required", "export_customs_declaration", "declared_value", "required", None, "fail", True),
    ("customs_departure_country_required", "export_customs_declaration", "departure_country", "required", None, "fail", True),
    ("customs_destination_country_required", "export_customs_declaration", "destination_country", "required", None, "fail", True),
    ("customs_hs_code_required", "export_customs_declaration", "hs_code", "required", None, "fail", False),
    ("customs_origin_country_required", "export_customs_declaration", "origin_country", "required", None, "warning", False),
    ("coo_consignor_required", "certificate_of_origin", "consignor_name", "required", None, "fail", True),
    ("coo_description_required", "certificate_of_origin", "goods_description", "required", None, "fail", True),
    ("coo_consignee_required", "certificate_of_origin", "consignee_name", "required", None, "warning", True),
    ("coo_issuer_required", "certificate_of_origin", "issuer", "required", None, "warning", True),
    ("coo_hs_code_required", "certificate_of_origin", "hs_code", "required", None, "fail", False),
    ("coo_origin_country_required", "certificate_of_origin", "origin_country", "required", None, "fail", False),
]

# ---- code dictionary: (category, code, name, sort, aliases, country) --------
CODE_SEED = [
    ("station", "PW", "平旺", 1, "", "中国"),
    ("station", "DT", "大同", 2, "", "中国"),
    ("station", "ZD", "中鼎", 3, "", "中国"),
    ("port", "MZL", "满洲里", 1, "", "中国"),
    ("port", "EL", "二连", 2, "二连浩特", "中国"),
    ("port", "HGS", "霍尔果斯", 3, "霍尔果斯口岸", "中国"),
    ("dest", "RU", "俄罗斯", 1, "俄国", ""),
    ("dest", "ZY", "中亚", 2, "", ""),
    ("dest", "MSK", "莫斯科", 3, "Moscow,Москва", "俄罗斯"),
    ("dest", "XLY", "谢利亚季诺", 4, "Селятино,谢利亚季", "俄罗斯"),
    ("dest", "XEG", "谢尔盖利", 5, "Сергели,Сергели", "中亚"),
    ("dest", "BLS", "别雷拉斯特", 6, "Белый Раст,别雷", "俄罗斯"),
]
COUNTRY_LEVEL_CODES = ["RU", "ZY"]
TRAIN_TYPE_WORDS = {
    "L": "L", "T": "T", "临": "L", "临时": "L", "临线": "L", "图": "T", "图定": "T", "计划": "T",
}
DEFAULT_TRAIN_TYPE = "T"
RECON_WARN_PCT = 5
RECON_WARN_AMOUNT = 5000

# ---- ledger columns -------------------------------------------------------
SUBSIDY_FIELDS = ["dt_supply_100", "dt_supply_70", "ly_advance_100", "ly_recover_70",
                  "auth_confirm_100", "auth_advance_70", "auth_remain_30", "forecast_diff"]
THREE_WAY_FIELDS = ["dt_supply_100", "ly_advance_100", "auth_confirm_100"]
SETTLEMENT_FIELDS = ["rail_freight", "customs_fee", "service_fee", "other_fee", "settle_total",
                     "actual_freight"]
TRIP_BASIC_FIELDS = ["goods_name", "wagon_count", "container_40hd", "container_20hd", "teu_total"]
COST_CATEGORY_FIELD = {"铁路运费": "rail_freight", "报关费": "customs_fee",
                       "服务费": "service_fee", "其他": "other_fee"}
# purpose -> takes part in freight coverage by default
FUND_PURPOSES = {"预付运费": True, "尾款结算": True, "补贴回款": False, "保证金": False, "其他": True}
PURPOSE_OTHER = "其他"

# ---- ledger headers: field -> accepted (normalised) captions ------------------
TRIP_HEADERS = {
    "dep_date": ["发运日期", "开行日期", "发运时间", "班列发运日期", "日期"],
    "station": ["发站", "发运站", "始发站"],
    "port": ["口岸", "出境口岸", "口岸站"],
    "dest": ["目的地", "目的国", "到站", "目的国地区", "目的国地区缩写"],
    "train_type": ["类型lt", "类型", "车次性质", "lt"],
    "goods_name": ["货物品名", "品名"],
    "wagon_count": ["车数", "车皮数"],
    "container_40hd": ["柜量40hd", "40hd", "40柜", "大柜"],
    "container_20hd": ["柜量20hd", "20hd", "20柜", "小柜"],
    "teu_total": ["柜量折合teu", "折合teu", "teu"],
    "rail_freight": ["铁路运费", "运费"],
    "customs_fee": ["报关费"],
    "service_fee": ["服务费", "代理费"],
    "other_fee": ["其他费用", "其他"],
    "settle_total": ["结算合计", "结算金额合计", "合计", "结算金额"],
    "actual_freight": ["实付运费", "实付元运费", "实付"],
    "actual_paid_at": ["实付时间", "付款日期", "实付日期"],
    "diff_reason": ["差异原因", "原因分析", "原因"],
    "dt_supply_100": ["大同供应链补贴测算补贴资料100", "补贴资料100", "大同供应链补贴100"],
    "dt_supply_70": ["大同供应链补贴测算补贴70", "补贴70"],
    "ly_advance_100": ["联运公司补贴测算联运垫付补贴100", "联运垫付补贴100"],
    "ly_recover_70": ["联运公司补贴测算需要给联运回款70", "需要给联运回款70", "需回款给联运的70"],
    "auth_confirm_100": ["上级拨付确认补贴100", "确认补贴100"],
    "auth_advance_70": ["上级拨付预拨付70", "预拨付70"],
    "auth_remain_30": ["上级拨付剩余30", "上级拨付30", "剩余30"],
    "forecast_diff": ["预测补贴差额", "预测补贴差额及原因分析"],
}
TRIP_COLUMNS = ["dep_date", "station", "port", "dest", "train_type", "goods_name", "wagon_count",
                "container_40hd", "container_20hd", "teu_total", "rail_freight", "customs_fee",
                "service_fee", "other_fee", "settle_total", "actual_freight", "actual_paid_at",
                "diff_reason"]
SUBSIDY_COLUMNS = ["dep_date", "train_type", "station", "port", "dest", "dt_supply_100",
                   "dt_supply_70", "ly_advance_100", "ly_recover_70", "auth_confirm_100",
                   "auth_advance_70", "auth_remain_30", "forecast_diff", "diff_reason"]
OWN_HEADERS = {
    "seq": ["序号", "no"],
    "dep_date": ["发运日期", "日期", "开行日期"],
    "route": ["班列路线", "路线", "路线信息", "班列路线信息"],
    "pay_date": ["付款日期", "支付日期"],
    "prepay": ["预付金额", "预付款", "预付"],
    "freight": ["运费", "铁路运费"],
    "customs": ["报关费", "报关"],
    "agency": ["代理费", "服务费"],
    "total": ["结算金额合计", "合计", "结算合计", "结算金额"],
}
AGENT_HEADERS = {
    "year": ["年份", "年"],
    "seq": ["序号"],
    "month": ["月份", "月"],
    "month_seq": ["月序号"],
    "dep_date": ["开行日期", "发运日期", "日期"],
    "station": ["发站", "始发站"],
    "port": ["口岸", "出境口岸"],
    "dest": ["到站", "目的地", "目的国"],
    "goods_name": ["货物品名", "品名"],
    "wagon_count": ["车数", "车皮数"],
    "container_40hd": ["柜量40hd", "40hd", "40柜"],
    "container_20hd": ["柜量20hd", "20hd", "20柜"],
    "teu_total": ["折合teu", "teu"],
    "rail_freight": ["铁路运费"],
    "customs_fee": ["报关费"],
    "service_fee": ["服务费"],
    "other_fee": ["其他", "其他费用"],
    "settle_total": ["合计", "结算合计"],
    "actual_freight": ["实付运费", "实付", "运费"],
    "deposit": ["保证金"],
}
TOTAL_WORDS = ["合计", "总计", "小计"]
STATION_NOISE = ["混编", "混拼", "拼车", "加开", "重复", "二次上报"]

# ---- list comparison ------------------------------------------------------
CONTAINER_PATTERN = r"[A-Z]{4}\d{7}"
ANOMALY_STATES = ["not_found", "anchor_missing", "format_anomaly", "ambiguous", "read_error"]
ANOMALY_RATIO = 0.2
WAGON_PATTERN = r"\d{7,8}"
SEAL_PATTERN = r"\d{6}"
WAGON_ANCHOR = "车辆—Вагон"
WAGON_ANCHOR_RU = "Вагон"
WAGON_ANCHOR_NOT_BEFORE = "предоставлен"
SEAL_ANCHOR = "记号—знаки"
SEAL_ANCHOR_RU = "знаки"
# depth below the anchor, reach to the left, reach to the right
WAGON_BAND = (85.0, 25.0, 85.0)
SEAL_BAND = (45.0, 45.0, 35.0)
BAND_TOLERANCE = 2.0
LOWER_PAGE = 0.55
SEAL_CAPTIONS = ["铅封号", "封号"]
WAGON_CAPTIONS = ["车底号", "车板号"]

# ---- page classification --------------------------------------------------
TYPE_KEYWORDS = {
    "invoice": ["COMMERCIAL INVOICE", "INVOICE NO", "发票"],
    "packing_list": ["PACKING LIST", "装箱单"],
    "railway_waybill": ["CONSIGNMENT NOTE", "WAYBILL", "运单", "RAILWAY"],
    "smgs_rail_waybill": ["НАКЛАДНАЯ СМГС", "SMGS NAKLADNAYA", "СМГС NAKLADNAJA", "国际货协运单",
                          "货协运单"],
    "export_customs_declaration": ["报关单", "DECLARATION NO", "海关出口"],
    "certificate_of_origin": ["CERTIFICATE OF ORIGIN", "原产地", "CCPIT"],
}
# captions that precede a field value on one line, in order of preference
CAPTIONS = {
    "invoice": {
        "invoice_no": [r"INVOICE\s*NO"],
        "consignor_name": ["SELLER"],
        "consignee_name": ["BUYER"],
        "goods_description": ["DESCRIPTION OF GOODS"],
        "total_packages": [r"TOTAL\s*PACKAGES"],
        "gross_weight_kg": [r"GROSS\s*WEIGHT"],
        "total_amount": [r"TOTAL\s*AMOUNT"],
        "currency": ["CURRENCY", "币种"],
    },
    "packing_list": {
        "packing_list_no": [r"PACKING\s*LIST\s*NO"],
        "consignor_name": ["SELLER"],
        "consignee_name": ["BUYER"],
        "goods_description": ["DESCRIPTION OF GOODS"],
        "total_packages": [r"TOTAL\s*PACKAGES"],
        "gross_weight_kg": [r"GROSS\s*WEIGHT"],
        "net_weight_kg": [r"NET\s*WEIGHT"],
        "container_no": [r"CONTAINER\s*NO"],
    },
    "railway_waybill": {
        "waybill_no": [r"WAYBILL\s*NO"],
        "waybill_type": [r"WAYBILL\s*TYPE"],
        "consignor_name": ["SHIPPER"],
        "consignee_name": ["CONSIGNEE"],
        "departure_station": ["FROM"],
        "destination_station": [r"\bTO\b"],
        "route_countries": ["VIA"],
        "goods_description": ["DESCRIPTION OF GOODS"],
        "total_packages": [r"TOTAL\s*PACKAGES"],
        "gross_weight_kg": [r"GROSS\s*WEIGHT"],
        "container_no": [r"CONTAINER\s*NO"],
    },
    "export_customs_declaration": {
        "declaration_no": ["报关单编号", r"DECLARATION\s*NO"],
        "consignor_name": ["境内发货人"],
        "consignee_name": ["境外收货人"],
        "goods_description": ["品名及规格"],
        "total_packages": ["件数"],
        "gross_weight_kg": ["毛重"],
        "declared_value": ["总价"],
        "currency": ["币种", "CURRENCY"],
        "destination_country": ["运抵国", r"目的国\)?"],
        "departure_country": ["起运国", r"发货国\)?"],
        "waybill_no": ["运单号"],
        "container_no": ["集装箱号"],
    },
    "certificate_of_origin": {
        "co_no": [r"CO\s*NO", "产地证编号"],
        "issuer": ["ISSUER", "签发机构"],
        "consignor_name": ["SELLER", "发货人"],
        "consignee_name": ["BUYER", "收货人"],
        "goods_description": ["DESCRIPTION OF GOODS", "货物描述"],
        "total_packages": [r"TOTAL\s*PACKAGES", "件数"],
    },
    "unknown": {
        "consignor_name": ["SELLER", "SHIPPER", "发货人"],
        "consignee_name": ["BUYER", "CONSIGNEE", "收货人"],
        "goods_description": ["DESCRIPTION OF GOODS", "品名"],
        "total_packages": [r"TOTAL\s*PACKAGES"],
    },
}
# captions whose colon may be missing
LOOSE_CAPTIONS = [r"目的国\)?", r"发货国\)?"]

# ---- evaluation -------------------------------------------------------------
GRADE_RANK = {"low": 0, "medium": 1, "high": 2}
LEVEL_OF_GRADE = {"low": "green", "medium": "yellow", "high": "red"}

# ---- rail consignment forms: fixed values ------------------------------------
# captions that may stand on a line of their own: field -> words (fixed values)
LINE_CAPTIONS = {
    "consignor_name": ["发货人", "发件人", "售方", "SELLER", "SHIPPER", "Consignor", "Отправитель"],
    "consignee_name": ["收货人", "收件人", "买方", "BUYER", "CONSIGNEE", "Receiver", "Получатель"],
    "goods_description": ["货物描述", "品名", "DESCRIPTION OF GOODS", "Goods"],
    "total_packages": ["件数", "箱数", "TOTAL PACKAGES", "Number of Packages"],
    "gross_weight_kg": ["毛重", "GROSS WEIGHT", "Вес брутто"],
    "net_weight_kg": ["净重", "NET WEIGHT", "Вес нетто"],
    "container_no": ["集装箱号", "箱号", "CONTAINER NO", "Container"],
    "seal_no": ["封印号", "铅封号", "封志", "SEAL NO", "Пломба"],
    "packing_type": ["包装种类", "包装方式", "PACKING TYPE", "Kind of Package"],
}
# numbered boxes of the rail consignment form: field -> box numbers, words (fixed values)
BOX_CAPTIONS = {
    "consignor_name": (["1"], ["发货人", "Отправитель", "Sender", "Shipper", "Consignor"]),
    "departure_station": (["2"], ["发站", "Станция отправления", "Станцияотправления", "Departure Station",
                                  "Station of Departure"]),
    "consignee_name": (["4"], ["收货人", "Получатель", "Consignee", "Receiver"]),
    "destination_station": (["5"], ["到站", "Станция назначения", "Станцияназначения", "Destination Station",
                                    "Station of Destination"]),
    "container_no": (["7"], ["集装箱", "Контейнер", "Container", "车辆", "Вагон"]),
    "goods_description": (["15"], ["货物名称", "Наименование груза", "Наименованиегруза", "Description of Goods"]),
    "packing_type": (["16"], ["包装种类", "Вид упаковки", "Видупаковки", "Род упаковки", "Родупаковки",
                              "Kind of Package", "Packing Type"]),
    "total_packages": (["17", "14"], ["件数", "Число мест", "Числомест", "Number of Packages", "No. of Packages"]),
    "gross_weight_kg": (["18", "13"], ["毛重", "Вес брутто", "Весбрутто", "Масса брутто", "Gross Weight"]),
    "net_weight_kg": (["18", "13"], ["净重", "Вес нетто", "Веснетто", "Масса нетто", "Net Weight"]),
    "seal_no": (["19"], ["封印", "Пломба", "Пломбы", "Seal"]),
    "carrier_segments": (["22"], ["承运人", "Перевозчик", "Carrier"]),
    "attached_documents": (["24"], ["随附文件", "添附的文件", "Приложенные документы", "Приложенныедокументы",
                                    "Attached Documents", "Документы"]),
    "waybill_no": ([], ["运单号", "Номер накладной", "Номернакладной", "Waybill No"]),
    "destination_country": ([], ["运抵国", "到达国家", "Destination Country"]),
    "currency": ([], ["币种", "Валюта", "Currency"]),
    "cargo_value": ([], ["货值", "货物价值", "Стоимость груза", "Стоимостьгруза", "Cargo Value", "Value of Goods"]),
}
NET_WORDS = ["净重", "Вес нетто", "Веснетто", "Масса нетто", "Net Weight"]
GROSS_WORDS = ["毛重", "Вес брутто", "Весбрутто", "Масса брутто", "Gross Weight"]
WEIGHT_WORDS = ["重量", "Вес", "Масса", "Weight"]
CURRENCY_PATTERN = r"\b(CNY|RMB|USD|EUR|RUB|KZT|CHF|GBP|JPY)\b|(人民币|美元|欧元|卢布|坚戈)"
NUMBER_IN_TEXT = r"((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)"
CONTAINER_IN_TEXT = r"\b([A-Z]{4}\d{7})(?![0-9])"
WEIGHT_RANGE = (30, 100000)
# unnumbered headings inside a box, which are neither values nor the start of another box
BOX_HEADINGS = ["签字", "Подпись", "数量", "记号", "знаки", "К-во", "车站代码", "коды станций", "换装后", "После перегрузки",
                "Масса груза", "К-во мест", "Пограничные станции", "Масса (в кг)", "Род упаковки", "缔约承运人",
                "Договорный перевозчик", "Оригинал накладной"]
# words that belong to an address or to contact data
ADDRESS_WORDS = ["УНП", "ИНН", "ОКПО", "ТГНЛ", "统一社会信用代码", "邮编", "Почтовый", "индекс", "тел.", "Телефон", "fax", "@",
                 "г. ", "ул.", "пр-т", "проспект", "улица", ".street", "road", "楼", "室", "号院", "省", "市", "区", "县", "街道",
                 "开发区", "region", "city", "province", "область", "город", "район"]
# what a registered name ends with, and the legal forms that stand before one
COMPANY_ENDINGS = ["公司", "厂", "集团", "中心", "有限公司", "株式会社", "GmbH", "LLC", "Ltd"]
LEGAL_FORMS = ["ООО", "OOO", "ОАО", "ЗАО", "ПАО", "АО", "ИП"]
# texts that are a legal form and nothing else
BARE_FORMS = ["ООО", "ОАО", "ЗАО", "ПАО", "АО", "ИП", "КХ", "Co. Ltd", "Co., Ltd", "Co Ltd", "Co, Ltd", "Company", "公司", "株式会社"]
KG_WORDS = ["kg", "kgs", "кг", "公斤", "千克"]

# ---- fields that checks compare ------------------------------------------------
COMPARED_FIELDS = ["invoice_no", "packing_list_no", "waybill_no", "declaration_no", "co_no",
                   "goods_description", "total_packages", "gross_weight_kg", "consignor_name",
                   "consignee_name", "container_no", "total_amount", "declared_value", "currency",
                   "waybill_type", "route_countries", "departure_country", "destination_country"]

# ---- retrieval -------------------------------------------------------------
# fixed values: words that are looked up together with the results of a check
CHECK_HINTS = {
    "DOC-001": "单证缺失 原产地证书 清关要求",
    "CONS-001": "货物描述 品名 归类一致",
    "CONS-002": "件数 装箱计数 查验",
    "CONS-003": "毛重 过磅 容差",
    "CONS-004": "发货人 名称 注册一致",
    "CONS-005": "收货人 名称 一致",
    "CONS-006": "运单号 随附单证 报关",
    "CONS-007": "集装箱号 箱号 铅封",
    "CONS-008": "申报金额 发票金额",
    "ROUTE-001": "运单类型 SMGS CIM 覆盖 路线",
    "ROUTE-002": "起运国 运抵国 路线 转关",
}

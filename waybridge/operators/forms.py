"""Values of captioned lines and of the numbered boxes of rail consignment forms.

``lines``: file, page, line_no (growing inside a file), text, x0, top, x1. Every line is described once; captions
meet the lines below them on (file, page), so a page is the most that is compared with itself. What a caption's
column holds travels as one short array, and each field reads its value from that array.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from waybridge import constants as C
from waybridge.functions import text as T
from waybridge.session import written

#: Points below, left and right of a caption in which a line belongs to its box; the carrier table is wide.
DEPTH, LEFT, RIGHT, WIDE = 90.0, 26.0, 12.0, 150.0
#: A line with nothing but a number lends it to a caption so near to it.
LEND_TOP, LEND_LEFT = 8.0, 60.0
#: Lines that a box is read for at most: text, packages, weights, value.
TEXT_LINES, PACKAGE_LINES, WEIGHT_LINES, VALUE_LINES = 6, 3, 8, 2
WEIGHT_BOXES = ["18", "13"]
SEVERAL = ["consignor_name", "consignee_name", "goods_description", "carrier_segments", "attached_documents"]
TEXT_FIELDS = [*SEVERAL, "departure_station", "destination_station", "destination_country", "packing_type", "seal_no", "waybill_no"]
CYRILLIC = "[А-ЯЁа-яё]"
_EDGE = r"[ :：\t\r\n/|、,，;；]"
_OPENING = r"^[（(【]"


def any_of(words: list[str]) -> str:
    """Pattern of any of the words, whatever their case."""
    return "(?iu)(?:" + "|".join(re.escape(w) if re.search(r"[.()@]", w) else w for w in words) + ")"


def holds(words: list[str]) -> str:
    """``any_of`` behind a test of the first letter, which most places of a text fail at once; for words that are no patterns."""
    plain = all(w[:1].isalnum() and not set(w) & set("\\[]{}|*+?^$") for w in words)
    first = f"(?=[{''.join(sorted({w[0] for w in words}))}])" if plain else ""
    return any_of(words).replace("(?iu)", f"(?iu){first}", 1)


CAPTION_WORDS = [w for _, words in C.BOX_CAPTIONS.values() for w in words]
CAPTION = any_of(CAPTION_WORDS)


def _trimmed(text: Column, edge: str) -> Column:
    return F.regexp_replace(text, f"^{edge}+|{edge}+$", "")


def remark_removed(text: Column) -> Column:
    """Text without one leading remark in brackets."""
    return F.regexp_replace(T.strip(text), r"^[（(【][^）)】]*[）)】]\s*[:：]?\s*", "")


#: What makes a text something other than a value, tested on the text without separators and leading remark.
NOT_A_VALUE = {
    "nothing": lambda t: t == "",
    "a remark": lambda t: t.rlike(_OPENING),
    "a caption": lambda t: t.rlike("^" + CAPTION.replace("(?iu)", "(?iu)", 1) + "$"),
    "a short text around a caption": lambda t: (F.length(t) <= 45) & t.rlike(holds(CAPTION_WORDS)),
    "a box number": lambda t: t.rlike(r"^\d{1,2}[.\s]*$"),
}


def step(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator, so that what is built on them does not work them out again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def merged(rows: DataFrame) -> DataFrame:
    """Rows per file or line, to be joined by a shuffle whatever Spark takes their size for.

    It knows the size of a written table packed; forms repeat their captions, so a table of a few MB may be a hundred when it is
    sent to the driver and broadcast.
    """
    return rows.hint("merge")


def judged(df: DataFrame, text: Column, flag: str) -> DataFrame:
    """Add ``flag``: whether a text looks like a value."""
    out = step(df, _bare=_trimmed(text, _EDGE))
    t = F.col("_bare")
    out = step(out, _core=F.when(t.rlike(_OPENING), _trimmed(remark_removed(t), "[ :：]")).otherwise(t))
    bad = F.lit(False)
    for test in NOT_A_VALUE.values():
        bad = bad | test(F.col("_core"))
    return step(out, **{flag: F.coalesce(~bad, F.lit(False))}).drop("_bare", "_core")


def numbers_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(C.NUMBER_IN_TEXT), F.lit(1))


def number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def behind(text: Column, words: list[str]) -> Column:
    """What follows the first of the captions on its line, without separators and dashes."""
    rest = F.regexp_extract(text, "(?iu)^.*?" + any_of(words).replace("(?iu)", "") + "(.*)$", 1)
    return T.strip(F.regexp_replace(_trimmed(rest, _EDGE), "^[—-]+", ""))


def described(lines: DataFrame) -> DataFrame:
    """Lines with their box number, the text behind it, and what kind of line they are."""
    out = step(lines, box=F.nullif(F.regexp_extract("text", r"^\s*(\d{1,2})[.\s]+", 1), F.lit("")))
    out = step(out, body=F.when(F.col("box").isNotNull(), F.trim(F.regexp_replace("text", r"^\s*\d{1,2}[.\s]+", ""))).otherwise(F.col("text")))
    headings = holds(C.BOX_HEADINGS).replace("(?iu)", "")
    return judged(step(
        out, stops=F.col("box").isNotNull() & F.col("body").rlike(holds(CAPTION_WORDS)),
        heading=F.col("box").isNull() & (F.length("body") < 40) & F.col("body").rlike(headings) & ~F.col("body").rlike(r"\d"),
        code=F.trim("body").rlike(r"^\d{3,8}$")), F.trim("body"), "valued")


def _tails(lines: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """One row per line and field whose caption it holds, with what stands behind the caption."""
    found = F.filter(F.array(*[F.when(F.col("text").rlike(holds(words)), F.lit(f)) for f, words in fields.items()]), lambda f: f.isNotNull())
    hits = lines.select("*", F.explode(found).alias("field"))
    tail = F.lit(None).cast("string")
    for f, words in fields.items():
        tail = F.when(F.col("field") == f, behind(F.col("text"), words)).otherwise(tail)
    return judged(step(hits, tail=tail), F.col("tail"), "tail_valued")


def captions(facts: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """One row per caption line and field: tail, place, box number (own or lent) and rank inside (file, field)."""
    # few lines are captions, and they are read several times
    hits = written(_tails(facts.where(F.col("text").rlike(holds([w for words in fields.values() for w in words]))).select(
        "file", "page", "line_no", "x0", "top", "x1", "box", "text", "body"), fields))
    lone = facts.where(F.trim("text").rlike(r"^\d{1,2}$")).select(
        "file", "page", F.col("x0").alias("lx"), F.col("top").alias("lt"), F.col("line_no").alias("lent_by"), F.trim("text").alias("lent"))
    near = hits.where("box is null").select("file", "page", "line_no", "x0", "top").distinct().join(merged(lone), ["file", "page"]).where(
        (F.abs(F.col("lt") - F.col("top")) < LEND_TOP) & (F.abs(F.col("lx") - F.col("x0")) < LEND_LEFT)).groupBy(
        "file", "page", "line_no").agg(F.min_by("lent", "lent_by").alias("lent"))
    return hits.join(merged(near), ["file", "page", "line_no"], "left").withColumn(
        "rank", F.struct(F.coalesce("box", "lent").isNull().alias("bare"), "page", "top", "line_no"))


def with_column(hits: DataFrame, facts: DataFrame) -> DataFrame:
    """Add ``column``: the lines below a caption in its box, in order, up to the next numbered caption."""
    below = facts.select("file", "page", F.col("line_no").alias("at"), F.col("x0").alias("bx"), F.col("top").alias("bt"),
                         F.struct("line_no", "text", "body", "stops", "heading", "valued", "code").alias("line"))
    gap = F.col("bt") - F.col("top")
    reach = F.when(F.col("field") == "carrier_segments", WIDE).otherwise(RIGHT)
    held = hits.select("file", "page", "line_no", "field", "x0", "top", "x1").join(merged(below), ["file", "page"]).where(
        (gap > 0) & (gap < DEPTH) & (F.col("at") != F.col("line_no")) & F.col("bx").between(F.col("x0") - LEFT, F.col("x1") + reach))
    held = held.groupBy("file", "page", "line_no", "field").agg(F.sort_array(F.collect_list("line")).alias("column"))
    stop = F.coalesce(F.nullif(F.array_position(F.transform("column", lambda x: x["stops"]), True), F.lit(0)), F.size("column") + 1)
    held = held.withColumn("column", F.slice("column", F.lit(1), (stop - 1).cast("int")))
    empty = F.array().cast(held.schema["column"].dataType)
    return hits.join(merged(held), ["file", "page", "line_no", "field"], "left").withColumn("column", F.coalesce("column", empty))


def _first(rows: DataFrame, *columns: str) -> DataFrame:
    """The best-ranked caption of every file and field."""
    return rows.groupBy("file", "field").agg(F.min_by(F.struct(*columns), "rank").alias("v")).select("file", "field", "v.*")


# ---- companies, stations, goods ----------------------------------------------------


def company(parts: Column) -> Column:
    """Registered name from the texts of a box.

    The first text is cut into words, each plain or part of an address; its plain words before the first address word are the name
    if they end like a company's. Else a legal form with the name behind it counts, wherever it stands; else the
    first text as it is.
    """
    first = T.strip(F.coalesce(F.get(parts, F.lit(0)), F.lit("")))
    words = F.filter(F.split(first, r"\s+"), lambda w: w != "")
    foreign = F.transform(words, lambda w: w.rlike(any_of(C.ADDRESS_WORDS)) | w.rlike(r"\d"))
    plain = F.coalesce(F.nullif(F.array_position(foreign, True), F.lit(0)), F.size(words) + 1) - 1
    lead = _trimmed(F.concat_ws(" ", F.slice(words, F.lit(1), plain.cast("int"))), "[ ,，;；]")
    named = lead.rlike("(?iu)(?:" + "|".join(C.COMPANY_ENDINGS) + ")$") & (F.length(lead) >= 5)
    every = F.concat_ws("\n", parts)
    form = r"(?iuU)\b(" + "|".join(C.LEGAL_FORMS) + r""")\s*[«"“]?([^,，;；\n»"”]+?)[»"”]?(?=\s*(?:[,，;；]|\d|$))"""
    kind, name = F.regexp_extract(every, form, 1), _trimmed(F.regexp_extract(every, form, 2), "[ \t«»\"“”]")
    kind = F.when((F.upper(kind) == "OOO") & name.rlike(CYRILLIC), F.lit("ООО")).otherwise(kind)
    return F.when(named, lead).when(name != "", F.concat(kind, F.lit(' "'), name, F.lit('"'))).otherwise(first)


def only_a_form(name: Column) -> Column:
    """A legal form without a name needs a person."""
    return name.rlike("(?iu)^(?:" + "|".join(re.escape(f) for f in C.BARE_FORMS) + r""")[.\s"«»]*$""")


def before_cyrillic(text: Column) -> Column:
    """Text before its first Cyrillic letter, without the separators there."""
    head = F.regexp_extract(text, "^([^А-ЯЁа-яё]*)", 1)
    return F.when(text.rlike(CYRILLIC), _trimmed(head, "[ —_/，,;；]")).otherwise(F.trim(text))


def station(text: Column) -> Column:
    """Station without a carrier in front of a slash and without its Russian repetition."""
    t = F.trim(text)
    pair = F.split(t, "/", 2)
    carrier = (F.size(pair) > 1) & (F.get(pair, F.lit(0)).rlike(CYRILLIC) | F.contains(F.get(pair, F.lit(0)), F.lit("铁")))
    return before_cyrillic(F.when(carrier, F.trim(F.get(pair, F.lit(1)))).otherwise(t))


_HS = r"(?i)HS\s*CODE\s*[:：]?\s*(\d{6,10})"


def goods(parts: Column) -> Column:
    """Struct ``name, hs_code``: a customs code line names no goods."""
    codes = F.filter(F.transform(parts, lambda t: F.regexp_extract(t, _HS, 1)), lambda c: c != "")
    mains = F.filter(F.transform(F.filter(parts, lambda t: ~t.rlike(_HS)), before_cyrillic), lambda t: t != "")
    return F.struct(_trimmed(F.coalesce(F.get(mains, F.lit(0)), F.lit("")), r"[ —\-/，,;；]").alias("name"),
                    F.try_element_at(codes, F.lit(-1)).alias("hs_code"))


# ---- fields ---------------------------------------------------------------------------


def text_fields(facts: DataFrame) -> DataFrame:
    """file, field, raw, value, state of the worded fields, with ``hs_code`` as a field of its own."""
    hits = with_column(captions(facts, {f: C.BOX_CAPTIONS[f][1] for f in TEXT_FIELDS}), facts)
    several = F.col("field").isin(*SEVERAL)
    usable = F.filter(F.slice("column", 1, TEXT_LINES), lambda x: ~x["heading"] & x["valued"])
    bodies = F.transform(F.filter(usable, lambda x: ~(several & x["code"])), lambda x: F.trim(x["body"]))
    own = F.when(F.col("tail_valued"), F.array("tail")).otherwise(F.array().cast("array<string>"))
    hits = step(hits, parts=F.concat(own, F.when(several, bodies).otherwise(F.slice(bodies, 1, 1))))
    best = _first(hits.where(F.size("parts") > 0), "parts")
    joined, parts, field = F.concat_ws(" ", "parts"), F.col("parts"), F.col("field")
    found = step(step(best, goods=F.when(field == "goods_description", goods(parts))),
        value=F.when(field.isin("consignor_name", "consignee_name"), company(parts))
        .when(field.isin("departure_station", "destination_station"), station(joined))
        .when(field == "goods_description", F.col("goods.name"))
        .when(field == "seal_no", F.coalesce(F.get(numbers_in(joined), F.lit(0)), joined)).otherwise(joined))
    organisation = field.isin("consignor_name", "consignee_name")
    row = lambda f, raw, value, state: F.struct(f.alias("field"), raw.alias("raw"), value.alias("value"), state.alias("state"))
    state = F.when(organisation & only_a_form(F.col("value")), C.NEEDS_REVIEW).otherwise(C.RECOGNIZED)
    rows = F.array(row(field, F.get("parts", F.lit(0)), F.col("value"), state),
                   row(F.lit("hs_code"), joined, F.col("goods.hs_code"), F.lit(C.RECOGNIZED)))
    return found.select("file", F.inline(F.filter(rows, lambda r: r["value"] != "")))


def containers(facts: DataFrame) -> DataFrame:
    """Container number and size type of a file: the first line that names it as one, else the last line with one."""
    upper = F.upper("text")
    marked = facts.withColumn("value", F.nullif(F.regexp_extract(upper, C.CONTAINER_IN_TEXT, 1), F.lit(""))).where("value is not null")
    at = F.struct("page", "line_no")
    row = F.struct("text", "value", "page", "line_no", "top", "x1")
    named = F.col("text").rlike(any_of(C.BOX_CAPTIONS["container_no"][1]))
    best = marked.groupBy("file").agg(F.coalesce(F.min_by(row, F.when(named, at)), F.max_by(row, at)).alias("b")).select("file", "b.*")
    size = r"\b(\d{1,2}[A-Z]\d)\b"
    own = F.nullif(F.regexp_extract(F.regexp_replace(upper, C.CONTAINER_IN_TEXT, ""), size, 1), F.lit(""))
    beside = facts.select("file", "page", F.col("line_no").alias("at"), F.col("x0").alias("bx"), F.col("top").alias("bt"),
                          F.nullif(F.regexp_extract(upper, size, 1), F.lit("")).alias("beside")).where("beside is not null")
    right = best.join(merged(beside), ["file", "page"]).where(
        (F.col("at") != F.col("line_no")) & (F.abs(F.col("bt") - F.col("top")) < 6) & (F.col("bx") >= F.col("x1"))).groupBy(
        "file").agg(F.min_by("beside", "at").alias("beside"))
    return best.join(merged(right), "file", "left").select(
        "file", F.col("text").alias("raw"), "value", F.coalesce(own, "beside").alias("size_type"))


def packages(facts: DataFrame) -> DataFrame:
    """Number of packages: the last number behind a caption, else in the first line below that has one."""
    hits = with_column(captions(facts, {"total_packages": C.BOX_CAPTIONS["total_packages"][1]}), facts)
    lists = F.transform(F.filter(F.slice("column", 1, PACKAGE_LINES), lambda x: ~x["heading"]), lambda x: numbers_in(x["text"]))
    own = numbers_in(F.col("tail"))
    some = F.when(F.size(own) > 0, own).otherwise(F.get(F.filter(lists, lambda n: F.size(n) > 0), F.lit(0)))
    rows = hits.withColumn("value", number(F.try_element_at(some, F.lit(-1)))).where("value is not null")
    return _first(rows, "value").drop("field")


def weights(facts: DataFrame) -> DataFrame:
    """Gross and net weight of every file, with a state.

    Numbers stand on the weight captions of boxes 18 and 13 and below them. A labelled number is recognised; an unlabelled one counts as
    gross. A net weight without its label is never assumed: it needs review when the box holds a second number, or the page
    another one near a kilogram sign, and is absent otherwise.
    """
    words = C.GROSS_WORDS + C.NET_WORDS + C.WEIGHT_WORDS
    hits = with_column(captions(facts.where("true"), {"weight": words}).where(F.col("box").isin(*WEIGHT_BOXES)), facts)
    low, high = C.WEIGHT_RANGE
    own = F.struct(F.col("line_no"), F.col("body").alias("said"), F.lit(True).alias("caption"))
    lines = F.concat(F.array(own), F.transform(F.slice("column", 1, WEIGHT_LINES), lambda x: F.struct(
        x["line_no"].alias("line_no"), x["text"].alias("said"), F.lit(False).alias("caption"))))
    scan = hits.select("file", "page", "rank", F.posexplode(lines).alias("k", "l")).select("file", "page", "rank", "k", "l.*")
    # a line under two captions is read for the first
    scan = scan.groupBy("file", "page", "line_no").agg(F.min(F.struct("rank", "k", "said", "caption")).alias("s")).select("file", "s.*")
    label = F.when(F.col("said").rlike(any_of(C.GROSS_WORDS)), "gross").when(F.col("said").rlike(any_of(C.NET_WORDS)), "net").otherwise("none")
    scan = scan.select("file", "rank", "k", "caption", label.alias("label"), F.posexplode(numbers_in(F.col("said"))).alias("n", "number"))
    scan = scan.withColumn("value", number(F.col("number"))).where(
        (F.col("label") != "none") | F.col("caption") | ((F.col("value") >= low) & (F.col("value") < high)))
    order = F.struct("rank", "k", "n")
    of = lambda name: F.min_by("value", F.when(F.col("label") == name, order))
    box = scan.groupBy("file").agg(
        of("gross").alias("gross"), of("net").alias("net"), of("none").alias("bare"),
        F.count_if(F.col("label") == "none").alias("n_bare"),
        F.collect_set(F.when(F.col("label") != "net", F.col("value"))).alias("known"))
    kilo = r"(?iuU)\b(?:" + "|".join(C.KG_WORDS) + r")\b"
    signs = facts.where(F.col("text").rlike(kilo)).groupBy("file", "page").agg(F.collect_set("top").alias("tops"))
    near = F.col("text").rlike(kilo) | F.exists("tops", lambda y: F.abs(F.col("top") - y) <= 14)
    others = facts.where(~F.col("stops")).join(merged(signs), ["file", "page"]).where(near).select(
        "file", F.explode(numbers_in(F.col("text"))).alias("number")).withColumn("value", number(F.col("number"))).where(
        (F.col("value") >= low) & (F.col("value") < high)).groupBy("file").agg(F.collect_set("value").alias("others"))
    rows = facts.select("file").distinct().join(merged(box), "file", "left").join(merged(others), "file", "left")
    gross = F.coalesce("gross", "bare")
    none = F.array().cast("array<double>")
    unsure = (F.coalesce("n_bare", F.lit(0)) > 1) | (F.size(F.array_except(F.coalesce("others", none), F.coalesce("known", none))) > 0)
    return rows.select(
        "file", gross.alias("gross_weight_kg"), F.when(gross.isNotNull(), C.RECOGNIZED).otherwise(C.NOT_FOUND).alias("gross_state"),
        F.col("net").alias("net_weight_kg"),
        F.when(F.col("net").isNotNull(), C.RECOGNIZED).when(unsure, C.NEEDS_REVIEW).otherwise(C.NOT_FOUND).alias("net_state"))


def cargo_value(facts: DataFrame) -> DataFrame:
    """Value and currency of a file: both near one caption, else a currency on its own caption line."""
    # both fields are read from these, so they are written once
    hits = written(with_column(captions(facts, {f: C.BOX_CAPTIONS[f][1] for f in ("cargo_value", "currency")}), facts))
    sign = lambda t: F.nullif(F.regexp_extract(t, C.CURRENCY_PATTERN, 0), F.lit(""))
    texts = F.concat(F.array("tail"), F.transform(F.filter(
        F.slice("column", 1, VALUE_LINES), lambda x: ~x["heading"]), lambda x: x["text"]))
    amounts = F.filter(F.transform(texts, numbers_in), lambda n: F.size(n) > 0)
    signs = F.filter(F.transform(texts, sign), lambda c: c.isNotNull())
    both = _first(hits.where("field = 'cargo_value'").withColumn(
        "value", number(F.try_element_at(F.get(amounts, F.lit(0)), F.lit(-1)))).withColumn("currency", F.get(signs, F.lit(0))).where(
        "value is not null and currency is not null"), "value", "currency").drop("field")
    alone = _first(hits.where("field = 'currency'").withColumn("alone", sign(F.col("tail"))).where("alone is not null"), "alone").drop("field")
    return both.join(merged(alone), "file", "full").select("file", "value", F.coalesce("currency", "alone").alias("currency"))


def form_fields(lines: DataFrame) -> DataFrame:
    """All fields of forms as rows: file, field, raw, value, state. Weights that need review have no value."""
    # every field reads the described lines, so they are written once
    facts = written(described(lines))
    as_text = lambda c: F.regexp_replace(F.col(c).cast("decimal(20,4)").cast("string"), r"\.?0+$", "")
    row = lambda df, field, value, state=None: df.select(
        "file", F.lit(field).alias("field"), F.lit(None).cast("string").alias("raw"), value.alias("value"),
        (F.lit(C.RECOGNIZED) if state is None else F.col(state)).alias("state"))
    heavy, cargo, boxes = weights(facts), cargo_value(facts), containers(facts)
    out = text_fields(facts)
    for part in (
        row(heavy, "gross_weight_kg", as_text("gross_weight_kg"), "gross_state"), row(heavy, "net_weight_kg", as_text("net_weight_kg"), "net_state"),
        row(packages(facts), "total_packages", as_text("value")), row(cargo.where("value is not null"), "cargo_value", as_text("value")),
        row(cargo, "currency", F.col("currency")), row(boxes, "container_no", F.col("value")),
        row(boxes.where("size_type is not null"), "container_type", F.col("size_type")),
    ):
        out = out.unionByName(part)
    return out


def with_missing(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Required fields of a document's type without a row are added as ``not_found``."""
    required = documents.sparkSession.createDataFrame(
        [(t, f) for t, fs in C.REQUIRED_FIELDS.items() for f in fs], "doc_type string, field string")
    return documents.select("file", "doc_type").join(required, "doc_type").join(found, ["file", "field"], "full").withColumn(
        "state", F.coalesce("state", F.lit(C.NOT_FOUND)))


# ---- lines without coordinates ------------------------------------------------------------


def line_values(lines: DataFrame, fields: dict[str, list[str]] = C.LINE_CAPTIONS) -> DataFrame:
    """Values of captioned lines: the rest of the line, else the next line unless that is a caption.

    ``lines``: file, line_no (dense inside a file), text. The next line arrives by an
    equi-join on its number, not by sorting a file in one task. Per file and field the
    first usable caption wins; numbers and containers are read from its text.
    """
    after = lines.select("file", (F.col("line_no") - 1).alias("line_no"), F.col("text").alias("next"))
    hits = _tails(lines.where(F.col("text").rlike(any_of([w for words in fields.values() for w in words]))).select(
        "file", "line_no", "text"), fields).join(merged(after), ["file", "line_no"], "left")
    body = F.trim(F.regexp_replace("next", r"^\s*\d{1,2}[.\s]+", ""))
    hits = judged(hits, F.col("next"), "next_valued")
    following = F.when(F.col("next_valued") & ~(body.rlike(CAPTION) & (F.length(body) < 48)), T.strip(F.col("next")))
    found = step(hits, raw=remark_removed(F.when(F.col("tail_valued"), F.col("tail")).otherwise(following)))
    value = (F.when(F.col("field").isin(*C.NUMERIC_FIELDS), F.replace(F.try_element_at(numbers_in(F.col("raw")), F.lit(-1)), F.lit(","), F.lit("")))
             .when(F.col("field") == "container_no", F.nullif(F.regexp_extract(F.upper("raw"), C.CONTAINER_IN_TEXT, 1), F.lit("")))
             .otherwise(F.nullif("raw", F.lit(""))))
    found = found.withColumn("value", value).where("value is not null")
    return found.groupBy("file", "field").agg(F.min_by(F.struct("raw", "value", "line_no"), "line_no").alias("v")).select("file", "field", "v.*")

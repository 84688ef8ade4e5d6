"""Values in printed boxes: anchor words and the words in the band below them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waybridge import constants as C


def wagon_anchors(words: DataFrame) -> DataFrame:
    """First wagon caption of every page: the exact caption, else the Russian word that is
    not followed on its line by the word of the neighbouring box."""
    label = F.regexp_replace("text", "[  ]", "")
    exact = words.where(label == C.WAGON_ANCHOR).withColumn("preference", F.lit(0))
    loose = words.where(F.col("text") == C.WAGON_ANCHOR_RU)
    right = words.where(F.contains("text", F.lit(C.WAGON_ANCHOR_NOT_BEFORE))).select(
        "file", "page", F.col("top").alias("r_top"), F.col("x0").alias("r_x0"))
    barred = loose.join(right, ["file", "page"]).where(
        (F.abs(F.col("r_top") - F.col("top")) < 3) & (F.col("r_x0") >= F.col("x1"))).select(
        "file", "page", "word_no").distinct()
    loose = loose.join(barred, ["file", "page", "word_no"], "left_anti").withColumn("preference", F.lit(1))
    return _first_per_page(exact.unionByName(loose))


def seal_anchors(words: DataFrame) -> DataFrame:
    label = F.regexp_replace("text", "[  ]", "")
    full = (label == C.SEAL_ANCHOR) | (
        F.contains(label, F.lit("记号")) & F.endswith(label, F.lit(C.SEAL_ANCHOR_RU)))
    preference = F.when(full, 0).when(F.col("text") == C.SEAL_ANCHOR_RU, 1)
    return _first_per_page(words.withColumn("preference", preference).where("preference is not null"))


def _first_per_page(hits: DataFrame) -> DataFrame:
    best = F.min_by(F.struct("text", "x0", "x1", "top", "bottom"), F.struct("preference", "word_no"))
    return hits.groupBy("file", "page").agg(best.alias("a")).select(
        "file", "page", F.col("a.text").alias("anchor"), F.col("a.x0").alias("ax0"), F.col("a.x1").alias("ax1"),
        F.col("a.top").alias("atop"), F.col("a.bottom").alias("abottom"))


def with_band(anchors: DataFrame, reach: tuple[float, float, float], rulings: DataFrame | None = None) -> DataFrame:
    """Band below each anchor: between the nearest vertical rulings, else a fixed reach.

    ``rulings``: file, page, x, top, bottom of vertical lines.
    """
    depth, left, right = reach
    out = anchors.withColumn("b_top", F.col("abottom") - 1).withColumn("b_bottom", F.col("abottom") + depth)
    if rulings is not None:
        crossing = anchors.join(rulings, ["file", "page"]).where(
            (F.col("bottom") > F.col("abottom")) & (F.col("top") < F.col("abottom") + depth)).withColumn(
            "x", F.round("x", 1))
        edges = crossing.groupBy("file", "page").agg(
            F.max(F.when(F.col("x") <= F.col("ax0") + 1, F.col("x"))).alias("line_left"),
            F.min(F.when(F.col("x") >= F.col("ax1") - 1, F.col("x"))).alias("line_right"))
        out = out.join(edges, ["file", "page"], "left")
    else:
        out = out.withColumn("line_left", F.lit(None).cast("double")).withColumn("line_right", F.lit(None).cast("double"))
    ruled = F.coalesce(F.col("line_right") > F.col("line_left"), F.lit(False))
    return (
        out.withColumn("ruled", ruled)
        .withColumn("b_left", F.when(ruled, F.col("line_left")).otherwise(F.col("ax0") - left))
        .withColumn("b_right", F.when(ruled, F.col("line_right")).otherwise(F.col("ax1") + right))
        .drop("line_left", "line_right"))


def band_values(pages: DataFrame, words: DataFrame, banded: DataFrame, pattern: str) -> DataFrame:
    """Value and reading state of one box on every page.

    Words meet the single band of their page on (file, page); the geometry is tested on
    those pairs, and candidates are reduced by aggregates, not collected.
    """
    tol = C.BAND_TOLERANCE
    inside = (
        (F.col("x0") >= F.col("b_left") - tol) & (F.col("x1") <= F.col("b_right") + tol)
        & (F.col("top") >= F.col("b_top") - tol) & (F.col("bottom") <= F.col("b_bottom") + tol))
    text = F.trim("text")
    hits = words.join(banded, ["file", "page"]).where(inside & (text != "")).select(
        "file", "page", text.alias("text"), "top", "x0", text.rlike(f"^(?:{pattern})$").alias("fits"))
    fitting = F.when(F.col("fits"), F.col("text"))
    found = hits.groupBy("file", "page").agg(
        F.count("*").alias("n_candidates"),
        F.min_by("text", F.when(F.col("fits"), F.struct("top", "x0", "text"))).alias("value"),
        (F.min(fitting) != F.max(fitting)).alias("many"))
    anchors = banded.select("file", "page", "anchor", "ruled")
    state = (
        F.when(F.col("anchor").isNull(), "anchor_missing").when(F.col("n_candidates").isNull(), "not_found")
        .when(F.col("value").isNull(), "format_anomaly").when(F.col("many"), "ambiguous").otherwise("ok"))
    return (
        pages.select("file", "page").join(anchors, ["file", "page"], "left").join(found, ["file", "page"], "left")
        .select("file", "page", "anchor", "ruled", "value", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
                state.alias("status")))


def container_values(pages: DataFrame, words: DataFrame) -> DataFrame:
    """Container number of every page: hits in the lower part of the page come first.

    ``pages`` carries the page height; words are numbered in reading order.
    """
    hits = words.select("file", "page", "word_no", "top", F.posexplode(
        F.regexp_extract_all("text", F.lit(f"({C.CONTAINER_PATTERN})"), F.lit(1))).alias("pos", "value"))
    placed = hits.join(pages.select("file", "page", "height"), ["file", "page"])
    upper = F.col("top") <= F.col("height") * C.LOWER_PAGE
    best = placed.groupBy("file", "page").agg(
        F.min_by("value", F.struct(upper, "word_no", "pos")).alias("value"),
        F.count_distinct("value").alias("n_candidates"))
    return pages.select("file", "page").join(best, ["file", "page"], "left").select(
        "file", "page", "value", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        F.when(F.col("value").isNull(), "not_found").otherwise("ok").alias("status"))


def as_extraction(value: Column, status: Column) -> Column:
    return F.struct(value.alias("value"), status.alias("status"))

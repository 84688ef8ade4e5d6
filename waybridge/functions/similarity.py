"""Character 1+2-gram cosine and contradiction guards.

The score of a pair is worked out inside its own row: both gram lists are
tagged, sorted together once and folded in a single pass, so a row costs
O(n log n) in its text length, needs no shuffle and reads the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from waybridge import constants as C


def plain_text(text: Column) -> Column:
    """Lower case, decimal points kept as a letter, everything but word characters removed."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?<=\d)\.(?=\d)", "点")
    return F.regexp_replace(kept, r"(?U)[^\w]+", "")


def grams(plain: Column) -> Column:
    """Every character and every pair of neighbouring characters, repeats included."""
    chars = F.filter(F.split(plain, ""), lambda c: c != "")
    n = F.size(chars)
    pairs = F.when(
        n > 1, F.zip_with(F.slice(chars, F.lit(1), n - 1), F.slice(chars, F.lit(2), n - 1),
                        lambda x, y: F.concat(x, y))
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(chars, pairs)


def _fold(state: Column, item: Column) -> Column:
    same = state["gram"] == item["gram"]
    left = F.when(item["side"] == 0, 1).otherwise(0).cast("double")
    right = F.when(item["side"] == 1, 1).otherwise(0).cast("double")
    return F.struct(
        item["gram"].alias("gram"),
        F.when(same, state["a"] + left).otherwise(left).alias("a"),
        F.when(same, state["b"] + right).otherwise(right).alias("b"),
        F.when(same, state["dot"]).otherwise(state["dot"] + state["a"] * state["b"]).alias("dot"),
        F.when(same, state["aa"]).otherwise(state["aa"] + state["a"] * state["a"]).alias("aa"),
        F.when(same, state["bb"]).otherwise(state["bb"] + state["b"] * state["b"]).alias("bb"),
    )


def _cosine(state: Column) -> Column:
    dot = state["dot"] + state["a"] * state["b"]
    aa = state["aa"] + state["a"] * state["a"]
    bb = state["bb"] + state["b"] * state["b"]
    return F.when(dot == 0, F.lit(0.0)).otherwise(F.round(dot / (F.sqrt(aa) * F.sqrt(bb)), 4))


def similarity(a: Column, b: Column) -> Column:
    """Cosine of the two gram counts, rounded to four places; 1.0 for equal texts."""
    pa, pb = plain_text(a), plain_text(b)

    def tagged(plain: Column, side: int) -> Column:
        return F.transform(grams(plain), lambda g: F.struct(g.alias("gram"), F.lit(side).alias("side")))

    start = F.struct(
        F.lit("").alias("gram"),
        *[F.lit(0.0).alias(name) for name in ("a", "b", "dot", "aa", "bb")],
    )
    merged = F.array_sort(F.concat(tagged(pa, 0), tagged(pb, 1)))
    score = F.aggregate(merged, start, _fold, _cosine)
    return F.when(pa == pb, F.lit(1.0)).when((pa == "") | (pb == ""), F.lit(0.0)).otherwise(score)


def _number_set(texts: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(texts, lambda t: t.cast("double"))))


def spec_tokens(text: Column) -> Column:
    """Sorted distinct ``number unit`` pairs; the first unit word that fits wins."""
    units = "|".join(C.UNIT_WORDS)
    pattern = F.lit(rf"(?i)(\d+(?:\.\d+)?)\s*({units})")
    raw = F.coalesce(text, F.lit(""))
    found = F.arrays_zip(
        F.regexp_extract_all(raw, pattern, F.lit(1)).alias("n"),
        F.regexp_extract_all(raw, pattern, F.lit(2)).alias("u"),
    )
    return F.array_sort(F.array_distinct(F.transform(
        found, lambda t: F.struct(t["n"].cast("double").alias("n"), F.lower(t["u"]).alias("u")))))


def bare_numbers(text: Column) -> Column:
    raw = F.coalesce(text, F.lit(""))
    return _number_set(F.regexp_extract_all(raw, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))


def has_negation(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = F.lit(False)
    for word in C.NEGATION_WORDS:
        hit = hit | F.contains(low, F.lit(word))
    return hit


def contradiction(a: Column, b: Column) -> Column:
    """First kind of contradiction between two descriptions, or null."""
    return (
        F.when(spec_tokens(a) != spec_tokens(b), "numeric_spec")
        .when(bare_numbers(a) != bare_numbers(b), "bare_number")
        .when(has_negation(a) != has_negation(b), "negation")
    )


def grade(score: Column, guard: Column) -> Column:
    return (
        F.when(guard.isNotNull(), "mismatch")
        .when(score >= C.MATCH_SCORE, "match")
        .when(score >= C.SUSPECT_SCORE, "suspect")
        .otherwise("mismatch")
    )

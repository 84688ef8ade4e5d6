"""Second opinions on cases between pass and fail: the case, its stored opinion and the passages it rests on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from waybridge import constants as C
from waybridge.functions.canonical import pair_signature, route_signature
from waybridge.operators import checks as K
from waybridge.operators.passages import basis_per_check
from waybridge.session import written
from waybridge.sources.refdata import with_preset_opinion


def gray_cases(flat: DataFrame, similarity: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Suspect descriptions and doubtful routes of all batches, with the signature of what is in doubt.

    ``item`` is the other description, or the position of the waybill. A description's signature does not depend on
    the order of the two texts.
    """
    goods = K.goods_scores(flat, similarity=similarity).where("grade = 'suspect'").select(
        "batch_id", F.col("other_text").alias("item"), F.lit("CONS-001").alias("check_id"),
        pair_signature(F.col("base_text"), F.col("other_text")).alias("signature"))
    routes = flat.where(F.col("route_state") == C.WARNING).select(
        "batch_id", F.col("doc_index").cast("string").alias("item"), F.lit(K.ROUTE_CHECK).alias("check_id"),
        route_signature(F.coalesce("waybill_type", F.lit("")), F.col("route")).alias("signature"))
    return goods.unionByName(routes)


def opinions(flat: DataFrame, presets: DataFrame, hints: DataFrame, passages: DataFrame,
             similarity: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Gray cases with the opinion stored for their signature, where there is one, and the basis of their check."""
    # the checks that are looked up are read from the cases too, so these are worked out once
    cases = written(with_preset_opinion(gray_cases(flat, similarity), presets))
    return basis_per_check(cases, hints, passages)

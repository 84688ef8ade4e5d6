"""The registered queries of this package: each applies one operator to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from waybridge.llm import (
    centroid_clustering, compression, language_id, line_dedup, nb_svm, packing, page_diff, secret_scan, signature_join,
    simhash, spelling, warc, winnowing)
from waybridge.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECK_SQL[name] = sql
        return fn
    return add


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                        keep_ids=False).drop("ids")


@query("op3_secret_scan")
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


@query("op4_warc")
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.records(warc.bundles(table(spark, sf_dir, "pages")), payloads=False).drop("payload", "url")


@query("op7_compression")
def op7_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.judge(table(spark, sf_dir, "documents"))


@query("op2_nb_svm")
def op2_nb_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb_svm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query("op8_line_dedup", line_dedup.SQL)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


@query("op5_winnowing")
def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_signature_join")
def op9_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.join_components(table(spark, sf_dir, "documents"))


@query("op10_page_diff")
def op10_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_diff.main_text(table(spark, sf_dir, "pages"))


@query("op11_centroid_clustering", centroid_clustering.SQL)
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.cluster(table(spark, sf_dir, "embeddings"))


@query("op12_simhash")
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op13_spelling")
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))

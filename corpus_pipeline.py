"""From raw documents to packed training sequences, in five stages.

Every stage works on all rows that the one before it kept. Its result is written as Parquet into the cluster's
shared folder and read again, so a lost executor costs a reread at most. Documents that the classifier rejects
go; lines that many documents share stay in one of them; of near copies (word shingles of five, Jaccard
similarity of 0.8) the smallest doc_id stays; documents with a benchmark window go; the rest is packed.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from waybridge.llm import line_dedup, nb_svm, packing, signature_join, winnowing
from waybridge.llm.common import table
from waybridge.session import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Labels of these ids (checksum's remainder) are not learned from, as in the classifier's own query.
FOLDS, HELD_OUT = 5, 0
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = nb_svm.learned(docs, table(spark, sf_dir, "labels"), FOLDS, HELD_OUT)
    return nb_svm.keep_good(docs.select(COLUMNS), model)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return signature_join.one_per_component(docs.select(COLUMNS), SHINGLE, PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnowing.clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality), ("line_dedup", line_deduplication), ("jaccard_join", near_copies),
    ("decontamination", decontamination), ("packing", packed)]

#: The classifier, the tokenizer and the curve have no SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of the documents that all stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

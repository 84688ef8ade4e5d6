"""Evaluation against labelled batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waybridge import constants as C


def label_from_counts(n_fail: Column, n_warning: Column) -> Column:
    """Grade that the rubric gives to numbers of failures and warnings."""
    return (F.when(n_fail >= 2, "high").when((n_fail == 1) & (n_warning >= 2), "high")
            .when(n_fail == 1, "medium").when(n_warning >= 2, "medium").otherwise("low"))


def _rank(grade: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in C.GRADE_RANK.items() for x in p]), grade)


def graded(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """Stored label, rubric and model side by side for every labelled batch."""
    rows = truth.select("batch_id", F.col("ground_truth").alias("stored")).join(scored, "batch_id", "left")
    failed = F.col("grade").isNull()
    return rows.select(
        "batch_id", "stored", label_from_counts(F.col("n_fail"), F.col("n_warning")).alias("rubric"),
        F.col("grade").alias("model"), "score", "n_fail", "n_warning", failed.alias("failed"),
    ).withColumn("ok", F.coalesce((F.col("stored") == F.col("rubric")) & (F.col("rubric") == F.col("model")),
                                  F.lit(False)))


def agreement(rows: DataFrame) -> DataFrame:
    """Agreement, under- and over-grading and failure counts and rates in one pass."""
    lower = ~F.col("failed") & (_rank(F.col("model")) < _rank(F.col("stored")))
    higher = ~F.col("failed") & (_rank(F.col("model")) > _rank(F.col("stored")))
    counted = rows.agg(
        F.count("*").alias("total"), F.count_if("ok").alias("agree"),
        F.count_if(F.col("failed")).alias("n_failed"),
        F.count_if(F.coalesce(lower, F.lit(False))).alias("under"),
        F.count_if(F.coalesce(higher, F.lit(False))).alias("over"))
    processed = F.nullif(F.col("total") - F.col("n_failed"), F.lit(0))
    share = lambda n, d: F.round(F.coalesce(F.col(n) / d, F.lit(0.0)), 4)
    return counted.withColumns({
        "agree_rate": share("agree", F.nullif(F.col("total"), F.lit(0))),
        "under_rate": share("under", processed), "over_rate": share("over", processed),
        "failed_rate": share("n_failed", F.nullif(F.col("total"), F.lit(0)))})


def extraction_rates(expected: DataFrame, extracted: DataFrame) -> DataFrame:
    """Recognised and doubtful shares of the expected fields.

    ``expected``: file, field; ``extracted``: file, field, confidence.
    """
    rows = expected.join(extracted, ["file", "field"], "left")
    counted = rows.agg(
        F.count("*").alias("expected"), F.count_if(F.coalesce(F.col("confidence") == "high", F.lit(False))).alias("identified"),
        F.count_if(F.coalesce(F.col("confidence").isin("missing", "review"), F.lit(False))).alias("review"))
    total = F.nullif(F.col("expected"), F.lit(0))
    return counted.withColumns({
        "identification_rate": F.round(F.coalesce(F.col("identified") / total, F.lit(0.0)), 4),
        "review_rate": F.round(F.coalesce(F.col("review") / total, F.lit(0.0)), 4)})


#: Columns of a report row: what was counted, for which level and key.
REPORT = ("section string, level string, key string, total long, hits long, doubtful long, under long, over long, failed long, "
          "hit_rate double, doubtful_rate double")


def _level(names: list[str]) -> tuple[Column, Column]:
    """Level and key of a grouping set that holds one of the columns, or none."""
    own = [(n, F.grouping(n) == 0) for n in names]
    level = F.coalesce(*[F.when(hit, n) for n, hit in own], F.lit("total"))
    return level.alias("level"), F.coalesce(*[F.when(hit, F.coalesce(F.col(n).cast("string"), F.lit("?"))) for n, hit in own], F.lit("")).alias("key")


def _reported(counted: DataFrame, section: str) -> DataFrame:
    rate = lambda n: F.round(F.coalesce(F.col(n) / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)), 4)
    rows = counted.withColumns({"section": F.lit(section), "hit_rate": rate("hits"), "doubtful_rate": rate("doubtful")})
    return rows.select([c.strip().split()[0] for c in REPORT.split(",")])


def extraction_report(expected: DataFrame, extracted: DataFrame, files: DataFrame) -> DataFrame:
    """Recognised and doubtful fields per file, document type and field and in total, in one aggregation.

    ``expected``: file, field; ``extracted``: file, field, confidence; ``files``: file, doc_type, error. Fields of a file that
    could not be read are not counted; the file itself is, as failed.
    """
    names = ["file", "doc_type", "field"]
    count = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    fields = expected.join(files.where("error is null").select("file", "doc_type"), "file").join(extracted, ["file", "field"], "left").select(
        *names, F.lit(1).cast("long").alias("n"), count(F.col("confidence") == "high").alias("hit"),
        count(F.col("confidence").isin("missing", "review")).alias("doubt"), F.lit(0).cast("long").alias("bad"))
    zero = F.lit(0).cast("long")
    unread = files.where("error is not null").select(
        "file", "doc_type", F.lit(None).cast("string").alias("field"), zero.alias("n"), zero.alias("hit"), zero.alias("doubt"), F.lit(1).cast("long").alias("bad"))
    sets = [[F.col(n)] for n in names] + [[]]
    level, key = _level(names)
    counted = fields.unionByName(unread).groupingSets(sets, *[F.col(n) for n in names]).agg(
        level, key, F.sum("n").alias("total"), F.sum("hit").alias("hits"), F.sum("doubt").alias("doubtful"), zero.alias("under"), zero.alias("over"),
        F.sum("bad").alias("failed"))
    # a file that failed has no fields to report on
    return _reported(counted.where("not (level = 'field' and key = '?')"), "extraction")


def grading_report(rows: DataFrame) -> DataFrame:
    """Agreement, under- and over-grading and failures per stored grade and in total, from ``graded`` rows."""
    zero = F.lit(0).cast("long")
    beside = lambda test: F.count_if(~F.col("failed") & F.coalesce(test, F.lit(False)))
    level, key = _level(["stored"])
    counted = rows.groupingSets([[F.col("stored")], []], F.col("stored")).agg(
        level, key, F.count("*").alias("total"), F.count_if("ok").alias("hits"), zero.alias("doubtful"),
        beside(_rank(F.col("model")) < _rank(F.col("stored"))).alias("under"), beside(_rank(F.col("model")) > _rank(F.col("stored"))).alias("over"),
        F.count_if("failed").alias("failed"))
    return _reported(counted, "grading")


def evaluation_report(graded_rows: DataFrame, expected: DataFrame, extracted: DataFrame, files: DataFrame) -> DataFrame:
    """The whole report as one typed table."""
    return grading_report(graded_rows).unionByName(extraction_report(expected, extracted, files))

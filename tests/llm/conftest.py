import pytest


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """The tables here are small; the operators run many small jobs."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    yield
    spark.conf.set(key, before)

"""What the corpus operators share: tables in the shared folder, Arrow batches and fixed-size hashing.

Python in this package runs inside ``mapInArrow`` tasks, which get a few hundred rows at a time and
keep nothing but small caches between batches; Spark does the partitioning, sorting and joining.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from waybridge.session import shared_folder

#: Rows of an Arrow batch at most. Texts are long, so a batch is kept to some megabytes.
BATCH_ROWS = 512
#: A key is heavy if it holds more than this part of all rows; so there are fewer heavy keys than this.
HEAVY = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batched(df: DataFrame) -> DataFrame:
    """Let Spark hand out small Arrow batches."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key, "10000")) != BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def stored(df: DataFrame) -> DataFrame:
    """Write rows into the cluster's shared folder and go on from the files.

    The rows are then worked out once, a lost executor costs a reread only, and their size is known.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more, and let Spark drop the shuffle files of finished jobs."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


def attached(rows: DataFrame, named: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``named`` (keys, n, ...), which counts in ``n`` the rows of every key.

    Keys that hold more than a thousandth of all rows are fewer than a thousand: these meet their rows by a
    broadcast, so no task gets all rows of a hot key. All others meet by a shuffle.
    """
    least = (named.agg(F.sum("n")).first()[0] or 0) // HEAVY
    heavy = F.broadcast(named.where(F.col("n") > least).drop("n"))
    light = named.where(F.col("n") <= least).drop("n")
    return rows.join(heavy, keys).unionByName(rows.join(heavy.select(keys), keys, "left_anti").join(light, keys))


def picked(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` different rows (doc_id, text, ...) with the smallest hashes of doc_id, or all where there are no more.

    Hashes are spread evenly, so a threshold lets few rows through before texts are moved; it is widened until enough are
    below. Repeated rows count once.
    """
    total, wanted = rows.count(), 2 * most
    keyed = rows.withColumns({"_hash": F.xxhash64("doc_id"), "_text": F.xxhash64("text")})
    while True:
        below = keyed if wanted >= total else keyed.where(F.col("_hash") < (wanted << 64) // total - (1 << 63))
        some = stored(below.distinct())
        if wanted >= total or some.count() >= most:
            return some.orderBy("_hash", "doc_id", "_text").limit(most).select(rows.columns)
        wanted *= 16
        discard(some)


#: Slots of a bitmap that tells which rows may have a partner; its size is fixed.
SLOTS = 1 << 22


def slotted(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """Rows whose key may be in ``wanted``; a bitmap of ``SLOTS`` bits leaves most others out before a shuffle."""
    slot = lambda: F.xxhash64(*keys).bitwiseAND(SLOTS - 1)
    # 64 slots to a word, put together inside the tasks first
    words = wanted.select(F.shiftright(slot(), 6).cast("int").alias("word"), F.expr(
        f"shiftleft(1L, cast(xxhash64({', '.join(keys)}) & 63 as int))").alias("bits")).groupBy("word").agg(
        F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(SLOTS >> 6, np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    held = rows.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def marked(slots: pd.Series) -> pd.Series:
        at = slots.to_numpy()
        return pd.Series(held.value[at >> 6] >> (at & 63) & 1 == 1)

    return rows.where(marked(slot()))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; a null is an empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def objects(column: pa.Array) -> list:
    """The values of a long column; several times faster than ``to_pylist``."""
    return column.to_numpy(zero_copy_only=False).tolist()


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """A ``mapInArrow`` function from a function of one batch."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out
    return run


def record_batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(n).type) for n, c in columns.items()],
        schema=pa.schema([schema.field(n) for n in columns]))


class Memo(dict):
    """A cache that works out missing entries and starts anew when it holds ``most`` of them."""

    def __init__(self, fn: Callable, most: int = 400_000):
        super().__init__()
        self.fn, self.most = fn, most

    def __missing__(self, key):
        value = self[key] = self.fn(key)
        return value

    def trim(self) -> None:
        """Call between batches."""
        if len(self) > self.most:
            self.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

"""Session settings and durable intermediate results.

No join in this package carries a broadcast hint: Spark broadcasts a side only
when its size estimate, or under adaptive execution its measured size, is below
``spark.sql.autoBroadcastJoinThreshold``, and shuffles it otherwise.
"""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "waybridge", cpus: int | str = "*") -> SparkSession:
    """Session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        # wide projections generate methods that the JVM would otherwise only interpret
        .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        # call-site capture costs more than building the plans of this package
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate data, named by ``spark.checkpoint.dir``.

    Only a local master, whose tasks share the disk, may go without: then one temporary folder serves the whole application.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None:
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="waybridge-"))
        folder = context.getCheckpointDir()
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows into the shared checkpoint folder and go on from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write rows as a table in the shared folder and read it back.

    From then on its size is known exactly, so Spark broadcasts it when it is small
    and shuffles it when it is not.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    for scope in getattr(_passing, "scopes", []):
        scope.append(path)
    # tables that soon go again are packed tighter, since they lie there beside their input
    (df.write.option("compression", "zstd") if getattr(_passing, "scopes", None) else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_passing = threading.local()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that are written in this block when it ends, and the shuffle files of its jobs; nothing may read them later."""
    scopes = _passing.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            delete_folder(spark, path)
        drop_shuffles(spark)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path, and the path in its terms."""
    out = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return out.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), out


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, out = hadoop_path(spark, path)
    fs.delete(out, True)

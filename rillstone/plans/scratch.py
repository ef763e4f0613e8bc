"""Shared scratch tables and lineage cuts.

Everything is written below the folder that ``spark.checkpoint.dir`` names, through Spark's own
writers, so any executor can read it and a lost executor loses nothing.  On a cluster the setting must be
there; only in local mode (tests, notebooks) a folder is made where it is not.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.  Local mode has one machine: without a setting it gets a temporary
    folder there, which goes with the process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="rillstone-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", "file://" + folder)
    return "file://" + folder


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/rillstone/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts the lineage, keeps
    the schema, gives the planner real sizes.  The shuffle files behind it go with the write."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    with setting(spark, CLEANUP, "true"):
        df.write.option("compression", compression).parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def settle_bucketed(df: DataFrame, tag: str, key: str, buckets: int) -> DataFrame:
    """Like ``settle``, bucketed by ``key``: joins on it move the other side only.  Rows are not shuffled
    for it; each task writes its rows to the files of their buckets."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    name = f"rillstone_{path.rpartition('-')[2]}"
    with setting(spark, CLEANUP, "true"):
        df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
    release(spark)
    return spark.table(name)


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop what plans that nothing refers to any more have left in the executors'
    memory (broadcasts of tables and functions); their shuffle files have gone with the writes."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """While this holds, the session's setting ``key`` is ``value``."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextlib.contextmanager
def short_batches(spark: SparkSession, rows: int = 1000):
    """While tables of long texts are written through Python: Arrow batches of ``rows`` rows at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    with setting(spark, key, str(min(rows, before) if before > 0 else rows)):
        yield


def drop_tables(spark: SparkSession | None = None) -> None:
    """Delete scratch tables that this process made (all, or those of one session)."""
    for made, path in list(_made):
        if spark is not None and made is not spark:
            continue
        try:
            made.sql(f"DROP TABLE IF EXISTS rillstone_{path.rpartition('-')[2]}")
            jvm = made.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(made.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session is gone: nothing can be deleted through it
            pass
        _made.remove((made, path))


atexit.register(drop_tables)

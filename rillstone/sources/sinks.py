"""Sinks: idempotent appends, staged overwrites, ordered exports, fingerprinted views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import fingerprint
from .readers import exists


def append_new(new: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows whose key the sink does not hold yet; a second run appends nothing."""
    spark = new.sparkSession
    fresh = new.dropDuplicates([key])
    if exists(spark, path):
        fresh = fresh.join(spark.read.schema(new.schema).parquet(path).select(key), key, "left_anti").select(*new.columns)
    fresh.write.mode("append").parquet(path)
    return spark.read.schema(new.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def replace(df: DataFrame, path: str) -> None:
    """Write beside the target, then swap by two renames: the old rows step aside, the new ones take their
    place, and only then the old ones go.  Whatever fails, all rows of one version are in ``path`` or, between
    the renames, in ``path``.old, from where the next call (or ``recover``) brings them back."""
    spark = df.sparkSession
    recover(spark, path)
    fs, Path = _fs(spark, path)
    df.write.mode("overwrite").parquet(path + ".staged")
    if fs.exists(Path(path)) and not fs.rename(Path(path), Path(path + ".old")):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(Path(path + ".staged"), Path(path)):
        recover(spark, path)
        raise OSError(f"cannot rename {path}.staged")
    fs.delete(Path(path + ".old"), True)


def recover(spark: SparkSession, path: str) -> None:
    """Bring back the rows that a broken ``replace`` has moved aside."""
    fs, Path = _fs(spark, path)
    if fs.exists(Path(path + ".old")):
        if fs.exists(Path(path)):
            fs.delete(Path(path + ".old"), True)
        elif not fs.rename(Path(path + ".old"), Path(path)):
            raise OSError(f"cannot bring {path}.old back")


def write_bank(records: DataFrame, path: str, order: list[Column]) -> None:
    """Line-delimited JSON in one fixed order, in one file: an export for people."""
    records.orderBy(*order).coalesce(1).write.mode("overwrite").json(path)


FAMILIES = ("dsa", "ml", "pytorch")


def bank_order(family: str = "family", source: str = "source", number: str = "number") -> list[Column]:
    rank = F.coalesce(*[F.when(F.col(family) == f, k) for k, f in enumerate(FAMILIES)], F.lit(9))
    return [rank, F.col(source), F.col(number)]


def corpus_fingerprint(df: DataFrame, columns: list[str]) -> str:
    """A digest of the content whatever the order of rows: sums of row hashes, then one hash."""
    row = F.xxhash64(*columns).cast("decimal(38,0)")
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("s"), F.sum(F.pmod(F.xxhash64(F.lit(1), *columns), F.lit(1 << 40))).alias("t"))
    return r.select(fingerprint(F.col("n").cast("string"), F.coalesce(F.col("s").cast("string"), F.lit("")), F.coalesce(F.col("t").cast("string"), F.lit("")))).first()[0]


def load_or_build(spark: SparkSession, root: str, name: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A view stored under its content's fingerprint: a hit (a folder with Spark's success mark) is read, a
    miss is built beside the older ones, which go when it is whole."""
    folder, path = f"{root}/{name}", f"{root}/{name}/fp={key}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
        fs, Path = _fs(spark, folder)
        for old in fs.listStatus(Path(folder)):
            if old.getPath().getName() != f"fp={key}":
                fs.delete(old.getPath(), True)
    return spark.read.parquet(path)


def is_fresh(vectors: DataFrame, key: str, n: int) -> bool:
    """Whether the stored view consists of exactly one (fingerprint, count) pair, the expected one."""
    pairs = vectors.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).limit(2).collect()
    return len(pairs) == 1 and pairs[0]["fingerprint"] == key and pairs[0]["n"] == n


def last_row_wins(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """An append-only cache as a table: the newest row per key."""
    return log.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq)))).where("_r = 1").drop("_r")


def changed_files(source: DataFrame, backup: DataFrame) -> DataFrame:
    """Files (path, content) whose bytes the backup does not hold."""
    digest = lambda d: d.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest"))
    return digest(source).join(digest(backup), ["name", "digest"], "left_anti")


def write_jdbc(df: DataFrame, url: str, name: str, **options: str) -> None:
    df.write.mode("append").jdbc(url, name, properties=options)


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    """A report of at most ``limit`` rows."""
    rows = df.limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])

"""Sessions and table access."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Tables of texts, whose rows cost far more than their bytes.
TEXTS = ("documents", "pages", "conversations")


def local_session(app: str = "rillstone", cores: int | None = None, memory: str = "12g") -> SparkSession:
    """A local session with the settings that the oracles assume (UTC, AQE on)."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    out = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(out) if name in TEXTS else out


def spread(df: DataFrame) -> DataFrame:
    """``df`` on as many tasks as run at once, if its files give fewer (a small file is one row group, which
    one task reads); larger inputs stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df._jdf.queryExecution().toRdd().getNumPartitions() < n else df

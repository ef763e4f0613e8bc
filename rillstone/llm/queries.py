"""The queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import table
from . import decontaminate, langid, licenses, lines, maxscore, mixing, quality, simhash, suffixes, warc


def op1_benchmark_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("version")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_digests(spark)).drop("version")


def op3_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("version")


def op4_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op7_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return maxscore.top_k(rows.where("vec_id % 50 = 0"), rows)


def op8_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = lines.drop_boilerplate(docs, counts=("n_lines", "n_removed"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.col("text").alias("kept_text"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedupe(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_templates": op1_benchmark_templates,
    "op2_license_scan": op2_license_scan,
    "op3_kneser_ney_quality": op3_kneser_ney_quality,
    "op4_hyperdimensional_langid": op4_hyperdimensional_langid,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_maxscore_topk": op7_maxscore_topk,
    "op8_line_spread": op8_line_spread,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_poisson_mixing": op10_poisson_mixing,
}

ORACLES: dict[str, str] = {
    "op1_benchmark_templates": decontaminate.oracle(),
    "op2_license_scan": licenses.oracle(),
    "op8_line_spread": lines.oracle(),
    "op10_poisson_mixing": mixing.oracle(),
}

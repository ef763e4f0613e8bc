"""A training-text pipeline out of five corpus operators.

Each stage takes the documents that its predecessor kept and returns documents with the same columns
(the last adds copy numbers and the mixing key).  ``run`` writes every stage as Parquet into the shared
folder and reads it again, so that a lost executor costs one stage at most.

Cases: each stage does with nulls, empty texts, repeated rows and empty tables what its operator's
module says; extra columns travel along under their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.llm import decontaminate, lines, mixing, nearcopies, quality
from rillstone.llm.rows import free
from rillstone.plans.scratch import settle
from rillstone.plans.session import table

#: The first stage is a language model and the third a graph: no SQL for the whole.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies above their language's threshold go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; a document of nothing else goes with them; n_chars follows the text.  Null and
    empty texts stay as they are, rows that share an id are judged by their own text."""
    before, removed = free(docs, "lines_before", "lines_removed")
    out = lines.drop_boilerplate(docs, counts=(before, removed))
    emptied = (F.col(removed) > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    out = out.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.drop(before, removed)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard similarity of five-word shingles 0.8 or more, found by
    SimHash and, beyond its bits, by a prefix filter) stays: the one with the smallest id.  Texts without words are copies of each other; rows without an id
    stay only where a group has no other; of rows that repeat id and text one stays."""
    return nearcopies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are replicated to the target weights of their sources and dealt out at random.  A null
    source is a source of its own; rows that share an id are drawn alike."""
    return mixing.replicate(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", source_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, name.replace(" ", "-"))
    return docs

"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: target share of the total mass over the mass it has.  A
document's number of copies is the Poisson quantile, at its source's rate, of a uniform number hashed
from the seed and the document's id: the same id always gets the same number, whatever the partitions.
Documents are exploded by that number and dealt out globally by a hash of (seed, id, copy).

Mass is counted in characters, one at least per document.  Sources without a given weight have
weight 0 when weights are given; without any, the weight of a source is mass ** temperature.

Cases: a null source is a source of its own (weight key None); null ids share one uniform number;
rows that repeat an id get equal numbers of copies; null and empty texts count one character; an empty
table gives an empty result; weights that sum to 0 give an empty result; a row's own columns come out as
they went in, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import settle
from .rows import free

SEED = 20
TEMPERATURE = 0.5
SPAN = 12  # standard deviations of the quantile table: beyond them lies less than 2**-52


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5: the same in any engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def rates(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    total: float | None = None,
    temperature: float = TEMPERATURE,
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(mix_source, rate): one row per source.  ``total`` is the target mass; None keeps the present one."""
    mass = F.greatest(F.length(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))), F.lit(1))
    slim = docs.select(F.col(f"`{source_col}`").cast("string").alias("mix_source"), mass.alias("mass"))
    by = slim.groupBy("mix_source").agg(F.sum("mass").cast("double").alias("mass"))
    if weights is None:
        by = by.withColumn("weight", F.pow("mass", F.lit(float(temperature))))
    else:
        given = docs.sparkSession.createDataFrame(
            [(k, float(v)) for k, v in weights.items()], "named string, weight double"
        )
        by = by.join(F.broadcast(given), F.col("mix_source").eqNullSafe(F.col("named")), "left").select(
            "mix_source", "mass", F.coalesce("weight", F.lit(0.0)).alias("weight")
        )
    sums = by.agg(F.sum("mass").alias("all_mass"), F.sum("weight").alias("all_weight"))
    want = F.lit(float(total)) if total is not None else F.col("all_mass")
    return by.crossJoin(F.broadcast(sums)).select(
        "mix_source", F.coalesce(F.try_divide(F.col("weight") * want, F.col("all_weight") * F.col("mass")), F.lit(0.0)).alias("rate")
    )


def quantiles(rate_table: DataFrame) -> DataFrame:
    """(mix_source, cdf): the distribution function of Poisson(rate) at 0, 1, 2, ... until it is 1 in doubles,
    as running sums over one row per source and count."""
    last = F.ceil(F.col("rate") + SPAN * F.sqrt(F.col("rate")) + 30).cast("int")
    rows = rate_table.where("rate > 0").select("mix_source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    upto = Window.partitionBy("mix_source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log_p = -F.col("rate") + F.sum(F.when(F.col("k") > 0, F.log("rate") - F.log(F.col("k").cast("double"))).otherwise(0.0)).over(upto)
    sums = rows.withColumn("p", F.exp(log_p)).withColumn("total", F.sum("p").over(upto))
    cdf = F.transform(F.sort_array(F.collect_list(F.struct("k", "total"))), lambda s: s["total"])
    return sums.groupBy("mix_source").agg(cdf.alias("cdf"))


def copies_at(cdf: Column, u: Column) -> Column:
    """How many entries of the rising array are at most ``u``, by halving."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(cdf) + 1)).cast("int"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        right = F.get(cdf, middle) <= u
        open_ = at["low"] < at["high"]
        return F.struct(F.when(open_ & right, middle + 1).otherwise(at["low"]).alias("low"), F.when(open_ & ~right, middle).otherwise(at["high"]).alias("high"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(cdf).alias("high")), halve, lambda at: at["low"])


def replicate(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    total: float | None = None,
    temperature: float = TEMPERATURE,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_broadcast_counts: int = 2_000_000,
) -> DataFrame:
    """``docs`` with each row as often as drawn, plus ``copy_no`` (from 0) and ``mix_key`` (with underscores
    behind where ``docs`` has such columns), dealt out and sorted by ``mix_key`` within partitions: a random
    order of the whole, the same at each run.  The quantile tables are broadcast up to
    ``max_broadcast_counts`` numbers in all."""
    known = settle(rates(docs, weights, total, temperature, text_col, source_col).where("rate > 0"), "rates")
    numbers = known.agg(F.sum(F.col("rate") + SPAN * F.sqrt("rate") + 31)).first()[0] or 0
    table = quantiles(known)
    keyed = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("doc"), F.col(f"`{source_col}`").cast("string").alias("source"), uniform(seed, F.col(f"`{id_col}`")).alias("u"))
    # many sources, a hot one among them: the planner shuffles and splits skewed partitions
    drawn = keyed.join(F.broadcast(table) if numbers <= max_broadcast_counts else table, F.col("source").eqNullSafe(F.col("mix_source")))
    copies = drawn.select("row", "doc", copies_at(F.col("cdf"), F.col("u")).alias("n")).where("n > 0")
    out = copies.select("row", "doc", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy_no"))
    out = out.withColumn("mix_key", uniform(seed + 1, F.col("doc"), F.col("copy_no")))
    copy_no, mix_key = free(docs, "copy_no", "mix_key")
    dealt = out.repartition(F.col("mix_key")).sortWithinPartitions("mix_key", "doc")
    return dealt.select("row.*", F.col("copy_no").alias(copy_no), F.col("mix_key").alias(mix_key))


def oracle(seed: int = SEED, temperature: float = TEMPERATURE) -> str:
    """The same draw as DuckDB SQL; the quantile tables come from a recursive query."""
    u = lambda s, *k: f"(('0x' || substr(md5(concat_ws(':', '{s}', {', '.join(k)})), 1, 13))::UBIGINT::DOUBLE / {2**52}.0)"
    return f"""
WITH RECURSIVE mass AS (SELECT source, sum(greatest(length(coalesce(text, '')), 1))::DOUBLE AS mass FROM documents GROUP BY source),
weight AS (SELECT *, pow(mass, {temperature}) AS weight FROM mass),
rate AS (SELECT source, weight * (SELECT sum(mass) FROM weight) / ((SELECT sum(weight) FROM weight) * mass) AS rate FROM weight),
cdf(source, rate, k, log_p, total) AS (
  SELECT source, rate, 0, -rate, exp(-rate) FROM rate
  UNION ALL
  SELECT source, rate, k + 1, log_p + ln(rate) - ln(k + 1), total + exp(log_p + ln(rate) - ln(k + 1)) FROM cdf
  WHERE k < ceil(rate + {SPAN} * sqrt(rate) + 30)),
drawn AS (SELECT doc_id, source, text, lang, n_chars, {u(seed, "coalesce(doc_id::VARCHAR, '')")} AS u FROM documents),
counted AS (SELECT d.doc_id, d.source, d.text, d.lang, d.n_chars, count(*) AS n FROM drawn d
  JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source AND c.total <= d.u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, copy_no, {u(seed + 1, "coalesce(doc_id::VARCHAR, '')", "copy_no::VARCHAR")} AS mix_key
FROM (SELECT *, unnest(generate_series(0, n - 1))::INTEGER AS copy_no FROM counted)
"""


def expected_copies(rate: float, u: float) -> int:
    """The quantile by brute force, for tests."""
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u and k < 10_000:
        k += 1
        p *= rate / k
        total += p
    return k

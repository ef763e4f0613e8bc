"""Joins, counts, slices and ordered reads over banks and logs, as functions of column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_known(rows: DataFrame, known: DataFrame, keys: list[str], value: str, fallback: Column, trusted: float, guessed: float) -> DataFrame:
    """Adds ``label`` and ``weight``: the known value, else a fallback, which weighs less."""
    got = known.select(*keys, F.col(value).alias("_value"), F.lit(True).alias("_known"))
    joined = rows.join(got, keys, "left")
    weight = F.when(F.col("_known"), F.lit(trusted)).otherwise(F.lit(guessed))
    return joined.withColumn("label", F.coalesce("_value", fallback)).withColumn("weight", weight).drop("_value", "_known")


def not_done(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are not done yet: what a resumed run has left."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def pairs_not_done(left: DataFrame, right: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs of two small sets whose composite key is not done yet."""
    return not_done(left.crossJoin(F.broadcast(right)), done, keys)


def lookup(rows: DataFrame, table: DataFrame, key: str, table_key: str, value: str, default: str) -> DataFrame:
    """Adds ``found``: the value under a key, or the default."""
    side = table.select(F.col(table_key).alias(key), F.col(value).alias("_found"))
    return rows.join(side, key, "left").withColumn("found", F.coalesce("_found", F.lit(default))).drop("_found")


def chosen(rows: DataFrame, column: str, allowed: list, members: DataFrame, key: str, member_key: str) -> DataFrame:
    """The rows with one of the allowed values whose key is a member."""
    return rows.where(F.col(column).isin(allowed)).join(members.select(F.col(member_key).alias(key)).distinct(), key, "left_semi")


def unknown_ids(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.select(key).join(known.select(key), key, "left_anti")


def counts(rows: DataFrame, by: str, distinct: str) -> DataFrame:
    """(by, n, distinct values) per group."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(distinct).alias("distinct"))


def count_kinds(rows: DataFrame, by: str, column: str, kinds: dict[str, str]) -> DataFrame:
    """(by, a count per kind, n)."""
    return rows.groupBy(by).agg(*[F.count_if(F.col(column) == v).alias(k) for k, v in kinds.items()], F.count(F.lit(1)).alias("n"))


def count_all_kinds(rows: DataFrame, kinds: DataFrame, column: str, where: Column) -> DataFrame:
    """(kind, n): a count for every kind, also for those without rows."""
    n = rows.where(where).groupBy(F.col(column).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.select("kind").distinct().join(n, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def sliced(rows: DataFrame, facets: list[str], value: str, places: int = 2) -> DataFrame:
    """(facets..., slice, n, mean): one pass over single-facet grouping sets; ``slice`` tells the facet by its bits."""
    bit = sum((F.grouping(c).cast("int") * (1 << len(facets) - 1 - i) for i, c in enumerate(facets)), F.lit(0))
    sets = [[F.col(c)] for c in facets]
    return rows.groupingSets(sets, *[F.col(c) for c in facets]).agg(bit.cast("int").alias("slice"), F.count(F.lit(1)).alias("n"), F.round(F.avg(value), places).alias("mean"))


def spread(rows: DataFrame, by: str, value: str, low_high: str) -> DataFrame:
    """(by, n, mean, sd, low, high)."""
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("sd"),
        F.min(low_high).alias("low"), F.max(low_high).alias("high"),
    )


def percentiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a linear percentile per name, mean)."""
    return rows.groupBy(by).agg(*[F.round(F.percentile(value, q), 6).alias(k) for k, q in shares.items()], F.round(F.avg(value), 6).alias("mean"))


def first_ids(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the place of their first occurrence, which orders them."""
    return rows.groupBy(value).agg(F.min(order).alias("first_id"))


def cost(rows: DataFrame, by: str, size: str, fixed: int = 200, rate: str = "0.35") -> DataFrame:
    """(by, tokens): a fixed part per call and a rate (decimal) per unit of size, rounded down per call."""
    return rows.groupBy(by).agg(F.sum(F.lit(fixed) + F.floor(F.col(size) * F.lit(rate).cast("decimal(9,4)"))).cast("long").alias("tokens"))


def leave_one_out(rows: DataFrame, group: str, value: str, order: list[Column]) -> DataFrame:
    """Adds ``others_mean`` (the row's own value if it is alone) and ``rank_norm`` (0 first, 1 last)."""
    w = Window.partitionBy(group)
    n = F.count(F.lit(1)).over(w)
    others = (F.sum(value).over(w) - F.col(value)) / F.nullif(n - 1, F.lit(0))
    rank = (F.row_number().over(w.orderBy(*order)) - 1).cast("double") / F.greatest(n - 1, F.lit(1))
    return rows.withColumn("others_mean", F.round(F.coalesce(others, F.col(value)), 6)).withColumn("rank_norm", F.round(rank, 6))


def longest_gap(rows: DataFrame, by: str, ts: str, order: list[str]) -> DataFrame:
    """(by, longest): the longest stretch in seconds between neighbours."""
    second = F.unix_timestamp(F.col(ts).cast("timestamp"))
    gap = second - F.lag(second).over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("_gap", gap).groupBy(by).agg(F.max("_gap").alias("longest"))


def merged_streams(streams: list[tuple[DataFrame, Column, Column]]) -> DataFrame:
    """(t, stream, id, place): rows of several streams in one order within each time."""
    out = None
    for number, (df, t, key) in enumerate(streams):
        one = df.select(t.alias("t"), F.lit(number).alias("stream"), key.alias("id"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("t").orderBy("stream", "id")).cast("long"))


def ordinals(rows: DataFrame, by: str, order: str, name: str = "ordinal") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(order)).cast("long"))


def last_by(rows: DataFrame, by: list[str], order: str, **values: str) -> DataFrame:
    """(by, last_id, a value each from the last row)."""
    return rows.groupBy(*by).agg(F.max(order).alias("last_id"), *[F.max_by(c, order).alias(k) for k, c in values.items()])


def ranks_within(rows: DataFrame, by: str, value: str, name: str = "r") -> DataFrame:
    """Adds the average rank of a value within its group."""
    rank = F.rank().over(Window.partitionBy(by).orderBy(value))
    return rows.withColumn(name, rank + (F.count(F.lit(1)).over(Window.partitionBy(by, value)) - 1) / 2.0)


def not_retired(rows: DataFrame, status: Column) -> DataFrame:
    return rows.where(F.coalesce(status, F.lit("")) != "retire")


def masked(rows: DataFrame, column: str, shown: int, where: Column) -> DataFrame:
    """Rows with only the first characters of a secret."""
    return rows.where(where).withColumn("masked", F.substring(column, 1, shown))


def replaced(rows: DataFrame, new: DataFrame, where: Column) -> DataFrame:
    """The rows outside a subset, with the new rows for it."""
    return rows.where(~F.coalesce(where, F.lit(False))).unionByName(new)


def deleted(rows: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """(rows left, one row with the numbers kept and deleted)."""
    hit = F.coalesce(where, F.lit(False))
    return rows.where(~hit), rows.agg(F.count(F.lit(1)).alias("all"), F.count_if(hit).alias("deleted"))


def left_of_budget(rows: DataFrame, by: str, cap: int, unlimited: Column) -> DataFrame:
    """(by, left_calls): what is left of the cap, null for those without one."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).select(by, F.when(~unlimited, F.greatest(F.lit(cap) - F.col("_n"), F.lit(0))).alias("left_calls"))


def used_on(rows: DataFrame, by: str, day: Column, today: Column) -> DataFrame:
    """(by, used): calls of today; 0 where the last call was on another day."""
    return rows.groupBy(by).agg(F.max(day).alias("_last"), F.count_if(day == today).alias("_n")).select(by, F.when(F.col("_last") == today, F.col("_n")).otherwise(0).cast("long").alias("used"))


def confusion(rows: DataFrame, by: str, label: str, names: dict[str, int]) -> DataFrame:
    """(by, a count per label)."""
    return rows.groupBy(by).agg(*[F.count_if(F.col(label) == v).alias(k) for k, v in names.items()])


def as_of(left: DataFrame, right: DataFrame, by: str, ts: str, value: str) -> DataFrame:
    """Adds ``as_of``: the latest value of ``right`` at or before each row's time, per key: both sides in one
    ordered pass, no range join.  At equal times, the right side's row counts."""
    r = right.select(by, ts, F.lit(0).alias("_side"), F.col(value).alias("as_of"), F.lit(None).cast(left.schema.simpleString()).alias("_row"))
    l = left.select(by, ts, F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("as_of"), F.struct("*").alias("_row"))
    upto = Window.partitionBy(by).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("as_of", F.last("as_of", ignorenulls=True).over(upto))
    return both.where("_side = 1").select("_row.*", "as_of")


def approximate(rows: DataFrame, by: str, value: str, key: str) -> DataFrame:
    """(by, distinct_estimate, median_estimate): sketches that merge across tasks."""
    return rows.groupBy(by).agg(F.approx_count_distinct(key, 0.01).alias("distinct_estimate"), F.percentile_approx(value, 0.5, 10_000).alias("median_estimate"))

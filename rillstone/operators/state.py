"""State as DataFrames: merges, latest rows, trims, quotas, review queues."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Rows of both by key; columns of ``new`` win, except those in ``keep`` where the old row has a value."""
    value = [c for c in old.columns if c not in keys]
    j = old.alias("o").join(new.alias("n"), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full")
    hit = F.coalesce(*[F.col(f"n.{k}") for k in keys]).isNotNull()
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in keep or c not in new.columns else F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return j.select(*[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys], *[(pick(c) if c in new.columns else F.col(f"o.{c}")).alias(c) for c in value])


def update_where(df: DataFrame, where: Column, changes: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows after the update, one row with the number of rows that it changed)."""
    hit = F.coalesce(where, F.lit(False))
    out = df.select(*[F.when(hit, changes[c].cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in df.columns])
    return out, df.agg(F.count_if(hit).alias("changed"))


def expire(df: DataFrame, touched: str, now: Column, ttl_seconds: int) -> DataFrame:
    """The rows touched within the last ``ttl_seconds``."""
    return df.where(F.unix_timestamp(now) - F.unix_timestamp(touched) <= ttl_seconds)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of ``new`` that are inserted: unknown keys, the first of each."""
    fresh = new.join(old.select(*keys), keys, "left_anti")
    return latest(fresh, keys, [F.col(order).asc()])


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def lru_trim(df: DataFrame, keep: int, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """The newest ``keep`` rows (per group): a sorted limit without groups, a ranked window with them."""
    if not by:
        return df.orderBy(*order).limit(keep)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= keep).drop("_r")


def reserve_single(df: DataFrame, by: list[str], order: list[str], cap: int) -> DataFrame:
    """Adds ``granted``: the first ``cap`` requests of each group."""
    return df.withColumn("granted", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) <= cap)


def charge(df: DataFrame, by: list[str], order: list[str], amount: str, cap: float) -> DataFrame:
    """Adds ``granted``: a charge goes through while what was charged before lies under the cap.  All of a
    group's charges up to the first refusal go through, so the running sum of all is the sum of the granted."""
    before = F.sum(F.greatest(F.lit(0.0), F.col(amount))).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("granted", F.coalesce(before, F.lit(0.0)) < cap)


def reserve_coupled(df: DataFrame, key_quota: int, key_cap: int, server_cap: int) -> DataFrame:
    """(day, event_id, verdict): calls in order against a key's quota on one engine, the key's budget and the
    server's budget; a refusal counts nothing.  ``df`` has day, seq, event_id, key, engine.

    The counters depend on each other, so a day is one ordered fold: its state is two numbers per key.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        used: dict = {}
        calls: dict = {}
        total, verdicts = 0, []
        for key, engine in rows.sort_values(["seq", "event_id"])[["key", "engine"]].itertuples(index=False):
            if engine == "claude" and used.get(key, 0) >= key_quota:
                verdicts.append("quota")
            elif calls.get(key, 0) >= key_cap or total >= server_cap:
                verdicts.append("budget")
            else:
                if engine == "claude":
                    used[key] = used.get(key, 0) + 1
                calls[key] = calls.get(key, 0) + 1
                total += 1
                verdicts.append("ok")
        s = rows.sort_values(["seq", "event_id"])
        return pd.DataFrame({"day": s["day"].to_numpy(), "event_id": s["event_id"].to_numpy(), "verdict": verdicts})

    return df.groupBy("day").applyInPandas(fold, "day string, event_id long, verdict string")


def review(attempts: DataFrame, now: Column) -> DataFrame:
    """(problem_key, attempts, solved, status, due, is_due, place): the latest attempt decides; ``place`` is
    the position in the queue of what is due, by status, then by the oldest finish."""
    order = Window.partitionBy("problem_key").orderBy(F.desc("finished_at"), "id")
    ranked = attempts.withColumn("_r", F.row_number().over(order))
    per = ranked.groupBy("problem_key").agg(
        F.count(F.lit(1)).alias("attempts"), F.bool_or(F.col("outcome") == "solved").alias("solved"),
        F.max(F.when(F.col("_r") == 1, F.struct("finished_at", "outcome", "hint_max"))).alias("l"),
    )
    status = numeric.attempt_status(F.col("l.outcome"), F.col("l.hint_max"))
    due = numeric.due_at(F.col("l.finished_at"), F.col("status"), now)
    out = per.withColumn("status", status).withColumn("due", due).withColumn("is_due", F.col("due") <= now)
    return out.select("problem_key", "attempts", "solved", "status", "due", "is_due", F.col("l.finished_at").alias("finished_at"))


def review_queue(reviewed: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` problems that are due."""
    rank = F.array_position(F.array(*map(F.lit, numeric.STATUSES)), F.col("status"))
    return reviewed.where("is_due").orderBy(rank, "finished_at", "problem_key").limit(limit)


def consecutive(df: DataFrame, by: list[str], order: list[str], column: str, keep: int | None = None) -> DataFrame:
    """Rows that differ from the one before, the last ``keep`` of them."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.where(F.lit(True)).withColumn("_p", F.lag(column).over(w)).withColumn("_i", F.row_number().over(w)).where(f"_i = 1 OR NOT ({column} <=> _p)").drop("_p", "_i")
    return lru_trim(out, keep, [F.col(c).desc() for c in order], by) if keep else out


def carry_forward(df: DataFrame, by: list[str], order: list[str], column: str, strictly_before: bool = False) -> Column:
    """The last value that is not null, up to the row or strictly before it."""
    return F.last(column, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strictly_before else 0))


def islands(df: DataFrame, by: list[str], order: list[str], flag: Column) -> DataFrame:
    """Adds ``island``: number of the run of rows with equal flags."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.when(F.lag("_f").over(w).eqNullSafe(F.col("_f")), 0).otherwise(1)
    return df.withColumn("_f", flag).withColumn("_c", change).withColumn("island", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c").withColumnRenamed("_f", "flag")

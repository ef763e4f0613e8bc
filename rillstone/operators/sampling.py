"""Deterministic samples and splits: orders come from digests of (seed, key), the same in any engine."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import hash_order


def stratified(df: DataFrame, stratum: str, key: str, limit: int, seed: int = 42) -> DataFrame:
    """Round-robin over strata in order: (row of stratum, stratum), the first ``limit``."""
    rn = F.row_number().over(Window.partitionBy(stratum).orderBy(hash_order(seed, F.col(key)), key))
    return df.withColumn("turn", rn).where(F.col("turn") <= limit).orderBy("turn", stratum).limit(limit)


def group_split(df: DataFrame, group: str, share: float, seed: int = 42) -> DataFrame:
    """Adds ``held_out``: all rows of ceil(share * n) groups.  Groups are ranked by digest among themselves."""
    groups = df.select(group).distinct()
    n = groups.agg(F.ceil(F.count(F.lit(1)) * share).alias("take"))
    order = F.row_number().over(Window.orderBy(hash_order(seed, F.col(group)), group))
    held = groups.withColumn("_r", order).crossJoin(F.broadcast(n)).select(group, (F.col("_r") <= F.col("take")).alias("held_out"))
    return df.join(held, group)


def two_folds(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Adds ``fold``: alternating over the shuffled keys."""
    keys = df.select(key).distinct()
    return df.join(keys.withColumn("fold", F.row_number().over(Window.orderBy(hash_order(seed, F.col(key)), key)) % 2), key)


def cap_per_group(df: DataFrame, group: str, order: list, cap: int, priority: Column | None = None) -> DataFrame:
    """The first ``cap`` rows of each group in order, those with ``priority`` before the others."""
    by = ([F.when(priority, 0).otherwise(1)] if priority is not None else []) + order
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*by))).where(F.col("place") <= cap)


def random_pick(df: DataFrame, group: str, key: str, seed: int = 42) -> DataFrame:
    """One row of each group, uniform by digest."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(hash_order(seed, F.col(key)), key))).where("_r = 1").drop("_r")


def balanced(pool: DataFrame, n: int) -> DataFrame:
    """Half of ``n`` per label, each time from the least filled bank, then the least used policy.

    The pool (label, bank, policy, key) is what people judge by hand, so it is small; it is one group."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key").reset_index(drop=True)
        taken: list[int] = []
        banks, policies = {}, {}
        for label, want in ((x, n // 2) for x in sorted(rows["label"].unique())):
            left = list(rows.index[rows["label"] == label])
            while left and want:
                i = min(left, key=lambda k: (banks.get(rows.bank[k], 0), policies.get(rows.policy[k], 0), rows.key[k]))
                left.remove(i)
                taken.append(i)
                banks[rows.bank[i]] = banks.get(rows.bank[i], 0) + 1
                policies[rows.policy[i]] = policies.get(rows.policy[i], 0) + 1
                want -= 1
        rest = [i for i in rows.index if i not in taken][: max(0, n - len(taken))]
        return rows.loc[taken + rest]

    columns = list(pool.columns)
    return pool.groupBy(F.lit("all")).applyInPandas(lambda p: pick(p[columns]), pool.schema)


def diverse(candidates: DataFrame, n: int) -> DataFrame:
    """(chunk, sentence, place): greedy cover - each time the sentence with most new hard terms, then the
    densest, one per chunk.  ``candidates`` has chunk, sentence, terms, words; a test set's worth of rows."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["chunk", "sentence"]).reset_index(drop=True)
        covered, chunks, out = set(), set(), []
        while len(out) < n:
            best = None
            for r in rows.itertuples():
                if r.chunk in chunks:
                    continue
                new = len(set(r.terms) - covered)
                score = (new, len(r.terms) / max(1, r.words))
                if new and (best is None or score > best[0]):
                    best = (score, r)
            if best is None:
                break
            r = best[1]
            covered |= set(r.terms)
            chunks.add(r.chunk)
            out.append((r.chunk, r.sentence, len(out) + 1))
        return pd.DataFrame(out, columns=["chunk", "sentence", "place"])

    return candidates.groupBy(F.lit("all")).applyInPandas(lambda p: pick(p), "chunk long, sentence string, place int")

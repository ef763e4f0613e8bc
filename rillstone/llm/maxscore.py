"""Exact top-k inner products by MaxScore over sharded inverted lists.

A vector's terms are its signed dimensions: (j, +) holds the rows whose component j is positive, (j, -)
the negative ones, and a query meets the list of its own sign.  In each shard a term's score bound is the
query's weight times the largest weight in the list.  Terms are split by these bounds: as long as the
bounds of the weakest terms sum to less than the k-th best score so far, they are non-essential, and no
row outside the lists of the others can enter the result.  Essential lists are traversed; the rows found
there probe the remaining terms only while partial score plus open bounds can still compete.  Survivors
are scored exactly, and the shards' results are merged by rank.

Components are turned into integers, floor(scale * x), and scores are exact integers.

Cases: vectors that are null or hold null, NaN or infinite components take no part on either side;
shorter vectors count as padded with zeros; equal rows count once; rows with the query's id are its own
and never candidates; equal scores rank by the smaller id; a null id takes no part; an empty table gives
an empty result; scores outside 64 bits are cut to the nearest long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

K, SCALE = 5, 256
SHARD_ROWS, QUERY_ROWS = 4096, 2048
SAFE = 1 << 62


def _integers(vectors: pd.Series, width: int, scale: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.float64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    out = np.floor(out * scale)
    if np.abs(out).max(initial=0) ** 2 * width < SAFE:
        return out.astype(np.int64)
    return np.array([[int(x) for x in row] for row in out], dtype=object).reshape(out.shape)


class Shard:
    """Inverted lists of signed dimensions over at most SHARD_ROWS vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.columns = np.ascontiguousarray(vectors.T)
        self.lists = [(np.flatnonzero(c > 0), np.flatnonzero(c < 0)) for c in self.columns]
        self.bounds = np.stack([np.maximum(vectors.max(axis=0), 0), np.maximum(-vectors.min(axis=0), 0)])

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        others = np.flatnonzero(self.ids != query_id)
        if not len(others):
            return self.ids[:0], np.zeros(0, self.vectors.dtype)
        seeds = others[:: max(1, len(others) // 64)]
        theta = np.sort(self.vectors[seeds] @ query)[-k] if len(seeds) >= k else None
        negative = (query < 0).astype(int)
        weight = np.abs(query)
        bound = weight * self.bounds[negative, np.arange(len(query))]
        order = np.argsort(bound, kind="stable")
        below = np.cumsum(bound[order])
        first = int(np.searchsorted(below, theta, side="left")) if theta is not None and theta > 0 else 0
        essential, rest = order[first:][::-1], order[:first][::-1]
        if first:
            partial = np.zeros(len(self.ids), self.vectors.dtype)
            seen = np.zeros(len(self.ids), bool)
            for j in essential:
                at = self.lists[j][negative[j]]
                partial[at] += self.columns[j][at] * query[j]
                seen[at] = True
            rows = np.flatnonzero(seen & (partial + below[first - 1] >= theta))
            partial, open_ = partial[rows], below[first - 1]
            for j in rest:
                if len(rows) <= 4 * k:
                    break
                open_ = open_ - bound[j]
                partial = partial + np.maximum(self.columns[j][rows] * query[j], 0)
                alive = partial + open_ >= theta
                rows, partial = rows[alive], partial[alive]
            rows = rows[self.ids[rows] != query_id]
        else:
            rows = others
        scores = self.vectors[rows] @ query
        top = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[top]], scores[top]


def finite(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part."""
    ok = F.col(vector_col).isNotNull() & F.forall(
        vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(ok, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")
    )


def top_k(
    queries: DataFrame, rows: DataFrame, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score).  Rows are dealt into shards and queries into blocks of bounded
    size; each pair of a block and a shard is one group."""
    rows, queries = finite(rows, id_col, vector_col), finite(queries, id_col, vector_col)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("w")).first()
    asked = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("w")).first()
    shards = max(1, -(-size["n"] // SHARD_ROWS))
    blocks = max(1, -(-asked["n"] // QUERY_ROWS))
    width = max(1, size["w"] or 0, asked["w"] or 0)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    stored = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("block", spread(blocks))
    asking = queries.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", spread(shards))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            both = _integers(pd.concat([left["vector"], right["vector"]]), width, scale)
            mine, theirs = both[: len(left)], both[len(left) :]
            ids = left["id"].to_numpy()
            first: dict[tuple, int] = {}
            for at, key in enumerate(zip(ids.tolist(), map(tuple, mine.tolist()))):
                first.setdefault(key, at)
            distinct = np.fromiter(first.values(), np.int64, len(first))
            shard = Shard(ids[distinct], mine[distinct])
            for query_id, query in zip(right["id"].to_numpy(), theirs):
                got, scores = shard.search(int(query_id), query, k)
                found += [(int(query_id), int(i), int(min(max(s, -(1 << 63)), (1 << 63) - 1))) for i, s in zip(got, scores)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("query_id", "vec_id", "score")])
    partial = stored.groupBy("block", "shard").cogroup(asking.groupBy("block", "shard")).applyInPandas(search, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        partial.distinct()
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )

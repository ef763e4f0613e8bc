"""Near copies by the Jaccard similarity of word shingles: SimHash first, an exact filter for what it leaves.

A text is the set of its SHINGLE-word shingles, hashed to 64 bits.  Its SimHash is looked up in the index of
``simhash``: pairs that differ in few bits are compared exactly, set with set, and linked if they are similar.
Similar sets may differ in more bits than an index can guarantee to find, so pairs in different components go
through a prefix filter besides.

Two sets of a Jaccard similarity of
SIMILAR at least share at least SIMILAR of the elements of either, so under any fixed order of all
elements they meet among the first ``n - ceil(SIMILAR * n) + 1`` of each: these are the index.  No pair is
missed, whatever the order; the order puts elements last that are frequent in a sample of the texts, so
that posting lists are short.  Two sets share at most what they share among these and the rest of one
of them; pairs for which that is enough are compared exactly as well.

Texts with the same set are one entry throughout.  Members of long posting lists are compared with
hubs of their list together with SimHash's pairs; then all pairs that meet and lie in different components are
counted, so a group of n near copies costs about n comparisons.

Cases: null and empty texts and texts without words have no shingles and are copies of each other; a
text of fewer words than a shingle is one shingle; null and repeated ids as in ``simhash``; an empty
table gives an empty result.  Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.broadcasts import small_side
from ..plans.scratch import settle, short_batches
from .components import components
from .simhash import SEED, links, majority, one_of_each

SHINGLE = 5
UP, DOWN = 4, 5  # SIMILAR = UP / DOWN = 0.8, in whole numbers
#: One text in SAMPLE is looked at for frequent shingles: those in at least OFTEN of them, the most frequent ones first.
SAMPLE, OFTEN, MOST = 16, 3, 200_000
LONG = 16  # posting lists of more are compared with hubs first
BATCH = 200  # pairs, each with two sets, that are handed to Python at once


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The set of hashed shingles, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64).view(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: len(words) - shingle + 1].tolist()
    found = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, len(starts))
    return np.unique(found.view(np.int64))


def similar(a: int, b: int, shared: int) -> bool:
    """Whether sets of ``a`` and ``b`` elements, ``shared`` in common, are near copies."""
    return shared * (UP + DOWN) >= UP * (a + b)


def _key(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63) if len(found) else 0


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("version"), F.col(text_col).cast("string").alias("text"))


def _frequent(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, ranks): the most frequent ones of a sample in order of their hashes, ranks by frequency."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py(), shingle))], ["hash"])

    sample = rows.where(F.pmod(F.xxhash64("doc_id", "version"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "hash long")
    counts = sample.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    top = counts.orderBy(F.desc("n"), "hash").limit(MOST).toPandas()
    hashes, n = top["hash"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return hashes[order], n[order]


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, version, key, n, fp, first): each text's set by its hash, its size, its SimHash, and its elements
    in the index."""
    hashes, ranks = _frequent(rows, shingle)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            keys, sizes, prints, firsts = [], [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py(), shingle)
                n = len(found)
                keys.append(_key(found))
                sizes.append(n)
                prints.append(majority([found.view(np.uint64)]))
                rank = np.zeros(n, np.int64)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
                    rank = np.where(hashes[at] == found, ranks[at], 0)
                count = n - (UP * n + DOWN - 1) // DOWN + 1 if n else 0
                firsts.append(found[np.argsort(rank, kind="stable")[:count]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()),
                 pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(firsts, pa.list_(pa.int64()))],
                ["doc_id", "version", "key", "n", "fp", "first"],
            )

    return rows.mapInArrow(run, "doc_id long, version long, key long, n int, fp long, first array<long>")


def _alike(sets: DataFrame) -> DataFrame:
    """(u, v): pairs that connect the sets whose SimHashes differ in few bits, those of equal ones included."""
    keys = sets.select("key", "fp").distinct()
    least = keys.groupBy("fp").agg(F.min("key").alias("rep"))
    near = links(least.select("fp")).join(least.toDF("u", "a"), "u").join(least.toDF("v", "b"), "v").select("a", "b")
    equal = keys.join(least, "fp").where("key <> rep").select(F.col("rep").alias("a"), F.col("key").alias("b"))
    return near.union(equal).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def _pairs(index: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(u, v): pairs that may be similar by their sizes and by how often they meet: of long lists, those
    with a hub; or with ``roots`` all whose members lie in different components."""
    whole = roots is not None
    if whole:
        index = index.join(roots.select(F.col("node").alias("key"), "root"), "key", "left")
    root = F.coalesce("root", "key") if whole else F.col("key")
    lists = index.groupBy("hash").agg(F.collect_list(F.struct("key", "n", root.alias("root"))).alias("of")).where(F.size("of") > (1 if whole else LONG))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            us, vs, needs = [], [], []
            for of in batch.column(0):
                key, n, root = (of.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                order = np.lexsort((key, n))
                key, n, root = key[order], n[order].astype(np.int64), root[order]
                hub = 0
                for i in range(len(key) - 1):
                    if not whole and i and UP * n[i] <= DOWN * n[hub]:
                        continue
                    hub = i
                    j = np.arange(i + 1, np.searchsorted(n, DOWN * n[i] // UP, "right"))
                    j = j[root[j] != root[i]]
                    us.append(np.minimum(key[i], key[j]))
                    vs.append(np.maximum(key[i], key[j]))
                    # similar sets share so many; all but these many may be among the rest of the larger one
                    needs.append(-(-UP * (n[i] + n[j]) // (UP + DOWN)) - (UP * n[j] + DOWN - 1) // DOWN + 1)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs, needs)], ["u", "v", "need"])

    met = lists.select("of").mapInArrow(run, "u long, v long, need long")
    return met.groupBy("u", "v").agg(F.count(F.lit(1)).alias("c"), F.min("need").alias("need")).where("c >= need").select("u", "v")


def _linked(pairs: DataFrame, rows: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """The ``pairs`` whose sets are similar; only their texts are read again."""
    pairs = settle(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct().join(classes, "key").select("key", "version")

    def again(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            found = [shingles(t.as_py(), shingle).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["key", "set"])

    texts = rows.join(small_side(wanted), "version").select("key", "text")
    with short_batches(pairs.sparkSession, BATCH):
        sets = settle(texts.mapInArrow(again, "key long, set binary").dropDuplicates(["key"]), "sets")

    def compare(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(a.as_py(), np.int64), np.frombuffer(b.as_py(), np.int64)
                keep.append(similar(len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v").select("u", "v", "a", "b")
    with short_batches(pairs.sparkSession, BATCH):
        return settle(both.mapInArrow(compare, "u long, v long"), "similar")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, version, component_id, root) for every row of ``docs``: components of near copies, with the
    least id in each; ``root`` is the component's name where ids repeat."""
    rows = _rows(docs, id_col, text_col)
    with short_batches(docs.sparkSession, BATCH):
        sets = settle(_sets(rows, shingle), "shingle-sets")
    classes = sets.groupBy("key").agg(F.min("doc_id").alias("least"), F.min("version").alias("version"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    alike = settle(_alike(sets), "alike")
    firsts = sets.select("key", "n", "first").dropDuplicates(["key"]).repartition(parts, F.xxhash64("key"))
    index = firsts.select("key", "n", F.explode("first").alias("hash"))
    # most elements are in one text: only lists are kept
    lists = index.groupBy("hash").agg(F.collect_list(F.struct("key", "n")).alias("of")).where(F.size("of") > 1)
    index = settle(lists.select("hash", F.explode("of").alias("x")).select("hash", "x.*"), "index")
    near = _linked(alike.union(_pairs(index)).distinct(), rows, classes, shingle)
    rest = _linked(_pairs(index, components(near)), rows, classes, shingle)
    roots = components(near.union(rest))
    rooted = classes.join(roots, classes["key"] == roots["node"], "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_key = rooted.join(smallest, "root").select("key", "root", "component_id")
    return sets.select("doc_id", "version", "key").join(by_key, "key").select("doc_id", "version", "component_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component: the smallest id; of rows that share it, one."""
    return one_of_each(docs, near_copies(docs, id_col, text_col, shingle), id_col, text_col)

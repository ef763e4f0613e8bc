"""SimHash near-duplicates over a byte-position inverted index with count filtering.

A fingerprint has 64 bits, seen as 8 positional bytes.  Two fingerprints that differ in at most
``max_bits`` bits differ in at most that many bytes, so they share at least ``8 - max_bits`` = m positional
bytes.  Postings of single bytes hold 1/256 of all rows, and counting their pairs grows with the square of
the input; the index is keyed by m - 1 positional bytes at a time instead (70 keys of 32 bits for 3 bits).
A pair with m bytes in common meets under m of these keys at least.  For the pairs that meet under a key the
shared positional bytes are tallied, pairs below the guaranteed minimum go, and the others are verified by
their differing bits; only links from each component of the list to its smallest member leave the task,
so a group of n near copies sends some n links for each key, not its pairs.

Posting lists of more than ALL_PAIRS fingerprints are linked by looking up the neighbours of each one
rather than by comparing pairs, which is linear.  Equal fingerprints are one entry throughout.

Cases: null and empty texts and texts without words have fingerprint zero and are linked like any
other; a text of fewer words than a shingle is one shingle; repeated rows and repeated ids get the same
component; null ids take no part in the choice of the component's id (null only if all are); an empty
table gives an empty result.  Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import settle, short_batches
from .components import components
from .rows import held

BITS, BYTES, SEED = 64, 8, 42
SHINGLE, MAX_BITS = 3, 3
ALL_PAIRS = 3000  # posting lists up to here are compared pair by pair, in blocks
BLOCK = 1024
HASHES = 400_000  # shingles of one text whose bits are counted at once


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    ends = (ends - 1).tolist()
    digest, n = xxhash.xxh64_intdigest, len(words) - shingle + 1
    pieces = range(0, n, HASHES)
    hashes = lambda at, stop: [digest(joined[a:b], SEED) for a, b in zip(starts[at:stop], ends[at + shingle - 1 : stop + shingle - 1])]
    return majority(np.array(hashes(at, min(n, at + HASHES)), np.uint64) for at in pieces)


def majority(pieces: Iterable[np.ndarray]) -> int:
    """The fingerprint of hashes (64 bits each) that come in pieces: bits that are set in over half of them."""
    counts, n = np.zeros(BITS, np.int64), 0
    for hashes in pieces:
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, version, fp): the fingerprint as a signed long; ``version`` is a hash of the text, which
    keeps rows apart that share an id."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.int64())], ["doc_id", "version", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("version"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, version long, fp long")


def _forest(prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(root, member) indices for every member but the root of each component of ``prints`` (sorted,
    distinct, uint64), where neighbours differ in at most ``max_bits`` bits: as many pairs as a spanning
    forest has, each to the component's smallest fingerprint."""
    n = len(prints)
    root = np.arange(n)

    def join(a: np.ndarray, b: np.ndarray) -> None:
        """Hook and jump until the links a-b lie within components."""
        while True:
            ra, rb = root[a], root[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up

    if n <= ALL_PAIRS:
        for at in range(0, n, BLOCK):
            block = prints[at : at + BLOCK]
            for other in range(at, n, BLOCK):
                differing = block[:, None] ^ prints[None, other : other + BLOCK]
                shared = (differing.view(np.uint8).reshape(*differing.shape, BYTES) == 0).sum(axis=2)
                a, b = np.nonzero(shared >= BYTES - max_bits)
                near = np.bitwise_count(differing[a, b]) <= max_bits
                join(a[near] + at, b[near] + other)
    else:
        used = int(np.bitwise_or.reduce(prints ^ prints[0]))
        bits = [1 << k for k in range(BITS) if used >> k & 1]
        for count in range(1, max_bits + 1):
            for flips in combinations(bits, count):
                near = prints ^ np.uint64(sum(flips))
                at = np.minimum(np.searchsorted(prints, near), n - 1)
                a = np.flatnonzero(prints[at] == near)
                if len(a):
                    join(a, at[a])
    child = np.flatnonzero(root != np.arange(n))
    return root[child], child


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v): links between different fingerprints (column ``fp``, distinct) that connect all that
    differ in at most ``max_bits`` bits."""
    shared = BYTES - max_bits
    width = max(1, shared - 1)
    masks = [sum(0xFF << 8 * k for k in kept) for kept in combinations(range(BYTES), width)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    posting = F.explode(F.array(*[F.struct(F.lit(k).cast("tinyint").alias("at"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)]))
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # each row becomes one per mask: spread them before, the planner only sees how small they are now (by a
    # hash of the print: it would drop a repartition by the key that the rows are grouped by already)
    index = prints.repartition(parts, F.xxhash64("fp")).select("fp", posting.alias("p")).select("fp", "p.at", "p.key")
    lists = index.groupBy("at", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def verify(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            us, vs = [], []
            for fps in batch.column(0):
                fp = np.sort(np.array(fps.values, np.int64).view(np.uint64))
                if len(fp) == 2:
                    differing = int(fp[0] ^ fp[1])
                    shared = sum(not differing >> 8 * k & 0xFF for k in range(BYTES))
                    if shared >= BYTES - max_bits and differing.bit_count() <= max_bits:
                        us.append(fp[:1])
                        vs.append(fp[1:])
                    continue
                a, b = _forest(fp, max_bits)
                us.append(fp[a])
                vs.append(fp[b])
            if us:
                u, v = (np.concatenate(x).view(np.int64) for x in (us, vs))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return lists.select("fps").mapInArrow(verify, "u long, v long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """(doc_id, version, fp, component_id, root) for every row of ``docs``; ``root`` is the component's least
    fingerprint, its name where ids repeat."""
    with short_batches(docs.sparkSession):
        prints = settle(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(classes.select("fp"), max_bits))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(smallest, "root").select(F.col("fp").alias("class_fp"), "root", "component_id")
    return prints.join(by_fp, F.col("fp") == F.col("class_fp")).select("doc_id", "version", "fp", "component_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group: the smallest id; of rows that share it, one."""
    return one_of_each(docs, near_duplicates(docs, id_col, text_col, shingle, max_bits), id_col, text_col)


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row of each group in ``found`` (doc_id, version, component_id, root)."""
    first = (
        found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root", "doc_id").agg(F.min("version").alias("first_version")).select(F.col("doc_id").alias("first_doc"), "first_version").distinct()
    )
    rows = held(docs, id_col, text_col).withColumn("doc", F.col("doc").cast("long"))
    kept = rows.join(first, F.col("doc").eqNullSafe(F.col("first_doc")) & (F.col("version") == F.col("first_version")), "left_semi")
    return kept.dropDuplicates(["doc", "version"]).select("row.*")


def hex_print(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

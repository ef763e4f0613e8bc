"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

The model works on characters, order 5, every n-gram one 60-bit number: code points below 2048 (Latin, Greek,
Cyrillic, Hebrew, Arabic and what lies between) stand for themselves, case and accents included, and the
others are hashed to as many further classes, so no script is folded into another and the table of n-grams
grows with the text.  Trusted texts are those labelled good; four fifths of them (by a hash of the id) are
counted, all of them, the rest calibrate.  The counts are sharded by n-gram: each block of documents
sends its distinct n-grams, packed by shard, where they are summed up; the n-grams meet the counts of all
orders in joins keyed by n-gram and context, and the resulting log probabilities go back, packed again, to
the block that asked.  A document's score is
its perplexity per character, drawn to the language's median as if the text were PRIOR_CHARS longer, so
that a few words do not count as evidence.  A language's threshold is a quantile of the scores of its
calibration texts, times MARGIN; documents above it go.  Quantiles of a language with few calibration texts
are drawn to those of all of them, as if PRIOR_TEXTS texts more had the latter.

Cases: null and empty texts have no characters, perplexity null, and are rejected (``keep`` false);
a null language, and one without calibration texts, takes the threshold of all calibration texts; if
there are none, all documents with characters are kept; an id with contradicting labels is not trusted;
null ids are never trusted; rows are scored one by one, repeated or not, also where they share an id; empty
tables give empty results.  Only id, text and language are read; the stage returns the documents' own
columns whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import settle
from .blocks import pack, unpack
from .rows import without

ORDER, WIDTH = 5, 12  # bits per class
CLASSES = 1 << WIDTH
EXACT = CLASSES // 2  # code points below stand for themselves
QUANTILE = 0.995
MARGIN = 1.1  # a document is rejected above threshold = quantile * MARGIN
CALIBRATION = 5  # one of so many trusted texts calibrates
PRIOR_TEXTS = 30
PIECE = 1 << 20  # characters whose n-grams are held at once
BLOCK_BYTES = 32 << 20  # two bytes a character
PRIOR_CHARS = 40  # a short text's perplexity is drawn to the median as if it had so many characters more


def fold(text: str) -> bytes:
    """Two bytes per character: its class (0 stands for the ends of a text)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    far = np.uint64(EXACT) + (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - WIDTH))
    return np.where(codes < EXACT, np.maximum(codes, np.uint64(1)), far).astype(np.uint16).tobytes()


def grams(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram at each character and at each end, document of each): texts padded with ORDER - 1 ends
    in front and one behind."""
    lengths = np.asarray(lengths, np.int64)
    pad = ORDER - 1
    out = np.zeros(int(lengths.sum()) + (pad + 1) * len(lengths), np.int64)
    starts = np.cumsum(lengths + pad + 1) - (lengths + pad + 1) + pad
    out[np.arange(len(codes)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)] = codes
    packed = out.copy()
    for back in range(1, ORDER):
        packed[back:] |= out[:-back] << np.int64(WIDTH * back)
    whole = np.repeat(np.arange(len(lengths)), lengths + pad + 1)
    inside = np.ones(len(out), bool)
    for k in range(pad):
        inside[starts - pad + k] = False
    return packed[inside], whole[inside]


def pieces(blob: bytes, lengths: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, its end, n-grams, document of each) for some PIECE characters at a time; ``lengths``
    in characters."""
    lengths = np.asarray(lengths, np.int64)
    codes, at, low = unpack(blob, 2 * lengths, 2).view(np.uint16), 0, 0
    ends = np.cumsum(lengths)
    while low < len(lengths):
        high = max(low + 1, int(np.searchsorted(ends, at + PIECE, side="right")))
        code, doc = grams(codes[at : int(ends[high - 1])], lengths[low:high])
        yield low, high, code, doc
        at, low = int(ends[high - 1]), high


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, their sums)."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first) if len(first) else n


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id) labelled good and never bad."""
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select(F.col("doc_id").cast("long").alias("doc_id"))


SHARD_BYTES = 32 << 20  # of texts for each shard of n-grams
ODD = 0x9E3779B97F4A7C15


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    return ((codes.astype(np.uint64) * np.uint64(ODD)) >> np.uint64(33)).astype(np.int64) % shards


def dealt(here: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, shard): a block's distinct n-grams by shard, within a shard as they were, and the shards in that order."""
    shard = shard_of(here, shards)
    order = np.argsort(shard, kind="stable")
    return order, shard[order]


def packed(numbers: np.ndarray) -> bytes:
    """Numbers compressed with their byte planes apart."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T).tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def block_counts(blocks: DataFrame, trusted: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """(shard, block, k, grams, counts) for the distinct n-grams of each block, counting those in training
    texts; and (block, idx) of the calibration texts."""
    index = blocks.select("block", F.posexplode("ids").alias("idx", "doc_id")).join(trusted, "doc_id")
    index = settle(index.select("block", "idx", (F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION)) == 0).alias("calibrates")), "trusted")
    train = index.where("NOT calibrates").groupBy("block").agg(F.collect_list("idx").alias("train"))
    names = ["shard", "block", "k", "grams", "counts"]

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for block, lengths, blob, train in zip(*[c.to_pylist() for c in batch.columns]):
                lengths = np.array(lengths, np.int64) // 2
                flag = np.zeros(len(lengths), bool)
                flag[train or []] = True
                keys, counts = [], []
                for low, high, code, doc in pieces(blob, lengths):
                    every = np.unique(code)
                    trained, n = np.unique(code[flag[low:high][doc]], return_counts=True)
                    keys += [every, trained]
                    counts += [np.zeros(len(every), np.int64), n]
                here, n = summed(keys, counts)
                order, shard = dealt(here, shards)
                here, n = here[order], n[order]
                cuts = np.flatnonzero(np.concatenate([[True], np.diff(shard) > 0, [True]])).tolist()
                rows = [(int(shard[a]), block, b - a, packed(np.diff(here[a:b], prepend=0)), packed(n[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names)

    joined = blocks.select("block", "lengths", "blob").join(train, "block", "left")
    counted = joined.select("block", "lengths", "blob", "train").mapInArrow(count, "shard int, block long, k int, grams binary, counts binary")
    return settle(counted, "grams"), index.where("calibrates").select("block", "idx")


def _codes(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.cumsum(unpacked(g, k, np.int64)) for g, k in zip(rows["grams"], rows["k"])]


def shard_counts(counted: DataFrame) -> DataFrame:
    """(shard, gram, n): the blocks' n-grams summed up, shard by shard."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        key, n = summed(_codes(rows), [unpacked(c, k, np.int64) for c, k in zip(rows["counts"], rows["k"])])
        return pd.DataFrame({"shard": np.full(len(key), rows["shard"].iloc[0], np.int32), "gram": key, "n": n})

    return settle(counted.groupBy("shard").applyInPandas(add, "shard int, gram long, n long"), "counts")


def answered(counted: DataFrame, known: DataFrame) -> DataFrame:
    """(block, shard, k, logp): the log probabilities of what each block asked for, in its order."""

    def look(asked: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        out = {"block": asked["block"], "shard": asked["shard"], "k": asked["k"]}
        if not len(asked):
            return pd.DataFrame(out | {"logp": []})
        model = model.sort_values("gram")
        gram, logp = model["gram"].to_numpy(np.int64), model["logp"].to_numpy(np.float32)
        return pd.DataFrame(out | {"logp": [packed(logp[np.searchsorted(gram, c)]) for c in _codes(asked)]})

    asked = counted.select("shard", "block", "k", "grams")
    return asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(look, "block long, shard int, k int, logp binary")


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of an order for counts 1, 2 and more, from four counts of counts."""
    row = counts.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first()
    y = row[0] / (row[0] + 2 * row[1]) if row[0] else 0.0
    return tuple(min(float(k), max(0.0, k - (k + 1) * y * row[k] / row[k - 1])) if row[k - 1] else 0.5 * k for k in (1, 2, 3))


def log_probabilities(asked: DataFrame) -> DataFrame:
    """(shard, gram, logp) of every n-gram (shard, gram, n) that occurs in any block: joins of the asked n-grams
    with the counts of each order, sharded by n-gram and by context.  The counts of an order are written once."""
    tail = lambda g, order: F.col(g).bitwiseAND(F.lit((1 << WIDTH * order) - 1))
    levels = [asked.where("n > 0").select(F.col("gram").alias("g"), "n")]
    for order in range(ORDER - 1, 0, -1):  # continuation counts: in how many different contexts, one character longer
        shorter = levels[-1].groupBy(tail("g", order).alias("g")).agg(F.count(F.lit(1)).alias("n"))
        levels.append(settle(shorter, f"counts{order}"))
    out = asked.select("shard", "gram").withColumn("p", F.lit(1.0 / CLASSES))
    for order, level in zip(range(1, ORDER + 1), reversed(levels)):
        d1, d2, d3 = discounts(level)
        level = level.withColumn("cut", F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3))
        contexts = level.groupBy(F.shiftright("g", WIDTH).alias("c")).agg(F.sum("n").alias("total"), F.sum("cut").alias("freed"))
        counts = level.select("g", (F.col("n") - F.col("cut")).alias("kept"))
        out = (
            out.withColumn("_g", tail("gram", order))
            .join(counts, F.col("_g") == F.col("g"), "left")
            .drop("g")
            .join(contexts, F.shiftright("_g", WIDTH) == F.col("c"), "left")
            .select(
                "shard", "gram",
                F.when(F.col("total").isNull(), F.col("p"))
                .otherwise((F.coalesce("kept", F.lit(0.0)) + F.col("freed") * F.col("p")) / F.col("total"))
                .alias("p"),
            )
        )
    return out.select("shard", "gram", F.log(F.greatest("p", F.lit(1e-12))).cast("float").alias("logp"))


def perplexities(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, version, lang, n_chars, perplexity, calibrates) for every row."""
    blocks = pack(docs, fold, id_col, text_col, lang_col, BLOCK_BYTES, width=2, level=6)
    total = blocks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    shards = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    counted, calibration = block_counts(blocks, trusted_ids(labels), shards)
    known = settle(log_probabilities(shard_counts(counted)), "logp")
    answers = answered(counted, known).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "k", "logp"))).alias("known"))
    held = calibration.groupBy("block").agg(F.collect_list("idx").alias("held"))
    asked = blocks.join(answers.join(held, "block", "left"), "block", "left")

    def score(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for k in range(batch.num_rows):
                ids, versions, tags, lengths, blob, answers_, held = (batch.column(c)[k] for c in range(7))
                lengths = np.array(lengths.values, np.int64) // 2
                total = np.zeros(len(lengths))
                if answers_.is_valid:
                    blob = blob.as_py()
                    known = np.unique(np.concatenate([np.unique(code) for _, _, code, _ in pieces(blob, lengths)]))
                    order, _ = dealt(known, shards)
                    value = np.empty(len(known))
                    value[order] = np.concatenate([unpacked(x["logp"], x["k"], np.float32) for x in answers_.as_py()])
                    for low, high, code, doc in pieces(blob, lengths):
                        total[low:high] = np.bincount(doc, weights=value[np.searchsorted(known, code)], minlength=high - low)
                flag = np.zeros(len(lengths), bool)
                flag[held.as_py() or []] = True
                ppl = np.exp(-total / (lengths + 1))
                yield pa.RecordBatch.from_arrays(
                    [ids.values, versions.values, tags.values, pa.array(lengths), pa.array(ppl, mask=lengths == 0), pa.array(flag)],
                    ["doc_id", "version", "lang", "n_chars", "perplexity", "calibrates"],
                )

    scored = asked.select("ids", "versions", "tags", "lengths", "blob", "known", "held").mapInArrow(
        score, "doc_id long, version long, lang string, n_chars long, perplexity double, calibrates boolean"
    )
    return settle(scored, "perplexities")


def classify(
    docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """(doc_id, version, lang, n_chars, perplexity, score, threshold, keep) for every row."""
    scored = perplexities(docs, labels, id_col, text_col, lang_col)
    group = F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("n"))
    at = lambda c, q: F.percentile_approx(c, q, 10_000)

    def per_language(frame: DataFrame, column: str, q: float) -> DataFrame:
        """``frame`` with ``cut``: the quantile among the calibration texts of the row's language, drawn to that
        of all of them where they are few."""
        held = frame.where("calibrates AND perplexity IS NOT NULL")
        overall = held.agg(at(column, q).alias("overall"))
        own = held.where("lang IS NOT NULL").groupBy(group.alias("_l")).agg(at(column, q).alias("own"), F.count(F.lit(1)).alias("n"))
        joined = frame.withColumn("_g", group).join(own, F.col("_g") == F.col("_l"), "left").crossJoin(F.broadcast(overall))
        cut = F.exp((F.col("n") * F.log("own") + PRIOR_TEXTS * F.log("overall")) / (F.col("n") + PRIOR_TEXTS))
        return joined.withColumn("cut", F.coalesce(cut, "overall")).drop("own", "overall", "n", "_l", "_g")

    length = F.col("n_chars") + 1
    drawn = F.exp((F.log("perplexity") * length + PRIOR_CHARS * F.log("cut")) / (length + PRIOR_CHARS))
    scored = per_language(scored, "perplexity", 0.5).withColumn("score", F.coalesce(drawn, F.col("perplexity"))).drop("cut")
    judged = per_language(scored, "score", quantile).withColumn("threshold", F.col("cut") * margin)
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True))
    return judged.select("doc_id", "version", "lang", "n_chars", "perplexity", "score", "threshold", keep.alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, columns unchanged."""
    return without(docs, classify(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col).where("NOT keep"), id_col, text_col)

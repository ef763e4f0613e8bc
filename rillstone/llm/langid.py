"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector, seeded by its code point.  A trigram's vector binds the
letters' vectors, the first rotated twice and the second once; a text's vector is the sum (bundle) of
its trigrams' vectors, and a language's prototype the sum over its training texts.  A text gets the
language whose prototype has the largest cosine with it.

Texts are lower-cased; whatever is no letter counts as one space, and a space stands at either end.
Prototypes are whole-number sums, so they do not depend on partitions.  Texts are never shuffled: a
task sends one sum per language, and scoring is a narrow pass per block of languages.

Cases: a null text and one without letters get ``und`` and score 0; languages tie to the smaller name;
null languages take no part in training; without any training text all rows get ``und``; repeated rows
are scored one by one; null ids are never held out.  Only id, text and language are read, so other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import settle

DIMENSIONS = 1024
SEED = 11
BATCH_DOCS = 256
BATCH_CHARS = 1_000_000
COLUMNS = 8192  # trigrams multiplied at once
LANGUAGES = 4000  # prototypes that one pass carries: 16 MB
UND = "und"

_is_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _is_letter
    if _is_letter is None:
        _is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _is_letter


class Space:
    """Letter vectors and the bundling of texts."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.ids = np.full(0x110000, -1, np.int32)
        self.size = 0
        self.rolled = [np.zeros((0, dimensions), np.int8) for _ in range(3)]

    def _vector(self, code: int) -> np.ndarray:
        bits = np.random.Generator(np.random.Philox(key=[self.seed, code])).integers(0, 2, self.dimensions, np.int8)
        return (2 * bits - 1).astype(np.int8)

    def _learn(self, codes: np.ndarray) -> None:
        """Give every new code point an id and a vector; the vector depends on the code point alone."""
        new = np.unique(codes[self.ids[codes] < 0])
        if len(new):
            self.ids[new] = np.arange(self.size, self.size + len(new), dtype=np.int32)
            fresh = np.stack([self._vector(int(c)) for c in new])
            self.rolled = [np.concatenate([old, np.roll(fresh, turn, axis=1)]) for turn, old in zip((2, 1, 0), self.rolled)]
            self.size += len(new)

    def trigrams(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, index into present, present trigram codes) of the texts; letters only count."""
        chunks, lengths = [], []
        for text in texts:
            codes = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "replace"), np.uint32)
            codes = np.where(_letters()[codes], codes, 32)
            space = codes == 32
            keep = np.ones(len(codes), bool)
            keep[1:] = ~(space[1:] & space[:-1])
            codes = codes[keep]
            if len(codes) < 3:
                codes = codes[:0]
            chunks.append(codes)
            lengths.append(len(codes))
        codes = np.concatenate(chunks) if chunks else np.zeros(0, np.uint32)
        if not len(codes):
            none = np.zeros(0, np.int64)
            return none, none, none
        self._learn(codes)
        doc = np.repeat(np.arange(len(texts)), lengths)
        letter = self.ids[codes].astype(np.int64)
        n = self.size
        code = (letter[:-2] * n + letter[1:-1]) * n + letter[2:]
        inside = doc[:-2] == doc[2:]
        code, doc = code[inside], doc[:-2][inside]
        if n <= 128:
            present = np.flatnonzero(np.bincount(code, minlength=n**3))
            slot = np.zeros(n**3, np.int64)
            slot[present] = np.arange(len(present))
            return doc, slot[code], present
        present, index = np.unique(code, return_inverse=True)
        return doc, index, present

    def bundle(self, row: np.ndarray, index: np.ndarray, present: np.ndarray, rows: int) -> np.ndarray:
        """(rows, dimensions): sum of the trigram vectors of each row, COLUMNS trigrams at a time."""
        out = np.zeros((rows, self.dimensions), np.float64)
        n = self.size
        for start in range(0, len(present), COLUMNS):
            part = present[start : start + COLUMNS]
            vectors = self.rolled[0][part // (n * n)] * self.rolled[1][part // n % n] * self.rolled[2][part % n]
            if len(present) > COLUMNS:
                here = (index >= start) & (index < start + len(part))
                r, i = row[here], index[here] - start
            else:
                r, i = row, index
            counts = np.bincount(r * len(part) + i, minlength=rows * len(part)).reshape(rows, len(part))
            out += counts.astype(np.float32) @ vectors.astype(np.float32)
        return out


def batches(stream: Iterator[pa.RecordBatch], docs: int = BATCH_DOCS, chars: int = BATCH_CHARS) -> Iterator[list[tuple]]:
    """Rows as tuples, text second, in lists of bounded length."""
    held, size = [], 0
    for batch in stream:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            held.append(row)
            size += len(row[1] or "")
            if len(held) >= docs or size >= chars:
                yield held
                held, size = [], 0
    if held:
        yield held


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def prototypes(training: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, bundle): one vector per language, added up by the executors and written as a table."""

    def add_up(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(), {}
        for rows in batches(stream):
            names = sorted({r[0] for r in rows})
            doc, index, present = space.trigrams([r[1] for r in rows])
            row = np.array([names.index(r[0]) for r in rows], np.int64)[doc]
            for name, vector in zip(names, space.bundle(row, index, present, len(names))):
                sums[name] = sums.get(name, 0) + np.rint(vector).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "bundle"]
            )

    parts = training.where(F.col(lang_col).isNotNull()).select(lang_col, text_col).mapInArrow(add_up, "lang string, bundle array<long>")
    total = (
        parts.select("lang", F.posexplode("bundle").alias("at", "x"))
        .groupBy("lang", "at")
        .agg(F.sum("x").alias("x"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("xs"))
        .select("lang", F.transform("xs", lambda s: s["x"]).alias("bundle"))
    )
    return settle(total.where(F.exists("bundle", lambda x: x != 0)), "prototypes")


def predict(docs: DataFrame, protos: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row.  The driver holds the prototypes of about
    LANGUAGES languages at once; beyond them a further narrow pass, whose rows are written, compares the best
    so far with the next block."""
    blocks = max(1, -(-protos.count() // LANGUAGES))
    mine = F.pmod(F.xxhash64("lang"), F.lit(blocks))
    out = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"),
        F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"),
    )
    for k in range(blocks):
        known = {r["lang"]: np.array(r["bundle"], np.float64) for r in protos.where(mine == k).toLocalIterator()}
        if not known:
            continue
        part = sorted(known)
        matrix = np.stack([known[n] for n in part])
        matrix = (matrix / np.linalg.norm(matrix, axis=1, keepdims=True)).T.copy()

        def best(stream: Iterator[pa.RecordBatch], part=part, matrix=matrix) -> Iterator[pa.RecordBatch]:
            space = Space()
            for rows in batches(stream):
                doc, index, present = space.trigrams([r[1] for r in rows])
                vectors = space.bundle(doc, index, present, len(rows))
                lettered = np.bincount(doc, minlength=len(rows)) > 0
                norm = np.linalg.norm(vectors, axis=1)
                cosine = (vectors @ matrix) / np.where(norm > 0, norm, 1)[:, None]
                at = cosine.argmax(axis=1)
                picked = []
                for r, k, c, ok in zip(rows, at, cosine[np.arange(len(rows)), at], lettered):
                    better = ok and (r[3] == UND or c > r[4] or (c == r[4] and part[k] < r[3]))
                    picked.append((part[k], float(c)) if better else (r[3], r[4]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
                        pa.array([r[2] for r in rows], pa.bool_()), pa.array([p[0] for p in picked], pa.string()),
                        pa.array([p[1] for p in picked], pa.float64()),
                    ],
                    ["doc_id", "text", "held_out", "lang_pred", "score"],
                )

        out = out.mapInArrow(best, "doc_id long, text string, held_out boolean, lang_pred string, score double")
        if k < blocks - 1:
            out = settle(out, "languages")
    return out.select("doc_id", "held_out", "lang_pred", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out and predict all rows."""
    return predict(docs, prototypes(docs.where(~held_out(id_col)), text_col, lang_col), id_col, text_col)

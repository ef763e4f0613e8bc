"""Documents packed into blocks: one row holds some megabytes of encoded texts.

Operators that visit the texts several times in Python pack them once, without a shuffle, into a table
in the shared folder and join what they need per block instead of per document.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import settle_bucketed, short_batches

BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
SCHEMA = "block long, ids array<long>, versions array<long>, tags array<string>, lengths array<int>, blob binary"


def pack(
    docs: DataFrame, encode: Callable[[str], bytes], id_col: str, text_col: str, tag_col: str | None = None, block_bytes: int = BLOCK_BYTES,
    width: int = 1, level: int = 1,
) -> DataFrame:
    """Blocks of about ``block_bytes`` encoded bytes (one long text may be more).  ``versions`` holds the
    hash of each text, so that rows which share an id stay apart; ``tags`` the tag column.  ``encode`` gives
    characters of ``width`` bytes, whose first bytes, second bytes and so on are compressed together.

    Block ids are random: the table is written once and only read from then on.  It is bucketed by block,
    some 16 MB of text to a bucket, so that joins on the block do not move the texts.
    """
    chars = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    buckets = min(50_000, max(8, -(-chars // BUCKET_BYTES)))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("versions", pa.list_(pa.int64())),
             ("tags", pa.list_(pa.string())), ("lengths", pa.list_(pa.int32())), ("blob", pa.binary())]
        )

        def flush() -> pa.RecordBatch:
            row = {"block": int.from_bytes(os.urandom(8), "little", signed=True), "ids": held[0], "versions": held[1], "tags": held[2]}
            planes = np.ascontiguousarray(np.frombuffer(b"".join(held[3]), np.uint8).reshape(-1, width).T)
            row |= {"lengths": [len(x) for x in held[3]], "blob": pa.Codec("zstd", compression_level=level).compress(planes.tobytes(), asbytes=True)}
            return pa.RecordBatch.from_pylist([row], schema)

        held, size = ([], [], [], []), 0
        for batch in stream:
            for doc, version, tag, text in zip(*[c.to_pylist() for c in batch.columns]):
                code = encode(text or "")
                for part, x in zip(held, (doc, version, tag, code)):
                    part.append(x)
                size += len(code) + 64
                if size >= block_bytes:
                    yield flush()
                    held, size = ([], [], [], []), 0
        if held[0]:
            yield flush()

    tag = F.col(tag_col).cast("string") if tag_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col)), tag, F.col(text_col).cast("string"))
    with short_batches(docs.sparkSession):
        return settle_bucketed(rows.toDF("id", "version", "tag", "text").mapInArrow(run, SCHEMA), "blocks", "block", buckets)


def unpack(blob: bytes, lengths: list[int], width: int = 1) -> np.ndarray:
    """The encoded bytes of a block."""
    total = int(np.sum(lengths, dtype=np.int64))
    if not total:
        return np.zeros(0, np.uint8)
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=total, codec="zstd", asbytes=True), np.uint8)
    return planes if width == 1 else np.ascontiguousarray(planes.reshape(width, -1).T).ravel()

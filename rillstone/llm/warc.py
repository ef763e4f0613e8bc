"""WARC archives: writing, reading and revisit resolution.

``decide`` shuffles headers only: for each payload digest the record with the largest page id answers for
the others, which become revisit records.  ``write_archives`` joins that decision to the payloads once and
writes WARC 1.1 files: every record is a gzip member of its own, a warcinfo record stands first, and an
empty member ends the file.  A file is built in one piece of bounded size and handed to Spark's text sink as
one value (whose separator is that empty member), so files appear through Spark's commit, in any file
system.  ``read_archives`` parses files record by record, gzip or plain, ours or others'.  ``resolve``
shuffles revisit headers by the id of the record they refer to and joins them to the original responses;
revisits that name no record, or one that is not there, are joined by payload digest.
``dedupe_archives`` does all of it for archives from elsewhere: responses and revisits are decided anew,
all other records (request, metadata, resource, conversion, warcinfo) are copied under their own headers.

Cases: a null payload is written as an empty one; payloads under ``min_bytes`` are always responses;
rows that repeat id and payload are all responses where that id is the largest; a null page id is smaller
than any other and is read back as null; records without any page id rank by their record id; a record
without an id gets one from its content; digests may be hex or base 32; a revisit whose original is
nowhere has no bytes, digest or reference, and ``dedupe_archives`` copies it as it is; a null or odd url is
written percent-encoded or left out; an empty table gives an archive without records; other columns of a
table of pages may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import fresh_path, settle, short_batches

MIN_BYTES = 1000
SALTS = 16
ARCHIVE_BYTES = 16 << 20
CHUNK = 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NL = "\r\n"
RECORDS = (
    "kind string, record_id string, page_id long, url string, date string, http string, payload binary, "
    "payload_digest string, refers_to_id string, fields string"
)
#: Header fields that are written anew; the others of a record are copied.
FRESH = {
    "warc-type", "warc-record-id", "warc-target-uri", "warc-date", "warc-payload-digest", "warc-block-digest", "warc-profile", "warc-refers-to",
    "warc-refers-to-target-uri", "warc-refers-to-date", "warc-truncated", "warc-warcinfo-id", "x-page-id", "content-length",
}


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


EMPTY_MEMBER = _member(b"")


def record_id(page_id: Column, url: Column, digest: Column) -> Column:
    """A stable UUID URN of a record."""
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(url, F.lit("")), digest))
    return F.concat(
        F.lit("<urn:uuid:"),
        F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)),
        F.lit(">"),
    )


def _salt(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int")


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def of_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) rows as response records."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{NL}Content-Type: text/html; charset=utf-8{NL}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(NL + NL))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("payload_digest", F.sha1("payload"))
    return rows.select(
        F.lit("response").alias("kind"), record_id(F.col("page_id"), F.col("url"), F.col("payload_digest")).alias("record_id"), "page_id", "url",
        F.lit(DATE).alias("date"), http.alias("http"), "payload", "payload_digest", F.lit(f"Content-Type: application/http; msgtype=response{NL}").alias("fields"),
    )


def decide(records: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Adds the original's ``orig_id``, ``orig_url`` and ``orig_date``, and ``revisit``: whether the record
    refers to it.

    Only (digest, ids, url, date) of large payloads are grouped, before the shuffle as far as possible; the
    rows of a hot digest are dealt over salts for the join.
    """
    least = F.lit(-(1 << 63))
    best = F.max(F.struct(F.coalesce("page_id", least).alias("p"), F.col("record_id").alias("id"), F.col("page_id").alias("page"), F.col("url").alias("url"), F.col("date").alias("date")))
    firsts = (
        records.where(F.octet_length("payload") >= min_bytes)
        .groupBy("payload_digest")
        .agg(best.alias("o"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("payload_digest").alias("_d"), F.col("o.id").alias("orig_id"), F.col("o.page").alias("_page"), F.col("o.url").alias("orig_url"), F.col("o.date").alias("orig_date"))
    )
    dealt = records.withColumn("_s", _salt(F.col("record_id")))
    joined = dealt.join(_salted(firsts), (F.col("payload_digest") == F.col("_d")) & (F.col("_s") == F.col("_salt")) & (F.octet_length("payload") >= min_bytes), "left")
    own = F.col("_d").isNull() | (F.col("record_id") == F.col("orig_id")) | F.coalesce(F.col("page_id") == F.col("_page"), F.lit(False))
    return joined.withColumn("revisit", ~own).drop("_s", "_salt", "_d", "_page")


def _safe(url: Column) -> Column:
    """The url without what would break a header line."""
    return F.regexp_replace(F.regexp_replace(url, r"[\x00-\x20\x7f]", "%20"), "^$", "%20")


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(NL))).otherwise("")


def headed(decided: DataFrame) -> DataFrame:
    """(head, body): a record's header lines with the HTTP head that belongs to its block, and the rest."""
    again = F.col("revisit")
    of_revisit = F.concat(
        F.lit(f"WARC-Profile: {PROFILE}{NL}"), _line("WARC-Refers-To", F.col("orig_id")),
        _line("WARC-Refers-To-Target-URI", _safe(F.col("orig_url"))), _line("WARC-Refers-To-Date", F.col("orig_date")),
    )
    http = F.coalesce(F.col("http"), F.lit(""))
    block = F.octet_length(http) + F.when(again, 0).otherwise(F.coalesce(F.octet_length("payload"), F.lit(0)))
    head = F.concat(
        F.lit(f"WARC/1.1{NL}WARC-Type: "), F.when(again, "revisit").otherwise(F.col("kind")), F.lit(NL),
        _line("WARC-Record-ID", F.col("record_id")), _line("WARC-Target-URI", _safe(F.col("url"))), _line("WARC-Date", F.col("date")),
        F.when(F.col("kind").isin("response", "revisit"), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest"))).otherwise(""),
        _line("X-Page-Id", F.col("page_id").cast("string")), F.when(again, of_revisit).otherwise(""), F.coalesce("fields", F.lit("")),
        F.lit("Content-Length: "), block.cast("string"), F.lit(NL + NL), http,
    )
    return decided.select(head.alias("head"), F.when(~again, F.col("payload")).alias("body"))


def _files(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole archives, one value each."""

    def closed() -> pa.RecordBatch:
        said = f"software: rillstone{NL}format: WARC File Format 1.1{NL}"
        name = uuid.UUID(bytes=hashlib.md5(held[0]).digest())
        info = f"WARC/1.1{NL}WARC-Type: warcinfo{NL}WARC-Record-ID: <urn:uuid:{name}>{NL}WARC-Date: {DATE}{NL}Content-Type: application/warc-fields{NL}Content-Length: {len(said)}{NL}{NL}{said}{NL}{NL}"
        return pa.RecordBatch.from_arrays([pa.array([b"".join([_member(info.encode()), *held])], pa.binary())], ["value"])

    held: list[bytes] = []
    size = 0
    for batch in stream:
        for head, body in zip(batch.column(0), batch.column(1)):
            held.append(_member(head.as_py().encode() + (body.as_py() or b"") + b"\r\n\r\n"))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield closed()
                held, size = [], 0
    if held:
        yield closed()


def write_records(decided: DataFrame, path: str) -> None:
    with short_batches(decided.sparkSession, 500):
        files = headed(decided).mapInArrow(_files, "value binary").select(F.col("value").cast("string").alias("value"))
        files.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Write (page_id, url, html) rows as archives below ``path``, duplicates as revisits."""
    write_records(decide(of_pages(pages), min_bytes), path)


def _chunks(data: bytes) -> Iterator[bytes]:
    """The data piece by piece, gzip members opened; what follows the last member must be zeros."""
    view, at = memoryview(data), 0
    while at < len(view):
        if view[:2] != b"\x1f\x8b":
            yield bytes(view[at : at + CHUNK])
            at += CHUNK
            continue
        if view[at : at + 2] != b"\x1f\x8b":
            if any(view[at:]):
                raise ValueError(f"no gzip member at byte {at}")
            return
        z = zlib.decompressobj(31)
        while not z.eof and at < len(view):
            piece = view[at : at + CHUNK]
            yield z.decompress(piece)
            at += len(piece)
        at -= len(z.unused_data)


def parse(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(header fields, block) of each record of an archive, which is read once from front to back."""
    source, buffer = _chunks(data), bytearray()

    def more() -> bool:
        piece = next(source, None)
        if piece is None:
            return False
        buffer.extend(piece)
        return True

    while True:
        while buffer[:2] == b"\r\n":
            del buffer[:2]
        if len(buffer) < 2 and more():
            continue
        if not buffer:
            return
        start = 0
        while (end := buffer.find(b"\r\n\r\n", start)) < 0:
            start = max(0, len(buffer) - 3)
            if not more():
                raise ValueError("a record's header has no end")
        version, *lines = buffer[:end].decode("utf-8", "replace").split(NL)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record where one should be: {version[:40]!r}")
        fields: list[tuple[str, str]] = []
        for line in lines:
            if line[:1] in " \t" and fields:  # continued
                fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
            else:
                name, _, value = line.partition(":")
                fields.append((name.strip(), value.strip()))
        size = int(next(v for k, v in fields if k.lower() == "content-length"))
        del buffer[: end + 4]
        while len(buffer) < size:
            if not more():
                raise ValueError("a record's block is cut short")
        yield fields, bytes(buffer[:size])
        del buffer[:size]


def _digest(value: str | None) -> str | None:
    """The lower-case hex form of a SHA-1 header, which may be in base 32."""
    kind, _, code = (value or "").rpartition(":")
    if kind.lower() not in ("", "sha1") or not code:
        return None
    return base64.b32decode(code.upper()).hex() if len(code) == 32 else code.lower()


def _row(fields: list[tuple[str, str]], block: bytes) -> tuple:
    """A record as the columns of RECORDS."""
    of = {k.lower(): v for k, v in fields}
    kind, page = of.get("warc-type", "").lower(), of.get("x-page-id")
    http, payload = None, block
    if kind in ("response", "revisit"):
        head, blank, rest = block.partition(b"\r\n\r\n")
        if of.get("content-type", "application/http").startswith("application/http"):
            http, payload = (head + blank).decode("latin-1"), rest
    digest = _digest(of.get("warc-payload-digest"))
    if kind == "response" and digest is None:
        digest = hashlib.sha1(payload).hexdigest()
    own = of.get("warc-record-id") or f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr(fields).encode() + block).digest())}>"
    rest_ = "".join(f"{k}: {v}{NL}" for k, v in fields if k.lower() not in FRESH)
    if kind == "revisit" and not any(k == "content-type" for k in of):
        rest_ += f"Content-Type: application/http; msgtype=response{NL}"
    return (
        kind, own, int(page) if page and page.lstrip("-").isdigit() else None, of.get("warc-target-uri"), of.get("warc-date"), http,
        None if kind == "revisit" else payload, digest, of.get("warc-refers-to"), rest_,
    )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the files below ``path``, whatever their names (RECORDS); a revisit's payload is
    null.  A file is one task's: split archives of gigabytes before."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.string()]
    schema = pa.schema([(c.split()[0], k) for c, k in zip(RECORDS.split(", "), kinds)])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for content in batch.column(0):
                held, size = [], 0
                for fields, block in parse(content.as_py()):
                    held.append(_row(fields, block))
                    size += len(block)
                    if size > 8 << 20 or len(held) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held), kinds)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held), kinds)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    with short_batches(spark, 4):
        return files.select("content").mapInArrow(run, RECORDS)


def _found(again: DataFrame, responses: DataFrame) -> DataFrame:
    """``again`` (refers_to_id, payload_digest, record_id, ...) with ``o``, taken from ``responses`` (record_id,
    payload_digest, rank, o): by the id referred to, else by digest; null where neither is there."""

    def by(rows: DataFrame, key: str, named: str) -> DataFrame:
        asked = rows.select(F.col(named).alias("_key")).where("_key IS NOT NULL").distinct()
        picked = responses.join(asked, F.col(key) == F.col("_key"), "left_semi").groupBy(F.col(key).alias("_key")).agg(F.max_by("o", "rank").alias("o"))
        dealt = rows.withColumn("_s", _salt(F.col("record_id")))
        return dealt.join(_salted(picked), (F.col(named) == F.col("_key")) & (F.col("_s") == F.col("_salt")), "left").drop("_s", "_salt", "_key")

    named = by(again, "record_id", "refers_to_id")
    return named.where("o IS NOT NULL").unionByName(by(named.where("o IS NULL").drop("o"), "payload_digest", "payload_digest"))


def _rank() -> Column:
    return F.struct(F.coalesce(F.col("page_id"), F.lit(-(1 << 63))).alias("p"), F.col("record_id").alias("id"))


def resolve(records: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, refers_to_id) of responses and
    revisits; ``refers_to_id`` is the record id of the response that a revisit was joined to."""
    slim = records.where("kind IN ('response', 'revisit')").select(
        "kind", "record_id", "page_id", "url", "refers_to_id", "payload_digest",
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("sha1"),
    )
    slim = settle(slim, "warc-headers")
    responses = slim.where("kind = 'response'")
    origin = F.struct("record_id", "page_id", "payload_bytes", "sha1")
    found = _found(
        slim.where("kind = 'revisit'").select("record_id", "page_id", "url", "refers_to_id", "payload_digest"),
        responses.select("record_id", "payload_digest", _rank().alias("rank"), origin.alias("o")),
    )
    return responses.select(
        "page_id", "url", "payload_bytes", F.col("sha1").alias("payload_digest"), F.lit("response").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_to_id"),
    ).unionByName(
        found.select(
            "page_id", "url", F.col("o.payload_bytes").alias("payload_bytes"), F.col("o.sha1").alias("payload_digest"),
            F.lit("revisit").alias("record_type"), F.col("o.page_id").alias("refers_to"), F.col("o.record_id").alias("refers_to_id"),
        )
    )


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES, path: str | None = None) -> DataFrame:
    """Write ``pages`` as deduplicated archives, read them back and resolve the revisits."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    return resolve(read_archives(spark, path))


def restore(records: DataFrame) -> DataFrame:
    """Responses and revisits as (kind, record_id, page_id, url, date, http, payload, payload_digest, fields): a
    revisit has the payload of its original, or none if that is nowhere."""
    columns = ["kind", "record_id", "page_id", "url", "date", "http", "payload", "payload_digest", "fields"]
    responses = records.where("kind = 'response'")
    found = _found(
        records.where("kind = 'revisit'").drop("payload"),
        responses.select("record_id", "payload_digest", _rank().alias("rank"), F.col("payload").alias("o")),
    )
    return responses.select(*columns).unionByName(found.withColumnRenamed("o", "payload").select(*columns))


def dedupe_archives(spark: SparkSession, source: str, target: str, min_bytes: int = MIN_BYTES) -> None:
    """Read archives, resolve their revisits and write them deduplicated with fresh headers."""
    records = settle(read_archives(spark, source), "warc-records")
    whole = settle(restore(records), "warc-restored")
    own = whole.where("payload IS NOT NULL").withColumn("kind", F.lit("response"))
    decided = decide(own.withColumn("payload_digest", F.sha1("payload")), min_bytes)
    nothing = [F.lit(None).cast("string").alias(c) for c in ("orig_id", "orig_url", "orig_date")]
    lost = whole.where("payload IS NULL").join(records.select("record_id", F.col("refers_to_id").alias("orig_id")).where("orig_id IS NOT NULL"), "record_id", "left")
    lost = lost.select(*whole.columns, "orig_id", *nothing[1:], F.lit(True).alias("revisit"))
    others = records.where("kind NOT IN ('response', 'revisit')").select(*whole.columns, *nothing, F.lit(False).alias("revisit"))
    write_records(decided.unionByName(lost).unionByName(others), target)

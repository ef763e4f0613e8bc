"""Readers: line-delimited JSON, documents, spreadsheets, notebooks, Markdown lists, event streams."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

# One superset schema for all banks: a missing field is null.
CHUNK = (
    "id string, content string, "
    "interview struct<question:string,model_answer:string,key_points:array<string>,common_mistakes:array<string>,followups:array<string>>, "
    "metadata struct<module:string,topic:string,difficulty:string,tags:array<string>,frequency:int,companies:array<string>,industries:array<string>,"
    "role_family:array<string>,language:string,original:string,source:string,bank_ref:string,tier:string,source_url:string,license:string,"
    "attribution:string,has_source_answer:boolean,semantic_ref:string,seed_topic:string,origin:string,fetched:string,"
    "review:struct<status:string,note:string>,expanded_from:string,round:string>"
)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_banks(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Chunks of all banks that exist, with ``bank``, blank lines skipped and retired rows left out."""
    present = {b: p for b, p in paths.items() if exists(spark, p)}
    if not present:
        return spark.createDataFrame([], f"{CHUNK}, bank string")
    out = None
    for bank, path in present.items():
        one = spark.read.schema(CHUNK).json(path).withColumn("bank", F.lit(bank))
        out = one if out is None else out.unionByName(one)
    return out.where("id IS NOT NULL AND coalesce(metadata.review.status, '') <> 'retire'")


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): parsed objects, and the lines that are none."""
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = F.trim("value").startswith("{") & F.col("r._bad").isNull()
    return parsed.where(good).select(*[F.col(f"r.{f}") for f in schema.names]), parsed.where(~good).select("value")


def read_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON document per file; a byte order mark is dropped, an unreadable file gives nulls."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.from_json(F.regexp_replace("value", "^﻿", ""), schema).alias("d")).select("d.*")


def read_pastes(spark: SparkSession, folder: str) -> DataFrame:
    """(ord, name, text): all .txt files by name, then all .md files."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("text"))
    kind = F.when(F.col("name").endswith(".txt"), 0).when(F.col("name").endswith(".md"), 1)
    kept = files.withColumn("kind", kind).where("kind IS NOT NULL")
    return kept.withColumn("ord", F.row_number().over(Window.orderBy("kind", "name"))).drop("kind")


def _cells(data: bytes) -> list[list]:
    """Rows of the first sheet of an .xlsx workbook."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns):
                shared.append("".join(t.text or "" for t in item.iter(f"{{{ns['m']}}}t")))
        sheet = ElementTree.fromstring(z.read(sorted(n for n in z.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml", n))[0]))
    rows = []
    for row in sheet.iter(f"{{{ns['m']}}}row"):
        cells: dict[int, str | None] = {}
        for cell in row.findall("m:c", ns):
            letters = re.match("[A-Z]+", cell.get("r", "A")).group()
            at = 0
            for ch in letters:
                at = at * 26 + ord(ch) - 64
            value = cell.find("m:v", ns)
            if cell.get("t") == "s":
                cells[at - 1] = shared[int(value.text)] if value is not None else None
            elif cell.get("t") == "inlineStr":
                cells[at - 1] = "".join(t.text or "" for t in cell.iter(f"{{{ns['m']}}}t"))
            else:
                cells[at - 1] = value.text if value is not None else None
        rows.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
    return rows


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, cells): rows of the first sheet of each workbook, numbered from 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(p, n, r) for p, c in zip(batch["path"], batch["content"]) for n, r in enumerate(_cells(bytes(c)))]
            yield pd.DataFrame(out, columns=["file", "n", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, n int, cells array<string>")


def frequency_sheet(sheet: DataFrame) -> DataFrame:
    """(file, question, frequency, occurrences): a row with a question opens it, rows without one add an
    occurrence to the question before; the header row is skipped.  Cells: question, frequency, company,
    industry, round, role."""
    cell = lambda k: F.nullif(F.trim(F.try_element_at("cells", F.lit(k))), F.lit(""))
    r = sheet.where("n > 0").select("file", "n", cell(1).alias("q"), cell(2).alias("f"), *[cell(k + 3).alias(c) for k, c in enumerate(("company", "industry", "round", "role_title"))])
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    grouped = r.withColumn("g", F.sum(F.when(F.col("q").isNotNull(), 1).otherwise(0)).over(w)).where("g > 0")
    occurrence = F.when(F.coalesce("company", "industry", "round", "role_title").isNotNull(), F.struct("n", "company", "industry", "round", "role_title"))
    return grouped.groupBy("file", "g").agg(
        F.max("q").alias("question"), F.coalesce(F.max(F.col("f").try_cast("int")), F.lit(1)).alias("frequency"), F.array_sort(F.collect_list(occurrence)).alias("occurrences")
    ).drop("g")


def record_sheet(sheet: DataFrame, flagged: str = "x") -> DataFrame:
    """(file, n, company, title, record): company and title carried forward from the last filled row; rows
    without a record and flagged rows are skipped.  Cells: company, title, record, flag."""
    cell = lambda k: F.nullif(F.trim(F.try_element_at("cells", F.lit(k))), F.lit(""))
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    r = sheet.where("n > 0").select("file", "n", cell(1).alias("c"), cell(2).alias("t"), cell(3).alias("record"), cell(4).alias("flag"))
    carried = r.select("file", "n", F.last("c", True).over(w).alias("company"), F.last("t", True).over(w).alias("title"), "record", "flag")
    return carried.where(F.col("record").isNotNull() & (F.coalesce("flag", F.lit("")) != flagged)).drop("flag")


NOTEBOOK = "cells array<struct<cell_type:string,source:array<string>>>"


def notebook_cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, kind, source, section, next_code): cells in order, the last heading so far, and the code of
    the next code cell."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", NOTEBOOK).alias("b"))
    cells = whole.select("file", F.posexplode("b.cells").alias("n", "c")).select("file", "n", F.col("c.cell_type").alias("kind"), F.array_join("c.source", "").alias("source"))
    w = Window.partitionBy("file").orderBy("n")
    heading = F.when((F.col("kind") == "markdown") & F.col("source").rlike(r"^#+ "), F.regexp_extract("source", r"^#+ ([^\n]*)", 1))
    code = F.when(F.col("kind") == "code", F.col("source"))
    return cells.withColumn("section", F.last(heading, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "next_code", F.first(code, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    )


REQUIRED = ("title", "module", "topic", "url", "license", "attribution", "fetched")


def front_matter(docs: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """(file, header, body) of ``docs`` (file, text): ``key: value`` lines up to the first line of dashes; a
    missing key raises."""
    parts = F.split("text", "\n---\n", 2)
    pairs = F.filter(F.split(F.regexp_replace(parts[0], r"^---\n", ""), "\n"), lambda x: x.contains(":"))
    entry = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("value"))
    out = docs.select("file", F.map_from_entries(F.transform(pairs, entry)).alias("header"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("body"))
    lacking = F.size(F.array_except(F.array(*map(F.lit, required)), F.map_keys("header"))) > 0
    return out.where(F.when(lacking, F.raise_error(F.concat(F.lit("front matter lacks keys: "), "file")).cast("boolean")).otherwise(F.lit(True)))


def truth(value: Column) -> Column:
    return F.lower(F.trim(value)).isin("yes", "true", "1")


def tiered_questions(docs: DataFrame, cap: int = 220) -> DataFrame:
    """(folder, num, tier, question, answer) of Markdown lists with ``## Basic`` tiers, ``### N. question``
    headings and collapsible answers.  A question has the tier in force before its block."""
    blocks = docs.select("folder", F.posexplode(F.split("text", r"(?m)(?=^###\s+\d+\.\s)")).alias("n", "block"))
    opened = F.lower(F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all("block", F.lit(r"(?m)^##\s+(Basic|Intermediate|Advanced)\b"), F.lit(1))), -1))
    w = Window.partitionBy("folder").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    tier = F.coalesce(F.last("opened", True).over(w), F.lit(""))
    answer = F.trim(F.regexp_replace(F.regexp_extract("block", r"(?s)<details>\s*(?:<summary>.*?</summary>)?(.*?)</details>", 1), r"(?s)```mermaid.*?```", ""))
    rows = blocks.withColumn("opened", opened).withColumn("tier", tier)
    head = r"^###\s+(\d+)\.\s+([^\n]+?)\s*(\n|$)"
    return rows.where(F.col("block").rlike(head)).select(
        "folder", F.regexp_extract("block", head, 1).cast("int").alias("num"), "tier", F.trim(F.regexp_extract("block", head, 2)).alias("question"), text.clip_words(answer, cap).alias("answer")
    )


def numbered_questions(docs: DataFrame, cap: int = 220) -> DataFrame:
    """(name, num, question, answer) of ``## ... Q12: question`` parts; the answer ends at a line of dashes."""
    parts = docs.select("name", F.explode(F.split("text", r"(?m)^(?=##\s+[^\n]*?Q\d+[:：])")).alias("part"))
    head = r"^##\s+[^\n]*?Q(\d+)[:：]\s*([^\n]*)"
    body = F.regexp_replace(F.regexp_replace("part", head, ""), r"(?m)^###\s*.*Answer.*$", "")
    answer = F.trim(F.get(F.split(body, r"(?m)^---\s*$"), F.lit(0)))
    return parts.where(F.col("part").rlike(head)).select(
        "name", F.regexp_extract("part", head, 1).cast("int").alias("num"), F.trim(F.regexp_extract("part", head, 2)).alias("question"), text.clip_words(F.trim(F.regexp_replace(answer, r"^\s+", "")), cap).alias("answer")
    )


# Line patterns of record cells.
ENUM = r"^\s*(?:\d+\s*[、.．)）]+|[-•–]\s*|\(\d+\)|（\d+）)\s*"
NARRATION = r"^(背景|接下来|next steps?$|公司介绍|.{0,14}介绍$|面试流程|上半部分$|下半部分$)"
SECTION = r"^(第[一二三四五]部分|上半部分|下半部分)\s*[：:]\s*(.*)$"
LIST_PREFIX = r"^(常规(面试)?(问题)?|.{0,12}(问|question)s?)\s*[：:]\s*(.+)$"
DISCOURSE = r"(?i)^(?:(?:and|but|so|also|okay|alright|now|um)[,，]?\s+)+"


def record_questions(cells: DataFrame) -> DataFrame:
    """(id, place, question) of multi-line cells (id, cell): numbered and bulleted lines open a question,
    other lines continue it unless a section header came between; list prefixes are split at semicolons;
    narration is dropped."""
    lines = cells.select("id", F.posexplode(F.split("cell", "\n")).alias("n", "raw")).select("id", "n", F.trim(F.regexp_replace("raw", r"\s+", " ")).alias("line")).where("line <> ''")
    weight = lambda c: F.size(text.tokens(c)) + text.cjk_count(c)
    line = F.col("line")
    section, rest = line.rlike(SECTION), F.trim(F.regexp_extract("line", SECTION, 2))
    listed = ~section & line.rlike(LIST_PREFIX)
    items = F.regexp_extract("line", LIST_PREFIX, 5)
    is_list, is_usual = listed & items.rlike("[；;]"), listed & F.regexp_extract("line", LIST_PREFIX, 1).startswith("常规")
    bare = F.regexp_replace(F.regexp_replace("line", rf"^(?:{ENUM[1:]})+", ""), DISCOURSE, "")
    narrated = bare.rlike(NARRATION) & ~bare.rlike("[?？]")
    kind = (
        F.when(section & (weight(rest) >= 5), "start").when(section, "reset").when(is_list, "list").when(is_usual, "start")
        .when((bare == "") | narrated, "drop").when(line.rlike(ENUM), "start").otherwise("more")
    )
    body = F.when(section, rest).when(is_list | is_usual, items).otherwise(bare)
    marked = lines.withColumn("kind", kind).withColumn("body", body).where("kind <> 'drop'")
    pieces = F.when(F.col("kind") == "list", F.filter(F.transform(F.split("body", "[；;]"), lambda x: F.trim(x)), lambda x: x != "")).otherwise(F.array("body"))
    w = Window.partitionBy("id").orderBy("n")
    starts = F.col("kind").isin("start", "list") | (F.coalesce(F.lag("kind").over(w), F.lit("reset")) == "reset")
    grouped = marked.withColumn("opens", starts & (F.col("kind") != "reset")).withColumn("g", F.sum(F.when(F.col("opens") | (F.col("kind") == "reset"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    said = grouped.where("kind <> 'reset'").select("id", "g", "n", F.posexplode(pieces).alias("k", "piece"), "kind")
    joined = said.groupBy("id", "g", F.when(F.col("kind") == "list", F.col("k")).otherwise(0).alias("k")).agg(
        F.min("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda s: s["piece"]), " ").alias("question")
    )
    return joined.select("id", F.row_number().over(Window.partitionBy("id").orderBy("n", "k")).alias("place"), "question")


def _docx(data: bytes) -> str:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{w}t"))
    out = []
    for block in body:
        if block.tag == f"{w}tbl":
            out += [" | ".join(said(c) for c in row.findall(f"{w}tc")) for row in block.iter(f"{w}tr")]
        elif block.tag == f"{w}p":
            out.append(said(block))
    return "\n".join(out)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text, error) of .txt, .md and .docx files; other kinds are reported as errors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content in zip(batch["path"], batch["content"]):
                suffix = name.rsplit(".", 1)[-1].lower()
                try:
                    got = _docx(bytes(content)) if suffix == "docx" else bytes(content).decode("utf-8-sig") if suffix in ("txt", "md") else None
                    out.append((name, got, None if got is not None else f"unsupported: {suffix}"))
                except (KeyError, ValueError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    out.append((name, None, str(e)[:200]))
            yield pd.DataFrame(out, columns=["file", "text", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, text string, error string")


def token_stream(events: DataFrame) -> DataFrame:
    """(id, seq, payload) of server-sent lines (id, seq, line): data lines before [DONE], malformed JSON left out."""
    data = events.where(F.col("line").startswith("data:")).withColumn("payload", F.trim(F.substr("line", F.lit(6))))
    done = data.where("payload = '[DONE]'").groupBy("id").agg(F.min("seq").alias("done"))
    before = data.join(done, "id", "left").where("done IS NULL OR seq < done")
    return before.where(F.try_parse_json("payload").isNotNull() & F.col("payload").startswith("{")).select("id", "seq", "payload")


def env_settings(spark: SparkSession, path: str) -> dict[str, str]:
    """key=value lines of a settings file, all of them; comments and blank lines are skipped."""
    lines = (r[0].strip() for r in spark.read.text(path, wholetext=False).where("value LIKE '%=%'").toLocalIterator())
    pairs = (x.partition("=") for x in lines if x and not x.startswith("#") and "=" in x)
    return {k.strip(): v.strip().strip("\"'") for k, _, v in pairs}


def jdbc_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a relational store; needs its driver on the class path."""
    return spark.read.jdbc(url, name, properties=options)

import json
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstone.operators import features
from rillstone.sources import readers, sinks


def test_banks(spark, tmp_path):
    rows = [{"id": "a", "metadata": {"module": "M"}}, {"id": "b", "metadata": {"review": {"status": "retire"}}}, {"id": "c"}]
    (tmp_path / "x.jsonl").write_text("\n\n".join(json.dumps(r) for r in rows) + "\n")
    got = readers.read_banks(spark, {"one": str(tmp_path / "x.jsonl"), "none": str(tmp_path / "missing.jsonl")})
    assert sorted((r.id, r.bank) for r in got.collect()) == [("a", "one"), ("c", "one")]


def test_tolerant_and_document(spark, tmp_path):
    (tmp_path / "y.jsonl").write_text('{"k": 1}\nnot json\n[1]\n{"k": 2}\n')
    good, bad = readers.read_tolerant(spark, str(tmp_path / "y.jsonl"), T.StructType.fromDDL("k int"))
    assert sorted(r.k for r in good.collect()) == [1, 2] and bad.count() == 2
    (tmp_path / "d.json").write_text('﻿{"k": 3}', encoding="utf-8")
    assert readers.read_document(spark, str(tmp_path / "d.json"), T.StructType.fromDDL("k int")).first().k == 3


def sheet(path, rows):
    cell = lambda c, r, v: f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if v is not None else ""
    body = "".join(f'<row r="{i}">' + "".join(cell(c, i, v) for c, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


def test_sheets(spark, tmp_path):
    sheet(tmp_path / "f.xlsx", [["q", "n", "c"], ["Why?", "3", None], [None, None, "A"], [None, None, "B"], ["How?", None, None]])
    got = {r.question: (r.frequency, [o.company for o in r.occurrences]) for r in readers.frequency_sheet(readers.read_sheet(spark, str(tmp_path / "f.xlsx"))).collect()}
    assert got == {"Why?": (3, ["A", "B"]), "How?": (1, [])}
    sheet(tmp_path / "r.xlsx", [["c", "t", "r", "f"], ["A", "MLE", "one", None], [None, None, "two", None], ["B", None, "bad", "x"], [None, "DS", None, None], [None, None, "three", None]])
    got = [(r.company, r.title, r.record) for r in readers.record_sheet(readers.read_sheet(spark, str(tmp_path / "r.xlsx"))).orderBy("n").collect()]
    assert got == [("A", "MLE", "one"), ("A", "MLE", "two"), ("B", "DS", "three")]


def test_pastes_and_files(spark, tmp_path):
    for n in ("b.txt", "a.md", "a.txt", "z.bin"):
        (tmp_path / n).write_text(n)
    assert [r.name for r in readers.read_pastes(spark, str(tmp_path)).orderBy("ord").collect()] == ["a.txt", "b.txt", "a.md"]
    with zipfile.ZipFile(tmp_path / "cv.docx", "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Name</w:t></w:r></w:p><w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr></w:tbl></w:body></w:document>")
    got = {r.file.rsplit("/", 1)[1]: (r.text, r.error) for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert got["cv.docx"] == ("Name\na | b", None) and got["z.bin"][1].startswith("unsupported")


def test_notebook(spark, tmp_path):
    cells = [("markdown", "# One\ntext"), ("code", "x = 1"), ("markdown", "plain"), ("code", "y = 2")]
    (tmp_path / "n.ipynb").write_text(json.dumps({"cells": [{"cell_type": k, "source": [s]} for k, s in cells]}))
    got = [(r.section, r.next_code) for r in readers.notebook_cells(spark, str(tmp_path / "n.ipynb")).orderBy("n").collect()]
    assert got == [("One", "x = 1"), ("One", "y = 2"), ("One", "y = 2"), ("One", None)]


def test_front_matter(spark):
    head = "\n".join(f"{k}: v{i}" for i, k in enumerate(readers.REQUIRED))
    ok = spark.createDataFrame([("f", f"{head}\n---\nbody: x")], "file string, text string")
    r = readers.front_matter(ok).first()
    assert r.header["title"] == "v0" and r.body == "body: x"
    with pytest.raises(PySparkException):
        readers.front_matter(spark.createDataFrame([("f", "title: x\n---\nb")], "file string, text string")).collect()


def test_markdown_lists(spark):
    md = "# T\n## Basic\n\n### 1. First one?\n<details><summary>Answer</summary>\nYes\n```mermaid\ngraph\n```\n</details>\n\n### 2. Second?\nx\n## Advanced\n### 3. Third?\n<details>\nNo\n</details>\n"
    got = [(r.num, r.tier, r.question, r.answer) for r in readers.tiered_questions(spark.createDataFrame([("04-x", md)], "folder string, text string")).orderBy("num").collect()]
    assert got == [(1, "basic", "First one?", "Yes"), (2, "basic", "Second?", ""), (3, "advanced", "Third?", "No")]
    plain = "## ❓ Q1: What is RAG?\n### Answer\nRetrieval.\n---\nad\n## Q2: KV cache?\nCache.\n"
    got = [(r.num, r.question, r.answer) for r in readers.numbered_questions(spark.createDataFrame([("QA_1.md", plain)], "name string, text string")).orderBy("num").collect()]
    assert got == [(1, "What is RAG?", "Retrieval."), (2, "KV cache?", "Cache.")]


def test_record_cells(spark):
    cell = "背景 x\n1. How would you build a feed\nwith many users?\n- -2). And so explain drift\n公司介绍\n第二部分：ML system design of a big search\n常规问题：why us; salary"
    got = [r.question for r in readers.record_questions(spark.createDataFrame([(1, cell)], "id int, cell string")).orderBy("place").collect()]
    assert got == ["How would you build a feed with many users?", "explain drift", "ML system design of a big search", "why us", "salary"]


def test_token_stream(spark):
    rows = [(1, 1, 'data: {"t": 1}'), (1, 2, ": ping"), (1, 3, "data: {bad"), (1, 4, 'data: {"t": 2}'), (1, 5, "data: [DONE]"), (1, 6, 'data: {"t": 3}')]
    got = readers.token_stream(spark.createDataFrame(rows, "id int, seq int, line string")).orderBy("seq").collect()
    assert [r.seq for r in got] == [1, 4]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "log")
    assert sinks.append_new(rows, path, "k").count() == 2 and sinks.append_new(rows, path, "k").count() == 2
    sinks.replace(rows.where("k = 1"), path)
    assert spark.read.parquet(path).count() == 1
    key = sinks.corpus_fingerprint(rows, ["k", "v"])
    assert key == sinks.corpus_fingerprint(rows.orderBy(F.desc("k")), ["k", "v"]) != sinks.corpus_fingerprint(rows.limit(1), ["k", "v"])
    built = []
    for _ in range(2):
        sinks.load_or_build(spark, str(tmp_path), "view", key, lambda: (built.append(1), rows)[1])
    assert built == [1]
    log = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "k int, seq int, v string")
    assert sinks.last_row_wins(log, ["k"], "seq").first().v == "y"


def test_char_ngrams(spark):
    r = spark.createDataFrame([("ab Xyz",)], "t string").select(features.char_ngrams(F.col("t")).alias("g")).first().g
    assert sorted(r) == sorted([" ab", "ab ", " ab ", " xy", "xyz", "yz ", " xyz", "xyz ", " xyz "])

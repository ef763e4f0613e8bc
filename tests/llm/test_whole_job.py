"""Findings of a review: cases that the operators once left out, against brute force."""

import random
from itertools import combinations

import pytest

import corpus_pipeline
from rillstone.llm import decontaminate, nearcopies
from tests.llm.test_operators import ODD, docs


# near dedup -------------------------------------------------------------------------------------------
def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def near_texts():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    passage, out = [word() for _ in range(60)], []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(30, 400))]
        for changes in (0, 1, 2, 4, 8, 16):
            text = list(base)
            for _ in range(changes):
                text[rng.randrange(len(text))] = word()
            out.append(text if rng.random() < 0.7 else [*text, *passage])
    rng.shuffle(out)
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("long", [1, 16])
def test_near_copies(spark, monkeypatch, long):
    monkeypatch.setattr(nearcopies, "LONG", long)
    texts = near_texts()
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in combinations(range(len(texts)), 2):
            if root[a] != root[b] and jaccard(texts[a], texts[b]) >= 0.8:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs(spark, rows)).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) < len(texts)
    kept = corpus_pipeline.near_dedup(spark, docs(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


def test_near_copies_by_simhash(spark, monkeypatch):
    """Similar texts within 3 bits are linked by SimHash; others within 3 bits fail the exact check."""
    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(words), " ".join(words[:-1] + ["x"]), " ".join(words[::-1])]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    asked = []
    plain = nearcopies.links
    monkeypatch.setattr(nearcopies, "links", lambda prints, *a: asked.append(prints.count()) or plain(prints, *a))
    monkeypatch.setattr(nearcopies, "_pairs", lambda index, roots=None: spark.createDataFrame([], "u long, v long"))  # SimHash alone
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs(spark, rows)).collect()}
    assert got == {0: 0, 1: 0, 2: 2} and asked
    monkeypatch.setattr(nearcopies, "majority", lambda pieces: 7)  # all prints equal
    assert {r.doc_id: r.component_id for r in nearcopies.near_copies(docs(spark, rows)).collect()} == got


def test_near_copies_odd_cases(spark):
    kept = nearcopies.keep_one(docs(spark, ODD))
    assert kept.columns == docs(spark, []).columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 5, 6, 6, 7]
    assert nearcopies.near_copies(docs(spark, [])).count() == 0


# decontamination --------------------------------------------------------------------------------------
def test_embedded_items(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows, around = [], ["some", "filler", "stands", "around", "it"]
    for i, t in items:
        w = t.split()
        half = len(w) // 2
        changed, inserted, dropped = [*w[:half], "zzz", *w[half + 1 :]], [*w[:half], "zzz", *w[half:]], [*w[:half], *w[half + 1 :]]
        rows += [(10 * i + k, " ".join([*around, *x, *around]), "en", "a") for k, x in enumerate((w, changed, inserted, dropped, w[half:]))]
    got = {tuple(r) for r in decontaminate.embedded(docs(spark, rows), bench).collect()}
    assert got >= {(10 * i + k, i) for i, _ in items for k in range(4)}
    assert not any(d % 10 == 4 and d // 10 == i for d, i in got)  # half an item
    kept = decontaminate.drop_contaminated(docs(spark, rows), bench)
    assert all(r.doc_id % 10 == 4 for r in kept.select("doc_id").collect())


def test_short_embedded_items(spark):
    bench = spark.createDataFrame([(1, "green ideas sleep quite furiously"), (2, "two words")], "item_id long, text string")
    rows = [(1, "they say green ideas sleep quite furiously at night", "en", "a"), (2, "they say green ideas sleep quite badly", "en", "a"), (3, "two words more", "en", "a")]
    assert [tuple(r) for r in decontaminate.embedded(docs(spark, rows), bench).collect()] == [(1, 1)]

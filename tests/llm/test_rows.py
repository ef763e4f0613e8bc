"""Odd rows through every operator: clashing column names, null and repeated ids, empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rillstone.llm import decontaminate, langid, licenses, lines, maxscore, mixing, nearcopies, quality, rows, simhash, suffixes, warc
from tests.llm.test_operators import ITEM

NAMES = (
    "version doc row rate cdf _id _v _gone gone mix_source source_ u n copy_no mix_key lines_before lines_removed row_no fp component_id root text_digest "
    "gone_doc gone_version hit_doc first_doc key canonical perplexity keep"
).split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
LONG = "one passage of some length that stands in two rows and is long enough to matter here"
ROWS = [
    (1, None, "en", "a"), (2, "", None, None), (3, "  \n\t ", "en", "b"), (4, "word", "en", "a"), (4, "word", "en", "a"), (4, ITEM, "en", "a"), (4, "All rights reserved.", "en", "a"),
    (None, "no id here", "fr", "c"), (None, ITEM, "en", "a"), (None, "All rights reserved.", "en", "a"), (None, LONG, "en", "b"), (5, LONG, "en", "a"), (5, "wholly other text", "de", "b"),
    (6, "x" * 30_000, "de", "a"), (7, "é" * 70, None, "b"), (8, "same menu\nown eight", "en", "a"), (9, "same menu\nown nine", "en", "b"), (9, "same menu", "en", "c"),
    (10, "same menu\nown ten", "en", "d"), (11, "same menu\nown eleven", "en", "e"), (12, "!?", "en", None),
]


def table(spark, of=ROWS):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *["c" + n for n in NAMES]) for i, t, lang, s in of], SCHEMA)


@pytest.fixture
def tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (5, 1, 0), (8, 1, 0), (9, 0, 0), (9, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string")
    return labels, bench


def bag(df):
    return sorted(map(repr, df.select("doc_id", "text", *[f"`{n}`" for n in NAMES]).collect()))


def test_stages_keep_every_column(spark, tables):
    labels, bench = tables
    d = table(spark)
    outs = {
        "quality": quality.keep_good(d, labels), "lines": lines.drop_boilerplate(d), "simhash": simhash.keep_one(d), "near": nearcopies.keep_one(d),
        "decontaminate": decontaminate.drop_contaminated(d, bench),
    }
    for name, out in outs.items():
        assert out.columns == d.columns, name
        assert all(r[n] == "c" + n for r in out.collect() for n in NAMES), name
    mixed = mixing.replicate(d, {"a": 1.0, "b": 1.0}, total=5000.0)
    assert mixed.columns == [*d.columns, "copy_no_", "mix_key_"] and all(r.copy_no == "ccopy_no" and r.copy_no_ >= 0 and r.source in "ab" for r in mixed.collect())
    counted = lines.drop_boilerplate(d, counts=tuple(rows.free(d, "lines_before", "lines_removed")))
    assert counted.columns == [*d.columns, "lines_before_", "lines_removed_"]
    taken = {r.doc_id: r.lines_removed_ for r in counted.collect() if r.text is not None and r.doc_id in (8, 10, 11)}
    assert taken == {8: 0, 10: 1, 11: 1}


def test_rows_that_share_an_id(spark, tables):
    _, bench = tables
    d = table(spark)
    left = [(r.doc_id, r.text) for r in decontaminate.drop_contaminated(d, bench).collect()]
    assert sorted(map(str, left)) == sorted(str((i, t)) for i, t, _, _ in ROWS if t != ITEM)
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(d, bench).collect()} == {(4, 1), (None, 1)}
    got = licenses.scan(d, licenses.known_digests(spark)).join(d.select("doc_id", "text").distinct().withColumn("version", F.xxhash64("text")), "version").collect()
    assert {r.text for r in got if r.notices} == {"All rights reserved."} and len(licenses.scan(d, licenses.known_digests(spark)).collect()) == len(ROWS)


@pytest.mark.parametrize("rows_", [ROWS, [(None, None, None, None)] * 3, []], ids=["odd", "nulls", "empty"])
def test_every_operator(spark, tables, rows_):
    labels, bench = tables
    d = table(spark, rows_)
    n = len(rows_)
    assert quality.classify(d, labels if rows_ else labels.limit(0)).count() == n
    assert decontaminate.matches(d, bench).count() == (2 if rows_ == ROWS else 0) and decontaminate.matches(d, bench.limit(0)).count() == 0
    assert licenses.scan(d, licenses.known_digests(spark)).count() == n
    assert langid.identify(d).count() == n
    assert simhash.near_duplicates(d).count() == n and nearcopies.near_copies(d).count() == n
    assert lines.drop_boilerplate(d).count() == n and bag(lines.drop_boilerplate(d, min_sites=99)) == bag(d)
    assert suffixes.dedupe(d).count() == n
    sources = {s for _, _, _, s in rows_}
    assert set(r.source for r in mixing.replicate(d, total=1000.0).select("source").collect()) <= sources
    pages = d.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), "version", "row", "rate")
    assert warc.round_trip(pages).count() == n
    vectors = d.select(F.col("doc_id").alias("vec_id"), F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")).alias("embedding"), "version", "rate")
    maxscore.top_k(vectors, vectors).count()


@pytest.mark.parametrize("rows_", [ROWS, []], ids=["odd", "empty"])
def test_pipeline(spark, tables, tmp_path, rows_):
    labels, bench = tables
    d = table(spark, rows_)
    for name, df in (("documents", d), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*d.columns, "copy_no_", "mix_key_"]
    texts = {r.text for r in out.collect()}
    assert ITEM not in texts and None not in texts and "" not in texts


def test_plain_license_files(spark):
    mit, bsd = licenses.KNOWN_TEXTS["MIT"], licenses.KNOWN_TEXTS["BSD-3-Clause"]
    files = {
        "MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + mit: "MIT", "The MIT License (MIT)\n\n© 2020 Jane Doe\n\n" + mit: "MIT", mit: "MIT",
        "BSD 3-Clause License\n\nCopyright (c) 2019, X\nAll rights reserved.\n\n" + bsd.replace("\n1. ", "\n* ").replace("\n2. ", "\n* ").replace("\n3. ", "\n* "): "BSD-3-Clause",
        "(c) 2021 Y. All rights reserved\n" + bsd: "BSD-3-Clause", mit + "\nand more": None, "MIT License": None,
    }
    d = spark.createDataFrame(list(enumerate(files)), "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(d, licenses.known_digests(spark)).collect()}
    assert got == dict(enumerate(files.values()))


@pytest.mark.parametrize("name,license_id", [("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("GPL-2", "GPL-2.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")])
def test_long_licenses(spark, name, license_id):
    try:
        text = open(f"/usr/share/common-licenses/{name}", encoding="utf-8").read()
    except OSError:
        pytest.skip("no such file here")
    d = spark.createDataFrame([(1, text), (2, text.upper() + "\n"), (3, text[:-300])], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in licenses.scan(d, licenses.known_digests(spark)).collect()} == {1: license_id, 2: license_id, 3: None}


def test_canonical_form_by_hand(spark):
    d = spark.createDataFrame([(1, "Copyright (c) 2020 A\n1. Sub-Licence the  COLOUR,\n  * organised acknowledgement!"), (2, "(c) item three\n© 1999 B")], "doc_id long, text string")
    got = [r.c for r in d.select(licenses.whole(licenses.canonical_lines(F.col("text"))).alias("c")).collect()]
    assert got == ["sublicense the color organized acknowledgment", "c item three"]


def test_template_by_hand(spark):
    d = spark.createDataFrame([(1, "The train needs 3 hours. Then Bob waits 12 km from Rome: 5 euros")], "doc_id long, text string")
    words = decontaminate.prepare(d, "doc_id", "text", "doc_id").first().words
    assert words == ["the", "train", "needs", "#", decontaminate.UNIT, "then", decontaminate.NAME, "waits", "#", decontaminate.UNIT, "from", decontaminate.NAME, "#", decontaminate.UNIT]


def test_copies_by_hand(spark):
    """Poisson(2): 0.1353, 0.4060, 0.6767, 0.8571, ..."""
    cdf = mixing.quantiles(spark.createDataFrame([("s", 2.0), ("t", 0.0), (None, 900.0)], "mix_source string, rate double")).collect()
    of = {r.mix_source: r.cdf for r in cdf}
    assert set(of) == {"s", None} and of["s"][:4] == pytest.approx([0.135335, 0.406006, 0.676676, 0.857123], abs=1e-6) and of[None][-1] == pytest.approx(1.0)
    u = spark.createDataFrame([(x, of["s"]) for x in (0.0, 0.1353, 0.1354, 0.5, 0.9999999)], "u double, cdf array<double>")
    assert [r.n for r in u.select(mixing.copies_at(F.col("cdf"), F.col("u")).alias("n")).collect()] == [mixing.expected_copies(2.0, x) for x in (0.0, 0.1353, 0.1354, 0.5, 0.9999999)]


def test_posting_tally(spark):
    """Components of the links, found by tallies of pairs or by neighbours, are those of all pairs."""
    import numpy as np

    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 12, dtype=np.int64)
    prints = set(base.tolist())
    for b in base.tolist():
        for _ in range(12):
            prints.add(b ^ sum(1 << int(k) for k in rng.choice(63, int(rng.integers(1, 5)), replace=False)))
    prints = sorted(prints)
    def classes(pairs):
        root = {p: p for p in prints}

        def top(p):
            while root[p] != p:
                p = root[p]
            return p

        for a, b in pairs:
            root[top(a)] = top(b)
        groups = {}
        for p in prints:
            groups.setdefault(top(p), set()).add(p)
        return sorted(map(sorted, groups.values()))

    near = lambda a, b: (a ^ b).bit_count() <= 3 and sum(not (a ^ b) >> 8 * k & 0xFF for k in range(8)) >= 5
    want = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3]
    assert all(near(a, b) for a, b in want)  # the minimum is guaranteed
    for pairs in (3000, 1):
        before, simhash.ALL_PAIRS = simhash.ALL_PAIRS, pairs
        try:
            found = [tuple(r) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()]
        finally:
            simhash.ALL_PAIRS = before
        assert classes(found) == classes(want)

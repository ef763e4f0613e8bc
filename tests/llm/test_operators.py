"""Corpus operators against brute force, SQL, round trips and held-out rows, with the odd cases."""

import base64
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rillstone.llm import components, decontaminate, langid, licenses, lines, maxscore, mixing, quality, simhash, suffixes, warc
from rillstone.llm.queries import ORACLES, QUERIES
from tests.oracle import assert_same, oracle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, line_no int, keep string, copy_no string"


def docs(spark, rows):
    """Rows of (doc_id, text, lang, source) with extra columns under names that operators use, too."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 7, "k", "c") for i, t, lang, s in rows], DOCS)


ODD = [
    (1, None, "en", "a"), (2, "", None, None), (3, "   \n\t ", "en", "b"), (4, "word", "en", "a"), (4, "word", "en", "a"), (None, "no id here", "fr", "c"),
    (5, "x" * 60_000, "de", "a"), (6, "é" * 70, None, "b"), (6, "other text, same id", "en", "b"), (7, "!?", "en", None),
]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    assert_same(QUERIES[name](spark, sf).toPandas(), oracle(ORACLES[name], sf))


# 1 --------------------------------------------------------------------------------------------------
ITEM = "Alice bought 12 apples for 3 dollars while Bob sold 12 pears and kept 5 melons for Alice herself today"


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "tiny item"), (3, None), (4, "")], "item_id long, text string")
    renamed = ITEM.replace("Alice", "Carol").replace("12", "40").replace("Bob", "Dave")
    broken = ITEM.replace("Alice bought 12", "Carol bought 40")
    rows = [(10, "before that: " + ITEM.replace(" and ", ",\nand ") + ". after", "en", "a"), (11, "Intro words. " + renamed, "en", "a"), (12, "see: " + broken, "en", "a"),
            (13, "Tiny item!", "en", "a"), (14, "tiny item and more", "en", "a"), *ODD]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs(spark, rows), bench).collect()}
    assert (10, 1) in got and got[10, 1].changed == 0 and (11, 1) in got and got[11, 1].changed > 0
    assert (12, 1) not in got and (13, 2) in got and (14, 2) not in got and {k[1] for k in got} == {1, 2}
    kept = decontaminate.drop_contaminated(docs(spark, rows), bench)
    assert kept.columns == docs(spark, rows).columns and kept.count() == len(rows) - 3
    assert decontaminate.matches(docs(spark, []), bench).count() == 0 and decontaminate.matches(docs(spark, rows), bench.limit(0)).count() == 0


# 2 --------------------------------------------------------------------------------------------------
def test_licenses(spark):
    mit = "Copyright (c) 2020 Jane\n\n" + licenses.KNOWN_TEXTS["MIT"].replace("software", "software").replace(". ", ".\n").upper().replace("SUBLICENSE", "SUB-LICENCE")
    rows = [(20, mit, "en", "a"), (21, "Text.\nlicensed under the APACHE licence, version 2.0\nReleased under the MIT License!", "en", "a"), *ODD]
    got = {(r.doc_id, r.license_id, r.notices) for r in licenses.scan(docs(spark, rows), licenses.known_digests(spark)).collect()}
    assert (20, "MIT", None) in got and (21, None, "Apache-2.0,MIT-notice") in got and (1, None, None) in got
    assert licenses.scan(docs(spark, rows), licenses.known_digests(spark)).count() == len(rows)
    assert licenses.scan(docs(spark, []), licenses.known_digests(spark)).count() == 0


# 3 --------------------------------------------------------------------------------------------------
def kneser_ney(train, text):
    """Interpolated modified Kneser-Ney by the book, on folded characters."""
    order = quality.ORDER
    classes = lambda t: np.frombuffer(quality.fold(t or ""), np.uint16).tolist()
    padded = [[0] * (order - 1) + classes(t) + [0] for t in train]
    counts = [{} for _ in range(order + 1)]
    for p in padded:
        for k in range(order - 1, len(p)):
            g = tuple(p[k - order + 1 : k + 1])
            counts[order][g] = counts[order].get(g, 0) + 1
    for n in range(order - 1, 0, -1):
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1
    cut = []
    for n in range(order + 1):
        of = [sum(v == k for v in counts[n].values()) for k in range(5)]
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.0
        cut.append([0.0] + [min(k, max(0.0, k - (k + 1) * y * of[k + 1] / of[k])) if of[k] else 0.5 * k for k in (1, 2, 3)])

    def p(g):
        if not g:
            return 1 / quality.CLASSES
        n = len(g)
        of = {k: v for k, v in counts[n].items() if k[:-1] == g[:-1]}
        lower = p(g[1:])
        if not of:
            return lower
        total, freed = sum(of.values()), sum(cut[n][min(v, 3)] for v in of.values())
        c = of.get(g, 0)
        return (c - cut[n][min(c, 3)] + freed * lower) / total

    q = [0] * (order - 1) + classes(text) + [0]
    return float(np.exp(-np.mean([np.log(p(tuple(q[k - order + 1 : k + 1]))) for k in range(order - 1, len(q))])))


def test_quality_matches_the_book(spark, monkeypatch):
    monkeypatch.setattr(quality, "CALIBRATION", 10**9)
    rng = random.Random(1)
    good = [(i, " ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat."]) for _ in range(12)), "en", "s") for i in range(12)]
    rows = good + [(50, "The cat sat!", "en", "s"), (51, "### zz %% qq", "en", "s")] + ODD
    labels = spark.createDataFrame([(i, 1, 0) for i in range(8)] + [(9, 1, 0), (9, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.perplexities(docs(spark, rows), labels).collect()
    trusted = [t for i, t, _, _ in rows if i is not None and i < 8]
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (0, 3, 50, 51) and r.n_chars:
            text = next(t for i, t, _, _ in rows if i == r.doc_id and len(t or "") == r.n_chars)
            assert r.perplexity == pytest.approx(kneser_ney(trusted, text), rel=1e-3)
    assert all((r.perplexity is None) == (r.n_chars == 0) for r in got)


def test_quality_decisions(spark, monkeypatch):
    """score, threshold and keep from the perplexities, language by language."""
    monkeypatch.setattr(quality, "CALIBRATION", 2)
    rng = random.Random(4)
    words = {"en": ["the", "cat", "sat", "on", "a", "mat."], "fr": ["le", "chat", "est", "sur", "un", "tapis."], None: ["der", "hund"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 30))), lang, "s") for i in range(90) for lang in [rng.choice(["en", "en", "fr", None])]]
    rows += [(200, "zqx 99 ##", "en", "s"), (201, "zqx 99 ##", "xx", "s"), *ODD]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(90)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs(spark, rows), labels, quantile=0.8, margin=1.1).collect()
    base = quality.perplexities(docs(spark, rows), labels).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.version, r.n_chars)
    got, base = sorted(got, key=key), sorted(base, key=key)
    pick = lambda xs, q: sorted(xs)[max(0, int(np.ceil(q * len(xs))) - 1)]

    def cut(q, values):
        held = [(r.lang, v) for r, v in zip(base, values) if r.calibrates and v is not None]
        overall = pick([v for _, v in held], q)
        own = {lang: [v for x, v in held if x == lang] for lang in {x for x, _ in held if x}}
        return [np.exp((len(own[r.lang]) * np.log(pick(own[r.lang], q)) + 30 * np.log(overall)) / (len(own[r.lang]) + 30)) if r.lang in own else overall for r in base]

    median = cut(0.5, [r.perplexity for r in base])
    score = [None if r.perplexity is None else float(np.exp((np.log(r.perplexity) * (r.n_chars + 1) + 40 * np.log(m)) / (r.n_chars + 41))) for r, m in zip(base, median)]
    limit = [1.1 * x for x in cut(0.8, score)]
    assert len(got) == len(rows) and sum(r.calibrates for r in base) > 10
    for r, s, t in zip(got, score, limit):
        assert (r.score is None and s is None) or r.score == pytest.approx(s)
        assert r.threshold == pytest.approx(t) and r.keep == (s is not None and s <= t)


def test_quality_of_other_scripts(spark):
    """Junk in a script other than Latin is told from prose."""
    rng = random.Random(6)
    words = "он она оно мы вы они был была было если когда потом дом лес река город вода земля небо".split()
    good = [(i, " ".join(rng.choice(words) for _ in range(60)), "ru", "s") for i in range(60)]
    bad = [(100 + i, "".join(rng.choice("абвгдежзиклмнопрстуфхцчшщъыьэюя ") for _ in range(300)), "ru", "s") for i in range(10)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.keep_good(docs(spark, good + bad), labels).collect()}
    assert kept == set(range(60))


def test_quality_keeps_good_text(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    j = quality.classify(d, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept"))
    kept = {r.quality: r.kept for r in j.collect()}
    assert kept[1] > 0.98 and kept[0] < 0.4
    empty = labels.limit(0)
    odd = docs(spark, ODD)
    out = quality.keep_good(odd, empty)
    assert out.columns == odd.columns and out.where("text IS NULL OR text = ''").count() == 0 and out.count() == len(ODD) - 2
    assert quality.keep_good(odd.limit(0), labels).count() == 0


# 4 --------------------------------------------------------------------------------------------------
def test_langid(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    rows = langid.predict(docs(spark, ODD), langid.prototypes(d)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 7)} == {"und"} and {r.lang_pred for r in rows if r.doc_id is None} <= {"en", "fr", "de", "es"}
    assert {r.lang_pred for r in langid.identify(docs(spark, [(2, "abc", None, "a")])).collect()} == {"und"}
    assert langid.identify(docs(spark, [])).count() == 0


def test_langid_by_hand(spark):
    """Binding, bundling and cosine, trigram by trigram."""
    space = langid.Space()
    turn = lambda c, k: np.roll(space._vector(ord(c)), k).astype(np.int64)

    def bundle(text):
        t = " " + re.sub(" +", " ", re.sub(r"[^a-zéß]", " ", text.lower())).strip() + " "
        return sum((turn(a, 2) * turn(b, 1) * turn(c, 0) for a, b, c in zip(t, t[1:], t[2:])), np.zeros(langid.DIMENSIONS, np.int64))

    learn = [(i, t, lang, "a") for i, (t, lang) in enumerate([("The cat sat, 2 cats!", "en"), ("le chat était là", "fr"), ("cat that", "en"), ("straße und haß", "de"), ("same", "b"), ("same", "a")])]
    protos = langid.prototypes(docs(spark, learn))
    want = {}
    for _, t, lang, _ in learn:
        want[lang] = want.get(lang, 0) + bundle(t.replace("à", "zq").replace("é", "é")) if lang != "fr" else bundle("x")
    got = {r.lang: np.array(r.bundle) for r in protos.collect()}
    assert set(got) == {"en", "fr", "de", "a", "b"} and all((got[k] == want[k]).all() for k in ("en", "de", "a", "b"))
    asked = [(10, "that cat", None, "a"), (11, "haß", None, "a"), (12, "same", None, "a"), (13, "xyzzy qqq jjj", None, "a")]
    for r in langid.predict(docs(spark, asked), protos).collect():
        v = bundle(next(t for i, t, _, _ in asked if i == r.doc_id)).astype(float)
        cos = {k: float(p @ v / np.linalg.norm(p) / np.linalg.norm(v)) for k, p in got.items()}
        best = min(cos, key=lambda k: (-round(cos[k], 9), k))
        assert r.lang_pred == best and r.score == pytest.approx(max(0.0, cos[best]), abs=1e-6)
    assert [r.lang_pred for r in langid.predict(docs(spark, asked[2:3]), protos).collect()] == ["a"]  # a tie


def test_langid_blocks_agree(spark, monkeypatch):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    protos = langid.prototypes(d)
    whole = sorted(map(tuple, langid.predict(d, protos).collect()))
    monkeypatch.setattr(langid, "LANGUAGES", 1)
    parts = sorted(map(tuple, langid.predict(d, protos).collect()))
    assert [p[:3] for p in parts] == [p[:3] for p in whole]


# 5 --------------------------------------------------------------------------------------------------
def fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    if not w:
        return 0
    g = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash(spark):
    rng = random.Random(7)
    base = [rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(300)]
    rows = list(ODD)
    for k in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(300)] = "changed"
        rows.append((100 + k, " ".join(words), "en", "a"))
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = {(i, t): fingerprint(t) for i, t, _, _ in rows}
    keys = list(prints)
    group = {k: {k} for k in keys}
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3 and group[a] is not group[b]:
                merged = group[a] | group[b]
                for k in merged:
                    group[k] = merged
    want = sorted((i, prints[i, t], min((k[0] for k in group[i, t] if k[0] is not None), default=None)) for i, t, _, _ in rows if i is not None)
    assert sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got if r.doc_id is not None) == want
    kept = simhash.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns and kept.count() == len({id(g) for g in group.values()})
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_forest_both_ways():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 24, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([centre ^ np.uint64(1 << int(rng.integers(24))) for _ in range(20)]))
    plain = simhash._forest(prints, 3)
    limit, simhash.ALL_PAIRS = simhash.ALL_PAIRS, 1
    try:
        near = simhash._forest(prints, 3)
    finally:
        simhash.ALL_PAIRS = limit
    assert sorted(zip(*map(list, plain))) == sorted(zip(*map(list, near)))


def test_components_of_a_chain(spark):
    got = components.components(spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "u long, v long")).collect()
    assert {r.node: r.root for r in got} == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


# 6 --------------------------------------------------------------------------------------------------
PAGES = [(1, "http://a/1", "x" * 1200), (3, "http://a/3", "x" * 1200), (2, None, "x" * 1200), (4, "http://a b\r\n/4", "é\r\n\r\nWARC/1.1\r\n" * 200), (5, "u", None), (6, "u", ""), (7, "u", "short"), (8, "u", "short"), (9, "u", "é\r\n\r\nWARC/1.1\r\n" * 200), (None, "n", "x" * 1200)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")


def test_warc(spark):
    got = {r.page_id: r for r in warc.round_trip(pages(spark)).collect()}
    assert len(got) == len(PAGES)
    for page, _, html in PAGES:
        body = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
    assert {k: r.refers_to for k, r in got.items() if r.record_type == "revisit"} == {1: 3, 2: 3, 4: 9, None: 3}
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_warc_round_trip(spark, tmp_path):
    first, second = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    warc.write_archives(pages(spark), first)
    warc.dedupe_archives(spark, first, second)
    back = warc.restore(warc.read_archives(spark, second))
    assert sorted((str(r.page_id), r.payload.decode()) for r in back.where("kind <> 'warcinfo'").collect()) == sorted((str(p), h or "") for p, _, h in PAGES)
    data = next(p for p in (tmp_path / "b").glob("part-*") if p.stat().st_size).read_bytes()
    records = [({k.lower(): v for k, v in f}, b) for f, b in warc.parse(data)]
    assert records[0][0]["warc-type"] == "warcinfo" and all("warc-record-id" in h and int(h["content-length"]) == len(b) for h, b in records)
    members, at = [], 0
    while at < len(data):  # one record a member, an empty one last
        z = zlib.decompressobj(31)
        members.append(z.decompress(data[at:]))
        at = len(data) - len(z.unused_data)
    assert members[-1] == b"" and all(m.startswith(b"WARC/1.1") and m.endswith(b"\r\n\r\n") for m in members[:-1])


def foreign():
    """An archive as others write them: no page ids, digests in base 32, a request, a revisit by id and one by digest."""
    body = b"y" * 1500
    digest = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\n"

    def record(kind, uid, block, *fields):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uid}>", "WARC-Date: 2020-05-05T00:00:00Z", *fields, f"Content-Length: {len(block)}"]
        return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"

    of = "Content-Type: application/http; msgtype=response"
    return [
        record("warcinfo", "i", b"software: x\r\n", "Content-Type: application/warc-fields"),
        record("request", "q", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request", "WARC-Concurrent-To: <urn:uuid:a>"),
        record("response", "a", http + body, "WARC-Target-URI: http://x/a", of, f"WARC-Payload-Digest: {digest}"),
        record("response", "b", http + body, "WARC-Target-URI: http://x/b", of),
        record("response", "c", http + b"small", "WARC-Target-URI: http://x/c", of),
        record("response", "d", http + b"small", "WARC-Target-URI: http://x/d", of),
        record("revisit", "r", http, "WARC-Target-URI: http://x/r", of, "WARC-Refers-To: <urn:uuid:a>", f"WARC-Payload-Digest: {digest}"),
        record("revisit", "s", http, "WARC-Target-URI: http://x/s", of, "WARC-Refers-To: <urn:uuid:gone>", f"WARC-Payload-Digest: {digest}"),
        record("revisit", "t", http, "WARC-Target-URI: http://x/t", of, f"WARC-Payload-Digest: {digest}"),
        record("revisit", "u", http, "WARC-Target-URI: http://x/u", of, "WARC-Refers-To: <urn:uuid:gone>", "WARC-Payload-Digest: sha1:" + "A" * 32),
    ]


@pytest.mark.parametrize("packed", [True, False])
def test_foreign_archives(spark, tmp_path, packed):
    (tmp_path / "in").mkdir()
    data = b"".join(gzip.compress(r) for r in foreign()) if packed else b"".join(foreign())
    (tmp_path / "in" / ("CC-MAIN-1.warc" + ".gz" * packed)).write_bytes(data)
    got = {r.url[-1]: r for r in warc.resolve(warc.read_archives(spark, f"file://{tmp_path}/in")).collect()}
    assert {k: r.record_type for k, r in got.items()} == dict.fromkeys("abcd", "response") | dict.fromkeys("rstu", "revisit")
    assert got["r"].refers_to_id == "<urn:uuid:a>" and {got[k].payload_bytes for k in "abrst"} == {1500} and got["u"].payload_bytes is None
    warc.dedupe_archives(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    back = {r.record_id[10:-1]: r for r in warc.read_archives(spark, f"file://{tmp_path}/out").collect()}
    assert {k: r.kind for k, r in back.items() if len(k) == 1} == {"i": "warcinfo", "q": "request", "a": "revisit", "b": "revisit", "c": "response", "d": "response", "r": "revisit", "s": "revisit", "t": "response", "u": "revisit"}
    assert {back[k].refers_to_id for k in "abrs"} == {"<urn:uuid:t>"} and back["u"].refers_to_id == "<urn:uuid:gone>" and "WARC-Concurrent-To: <urn:uuid:a>" in back["q"].fields
    again = {r.url[-1]: r for r in warc.resolve(warc.read_archives(spark, f"file://{tmp_path}/out")).collect()}
    assert {again[k].payload_bytes for k in "abrst"} == {1500} and again["u"].payload_bytes is None


# 7 --------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("shard", [16, 4096])
def test_maxscore(spark, monkeypatch, shard):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", shard)
    monkeypatch.setattr(maxscore, "QUERY_ROWS", 5)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 12)).round(2)
    v[100:140] = v[100]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [1.0, None]), (902, [float("nan")] * 12), (None, [1.0] * 12), (7, [float(x) for x in v[7]])]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, score int")
    got = maxscore.top_k(frame.where("vec_id % 20 = 0"), frame).collect()
    whole = np.floor(v * 256).astype(int)
    for q in range(0, 300, 20):
        s = whole @ whole[q]
        want = [(int(s[j]), j) for j in np.lexsort((np.arange(300), -s)) if j != q][:5]
        assert [(r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    assert maxscore.top_k(frame.limit(0), frame.limit(0)).count() == 0


# 8 --------------------------------------------------------------------------------------------------
def test_lines(spark):
    menu, rare = "Home | About", "seen twice"
    rows = [(i, f"own {i}\n {menu} \n{rare if i < 102 else 'x' + str(i)}", "en", f"s{i}") for i in range(100, 112)]
    hot = [(200 + i, f"hot line\nbody {i}", "en", "a") for i in range(30)]
    got = {r.doc_id: r for r in lines.drop_boilerplate(docs(spark, rows + hot + ODD), min_sites=8).collect()}
    assert got[100].text == f"own 100\n {menu} \n{rare}" and got[105].text == "own 105\nx105" and got[205].text == "hot line\nbody 5"
    out = lines.drop_boilerplate(docs(spark, rows + ODD), min_sites=2)
    assert out.count() == len(rows) + len(ODD) and out.where("text IS NULL").count() == 1
    assert lines.drop_boilerplate(docs(spark, [])).count() == 0


# 9 --------------------------------------------------------------------------------------------------
def spans(rows):
    """(removed mask) of each row by brute force; rows in order of ids, null first."""
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    for k in order:
        i, t = rows[k][0], (rows[k][1] or "").encode()
        key = suffixes.NULL_ID if i is None else i
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - 49):
            if seen.setdefault(t[a : a + 50], key) < key:
                gone[a : a + 50] = True
        out.append((i, len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("hot,piece", [(4096, 1 << 20), (2, 300)])
def test_suffixes(spark, monkeypatch, hot, piece):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "PIECE", piece)
    monkeypatch.setattr(suffixes, "RANGE_BYTES", 20_000)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passage = [" ".join(word() for _ in range(30)) for _ in range(4)]
    rows = []
    for k in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(1, 25)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passage)
            cut = rng.randint(0, 60)
            parts += [p[cut:], " ".join(word() for _ in range(rng.randint(0, 8)))]
        rows.append((k, " ".join(parts), "en", "a"))
    rows += [(70, rows[3][1], "en", "a"), (71, "ab" * 400, "en", "a"), (72, "ab" * 300, "en", "a"), (73, "z" * 49, "en", "a"), (74, "z" * 49, "en", "a"), *ODD]
    got = suffixes.dedupe(docs(spark, rows)).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == spans(rows)
    assert suffixes.dedupe(docs(spark, [])).count() == 0


def test_merge_is_sorted():
    rng = random.Random(9)
    codes, keys, every = [], [], []
    for r in range(5):
        run = sorted({bytes([1] + [rng.randint(97, 98) for _ in range(suffixes.KEY - 1)]) for _ in range(40)})
        run += [run[-1][:-1] + bytes([c]) for c in (120, 121)]
        words = suffixes._words(np.frombuffer(b"".join(run), np.uint8).reshape(-1, suffixes.KEY))
        shared = np.zeros(len(words), np.uint8)
        shared[1:] = (words[1:] != words[:-1]).argmax(axis=1)
        rest = words[np.arange(suffixes.WORDS)[None, :] >= shared[:, None]]
        back, code = suffixes._decode(shared.tobytes(), suffixes._pack(np.ascontiguousarray(rest.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 1:])))
        assert (back == words).all() and suffixes._bytes(back).tobytes() == b"".join(run)
        codes.append(code.tolist())
        keys.append(b"".join(run))
        every += run
    keys.append(keys[0])  # the same run twice
    codes.append(codes[0])
    every += [keys[0][k : k + suffixes.KEY] for k in range(0, len(keys[0]), suffixes.KEY)]
    runs, entries, out = suffixes.merged(codes, keys)
    got = [keys[r][e * suffixes.KEY : (e + 1) * suffixes.KEY] for r, e in zip(runs, entries)]
    assert got == sorted(every)
    for a, b, c in zip(got, got[1:], out[1:]):
        k = next((i for i in range(suffixes.WORDS) if a[7 * i : 7 * i + 7] != b[7 * i : 7 * i + 7]), suffixes.WORDS)
        assert suffixes.WORDS - (c >> 56) == k


# 10 -------------------------------------------------------------------------------------------------
def test_mixing(spark):
    rows = [(i, "t" * 10, "en", "big" if i % 3 else "small") for i in range(3000)] + ODD
    out = mixing.replicate(docs(spark, rows), {"big": 1.0, "small": 3.0}, total=40_000)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(n) == {"big", "small"} and abs(n["small"] / 3000 - 1) < 0.1 and abs(n["big"] / 1000 - 1) < 0.15
    u = docs(spark, rows).select("doc_id", mixing.uniform(mixing.SEED, F.col("doc_id")).alias("u")).where("doc_id = 30").first().u
    rate = {r.mix_source: r.rate for r in mixing.rates(docs(spark, rows), {"big": 1.0, "small": 3.0}, 40_000).collect()}["small"]
    assert out.where("doc_id = 30").count() == mixing.expected_copies(rate, u)
    again = mixing.replicate(docs(spark, rows).repartition(7), {"big": 1.0, "small": 3.0}, total=40_000)
    assert sorted(map(tuple, out.select("doc_id", "copy_no").collect())) == sorted(map(tuple, again.select("doc_id", "copy_no").collect()))
    assert mixing.replicate(docs(spark, ODD)).count() >= 0 and mixing.replicate(docs(spark, [])).count() == 0 and mixing.replicate(docs(spark, rows), {"none": 1.0}).count() == 0


# Pipeline -------------------------------------------------------------------------------------------
def test_pipeline(spark, sf):
    import corpus_pipeline as P

    d = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in d.collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = P.run(spark, sf)
    got = {r.doc_id: r.text for r in out.collect()}
    good = quality.keep_good(d, labels)
    assert set(got) <= {r.doc_id for r in good.select("doc_id").collect()} and set(got) <= set(before)
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(b in t for t in got.values() for b in bench) and len(set(got.values())) == len(got)
    assert [name for name, _ in P.STAGES] == ["quality classifier", "line dedup", "near dedup", "decontamination", "mixing"]
    docs_ = d
    for _, stage in P.STAGES[:-1]:
        docs_ = stage(spark, docs_, sf)
        assert docs_.columns == d.columns

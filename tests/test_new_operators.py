"""Operators against values worked out by hand or brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from rillstone.functions import text
from rillstone.operators import dedupe, features, relations, reports, state, transcripts as T
from rillstone.sources import sinks


def lexicon(spark):
    rows = [(0, "LightGBM", ["light gbm"]), (1, "MAE", None), (2, "one two three four five six seven eight nine", None), (3, "quadratic weighted kappa", ["QWK"])]
    return T.lexicon(spark.createDataFrame(rows, "pos int, term string, aliases array<string>"))


def items(spark, rows, **more):
    df = spark.createDataFrame([(i, r, h) for i, r, h in rows], "item long, r string, h string")
    return df.select("item", text.spoken_tokens(F.col("r")).alias("ref"), text.spoken_tokens(F.col("h")).alias("hyp"))


def test_long_terms_match(spark):
    nine = "one two three four five six seven eight nine"
    got = {(r.item, r.term): (r["count"], r.strict, r.lenient) for r in T.term_errors(items(spark, [(1, f"say {nine} now", f"say {nine} now"), (2, nine, nine.replace(" ", ""))]), lexicon(spark)).collect()}
    term = "one two three four five six seven eight nine"
    assert got[1, term] == (1, 1, 1) and got[2, term][:2] == (1, 0)


def test_misrecognitions(spark):
    it = items(spark, [(1, "use MAE here and MAE there", "use may here and MAE there"), (2, "the quadratic weighted kappa", "the")])
    found = {(r.item, r.term, r.became) for r in T.misrecognised(it, lexicon(spark)).collect()}
    assert found == {(1, "MAE", "may"), (1, "MAE", "mae"), (2, "quadratic weighted kappa", "(dropped)")}


def test_audit(spark):
    it = items(spark, [(1, "MAE and MAE", "may and may and may")])
    fixes = spark.createDataFrame([(1, k, "MAE") for k in range(3)], "item long, seq int, term string")
    assert [tuple(r) for r in T.audit(fixes, it, lexicon(spark)).collect()] == [(1, 3, 1)]


def test_compare_live(spark):
    rows = [(1, 1, "use may now", "use MAE now"), (1, 2, "fine words", "fine words"), (1, 3, "", "x"), (2, 1, None, "y")]
    turns, totals = T.compare_live(spark.createDataFrame(rows, "session long, turn long, live string, final string"), lexicon(spark))
    assert sorted((r.session, r.turn, r.wer, r.terms_fixed) for r in turns.collect()) == [(1, 1, 0.333, ["MAE"]), (1, 2, 0.0, [])]
    assert [tuple(r) for r in totals.collect()] == [(1, 2, 0.2, 1)]


def test_condition(spark):
    it = items(spark, [(1, "use MAE here", "use may here"), (2, "plain words", "plain words")])
    grades = spark.createDataFrame([(1, 7.0, 5.5, 4, 1), (2, 6.0, 6.5, 4, 0)], "item long, ref_score double, hyp_score double, kp_total int, kp_flips int")
    summary, worst = T.condition(it, lexicon(spark), grades)
    s = summary.first()
    assert (s.n, s.wer, s.occurrences, s.ter_strict, s.mean_abs, s.ge1_rate, s.kp_flip_rate) == (2, 0.2, 1, 1.0, 1.0, 0.5, 0.125)
    assert [(r.term, r.lenient_misses, [tuple(b) for b in r.became]) for r in worst.collect()] == [("MAE", 1, [("may", 1)])]


def test_keyterm_policies(spark):
    rows = [(0, "QWK", None, False, None, None), (1, "MAPE", None, False, ["map e"], True), (2, "data", None, True, None, None), (3, "a very long term of six words", None, False, None, None), (4, "x<y", None, False, None, None)]
    lex = spark.createDataFrame(rows, "pos int, term string, short string, common boolean, aliases array<string>, alias_keyterms boolean")
    assert [r.form for r in T.naive_keyterms(lex, 3).orderBy("place").collect()] == ["QWK", "MAPE", "data"]
    assert [r.form for r in T.batch_keyterms(lex).orderBy("place").collect()] == ["QWK", "MAPE", "map e", "data"]
    whole = T.lexicon(lex).withColumn("pos", F.col("pos"))
    texts = spark.createDataFrame([(1, "we have data"), (1, "and more"), (2, "nothing")], "session long, text string")
    rates = spark.createDataFrame([("MAPE", 0.5, 2)], "term string, rate double, observed long")
    got = {}
    for r in T.session_keyterms(texts, whole, rates, 2).orderBy("place").collect():
        got.setdefault(r.session, []).append(r.form)
    assert got[1][0] == got[2][0] == "MAPE" and len(got[1]) == 2


def test_cross_fitted(spark):
    lex = T.lexicon(spark.createDataFrame([(0, "MAE", None), (1, "QWK", None)], "pos int, term string, aliases array<string>"))
    lex = lex.withColumn("short", F.lit(None).cast("string")).withColumn("common", F.lit(False))
    it = items(spark, [(1, "MAE", "may"), (2, "QWK", "cue")]).withColumn("fold", (F.col("item") - 1).cast("int"))
    got = {(r.fold, r.place): r.form for r in T.cross_fitted(it, lex, []).collect()}
    assert got[0, 1] == "QWK" and got[1, 1] == "MAE"  # what the other fold got wrong comes first


@pytest.mark.parametrize("threshold", [0.5, 0.65, 0.8, 1.0])
def test_containment_all_pairs(spark, threshold):
    rng = random.Random(3)
    sets = [sorted(rng.sample("abcdefghijklmnopqrst", rng.randint(1, 12))) for _ in range(60)] + [["a"], ["a", "b"], ["a", "b"]]
    df = spark.createDataFrame(list(enumerate(sets)), "idx long, tokens array<string>")
    want = {(i, j) for i, j in combinations(range(len(sets)), 2) if len(set(sets[i]) & set(sets[j])) / min(len(sets[i]), len(sets[j])) >= threshold - 1e-12}
    assert {(r.i, r.j) for r in dedupe.containment_pairs(df, threshold).collect()} == want


def test_corruptions(spark):
    df = spark.createDataFrame([(1, "First, we scale; then we fit. After that everything is measured.")], "k int, a string")

    def one(style):
        return df.select(features.corrupt(F.col("a"), F.array(F.lit(style)), 1, F.col("k").cast("string")).alias("x")).first().x

    base = df.first().a
    assert one("lowercase") == base.lower() and one("strip_punct") == base.replace(",", "").replace(";", "").replace(".", " ")
    assert one("bulletize") == "- First, we scale\n- then we fit\n- After that everything is measured" and one("filler").endswith(base) and one("filler") != base
    assert sorted("".join(one("typos").split())) == sorted("".join(base.split()))
    assert df.select(features.word_dropout(F.lit("a b c d"), 0.9, 1, F.lit("k")).alias("x")).first().x == "a b c d"


def test_synthetic_tiers(spark):
    rows = [(i, f"What is topic {i}?", f"First sentence of {i}. Second sentence here. Third one of {i}.", [f"point {i}", "other"], ["wrong"], f"Topic {i}", "A long sentence that is prose and clearly over forty characters. Another long sentence with more than forty characters too.") for i in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id long, question string, model_answer string, key_points array<string>, common_mistakes array<string>, topic string, content string")
    got = features.synthetic_answers(chunks).collect()
    tiers = {r.tier for r in got}
    assert tiers == {"model_answer", "paraphrase_lite", "keypoint_recall", "paraphrase_heavy", "content_extract", "partial", "partial_2", "fragment", "vague", "vague_short", "question_echo", "off_topic", "off_topic_short"}
    assert all(1 <= r.label <= 9 and len(r.style) <= 2 for r in got) and 0.3 < sum(bool(r.style) for r in got) / len(got) < 0.7
    plain = {(r.chunk_id, r.tier): r.answer for r in got if not r.style}
    assert all(a != rows[c][2] for (c, t), a in plain.items() if t == "off_topic") and all(a == rows[c][2] for (c, t), a in plain.items() if t == "model_answer")
    assert sorted(map(tuple, features.synthetic_answers(chunks.repartition(5)).select("row_id", "answer").collect())) == sorted((r.row_id, r.answer) for r in got)


def test_code_rules(spark):
    reply = "Look:\n```\nx = 1\n\nreturn x\n```\ny = 2\nfor a in b:\nUse `z = 3` here"
    df = spark.createDataFrame([(reply, 1), ("word " * 56, 2), ("word " * 70, 1), ("1. word\n2. word\n3. " + "word " * 70, 0), (None, 2)], "t string, level int")
    got = df.select(text.code_lines(F.col("t")).alias("n"), text.prose_suspect(F.col("t"), F.col("level")).alias("s")).collect()
    assert [r.n for r in got][0] == 4 and [r.s for r in got] == [False, True, False, True, False]


def test_pydoc_and_templates(spark):
    source = 'x = 1\nclass Fit(Base):\n    """Fits.\n\n    Uses ``c`` and :class:`Other`.\n    """\n    pass\n'
    df = spark.createDataFrame([(source,)], "s string")
    got = df.select(text.pydoc_to_text(F.col("s"), "Fit").alias("a"), text.pydoc_to_text(F.col("s"), "Nope").alias("b")).first()
    assert got.a.startswith("Fits.") and "Other" in got.a and "``" not in got.a and got.b is None
    assert df.select(text.render(F.lit("At {level} in {domain}: {{x}}"), level=F.lit("Senior"), domain=F.lit("ads")).alias("t")).first().t == "At Senior in ads: {x}"


def test_updates_and_expiry(spark):
    keys = spark.createDataFrame([("a", None), ("b", "2024-01-01")], "key string, revoked string")
    out, n = state.update_where(keys, (F.col("key") == "a") & F.col("revoked").isNull(), {"revoked": F.lit("2024-02-02")})
    assert sorted(map(tuple, out.collect())) == [("a", "2024-02-02"), ("b", "2024-01-01")] and n.first().changed == 1
    tries = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 12:00:00")], "k int, t string").withColumn("t", F.to_timestamp("t"))
    now = F.to_timestamp(F.lit("2024-01-01 12:00:01"))
    assert [r.k for r in state.expire(tries, "t", now, 12 * 3600).collect()] == [2]


def test_policy_stats(spark):
    d = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "a", None), (1, "b", "x"), (2, "b", None), (3, "b", None)], "probe_id int, policy string, chunk_id string")
    fair = spark.createDataFrame([(1, "x"), (2, "z")], "probe_id int, chunk_id string")
    stats = reports.policy_stats(d, fair, 0.6, 0.3)
    got = {r.policy: (r.attached, r.fair, r.precision, r.coverage, r.passes) for r in stats.collect()}
    assert got == {"a": (2, 1, 0.5, 0.3333, False), "b": (1, 1, 1.0, 0.3333, True)}
    assert [r.policy for r in reports.policy_winner(stats, ["a", "b"]).collect()] == ["b"]


def test_coverage_split(spark):
    probes = spark.createDataFrame([(1, "covered"), (2, "uncovered"), (3, "covered")], "probe_id int, covered string")
    cand = spark.createDataFrame([(1, "no", ["bm25", "dense"]), (2, "yes", ["dense"])], "probe_id int, label string, attached_by array<string>")
    got = {r.split: (r.total, r.covered, r.uncovered) for r in reports.coverage_split(probes, cand).collect()}
    assert got == {"ungrounded_bm25": (2, 1, 1), "unfair_bm25": (1, 1, 0), "unfair_dense": (1, 1, 0)}
    with pytest.raises(Exception, match="no label"):
        reports.coverage_split(spark.createDataFrame([(1, None)], "probe_id int, covered string"), cand).collect()


def test_collect_runs(spark, tmp_path):
    import json

    for name, run in {"a1": {"arm": "x", "seed": 1, "qwk": 0.5}, "a2": {"arm": "x", "seed": 2, "qwk": 0.7, "variant": "silver"}, "a3": {"arm": "y", "seed": 1, "qwk": 0.1, "smoke": True}, "serve_1": {"arm": "z", "seed": 1, "qwk": 0.2}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(run))
    assert sorted((r.name, r.seed) for r in reports.collect_runs(spark, f"file://{tmp_path}/*.json").collect()) == [("x", 1), ("x-silver", 2)]


def test_replace_recovers(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.replace(spark.range(3), path)
    sinks.replace(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    (tmp_path / "t").rename(tmp_path / "t.old")  # as after a crash between the renames
    sinks.recover(spark, path)
    assert spark.read.parquet(path).count() == 5


def test_views_survive_a_failed_build(spark, tmp_path):
    root = f"file://{tmp_path}"
    sinks.load_or_build(spark, root, "v", "one", lambda: spark.range(2))

    def broken():
        raise ValueError("no")

    with pytest.raises(ValueError):
        sinks.load_or_build(spark, root, "v", "two", broken)
    assert sinks.load_or_build(spark, root, "v", "one", broken).count() == 2
    assert sinks.load_or_build(spark, root, "v", "two", lambda: spark.range(4)).count() == 4
    assert sorted(p.name for p in (tmp_path / "v").iterdir()) == ["fp=two"]


def test_as_of(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 5), (4, "a", 3)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y")], "k string, t int, v string")
    assert {r.id: r.as_of for r in relations.as_of(left, right, "k", "t", "v").collect()} == {1: "y", 2: None, 3: None, 4: "x"}


def test_sketches(spark):
    rows = spark.range(20_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 3001).alias("u"), (F.col("id") * 1.0).alias("v"))
    for r in relations.approximate(rows, "g", "v", "u").collect():
        assert abs(r.distinct_estimate / 3001 - 1) < 0.05 and abs(r.median_estimate - 10_000) < 50


def features_by_hand(answer, chunk, chunks):
    import math
    import re

    stem = lambda t: next((t[: -len(s)] for s in ("ing", "ed", "s") if t.endswith(s) and len(t) - len(s) >= 3), t)
    toks = lambda s: [stem(t) for t in re.findall("[a-z0-9]+", s.lower())]
    sents = lambda s: [x.strip() for x in re.split(r"[.!?;\n]+", s) if len(x.strip()) >= 3]
    docs = [set(toks(" ".join([c["question"], c["model_answer"], *c["key_points"]]))) for c in chunks]
    idf = {t: math.log(1 + (len(docs) - (n := sum(t in d for d in docs)) + 0.5) / (n + 0.5)) for d in docs for t in d}
    median = sorted(idf.values())[len(idf) // 2]
    w = lambda t: idf.get(t, median)

    def share(target, heard):
        total = sum(map(w, target))
        return sum(w(t) for t in target if t in heard) / total if total else 0.0

    heard = [set(toks(answer)), *[set(toks(s)) for s in sents(answer)]]
    best = lambda point: max(share(set(toks(point)), h) for h in heard)
    return [best(p) for p in chunk["key_points"]], max((best(m) for m in chunk["common_mistakes"]), default=0.0), share(set(toks(chunk["question"])), heard[0])


def test_features_by_hand(spark):
    chunks = [
        {"chunk_id": 1, "question": "What is boosting?", "model_answer": "Boosting fits trees to residuals.", "key_points": ["fits residuals in turn", "learning rates shrink steps"], "common_mistakes": ["says trees are independent"], "topic": "T"},
        {"chunk_id": 2, "question": "What is bagging?", "model_answer": "Bagging averages trees.", "key_points": ["bootstrap samples", "averaging cuts variance"], "common_mistakes": ["says it cuts bias"], "topic": "T"},
    ]
    c = spark.createDataFrame([tuple(x.values()) for x in chunks], "chunk_id long, question string, model_answer string, key_points array<string>, common_mistakes array<string>, topic string")
    answers = [("a", 1, "It fits the residuals. Learning rate shrinks each step."), ("b", 2, "Bagging samples and trees are independent"), ("c", 1, "")]
    a = spark.createDataFrame(answers, "row_id string, chunk_id long, answer string")
    points = {(r.row_id, r.pos): r for r in features.keypoint_features(a, c).collect()}
    whole = {r.row_id: r for r in features.answer_features(a, c).collect()}
    for row_id, chunk_id, answer in answers:
        chunk = chunks[chunk_id - 1]
        cover, mistake, echo = features_by_hand(answer, chunk, chunks)
        for pos, want in enumerate(cover):
            assert points[row_id, pos].token_overlap == pytest.approx(want) and points[row_id, pos].cover_best >= want - 1e-9
        assert whole[row_id].mistake_sim_max == pytest.approx(mistake) and whole[row_id].question_echo == pytest.approx(echo)
        covers = [points[row_id, pos].cover_best for pos in range(len(cover))]
        assert whole[row_id].kp_cover_mean == pytest.approx(sum(covers) / len(covers)) and whole[row_id].kp_cover_max == pytest.approx(max(covers))
        assert whole[row_id].kp_frac_hit == pytest.approx(sum(x >= 0.35 for x in covers) / len(covers))
        assert sorted(points[row_id, pos].cover_rank_norm for pos in range(len(cover))) == [0.0, 1.0]
        assert points[row_id, 0].others_cover_mean == pytest.approx(points[row_id, 1].cover_best)


def test_state_survives_as_json():
    from rillstone.streaming import folds

    e = folds.Endpoints(silence_ms=64.0)
    for p in (0.9,) * 8:
        e.feed(p)
    again = folds.thaw(folds.Endpoints(silence_ms=64.0), folds.freeze(e))
    assert again.now == e.now and [again.feed(0.0) for _ in range(3)] == [e.feed(0.0) for _ in range(3)]
    r = folds.Reservation(1, 2, 9)
    r.feed(7, "claude")
    again = folds.thaw(folds.Reservation(1, 2, 9), folds.freeze(r))
    assert again.used == {7: 1} and again.total == 1 and again.feed(7, "claude") == "quota"


def test_reconciliation_stream(spark, tmp_path):
    from rillstone.streaming import operators as streams

    schema = "session long, seq long, kind string, end double, text string"
    rows = [(1, 1, "interim", 1.0, "he"), (1, 2, "final", 2.0, "hello"), (1, 3, "final", 1.5, "late"), (1, 4, "final", 3.0, "you"), (2, 1, "interim", 1.0, "x")]
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
    q = streams.reconciled(source, streaming=True).writeStream.format("memory").queryName("finals").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, streams.reconciled(df).collect()))
    assert sorted(map(tuple, spark.table("finals").collect())) == want == [(1, 2.0, "hello"), (1, 3.0, "you")]

import pytest
from pyspark.sql import functions as F

from rillstone.functions import correction
from rillstone.functions import text
from rillstone.operators import chunks as C
from rillstone.operators import reports as R


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_relevance(spark):
    df = frame(spark, [(["a"], None, None, "a", "M", ["x"]), (["a"], None, None, "b", "M", ["x"]), (None, "M", ["x"], "b", "M", ["x", "y"]), (None, "M", ["z"], "b", "M", ["x"]), (None, None, None, "b", "M", ["x"])],
               "ids array<string>, m string, t array<string>, cid string, cm string, ct array<string>")
    got = [r.o for r in df.select(C.is_relevant(*map(F.col, ("ids", "m", "t", "cid", "cm", "ct"))).alias("o")).collect()]
    assert got == [True, False, True, False, False]


def test_build_and_strip(spark):
    rows = [(7, "Explain KV cache and batching", "text", ["p"], ["b", "a", "a", None], [], None, "MIT", "s"), (8, "Explain RAG", "text", ["p"], [], ["DS"], "basic", "none", "s")]
    schema = "idx int, text string, answer string, key_points array<string>, companies array<string>, role_family array<string>, tier string, license string, source string"
    got = {r.id: r for r in C.build(frame(spark, rows, schema)).collect()}
    a, b = got["list_007_explain_kv_cache_and"], got["list_008_explain_rag"]
    assert a.metadata.companies == ["a", "b"] and a.metadata.role_family == ["MLE"] and a.interview.model_answer == "text" and a.metadata.module == "Inference & Production"
    assert b.interview.model_answer is None and b.metadata.role_family == ["DS"]
    full = frame(spark, [("i", "c")], "id string, content string").withColumn("metadata", F.struct(F.lit(1).alias("frequency"), F.lit("M").alias("module")))
    assert C.strip(full).schema["metadata"].dataType.names == ["module"] and "content" not in C.strip(full).columns


def test_resolve(spark):
    problems = frame(spark, [(1, "two-sum", 1, "Two Sum"), (2, "lru", 146, "LRU Cache")], "problem_id int, slug string, number int, title string")
    q = frame(spark, [(1, "two sum"), (2, "146"), (3, "lru cache"), (4, "no such")], "qid int, query string")
    got = {r.qid: (r.problem_id, r.synthetic, r.title) for r in C.resolve(q, problems).collect()}
    assert got[1][0] == 1 and got[2][0] == 2 and got[3][0] == 2 and got[4] == (None, True, "No Such")


def test_sections_and_issues(spark):
    d = frame(spark, [(1, "x\n# Use it\na\n\n\n\nb\n## Skip me\nno\n## More\nc\n# End\nz")], "id int, text string")
    assert C.sections(d, "^Use", "^End", "^Skip").first().text == "# Use it\na\n\nb\n## More\nc"
    rec = frame(spark, [("A long question", "A long answer of words", ["a", "b", "c"], ["h"], "O(n)"), ("short", None, ["a"], [], "n")], "question string, answer string, key_points array<string>, hints array<string>, complexity string")
    got = [r.o for r in rec.select(C.issues(F.lit(0)).alias("o")).collect()]
    assert got[0] == [] and got[1] == ["no question", "no answer", "few key points", "no hints", "no complexity"]


def test_decisions_and_semantics(spark):
    rows, dec = frame(spark, [("a",), ("b",)], "id string"), frame(spark, [("a", "keep", "n"), ("z", "keep", None)], "id string, status string, note string")
    out, unknown = C.decide(rows, dec)
    assert {r.id: r.status for r in out.collect()} == {"a": "keep", "b": "retire"} and [r.id for r in unknown.collect()] == ["z"]
    pairs = lambda *r: frame(spark, list(r), "idx int, of int, score double")
    got = {r.idx: (r.verdict, r.of) for r in C.semantic_verdicts(pairs((1, 10, 0.95), (2, 11, 0.82), (4, 9, 0.1)), pairs((2, 5, 0.86), (3, 5, 0.5)), pairs((3, 1, 0.93))).collect()}
    assert got == {1: ("bank_dup", 10), 2: ("parent_dup", 5), 3: ("pool_dup", 1), 4: ("keep", None)}


def test_parents_and_mentions(spark):
    bank = frame(spark, [("a", "text", None, "Drift"), ("b", "text", "a", "Drift"), ("c", "", None, "Drift"), ("d", "text", None, "Trees"), ("e", "text", None, "drift two")], "id string, content string, expanded_from string, topic string")
    bank = bank.select("id", "content", F.struct("expanded_from", "topic").alias("metadata"))
    assert [r.id for r in C.parents(bank, frame(spark, [("e",)], "parent string"), "drift").collect()] == ["a"]
    rows = frame(spark, [("row_001_x",), ("row_002_y",), ("n1",)], "id string")
    notes = frame(spark, [("n1", "see row_001 and row_002, row_001")], "note_id string, note string")
    assert C.mentioned(notes, rows).first().ids == ["row_001_x", "row_002_y"]


def test_parse_and_json(spark):
    df = frame(spark, [('{"score": 4, "probabilities": {"3": 0.5}, "points": {"0": "hit"}}',)], "b string")
    r = df.select(C.parse_answers(F.col("b"), 2).alias("o")).first().o
    assert r.score == 5.0 and r.probabilities[3] == 0.5 and r.probabilities[0] == 0.0 and r.points == ["hit", None]
    assert df.select(C.canonical_json({"b": F.lit(1), "a": F.lit("x")}).alias("o")).first().o == '{"a":"x","b":1}'


def test_transcript_and_suite(spark):
    t = frame(spark, [(1, 2, "q2", "live", " final "), (1, 1, "q1", "a1", "")], "conv_id int, turn int, question string, answer string, answer_final string")
    assert R.transcript_text(t).first().transcript == "Q: q1\nA: a1\nQ: q2\nA: final"
    exp = frame(spark, [("s", i, f"c{i}") for i in range(4)] + [("t", 0, "c0")], "suite string, ord int, case string")
    res = frame(spark, [("s", "c0", True, None), ("s", "c1", False, "bad"), ("t", "c0", True, None)], "suite string, case string, ok boolean, note string")
    done = R.complete_suite(exp, res)
    assert [(r.case, r.note) for r in done.where("suite = 's'").orderBy("ord").collect()] == [("c0", None), ("c1", "bad"), ("c2", "timed out"), ("c3", "not run")]
    assert {r.suite: (r.valid, r.first_failure) for r in R.valid_suites(done).collect()} == {"s": (False, "c1"), "t": (True, None)}


def test_attempts(spark):
    e = frame(spark, [(1, 1.0, "message", False, 0, None), (1, 2.0, "check", False, None, "passing"), (1, 3.0, "run", True, None, "error:ValueError"), (1, 4.0, "run", False, None, "fine"), (2, 1.0, "message", False, None, None)],
              "attempt int, t double, kind string, failed boolean, level int, state string")
    got = {r.attempt: r for r in R.attempt_report(e).collect()}
    assert got[1].blocker == "error:ValueError" and got[1].last_check == "passing" and got[1].failed_runs == 1 and got[2].blocker == "start"
    n = frame(spark, [(1, 1, None, "Off by one"), (1, 2, None, "off by one"), (1, 3, 1, "x"), (1, 4, None, "Edge case")], "attempt long, seq int, ordinal int, wording string")
    assert R.merge_watchouts(n).first().watchouts == ["Off by one (3)", "Edge case (1)"]


def test_rubric_and_samples(spark):
    probes = frame(spark, [("p", "c"), ("q", None), ("r", "c")], "probe_id string, chunk_id string")
    turns = frame(spark, [("p", "yes"), ("q", "yes"), ("r", " ")], "probe_id string, answer string")
    points = frame(spark, [("p", "a", "hit"), ("p", "b", "miss"), ("r", "a", "hit")], "probe_id string, point string, verdict string")
    got = R.rubric_verdicts(probes, turns, points).collect()
    assert len(got) == 1 and (got[0].hits, got[0].partials, got[0].misses) == (["a"], [], ["b"])
    pool = frame(spark, [("p", "c"), ("p", "d")], "probe_id string, chunk_id string")
    v = frame(spark, [("p", "c", "Yes"), ("p", "d", "?"), ("z", "c", "no")], "probe_id string, chunk_id string, verdict string")
    scored, undecided, outside = R.spot_check(pool, v)
    assert scored.first().label == "fair" and undecided.first().chunk_id == "d" and outside.first().probe_id == "z"
    s = frame(spark, [("fair", "ml", ["a", "b"]), ("fair", "ai", ["a"])], "label string, bank string, policies array<string>")
    assert {(r.facet, r.value): r.n for r in R.composition(s).collect()} == {("label", "fair"): 2, ("bank", "ml"): 1, ("bank", "ai"): 1, ("policy", "a"): 2, ("policy", "b"): 1}


def test_small_reports(spark):
    keys = frame(spark, [("k1", "paid", None, None), ("k2", "gold", True, None), ("k3", "paid", True, "2024")], "key string, tier string, log boolean, revoked_at string")
    got = {r.key: r.tier for r in R.session_keys(frame(spark, [("k1",), ("k2",), ("k3",), ("kx",)], "key string"), keys).collect()}
    assert got == {"k1": "paid", "k2": "free", "k3": "anonymous", "kx": "anonymous"}
    runs = frame(spark, [("a", "a_1.json", 0.9), ("a", "a_2.json", 0.8), ("b", "b_1.json", 0.86), ("c", "serve_c.json", 0.99)], "arm string, file string, qwk double")
    assert R.best_arm(runs).first().arm == "b"
    assert R.noise_floor(frame(spark, [(1, 5.0, 5.0), (2, 5.0, 7.0)], "key int, first double, second double")).first().share_off == 0.5
    d = frame(spark, [(1, "The model drifts when its inputs change over time a lot. too short. Code f() { x } does not count as prose at all here.")], "id int, text string")
    assert R.sentence_candidates(d).count() == 1
    lex = R.build_lexicon(frame(spark, [(0, "LightGBM", ["light gbm"])], "pos int, term string, aliases array<string>"), frame(spark, [(0, "light gbm"), (1, "PSI")], "pos int, term string"), frame(spark, [(0, "psi"), (1, "MAE")], "pos int, term string"))
    assert {r.term: r.source for r in lex.collect()} == {"LightGBM": "curated", "PSI": "corpus", "MAE": "extra"}
    assert frame(spark, [("seed",)], "s string").select(R.pick(F.col("s"), ["a", "b", "c"]).alias("o")).first().o in "abc"


def test_correction(spark):
    terms = {"LightGBM": ["lightgbm"], "softmax": ["softmax"], "data": ["data"], "Kubernetes": ["kubernetes"]}
    c = correction.Corrector(terms, common={"data"})
    tokens, done = c.correct(["use", "light", "gbm", "and", "soft", "macs", "on", "cubernetes", "date"])
    assert tokens == ["use", "lightgbm", "and", "softmax", "on", "kubernetes", "date"] and done[0] == ("light gbm", "LightGBM")
    assert correction.written("Use light-GBM now.", done) == "Use LightGBM now."
    df = frame(spark, [(["light", "gbm"],)], "t array<string>").select(correction.corrector(terms)("t").alias("o"))
    assert df.first().o.tokens == ["lightgbm"]


@pytest.mark.parametrize("word", ["phiddle", "Queue", "xyz", ""])
def test_key_matches_the_column(spark, word):
    assert frame(spark, [(word,)], "w string").select(text.phonetic_key(F.col("w")).alias("o")).first().o == correction.key_of(word)

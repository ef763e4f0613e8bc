import random

from pyspark.sql import functions as F

from rillstone.operators import sampling, state
from rillstone.streaming import folds, operators as streams


def test_upsert_keeps(spark):
    old = spark.createDataFrame([(1, "a", True, 5), (2, "b", False, 6)], "k int, v string, starred boolean, first_seen int")
    new = spark.createDataFrame([(2, "c", True, 9), (3, "d", False, 9)], "k int, v string, starred boolean, first_seen int")
    got = sorted(tuple(r) for r in state.upsert(old, new, ["k"], ["starred", "first_seen"]).collect())
    assert got == [(1, "a", True, 5), (2, "c", False, 6), (3, "d", False, 9)]


def test_insert_ignore_and_trim(spark):
    old = spark.createDataFrame([(1,)], "k int")
    new = spark.createDataFrame([(1, 1), (2, 5), (2, 3), (3, 1)], "k int, seq int")
    assert sorted((r.k, r.seq) for r in state.insert_ignore(old, new, ["k"], "seq").collect()) == [(2, 3), (3, 1)]
    assert [r.seq for r in state.lru_trim(new, 2, [F.desc("seq")]).collect()] == [5, 3]


def test_review_queue(spark):
    rows = [(1, 1, "2024-01-01", "unsolved", None), (2, 2, "2024-01-01", "solved", 3), (3, 3, "2024-01-01", "solved", None)]
    a = spark.createDataFrame(rows, "id int, problem_key int, d string, outcome string, hint_max int").withColumn("finished_at", F.to_timestamp("d"))
    due = lambda now: [r.problem_key for r in state.review_queue(state.review(a, F.to_timestamp(F.lit(now))), 10).collect()]
    assert due("2024-01-01") == [1] and due("2024-01-04") == [1, 2] and due("2024-01-23") == [1, 2, 3]


def test_consecutive(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, "a", "a", "b", None, None, "a"])], "k int, t int, v string")
    assert [r.t for r in state.consecutive(df, ["k"], ["t"], "v").orderBy("t").collect()] == [0, 1, 3, 4, 6]


def test_reservation_grants_exactly_the_cap(spark):
    calls = spark.createDataFrame([("d", i, i, 1, "other") for i in range(20)], "day string, seq long, event_id long, key long, engine string")
    got = [r.verdict for r in state.reserve_coupled(calls, 9, 99, 5).orderBy("event_id").collect()]
    assert got == ["ok"] * 5 + ["budget"] * 15
    same = [r.verdict for r in streams.reserve(calls, 9, 99, 5).orderBy("event_id").collect()]
    assert same == got


def test_group_split_has_no_leak(spark):
    df = spark.createDataFrame([(i, i % 13) for i in range(200)], "row int, g int")
    got = sampling.group_split(df, "g", 0.2).select("g", "held_out").distinct().collect()
    assert len(got) == 13 and sum(r.held_out for r in got) == 3


def test_samplers(spark):
    pool = spark.createDataFrame([(label, bank, "p", k) for k, (label, bank) in enumerate([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("b", "y")])], "label string, bank string, policy string, key int")
    got = sampling.balanced(pool, 4).collect()
    assert len(got) == 4 and sorted(r.label for r in got) == ["a", "a", "b", "b"] and {r.bank for r in got} == {"x", "y"}
    cand = spark.createDataFrame([(1, "s1", ["a", "b"], 10), (2, "s2", ["a"], 2), (3, "s3", ["c"], 5)], "chunk long, sentence string, terms array<string>, words int")
    assert [r.chunk for r in sampling.diverse(cand, 3).orderBy("place").collect()] == [1, 3]


def test_endpointer():
    def events(probs, **kw):
        e = folds.Endpoints(**kw)
        return [x for p in probs for x in e.feed(p)]

    assert events([0.9] * 20 + [0.1] * 45) == ["speech_start", "end_of_turn"]
    assert events([0.9] * 20 + [0.1] * 30 + [0.9] * 5) == ["speech_start"]
    assert events([0.9] * 3 + [0.1] * 20) == []
    assert events([0.0] * 60, timeout_s=1.0) == ["timeout"]
    held, limits, seen = folds.hold(folds.Listening(said=True), 320.0), folds.Limits(), []
    for _ in range(20):
        held, event = folds.listen(held, 0.1, limits)
        seen.append(event)
    assert seen.index("end_of_turn") == 9


def test_turn_stream_any_cut():
    text = 'Hello there. Use v2.5 e.g. now.\nNext line\n----\n{"done": true}'
    rng = random.Random(4)
    for _ in range(30):
        cuts = sorted(rng.sample(range(1, len(text)), 5))
        stream, out = folds.Turn(), []
        for a, b in zip([0, *cuts], [*cuts, len(text)]):
            out += stream.feed(text[a:b])
        late, meta = stream.finish()
        assert out + late == ["Hello there.", "Use v2.5 e.g. now.", "Next line"] and meta == {"done": True}


def test_reconciler():
    r = folds.Reconciler()
    r.feed("interim", 1.0, "a")
    assert r.feed("final", 2.0, "ab") == [(2.0, "ab")]
    assert r.feed("final", 1.5, "late") == []
    r.feed("interim", 3.0, "c")
    assert r.finish() == "ab c"


def test_stream_equals_batch(spark, tmp_path):
    frames = [(s, i, 0.9 if 5 <= i < 25 else 0.1) for s in (1, 2) for i in range(70)]
    schema = "session long, frame_no long, prob double"
    for k in range(2):
        spark.createDataFrame([f for f in frames if f[1] // 35 == k], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    source = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.endpoint_events(source, streaming=True).writeStream.format("memory").queryName("ends").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.session, r.frame_no, r.event) for r in spark.table("ends").collect())
    want = sorted((r.session, r.frame_no, r.event) for r in streams.endpoint_events(spark.createDataFrame(frames, schema)).collect())
    assert got == want and len(got) == 4


def test_window_stream(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    out = streams.tumbling(source, "1 hour", by=("event_type",))
    q = out.writeStream.format("memory").outputMode("complete").queryName("hours").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("hours").agg(F.sum("n")).first()[0] == events.count()


def test_ticks_and_barge_in(spark):
    s = spark.createDataFrame([(1, 65.0), (2, 1000.0), (3, 0.0)], "session int, seconds double")
    got = streams.ticks(s, 30, 300, 600).groupBy("session").agg(F.max("charged").alias("c")).collect()
    assert {r.session: r.c for r in got} == {1: 90, 2: 300}
    t = spark.createDataFrame([(1, ["a", "b"], 1), (2, ["a"], None)], "turn_id int, sentences array<string>, played_seq int")
    assert {r.turn_id: (r.spoken, r.cut) for r in streams.barge_in(t).collect()} == {1: ("a", True), 2: ("a", False)}

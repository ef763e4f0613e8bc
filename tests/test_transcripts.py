import random

from pyspark.sql import functions as F

from rillstone.functions import text
from rillstone.operators import transcripts as T


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def test_word_distance(spark):
    rng = random.Random(2)
    pairs = [([rng.choice("abcdef") * 3 for _ in range(rng.randint(0, 9))], [rng.choice("abcdef") * 3 for _ in range(rng.randint(0, 9))]) for _ in range(40)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = {r.i: r.d for r in df.select("i", T.word_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert all(got[i] == distance(a, b) for i, (a, b) in enumerate(pairs))


def test_wer(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "x"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [r.w for r in df.select(T.wer(F.col("a"), F.col("b")).alias("w")).collect()] == [2 / 3, 1.0]


def test_terms(spark):
    lex = T.lexicon(spark.createDataFrame([(0, "LightGBM", ["light gbm"]), (1, "MAE", None), (2, "mae", None), (3, "quadratic weighted kappa", ["QWK"])], "pos int, term string, aliases array<string>"))
    items = spark.createDataFrame([(1, "use LightGBM and MAE and MAE again", "use light gbm and MAE and may again"), (2, "quadratic weighted kappa", "qwk")], "item long, r string, h string")
    items = items.select("item", text.spoken_tokens(F.col("r")).alias("ref"), text.spoken_tokens(F.col("h")).alias("hyp"))
    got = {(r.item, r.term): (r["count"], r.strict, r.lenient) for r in T.term_errors(items, lex).collect()}
    assert got == {(1, "LightGBM"): (1, 0, 1), (1, "MAE"): (2, 1, 1), (2, "quadratic weighted kappa"): (1, 0, 1)}


def test_communication(spark):
    rows = [(1, "um I did um things", 30000), (1, "like it was good", 15000), (1, "", None), (2, "", 5)]
    got = {r.c: r for r in T.communication(spark.createDataFrame(rows, "c int, answer string, answer_ms long"), "c").collect()}
    assert set(got) == {1} and got[1].answers == 2 and got[1].filler_total >= 3 and got[1].avg_answer_seconds == 22.5


def test_keyterms(spark):
    lex = spark.createDataFrame([(0, "QWK", None, False), (1, "MAPE", None, False), (2, "data", None, True), (3, "long term here", None, False)], "pos int, term string, short string, common boolean")
    rates = spark.createDataFrame([("QWK", 0.9, 4), ("MAPE", 0.5, 2), ("data", 0.0, 5)], "term string, rate double, observed long")
    got = [r.form for r in T.keyterms(lex, rates, ["data"], 3).orderBy("place").collect()]
    assert got == ["QWK", "MAPE", "long term here"]

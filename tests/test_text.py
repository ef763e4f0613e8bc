import pytest
from pyspark.sql import functions as F

from rillstone.functions import text, udfs


def apply(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_tokens_and_stems(spark):
    assert apply(spark, text.tokens, "Été 2.5 GPU-hours", None) == [["t", "2", "5", "gpu", "hours"], []]
    assert apply(spark, text.stem, "training", "leaks", "ed", "used", "is") == ["train", "leak", "ed", "used", "is"]
    assert apply(spark, text.content_tokens, "What is the bias of a model?") == [["bias", "model"]]


def test_classify(spark):
    got = apply(
        spark, text.classify, "Implement a stack", "How would you design a ranking system?", "Are you based in Boston?", "Tell me about a project",
        "What is overfitting?", "What is your greatest weakness?", "You said it was fast?", "curious about translate",
    )
    assert got == ["coding", "system_design", "logistics", "experience", "technical", "behavioral", "followup", "behavioral"]


def test_intents_and_vague(spark):
    assert apply(spark, text.intent_of, "What salary do you expect?", "Why are you looking to leave?", "Explain RAG") == ["compensation", "why_leaving", None]
    assert apply(spark, text.too_vague, "PyTorch", "PyTorch?", "implement stack from scratch", "one two three four five") == [True, False, False, False]
    assert apply(spark, text.language_of, "plain", "你好世界", "explain 模型 to me please") == ["en", "zh", "mixed"]


def test_sentences(spark):
    assert apply(spark, text.sentences, "One two. Hi\n a; three!") == [["One two", "three"]]
    assert udfs.spoken_sentences("Use v2.5 e.g. this. Next one") == (["Use v2.5 e.g. this."], "Next one")
    assert udfs.spoken_sentences("It ends.") == ([], "It ends.")
    assert udfs.spoken_sentences("It ends.", True) == (["It ends."], "")


def test_spoken_tokens(spark):
    got = apply(spark, text.spoken_tokens, "two point five GPUs/hour", "don't stop. 95% of it", "Light-GBM, v2.5!", None)
    assert got == [["2.5", "gpus", "hour"], ["dont", "stop", "95", "percent", "of", "it"], ["light", "gbm", "v2.5"], []]


def test_small_functions(spark):
    assert apply(spark, text.phonetic_key, "phiddle", "cc") == ["fdl", "k"]
    assert apply(spark, text.looks_unfinished, "and then,", "done.", "because", "", None) == [True, False, True, False, False]
    assert apply(spark, text.filler_count, "um um like it", "you know, I mean it") == [2, 2]
    assert apply(spark, text.slug, "When does re-ranking pay off?", "???") == ["when_does_re_ranking", "question"]
    assert apply(spark, text.error_type, "Traceback\nValueError: x", "nothing") == ["ValueError", "Error"]
    assert apply(spark, lambda c: text.clip_words(c, 2), "a b c", "a b") == ["a b ...", "a b"]
    assert apply(spark, lambda c: text.cap_words(c, 3), "a b\n\nc d\n\ne", "a b c d e") == ["a b", "a b c ..."]
    assert apply(spark, lambda c: text.split_trailer(c)[1], 'hi\n---\n{"a": 1}', "hi") == ['{"a": 1}', None]
    assert apply(spark, lambda c: text.replace_section(c, "## A", "## A\nnew\n"), "## A\nold\n## B\nx") == ["## A\nnew\n## B\nx"]
    assert apply(spark, text.normalize_label, " Yes", "no", "?") == ["fair", "unfair", None]


def test_html():
    page = "<html><head><title>x</title><style>p{}</style></head><body><nav><ul><li>menu</li></ul></nav><article><h1>T</h1><p>a <a>b</a></p><p>a <a>b</a></p><ul><li>i</li></ul><script>1</script></article></body></html>"
    assert udfs.html_lines(page) == ["# T", "a b", "- i"]
    assert udfs.html_lines(None) == []


def test_alignment(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "y", "c"])], "r array<string>, h array<string>")
    assert df.select(udfs.aligned("r", "h").alias("o")).first().o == ["a", "x y", "c"]


@pytest.mark.parametrize("value,want", [("ﬁne", "fine"), (None, None)])
def test_nfkc(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(udfs.nfkc("v").alias("o")).first().o == want

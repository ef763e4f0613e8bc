"""Feature, model, source and streaming queries (rows and tests where SQL cannot say them)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluation, features, models, sampling
from ..plans.scratch import settle
from ..plans.session import table
from ..sources import readers
from ..streaming import operators as streams
from .retrieval import TOK

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def chunks(spark, sf) -> DataFrame:
    """Benchmark items as chunks: the first sentence asks, the others are key points."""
    s = text.sentences(F.col("text"))
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("chunk_id"), F.coalesce(F.get(s, F.lit(0)), F.lit("")).alias("question"), F.col("text").alias("model_answer"),
        F.slice(s, 2, F.greatest(F.size(s), F.lit(1))).alias("key_points"), F.slice(s, 1, 1).alias("common_mistakes"), F.coalesce(F.get(s, F.lit(0)), F.lit("topic")).alias("topic"),
    )


def answers(spark, sf) -> DataFrame:
    return features.synthetic_answers(chunks(spark, sf))


@query()
def synthetic_answers(spark, sf):
    return answers(spark, sf)


@query()
def tier_label_range(spark, sf):
    return answers(spark, sf).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))


@query()
def coverage_features(spark, sf):
    f = features.answer_features(answers(spark, sf).select("row_id", "chunk_id", "answer"), chunks(spark, sf))
    return f.select("row_id", *[F.round(c, 6).alias(c) for c in f.columns if c != "row_id"])


@query()
def keypoint_features(spark, sf):
    f = features.keypoint_features(answers(spark, sf).select("row_id", "chunk_id", "answer"), chunks(spark, sf))
    return f.select("row_id", "pos", *[F.round(c, 6).alias(c) for c in f.columns if c not in ("row_id", "pos")])


GRAMS = """list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''), lambda w: ' ' || w || ' ')"""


@query(f"""WITH w AS (SELECT item_id AS idx, unnest({GRAMS}) AS w FROM benchmark), g AS (SELECT idx, w, unnest([3, 4, 5]) AS n FROM w),
c AS (SELECT idx, substr(w, o, n) AS gram FROM (SELECT idx, w, n, unnest(generate_series(1, greatest(length(w) - n + 1, 1))) AS o FROM g WHERE n = 3 OR length(w) >= n)),
tf AS (SELECT idx, gram, count(*) AS tf FROM c GROUP BY ALL), df AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram),
r AS (SELECT idx, gram, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM benchmark)) / (1.0::DOUBLE + df)) + 1) AS w FROM tf JOIN df USING (gram))
SELECT idx, gram, round(w / sqrt(sum(w * w) OVER (PARTITION BY idx)), 6) AS weight FROM r""")
def tfidf_char(spark, sf):
    return features.tfidf(table(spark, sf, "benchmark").select(F.col("item_id").alias("idx"), "text")).select("idx", "gram", F.round("weight", 6).alias("weight"))


def document_features(spark, sf) -> DataFrame:
    t = F.col("text")
    n = F.greatest(F.length(t), F.lit(1))
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", F.col("quality").cast("double").alias("quality"), F.log1p(F.length(t)).alias("chars_log"),
        (F.regexp_count(t, F.lit(r"[!|$%&#*]")) / n).alias("symbols"), (F.regexp_count(t, F.lit("[A-Z]")) / n).alias("capitals"),
        (F.size(F.array_distinct(text.tokens(t))) / F.greatest(F.size(text.tokens(t)), F.lit(1))).alias("variety"),
    )


SIGNALS = ["chars_log", "symbols", "capitals", "variety"]


@query(f"""SELECT doc_id, quality::DOUBLE AS quality, round(ln(1 + length(text)), 6) AS chars_log, round(len(regexp_extract_all(text, '[!|$%&#*]')) / greatest(length(text), 1)::DOUBLE, 6) AS symbols,
round(len(regexp_extract_all(text, '[A-Z]')) / greatest(length(text), 1)::DOUBLE, 6) AS capitals, round(len(list_distinct({TOK})) / greatest(len({TOK}), 1)::DOUBLE, 6) AS variety FROM documents JOIN labels USING (doc_id)""")
def quality_signals(spark, sf):
    f = document_features(spark, sf)
    return f.select("doc_id", "quality", *[F.round(c, 6).alias(c) for c in SIGNALS])


TRUSTED = 3.0  # weight of an answer whose label is not guessed from a share
POINT = [
    "token_overlap", "char_cosine", "cover_best", "cover_rank_norm", "kp_tokens_log", "kp_idf_mean", "others_cover_mean", "word_count_log", "mistake_sim_max", "question_echo",
]


def _rows(spark, sf) -> DataFrame:
    a = answers(spark, sf)
    weight = F.when(F.col("tier").startswith("partial"), 1.0).otherwise(TRUSTED)
    return sampling.group_split(a.withColumn("weight", weight), "chunk_id", 0.2).withColumn("label", F.col("label").cast("double"))


def _graded(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Answers with their sixteen features, label and weight; chunks held out together."""
    rows = _rows(spark, sf)
    f = features.answer_features(rows.select("row_id", "chunk_id", "answer"), chunks(spark, sf))
    f = settle(f.join(rows.select("row_id", "chunk_id", "tier", "label", "weight", "held_out"), "row_id"), "answer-features")
    f = f.repartition(4, "row_id").sortWithinPartitions("row_id")
    return f.where("NOT held_out"), f.where("held_out")


def _signals(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("row_id", "chunk_id", "tier", "label", "weight", "held_out")]


def _points(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Key points of answers with their ten features and a verdict that follows from the recipe."""
    rows = _rows(spark, sf)
    f = features.keypoint_features(rows.select("row_id", "chunk_id", "answer"), chunks(spark, sf))
    known = F.when(F.col("tier").isin("model_answer", "keypoint_recall", "paraphrase_lite"), "hit").when(F.col("tier").startswith("partial"), features.lexical_verdict(F.col("cover_best"))).otherwise(
        F.when(F.col("tier").isin("vague", "vague_short", "question_echo", "off_topic", "off_topic_short"), "miss").otherwise(features.lexical_verdict(F.col("cover_best")))
    )
    f = f.join(rows.select("row_id", "tier", "weight", "held_out"), "row_id").withColumn("verdict", known)
    f = settle(f, "point-features").repartition(4, "row_id", "pos").sortWithinPartitions("row_id", "pos")
    return f.where("NOT held_out"), f.where("held_out")


@query()
def ridge_metrics(spark, sf):
    train, test = _graded(spark, sf)
    return evaluation.grade_metrics(models.clipped(models.ridge(train, _signals(train), "label", "weight").transform(test)), "label", "prediction")


@query()
def boosted_metrics(spark, sf):
    train, test = _graded(spark, sf)
    return evaluation.grade_metrics(models.clipped(models.boosted(train, _signals(train), "label", "weight", rounds=40).transform(test)), "label", "prediction")


def _verdict_model(train: DataFrame):
    return models.verdicts(train, POINT, "verdict", "weight")


@query()
def rf_metrics(spark, sf):
    train, test = _points(spark, sf)
    model = _verdict_model(train)
    names = F.array(*map(F.lit, model.stages[0].labels))
    said = model.transform(test).withColumn("said", F.element_at(names, F.col("prediction").cast("int") + 1))
    return evaluation.label_scores(said, "verdict", "said")


@query()
def stacked_metrics(spark, sf):
    """Ridge over the answer's features and what the classifier says about its key points."""
    points, held = _points(spark, sf)
    model = _verdict_model(points)
    train, test = _graded(spark, sf)
    signals = [*_signals(train), "frac_hit", "frac_partial", "hit_mean", "hit_min"]
    add = lambda a, p: a.join(models.stacked(p, model, "row_id"), "row_id", "left").na.fill(0.0)
    fitted = models.ridge(add(train, points), signals, "label", "weight")
    return evaluation.grade_metrics(models.clipped(fitted.transform(add(test, held))), "label", "prediction")


@query()
def isotonic_fit(spark, sf):
    from ..functions.numeric import interpolate

    train, test = _graded(spark, sf)
    xs, ys = models.isotonic(train, "kp_cover_mean", "label")
    return test.select("row_id", F.col("kp_cover_mean").alias("cover"), F.round(interpolate(F.col("kp_cover_mean"), xs, ys), 6).alias("calibrated"))


@query()
def endpoint_events(spark, sf):
    """Event values as speech probabilities of a user's frames."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("frame_no"), (F.pmod(F.col("event_id") * 7919, F.lit(1000)) / 1000.0).alias("prob"))
    return streams.endpoint_events(e, min_speech_ms=64.0, silence_ms=96.0, timeout_s=1.0)


@query()
def spoken_stream(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("turn_id"), F.col("turn").alias("seq"), F.concat("text", F.lit("\n")).alias("delta"))
    return streams.spoken_sentences(c)


@query()
def transcript_reconcile(spark, sf):
    kind = F.when(F.col("event_type").isin("click", "view"), "interim").otherwise("final")
    e = table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") - F.col("event_id") % 3 * 40).cast("double").alias("end"), F.col("event_type").alias("text"))
    return streams.reconcile(e)


@query("""SELECT user_id AS session, unnest(generate_series(1, least(ceil(s / 30), ceil(300 / 30.0), ceil(600 / 30.0))::INTEGER))::INTEGER AS tick, 0 + 30 * tick AS charged FROM (SELECT user_id, sum(value) AS s FROM events WHERE event_type = 'view' GROUP BY user_id) WHERE s > 0""".replace("0 + 30 * tick AS charged", "30 * tick AS charged"))
def metering_ticks(spark, sf):
    s = table(spark, sf, "events").where("event_type = 'view'").groupBy(F.col("user_id").alias("session")).agg(F.sum("value").alias("seconds"))
    return streams.ticks(s, 30, 300, 600)


@query("""SELECT conv_id * 1000 + turn AS turn_id, array_to_string(p[1:k], ' ') AS spoken, k < len(p) AS cut FROM (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[.!?;\\n]+'), lambda s: regexp_replace(s, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), lambda s: length(s) >= 3) AS p, turn % 4 AS k FROM conversations)""")
def barge_in(spark, sf):
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), text.sentences(F.col("text")).alias("sentences"), (F.col("turn") % 4).cast("int").alias("played_seq"))
    return streams.barge_in(c)


@query()
def record_questions(spark, sf):
    return readers.record_questions(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("cell")))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def window_counts(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.tumbling(e, "1 hour", by=("event_type",))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT user_id, event_type FROM events GROUP BY ALL")
def replay_dedupe(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "ts")
    return streams.first_seen(e, ["user_id", "event_type"]).select("user_id", "event_type")

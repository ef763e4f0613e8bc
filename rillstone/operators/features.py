"""Rubric features: idf-weighted coverage of key points, character n-gram TF-IDF, answer features.

Chunks are (chunk_id, question, model_answer, key_points, common_mistakes); answers are (row_id, chunk_id,
answer).  Everything is a join on tokens or an array function; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric, text
from .retrieval import median_idf

HIT, STRONG = 0.35, 0.6


def chunk_text(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("chunk_id").alias("idx"), F.concat_ws(" ", "question", "model_answer", F.array_join("key_points", " ")).alias("text"))


def idf(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, df, idf) of stemmed tokens over the chunks, and one row (median_idf), the upper median."""
    docs = chunk_text(chunks).select("idx", F.array_distinct(text.grader_tokens(F.col("text"))).alias("t"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = docs.select(F.explode("t").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    table = df.crossJoin(F.broadcast(n)).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return table, median_idf(table)


def char_ngrams(t: Column) -> Column:
    """Character 3- to 5-grams of words padded with one space; a word as short as an n-gram counts once."""
    padded = F.transform(text.words(F.lower(t)), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(w: Column) -> Column:
        n_grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda o: F.substr(w, o, n))
        return F.flatten(F.transform(F.filter(F.array(F.lit(3), F.lit(4), F.lit(5)), lambda n: (n == 3) | (F.length(w) >= n)), n_grams))

    return F.flatten(F.transform(padded, of))


def tfidf(docs: DataFrame, fitted: DataFrame | None = None) -> DataFrame:
    """(idx, gram, weight) of (idx, text): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), L2-normalised.
    ``fitted`` is the corpus that gives n and df, by default the documents themselves."""
    grams = lambda d: d.select("idx", F.explode(char_ngrams(F.col("text"))).alias("gram")).groupBy("idx", "gram").agg(F.count(F.lit(1)).alias("tf"))
    corpus = fitted if fitted is not None else docs
    df = grams(corpus).groupBy("gram").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(corpus.agg(F.count(F.lit(1)).alias("n"))))
    raw = grams(docs).join(df, "gram").select("idx", "gram", ((1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norms = raw.groupBy("idx").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "idx").select("idx", "gram", (F.col("w") / F.col("norm")).alias("weight"))


def _weighted(answers: DataFrame, chunks: DataFrame, column: str, kind: str) -> DataFrame:
    """(row_id, kind, pos, target): stemmed distinct tokens of each target text of the answer's chunk."""
    targets = chunks.select("chunk_id", F.posexplode(column).alias("pos", "point"))
    return answers.select("row_id", "chunk_id").join(targets, "chunk_id").select(
        "row_id", F.lit(kind).alias("kind"), "pos", "point", F.array_distinct(text.grader_tokens(F.col("point"))).alias("target")
    )


def overlap(answers: DataFrame, chunks: DataFrame, idf_table: DataFrame, median: DataFrame) -> DataFrame:
    """(row_id, kind, pos, n_target, idf_mean, whole, best): idf-weighted share of a target's tokens in the
    answer, and the best over the answer and its sentences; kinds point, mistake and question."""
    chunks = chunks.withColumn("questions", F.array("question"))
    targets = _weighted(answers, chunks, "key_points", "point").unionByName(_weighted(answers, chunks, "common_mistakes", "mistake")).unionByName(_weighted(answers, chunks, "questions", "question"))
    heard = answers.select("row_id", F.concat(F.array(F.array_distinct(text.grader_tokens(F.col("answer")))), F.transform(text.sentences(F.col("answer")), lambda s: F.array_distinct(text.grader_tokens(s)))).alias("heard"))
    weighted = (
        targets.select("row_id", "kind", "pos", F.explode_outer("target").alias("term"))
        .join(idf_table.select("term", "idf"), "term", "left").crossJoin(F.broadcast(median))
        .groupBy("row_id", "kind", "pos")
        .agg(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", F.coalesce("idf", "median_idf").alias("w")))).alias("terms"))
    )
    total = F.aggregate("terms", F.lit(0.0), lambda a, t: a + t["w"])
    share = lambda words: F.when(F.col("total") > 0, F.aggregate("terms", F.lit(0.0), lambda a, t: a + F.when(F.array_contains(words, t["term"]), t["w"]).otherwise(0.0)) / F.col("total")).otherwise(0.0)
    return weighted.join(heard, "row_id").withColumn("total", total).select(
        "row_id", "kind", "pos", F.size("terms").alias("n_target"),
        F.when(F.size("terms") > 0, F.col("total") / F.size("terms")).otherwise(0.0).alias("idf_mean"),
        share(F.col("heard")[0]).alias("whole"), F.array_max(F.transform("heard", share)).alias("best"),
    )


def char_cosine(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """(row_id, pos, char_cosine): best cosine of a key point with the answer or one of its sentences."""
    fitted = chunk_text(chunks)
    points = chunks.select("chunk_id", F.posexplode("key_points").alias("pos", "text")).withColumn("idx", F.concat_ws("/", F.col("chunk_id").cast("string"), F.col("pos").cast("string")))
    pieces = answers.select("row_id", "chunk_id", F.posexplode(F.concat(F.array("answer"), text.sentences(F.col("answer")))).alias("k", "text"))
    pieces = pieces.withColumn("idx", F.concat_ws("/", F.col("row_id").cast("string"), F.col("k").cast("string")))
    p = tfidf(points.select("idx", "text"), fitted).join(points.select("idx", "chunk_id", "pos"), "idx").select("chunk_id", "pos", "gram", F.col("weight").alias("wp"))
    a = tfidf(pieces.select("idx", "text"), fitted).join(pieces.select("idx", "row_id", "chunk_id", "k"), "idx").select("row_id", "chunk_id", "k", "gram", F.col("weight").alias("wa"))
    products = a.join(p, ["chunk_id", "gram"]).groupBy("row_id", "pos", "k").agg(F.sum(F.col("wa") * F.col("wp")).alias("c"))
    return products.groupBy("row_id", "pos").agg(F.max("c").alias("char_cosine"))


def keypoint_features(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per answer and key point with the ten features of the coverage classifier."""
    table, median = idf(chunks)
    o = overlap(answers, chunks, table, median)
    points = o.where("kind = 'point'").join(char_cosine(answers, chunks), ["row_id", "pos"], "left").withColumn("char_cosine", F.coalesce("char_cosine", F.lit(0.0)))
    points = points.withColumn("cover", F.greatest("best", "char_cosine"))
    sides = o.groupBy("row_id").agg(F.coalesce(F.max(F.when(F.col("kind") == "mistake", F.col("best"))), F.lit(0.0)).alias("mistake_sim_max"), F.max(F.when(F.col("kind") == "question", F.col("whole"))).alias("question_echo"))
    words = answers.select("row_id", F.log1p(F.size(text.words(F.col("answer")))).alias("word_count_log"))
    w = Window.partitionBy("row_id")
    n = F.count(F.lit(1)).over(w)
    rank = F.row_number().over(w.orderBy(F.desc("cover"), "pos")) - 1
    return points.join(sides, "row_id").join(words, "row_id").select(
        "row_id", "pos", F.col("best").alias("token_overlap"), "char_cosine", F.col("cover").alias("cover_best"),
        (rank / F.greatest(n - 1, F.lit(1))).alias("cover_rank_norm"), F.log1p("n_target").alias("kp_tokens_log"), F.col("idf_mean").alias("kp_idf_mean"),
        F.when(n > 1, (F.sum("cover").over(w) - F.col("cover")) / (n - 1)).otherwise(F.col("cover")).alias("others_cover_mean"),
        "word_count_log", "mistake_sim_max", "question_echo",
    )


def answer_features(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per answer with the sixteen features of the grader."""
    table, median = idf(chunks)
    o = overlap(answers, chunks, table, median)
    cosines = char_cosine(answers, chunks)
    cover = F.greatest("best", F.coalesce("char_cosine", F.lit(0.0)))
    points = o.where("kind = 'point'").join(cosines, ["row_id", "pos"], "left").withColumn("cover", cover).groupBy("row_id").agg(
        F.avg("cover").alias("kp_cover_mean"), F.min("cover").alias("kp_cover_min"), F.max("cover").alias("kp_cover_max"),
        F.avg(F.when(F.col("cover") >= HIT, 1.0).otherwise(0.0)).alias("kp_frac_hit"), F.avg(F.when(F.col("cover") >= STRONG, 1.0).otherwise(0.0)).alias("kp_frac_strong"),
        F.log1p(F.count(F.lit(1))).alias("kp_count_log"),
    )
    mistake = F.when(F.col("kind") == "mistake", F.col("best"))
    sides = o.groupBy("row_id").agg(
        F.coalesce(F.max(mistake), F.lit(0.0)).alias("mistake_sim_max"), F.coalesce(F.avg(mistake), F.lit(0.0)).alias("mistake_sim_mean"),
        F.max(F.when(F.col("kind") == "question", F.col("whole"))).alias("question_echo"),
    )
    toks = answers.select("row_id", F.explode(text.grader_tokens(F.col("answer"))).alias("term")).join(table.select("term", "idf"), "term", "left").crossJoin(F.broadcast(median))
    density = toks.groupBy("row_id").agg((F.count_if(F.col("idf") >= F.col("median_idf")) / F.count(F.lit(1))).alias("technical_density"), (F.count_distinct("term") / F.count(F.lit(1))).alias("type_token_ratio"))
    a = F.col("answer")
    n_words, n_sent = F.size(text.words(a)), F.size(text.sentences(a))
    flat = answers.select(
        "row_id", F.log1p(n_words).alias("word_count_log"), n_sent.cast("double").alias("sentence_count"),
        F.when(n_sent > 0, n_words / F.nullif(n_sent, F.lit(0))).otherwise(0.0).alias("avg_sentence_words"),
        F.when(a.rlike(r"(?m)^\s*(?:[-*]|\d+[.)])\s+"), 1.0).otherwise(0.0).alias("bullet_flag"),
        F.when(F.length(a) > 0, F.regexp_count(a, F.lit(r"[.,;:()!?]")) / F.nullif(F.length(a), F.lit(0))).otherwise(0.0).alias("punct_density"),
    )
    out = flat.join(points, "row_id", "left").join(sides, "row_id", "left").join(density, "row_id", "left")
    return out.na.fill(0.0)


def lexical_verdict(cover: Column) -> Column:
    return F.when(cover >= STRONG, "hit").when(cover >= HIT, "partial").otherwise("miss")


def keyword_baseline(frac_hit: Column) -> Column:
    return numeric.clamp(F.rint(2 + 8 * frac_hit), 1.0, 10.0)


def keep_local(pred: Column, frac_hit: Column) -> Column:
    """The cascade's confidence predicate."""
    return (pred <= 2.5) & (frac_hit <= 0.25)


def route(pred: Column, frac_hit: Column, paid: Column, quota_left: Column, budget_left: Column) -> Column:
    """Which engine grades an answer: the local model when it is sure or nothing else is left."""
    return F.when(keep_local(pred, frac_hit) | ~paid, "local").when(quota_left > 0, "claude").when(budget_left > 0, "other").otherwise("local")


# Openings and texts of made-up answers.
OPENINGS = ("So basically, ", "I'd say ", "")
LINKS = ("", "Also, ", "And ")
STARTS = ("Um, so ", "Okay so ", "I think ")
VAGUE = (
    "Good question. For {topic} I would follow the standard best practices, use the common tools, and evaluate carefully. It really depends on the data and the use case, so I would experiment with a few approaches and pick whichever works best.",
    "I would start by looking closely at {topic} and trying a few standard techniques to see what works. If the results are not good I would tune things and iterate. In my experience it is important to be careful and follow a solid process.",
)
VAGUE_SHORT = (
    "It depends on the situation and the data. I would try a few different approaches and compare the results to see which one works best.",
    "I would follow best practices and use the standard methods for this. Honestly it depends on the specifics.",
    "I'm not totally sure, I haven't worked with this much before, but I would probably experiment and see what works.",
)
STYLES = ("lowercase", "strip_punct", "typos", "filler", "bulletize")


def draw(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from a digest: the same row draws the same number anywhere."""
    text_ = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text_), 1, 8), 16, 10).cast("double") / float(1 << 32)


def pick(options: tuple[str, ...], u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), F.floor(u * len(options)).cast("int") + 1)


def word_dropout(answer: Column, rate: float, seed: int, key: Column) -> Column:
    """The answer without about ``rate`` of its words, or as it is if fewer than five would be left."""
    kept = F.filter(text.words(answer), lambda w, i: draw(seed, key, i) > rate)
    return F.when(F.size(kept) >= 5, F.array_join(kept, " ")).otherwise(answer)


def styles(seed: int, key: Column) -> Column:
    """One or two of the STYLES, in drawn order."""
    order = F.array_sort(F.array(*[F.struct(draw(seed, key, F.lit(s)).alias("u"), F.lit(s).alias("s")) for s in STYLES]))
    n = F.when(draw(seed, key, F.lit("n")) < 0.5, 1).otherwise(2)
    return F.transform(F.slice(order, 1, n), lambda x: x["s"])


def corrupt(answer: Column, chosen: Column, seed: int, key: Column) -> Column:
    """The answer with each chosen style applied in turn; none changes what the answer is worth."""

    def typo(w: Column, i: Column) -> Column:
        at = F.floor(draw(seed, key, F.lit("at"), i) * (F.length(w) - 1)).cast("int")
        swapped = F.concat(F.substr(w, F.lit(1), at), F.substr(w, at + 2, F.lit(1)), F.substr(w, at + 1, F.lit(1)), F.substr(w, at + 3))
        return F.when((F.length(w) > 4) & (draw(seed, key, F.lit("typo"), i) < 0.04), swapped).otherwise(w)

    def apply(a: Column, s: Column) -> Column:
        points = F.array_join(F.transform(text.sentences(a), lambda x: F.concat(F.lit("- "), x)), "\n")
        return (
            F.when(s == "lowercase", F.lower(a))
            .when(s == "strip_punct", F.replace(F.regexp_replace(a, "[,;]", ""), F.lit("."), F.lit(" ")))
            .when(s == "typos", F.array_join(F.transform(text.words(a), typo), " "))
            .when(s == "filler", F.concat(pick(STARTS, draw(seed, key, F.lit("start"))), a))
            .otherwise(F.when(points != "", points).otherwise(a))
        )

    return F.aggregate(chosen, answer, apply)


def synthetic_answers(chunks: DataFrame, seed: int = 42, corrupted: float = 0.5) -> DataFrame:
    """(row_id, chunk_id, tier, style, answer, label): texts of graded quality made from a chunk by recipes,
    all choices drawn from digests; a share of ``corrupted`` rows gets one or two styles.

    ``chunks`` may have ``content`` (prose that an extract is taken from).  The off-topic answers are those of
    the next chunk in the order of digests, the first one's for the last: chunks are ranked by digest within
    buckets, so no window spans them all.
    """
    from .sampling import hash_order

    if "content" not in chunks.columns:
        chunks = chunks.withColumn("content", F.lit(None).cast("string"))
    key = F.col("chunk_id").cast("string")
    ranked = chunks.withColumn("_h", hash_order(seed, key))
    # the chunk with the next digest in the same bucket; a bucket's last one takes its first
    bucket = Window.partitionBy(F.substring("_h", 1, 1)).orderBy("_h", "chunk_id")
    every = Window.partitionBy(F.substring("_h", 1, 1))
    first = F.min(F.struct("_h", "chunk_id", "model_answer")).over(every)
    other = F.coalesce(F.lead(F.struct("_h", "chunk_id", "model_answer")).over(bucket), first)
    base = ranked.withColumn("_o", other).withColumn("other", F.when(F.col("_o.chunk_id") != F.col("chunk_id"), F.col("_o.model_answer"))).drop("_h", "_o")

    s, topic = text.sentences(F.col("model_answer")), F.lower("topic")
    n = F.size(s)
    shuffled = F.transform(F.array_sort(F.transform(s, lambda x, i: F.struct(draw(seed, key, F.lit("order"), i).alias("u"), x.alias("x")))), lambda x: x["x"])
    prose = F.filter(text.sentences(F.regexp_replace(F.coalesce("content", F.lit("")), r"(?s)```.*?```", " ")), lambda x: F.length(x) >= 40)
    take = 2 + F.floor(draw(seed, key, F.lit("take")) * (F.least(F.lit(4), F.size(prose)) - 1)).cast("int")
    start = F.floor(draw(seed, key, F.lit("start")) * (F.size(prose) - take + 1)).cast("int")
    extract = F.when(F.size(prose) >= 2, F.concat(F.array_join(F.slice(prose, start + 1, F.greatest(take, F.lit(0))), ". "), F.lit(".")))

    def partial(which: str) -> tuple[Column, Column]:
        """Some of the sentences in order, and a label by their share."""
        k = 1 + F.floor(draw(seed, key, F.lit(which)) * (n - 1)).cast("int")
        order = F.slice(F.array_sort(F.transform(s, lambda x, i: F.struct(draw(seed, key, F.lit(which), i).alias("u"), i.alias("i")))), 1, F.greatest(k, F.lit(0)))
        kept = F.filter(s, lambda x, i: F.exists(order, lambda o: o["i"] == i))
        return F.concat(F.array_join(kept, ". "), F.lit(".")), F.greatest(F.lit(2), F.least(F.lit(8), F.rint(2 + 7 * k / F.nullif(n, F.lit(0))).cast("int")))

    (some, worth), (some_2, worth_2) = partial("partial"), partial("partial_2")
    point = lambda p, i: F.concat(pick(LINKS, draw(seed, key, F.lit("link"), i)), p, F.lit("."))
    recipe = lambda tier, answer, label: F.struct(F.lit(tier).alias("tier"), answer.alias("answer"), (F.lit(label) if isinstance(label, int) else label).alias("label"))
    other_s = text.sentences(F.col("other"))
    recipes = F.array(
        recipe("model_answer", F.col("model_answer"), 9),
        recipe("paraphrase_lite", F.concat(pick(OPENINGS, draw(seed, key, F.lit("opening"))), F.lower(word_dropout(F.col("model_answer"), 0.15, seed, key))), 8),
        recipe("keypoint_recall", F.array_join(F.transform("key_points", point), " "), 7),
        recipe("paraphrase_heavy", word_dropout(F.array_join(shuffled, ". "), 0.3, seed + 1, key), 6),
        recipe("content_extract", extract, 7),
        recipe("partial", F.when(n >= 2, some), worth), recipe("partial_2", F.when(n >= 3, some_2), worth_2),
        recipe("fragment", F.coalesce(F.concat(F.get(s, F.lit(0)), F.lit(".")), F.col("model_answer")), 3),
        recipe("vague", F.replace(pick(VAGUE, draw(seed, key, F.lit("vague"))), F.lit("{topic}"), topic), 2),
        recipe("vague_short", pick(VAGUE_SHORT, draw(seed, key, F.lit("short"))), 2),
        recipe("question_echo", F.concat(F.lit("Honestly I am not completely sure. I guess the question is really asking about "), topic, F.lit(": "), F.col("question"), F.lit(" That is a tricky one.")), 1),
        recipe("off_topic", F.col("other"), 1), recipe("off_topic_short", F.concat(F.get(other_s, F.lit(0)), F.lit(".")), 1),
    )
    rows = base.select("chunk_id", F.inline(recipes)).where("answer IS NOT NULL")
    row_id = F.concat_ws("/", F.col("chunk_id").cast("string"), "tier")
    chosen = F.when(draw(seed, row_id, F.lit("corrupt")) < corrupted, styles(seed, row_id)).otherwise(F.array().cast("array<string>"))
    rows = rows.select(row_id.alias("row_id"), "chunk_id", "tier", chosen.alias("style"), "answer", "label")
    return rows.withColumn("answer", corrupt(F.col("answer"), F.col("style"), seed, F.col("row_id")))

"""Transcript analytics: word error rates, lexicon terms, communication metrics, keyterms, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..plans.broadcasts import small_side

FIRST_CODE = 0x100  # 55,000 code points from here stand for the distinct tokens of a pair


def word_distance(ref: Column, hyp: Column) -> Column:
    """Word-level edit distance: each distinct token of the pair becomes one character."""
    known = F.array_distinct(F.concat(ref, hyp))
    coded = lambda a: F.array_join(F.transform(a, lambda t: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, t) + FIRST_CODE), 4, "0")), "UTF-16BE")), "")
    return F.levenshtein(coded(ref), coded(hyp))


def wer(ref: Column, hyp: Column) -> Column:
    return word_distance(ref, hyp) / F.greatest(F.lit(1), F.size(ref))


def lexicon(entries: DataFrame) -> DataFrame:
    """(pos, term, tokens, canonical, forms): distinct terms in order, with the collapsed forms of the term
    and its aliases.  ``entries`` has pos, term, aliases."""
    first = entries.withColumn("_r", F.row_number().over(Window.partitionBy(F.lower("term")).orderBy("pos"))).where("_r = 1").drop("_r")
    forms = F.array_distinct(F.filter(F.transform(F.concat(F.array("term"), F.coalesce("aliases", F.array())), lambda a: text.canonical(text.spoken_tokens(a))), lambda f: f != ""))
    out = first.withColumn("tokens", text.spoken_tokens(F.col("term"))).where(F.size("tokens") > 0)
    return out.withColumn("canonical", text.canonical(F.col("tokens"))).withColumn("forms", forms)


def _runs(items: DataFrame, sizes: DataFrame, tokens_col: str, glue: str) -> DataFrame:
    """(item, start, n, run): the token runs of each length in ``sizes`` (n), joined by ``glue``."""
    lengths = sizes.agg(F.array_sort(F.collect_set("n")).alias("ns"))  # one row: distinct lengths of terms
    toks = items.select("item", F.col(tokens_col).alias("toks")).crossJoin(F.broadcast(lengths))
    starts = toks.select("item", "toks", F.explode("ns").alias("n")).where("n > 0 AND n <= size(toks)")
    starts = starts.select("item", "toks", "n", F.explode(F.sequence(F.lit(1), F.size("toks") - F.col("n") + 1)).alias("start"))
    return starts.select("item", "start", "n", F.array_join(F.slice("toks", F.col("start"), F.col("n")), glue).alias("run"))


def strict_hits(items: DataFrame, lex: DataFrame, tokens_col: str) -> DataFrame:
    """(item, term, found): contiguous token runs equal to the term's tokens, overlaps counted.  Runs are as
    long as the lexicon's terms are."""
    terms = lex.select("term", F.array_join("tokens", " ").alias("run"), F.size("tokens").alias("n"))
    return _runs(items, terms, tokens_col, " ").drop("n").join(small_side(terms.drop("n")), "run").groupBy("item", "term").agg(F.count(F.lit(1)).alias("found"))


def lenient_hits(items: DataFrame, lex: DataFrame, tokens_col: str) -> DataFrame:
    """(item, term, found): runs whose collapsed form is one of the term's forms; the shortest run per start.

    A form of c characters is a run of c tokens at most (none is empty), so every length up to the longest
    form is looked at; runs longer than that in characters are not built."""
    forms = lex.select("term", F.explode("forms").alias("run"))
    longest = forms.agg(F.coalesce(F.max(F.length("run")), F.lit(0)).alias("most"))
    toks = items.select("item", F.filter(tokens_col, lambda t: t != "").alias("toks")).crossJoin(F.broadcast(longest))
    starts = toks.select("item", "toks", "most", F.posexplode(F.col("toks")).alias("at", "first")).where(F.length("first") <= F.col("most"))
    # prefixes of the text from each start on, as long as they may still be a form
    grown = F.aggregate(
        F.slice("toks", F.col("at") + 1, F.least(F.col("most"), F.size("toks") - F.col("at"))),
        F.struct(F.lit("").alias("run"), F.array().cast("array<string>").alias("runs")),
        lambda s, t: F.when(F.length(s["run"]) + F.length(t) <= F.col("most"), F.struct(F.concat(s["run"], t).alias("run"), F.concat(s["runs"], F.array(F.concat(s["run"], t))).alias("runs")))
        .otherwise(F.struct(F.rpad(s["run"], F.col("most") + 1, "\x00").alias("run"), s["runs"].alias("runs"))),
        lambda s: s["runs"],
    )
    runs = starts.select("item", "at", F.posexplode(grown).alias("n", "run"))
    return runs.join(small_side(forms), "run").groupBy("item", "term", "at").agg(F.min("n").alias("n")).groupBy("item", "term").agg(F.count(F.lit(1)).alias("found"))


def term_errors(items: DataFrame, lex: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """(item, term, count, strict, lenient): occurrences in the reference and how many were recovered."""
    need = strict_hits(items, lex, ref).withColumnRenamed("found", "count")
    strict = strict_hits(items, lex, hyp).withColumnRenamed("found", "s")
    lenient = lenient_hits(items, lex, hyp).withColumnRenamed("found", "l")
    return need.join(strict, ["item", "term"], "left").join(lenient, ["item", "term"], "left").select(
        "item", "term", "count", F.least("count", F.coalesce("s", F.lit(0))).alias("strict"), F.least("count", F.coalesce("l", F.lit(0))).alias("lenient")
    )


def term_summary(errors: DataFrame) -> DataFrame:
    """(term, count, strict_hits, lenient_hits, rate): totals and the failure rate without leniency 1 - hits / count."""
    return errors.groupBy("term").agg(F.sum("count").alias("count"), F.sum("strict").alias("strict_hits"), F.sum("lenient").alias("lenient_hits")).withColumn(
        "rate", F.round(1 - F.col("lenient_hits") / F.col("count"), 3)
    )


def keyterms(lex: DataFrame, rates: DataFrame, priority: list[str], n: int = 50, max_len: int = 20) -> DataFrame:
    """(place, form): the terms that need help most: 3 * failure rate + 1 if wanted by the session + rarity,
    less 1 if seen twice and never missed; ties in lexicon order, each written form once."""
    form = F.coalesce("short", "term")
    rarity = F.when(F.coalesce("common", F.lit(False)), 0.0).when(F.col("term").contains(" "), 0.5).otherwise(1.0)
    fail, seen = F.coalesce("rate", F.lit(0.0)), F.coalesce("observed", F.lit(0))
    score = 3 * fail + F.when(F.lower("term").isin(*[p.lower() for p in priority]), 1.0).otherwise(0.0) + rarity - F.when((seen >= 2) & (fail == 0), 1.0).otherwise(0.0)
    scored = lex.join(rates, "term", "left").where(F.length(form) <= max_len).select("pos", form.alias("form"), F.round(score, 6).alias("score"))
    first = scored.withColumn("_r", F.row_number().over(Window.partitionBy(F.lower("form")).orderBy(F.desc("score"), "pos"))).where("_r = 1")
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "pos"))).where(F.col("place") <= n).select("place", "form")


def naive_keyterms(lex: DataFrame, n: int = 50, max_len: int = 20) -> DataFrame:
    """(place, form): the first terms in lexicon order, without any measurement."""
    fit = lex.select("pos", F.coalesce("short", "term").alias("form")).where(F.length("form") <= max_len).orderBy("pos").limit(n)
    return fit.select(F.row_number().over(Window.orderBy("pos")).alias("place"), "form")


def batch_keyterms(lex: DataFrame, max_terms: int = 1000, max_len: int = 49) -> DataFrame:
    """(place, form): all terms that fit a batch request, each followed by its aliases if it offers them
    (``alias_keyterms``)."""
    ok = (F.length("term") < max_len) & (F.size(text.words(F.col("term"))) <= 5) & ~F.col("term").rlike(r"[<>{}\[\]\\]")
    aliases = F.when(F.coalesce("alias_keyterms", F.lit(False)), F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.length(a) < max_len)).otherwise(F.array().cast("array<string>"))
    forms = F.concat(F.when(ok, F.array("term")).otherwise(F.array().cast("array<string>")), aliases)
    rows = lex.select("pos", F.posexplode(forms).alias("k", "form")).orderBy("pos", "k").limit(max_terms)
    return rows.select(F.row_number().over(Window.orderBy("pos", "k")).alias("place"), "form")


def cross_fitted(items: DataFrame, lex: DataFrame, priority: list[str], n: int = 50, max_len: int = 20) -> DataFrame:
    """(fold, place, form): the keyterms for each of two folds of ``items`` (item, fold, ref, hyp), chosen by the
    failure rates measured on the other fold."""
    errors = term_errors(items, lex).join(items.select("item", "fold"), "item")
    out = None
    for fold in (0, 1):
        rates = term_summary(errors.where(F.col("fold") != fold)).select("term", "rate", F.col("count").alias("observed"))
        chosen = keyterms(lex, rates, priority, n, max_len).select(F.lit(fold).alias("fold"), "place", "form")
        out = chosen if out is None else out.unionByName(chosen)
    return out


def priority_terms(texts: DataFrame, lex: DataFrame) -> DataFrame:
    """(session, term): the lexicon's terms that occur in a session's own material (session, text)."""
    joined = texts.where(F.coalesce("text", F.lit("")) != "").groupBy("session").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("text"))
    items = joined.select(F.col("session").alias("item"), text.spoken_tokens(F.col("text")).alias("toks"))
    return strict_hits(items, lex, "toks").select(F.col("item").alias("session"), "term")


def session_keyterms(texts: DataFrame, lex: DataFrame, rates: DataFrame, n: int = 50, max_len: int = 20) -> DataFrame:
    """(session, place, form): ``keyterms`` for every session at once, wanted being what its material names."""
    form = F.coalesce("short", "term")
    rarity = F.when(F.coalesce("common", F.lit(False)), 0.0).when(F.col("term").contains(" "), 0.5).otherwise(1.0)
    fail, seen = F.coalesce("rate", F.lit(0.0)), F.coalesce("observed", F.lit(0))
    base = lex.join(rates, "term", "left").where(F.length(form) <= max_len)
    base = base.select("pos", "term", form.alias("form"), (3 * fail + rarity - F.when((seen >= 2) & (fail == 0), 1.0).otherwise(0.0)).alias("base"))
    wanted = priority_terms(texts, lex).withColumn("bonus", F.lit(1.0))
    scored = texts.select("session").distinct().join(small_side(base)).join(wanted, ["session", "term"], "left")
    scored = scored.withColumn("score", F.round(F.col("base") + F.coalesce("bonus", F.lit(0.0)), 6))
    order = [F.desc("score"), F.col("pos")]
    first = scored.withColumn("_r", F.row_number().over(Window.partitionBy("session", F.lower("form")).orderBy(*order))).where("_r = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy(*order))).where(F.col("place") <= n).select("session", "place", "form")


def misrecognised(items: DataFrame, lex: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """(item, term, became): for each term that was not recovered everywhere, what each of its occurrences became
    in the hypothesis, ``(dropped)`` if nothing did."""
    from ..functions.udfs import aligned

    lost = term_errors(items, lex, ref, hyp).where("lenient < count").select("item", "term")
    terms = lex.select("term", "tokens")
    named = items.join(lost.select("item").distinct(), "item").select("item", F.col(ref).alias("r"), aligned(F.col(ref), F.col(hyp)).alias("became"))
    pairs = lost.join(small_side(terms), "term").join(named, "item")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size("r") - F.size("tokens"), F.lit(0))), lambda i: F.slice("r", i + 1, F.size("tokens")) == F.col("tokens"))
    spans = pairs.select("item", "term", "tokens", "became", F.explode(starts).alias("at"))
    pieces = F.filter(F.slice("became", F.col("at") + 1, F.size("tokens")), lambda x: x != "")
    once = F.filter(pieces, lambda x, i: (i == 0) | (x != F.element_at(pieces, F.greatest(i, F.lit(1)))))
    return spans.select("item", "term", F.coalesce(F.nullif(F.array_join(once, " "), F.lit("")), F.lit("(dropped)")).alias("became"))


def misrecognitions(found: DataFrame) -> DataFrame:
    """(term, became, n): how often a term became what."""
    return found.groupBy("term", "became").agg(F.count(F.lit(1)).alias("n"))


def audit(corrections: DataFrame, items: DataFrame, lex: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """(item, applied, false): corrections (item, seq, term) to a term that the reference does not need, having
    no more occurrences than the hypothesis had and earlier corrections have granted."""
    need = strict_hits(items, lex, ref).withColumnRenamed("found", "need")
    had = strict_hits(items, lex, hyp).withColumnRenamed("found", "had")
    n = corrections.groupBy("item", "term").agg(F.count(F.lit(1)).alias("n"))
    j = n.join(need, ["item", "term"], "left").join(had, ["item", "term"], "left")
    granted = F.least("n", F.greatest(F.coalesce("need", F.lit(0)) - F.coalesce("had", F.lit(0)), F.lit(0)))
    return j.groupBy("item").agg(F.sum("n").alias("applied"), F.sum(F.col("n") - granted).alias("false"))


def compare_live(entries: DataFrame, lex: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Live against final transcripts (session, turn, live, final): per turn (session, turn, wer, terms_fixed), and
    per session (answers_compared, wer, terms_fixed_total).  Entries that lack either side are left out."""
    both = entries.where((F.trim(F.coalesce("live", F.lit(""))) != "") & (F.trim(F.coalesce("final", F.lit(""))) != ""))
    items = both.select(
        F.struct("session", "turn").alias("item"), text.spoken_tokens(F.col("final")).alias("ref"), text.spoken_tokens(F.col("live")).alias("hyp")
    ).where(F.size("ref") > 0)
    fixed = term_errors(items, lex).where("lenient < count").groupBy("item").agg(F.array_sort(F.collect_set("term")).alias("terms_fixed"))
    rows = items.select("item", word_distance(F.col("ref"), F.col("hyp")).alias("d"), F.size("ref").alias("n")).join(fixed, "item", "left")
    rows = rows.withColumn("terms_fixed", F.coalesce("terms_fixed", F.array().cast("array<string>")))
    turns = rows.select("item.session", "item.turn", F.round(F.col("d") / F.col("n"), 3).alias("wer"), "terms_fixed")
    totals = rows.groupBy("item.session").agg(
        F.count(F.lit(1)).alias("answers_compared"), F.round(F.sum("d") / F.greatest(F.lit(1), F.sum("n")), 3).alias("wer"), F.sum(F.size("terms_fixed")).alias("terms_fixed_total")
    )
    return turns, totals


def verdict_flips(live: DataFrame, final: DataFrame) -> DataFrame:
    """One row (verdicts_checked, flips) from verdicts per key point (row_id, pos, verdict) of both texts."""
    j = live.withColumnRenamed("verdict", "l").join(final.withColumnRenamed("verdict", "f"), ["row_id", "pos"])
    return j.agg(F.count(F.lit(1)).alias("verdicts_checked"), F.count_if(F.col("l") != F.col("f")).alias("flips"))


def condition(items: DataFrame, lex: DataFrame, grades: DataFrame | None = None, worst: int = 12) -> tuple[DataFrame, DataFrame]:
    """One condition's evaluation over ``items`` (item, ref, hyp): (summary of one row, the worst terms).

    ``grades`` (item, ref_score, hyp_score, kp_total, kp_flips) gives the damage that transcription does to
    grades: mean absolute difference, share of a point or more, share of flipped verdicts."""
    w = items.select(word_distance(F.col("ref"), F.col("hyp")).alias("d"), F.size("ref").alias("words"))
    summary = w.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d") / F.greatest(F.lit(1), F.sum("words")), 6).alias("wer"))
    errors = term_errors(items, lex)
    share = lambda c: F.coalesce(F.round(1 - F.sum(c) / F.nullif(F.sum("count"), F.lit(0)), 6), F.lit(0.0))
    summary = summary.crossJoin(errors.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("occurrences"), share("strict").alias("ter_strict"), share("lenient").alias("ter_lenient")))
    if grades is not None:
        gap = F.abs(F.col("ref_score") - F.col("hyp_score"))
        summary = summary.crossJoin(grades.agg(
            F.count(F.lit(1)).alias("damage_n"), F.round(F.avg(gap), 6).alias("mean_abs"), F.round(F.avg(F.when(gap >= 1, 1.0).otherwise(0.0)), 6).alias("ge1_rate"),
            F.round(F.try_divide(F.sum("kp_flips"), F.sum("kp_total")), 6).alias("kp_flip_rate"),
        ))
    top4 = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "became"))), 1, 4), lambda x: F.struct(x["became"].alias("became"), (-x["m"]).alias("n")))
    became = misrecognitions(misrecognised(items, lex)).groupBy("term").agg(top4.alias("became"))
    terms = errors.groupBy("term").agg(F.sum("count").alias("count"), (F.sum("count") - F.sum("lenient")).alias("lenient_misses"), (F.sum("count") - F.sum("strict")).alias("strict_misses"))
    return summary, terms.where("lenient_misses > 0").join(became, "term", "left").orderBy(F.desc("lenient_misses"), "term").limit(worst)


def communication(turns: DataFrame, by: str) -> DataFrame:
    """Metrics of the answers of each conversation: (by, answers, words, fillers, timing), timing null
    where nothing was timed.  ``turns`` has by, answer, answer_ms."""
    a = turns.where(F.trim(F.coalesce("answer", F.lit(""))) != "").select(
        by, F.size(text.word_run(F.col("answer"))).alias("w"), text.filler_count(F.col("answer")).alias("f"), (F.nullif(F.col("answer_ms"), F.lit(0)) / 1000.0).alias("s")
    )
    timed = F.col("s").isNotNull()
    minutes = F.sum("s") / 60
    return a.groupBy(by).agg(
        F.count(F.lit(1)).alias("answers"), F.sum("w").alias("total_words"), F.round(F.avg("w"), 1).alias("avg_words"),
        F.max("w").alias("longest_words"), F.min("w").alias("shortest_words"),
        F.round(F.try_divide(F.stddev_pop("w"), F.avg("w")), 2).alias("length_balance_cv"),
        F.sum("f").alias("filler_total"), F.round(100 * F.sum("f") / F.greatest(F.sum("w"), F.lit(1)), 1).alias("filler_per_100_words"),
        F.round(F.avg("s"), 1).alias("avg_answer_seconds"), F.round(F.max("s"), 1).alias("longest_answer_seconds"), F.round(F.min("s"), 1).alias("shortest_answer_seconds"),
        F.round(F.try_divide(F.sum(F.when(timed, F.col("w"))), minutes), 0).alias("words_per_minute"),
        F.round(F.try_divide(F.sum(F.when(timed, F.col("f"))), minutes), 1).alias("fillers_per_minute"),
    )


def pooled_wer(items: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """One row: edits over words of all items together, and the mean of the items' own rates."""
    d = items.select(word_distance(F.col(ref), F.col(hyp)).alias("d"), F.size(ref).alias("n"))
    return d.agg(F.round(F.sum("d") / F.greatest(F.sum("n"), F.lit(1)), 6).alias("pooled"), F.round(F.avg(F.col("d") / F.greatest(F.lit(1), F.col("n"))), 6).alias("mean"))

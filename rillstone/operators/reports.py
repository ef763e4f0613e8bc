"""Reporting and test-set assembly: transcripts, rubric verdicts, suites, attempts, samples, runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric, text


def lines_in_order(order: Column, line: Column, sep: str = "\n") -> Column:
    """Aggregate: the lines of a group joined in the given order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"]), sep)


def transcript_text(turns: DataFrame) -> DataFrame:
    """(conv_id, transcript): question and answer per turn, the final text before the live one."""
    said = F.coalesce(F.nullif(F.trim("answer_final"), F.lit("")), F.col("answer"), F.lit(""))
    return turns.groupBy("conv_id").agg(lines_in_order(F.col("turn"), F.concat(F.lit("Q: "), F.col("question"), F.lit("\nA: "), said)).alias("transcript"))


def graded_text(final: Column, live: Column, voice: Column) -> Column:
    """The text that is graded: the final transcript, else the live one; spoken text normalised."""
    chosen = F.coalesce(F.nullif(F.trim(final), F.lit("")), live)
    return F.when(voice, F.array_join(text.spoken_tokens(chosen), " ")).otherwise(chosen)


def rubric_verdicts(probes: DataFrame, turns: DataFrame, points: DataFrame) -> DataFrame:
    """(probe_id, hits, partials, misses) of answered probes with a rubric: (probe_id, chunk_id), (probe_id,
    answer) and (probe_id, point, verdict)."""
    answered = turns.where(F.trim(F.coalesce("answer", F.lit(""))) != "").select("probe_id").distinct()
    of = lambda v: F.array_sort(F.collect_list(F.when(F.col("verdict") == v, F.col("point")))).alias({"hit": "hits", "partial": "partials", "miss": "misses"}[v])
    return probes.where("chunk_id IS NOT NULL").join(answered, "probe_id", "left_semi").join(points, "probe_id").groupBy("probe_id").agg(of("hit"), of("partial"), of("miss"))


def complete_suite(expected: DataFrame, results: DataFrame) -> DataFrame:
    """(suite, ord, case, ok, note): every expected case once; the first unreported one timed out, the rest
    did not run."""
    j = expected.join(results, ["suite", "case"], "left")
    missing = F.row_number().over(Window.partitionBy("suite", F.col("ok").isNull()).orderBy("ord"))
    note = F.when(F.col("ok").isNotNull(), F.col("note")).when(missing == 1, "timed out").otherwise("not run")
    return j.select("suite", "ord", "case", F.coalesce("ok", F.lit(False)).alias("ok"), note.alias("note"))


def valid_suites(completed: DataFrame) -> DataFrame:
    """(suite, valid, first_failure): a suite is valid if the reference passes every case."""
    return completed.groupBy("suite").agg(F.bool_and("ok").alias("valid"), F.min_by("case", F.when(~F.col("ok"), F.col("ord"))).alias("first_failure"))


def attempt_report(events: DataFrame) -> DataFrame:
    """(attempt, messages, runs, failed_runs, hints, last_check, blocker) from (attempt, t, kind, failed,
    level, state): a check always tells what blocks, a run only if it failed."""
    informative = (F.col("kind") == "check") | ((F.col("kind") == "run") & F.col("failed"))
    return events.groupBy("attempt").agg(
        F.count_if(F.col("kind") == "message").alias("messages"), F.count_if(F.col("kind").isin("run", "check")).alias("runs"), F.count_if("failed").alias("failed_runs"),
        F.max("level").alias("hint_max"), F.max_by(F.when(F.col("kind") == "check", F.col("state")), F.when(F.col("kind") == "check", F.col("t"))).alias("last_check"),
        F.coalesce(F.max_by("state", F.when(informative, F.col("t"))), F.lit("start")).alias("blocker"),
    )


def merge_watchouts(notes: DataFrame, new_max: int = 3) -> DataFrame:
    """(attempt, watchouts): notes in order (attempt, seq, ordinal, wording): an ordinal updates that entry's
    count, a new wording is added under its slug while fewer than ``new_max`` were; the first wording stays."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[list] = []
        added = 0
        for ordinal, wording in rows.sort_values("seq")[["ordinal", "wording"]].itertuples(index=False):
            slug = "-".join(str(wording).lower().split())
            known = next((k for k in kept if k[0] == slug), None)
            if ordinal == ordinal and ordinal is not None and 0 < ordinal <= len(kept):
                kept[int(ordinal) - 1][2] += 1
            elif known:
                known[2] += 1
            elif added < new_max:
                kept.append([slug, wording, 1])
                added += 1
        return pd.DataFrame({"attempt": [rows["attempt"].iloc[0]], "watchouts": [[f"{w} ({n})" for _, w, n in kept]]})

    return notes.groupBy("attempt").applyInPandas(fold, "attempt long, watchouts array<string>")


def session_keys(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, tier, log): unknown and revoked keys are anonymous; any tier but paid is free."""
    known = keys.where("revoked_at IS NULL").select("key", F.when(F.col("tier") == "paid", "paid").otherwise("free").alias("tier"), F.coalesce("log", F.lit(True)).alias("log"))
    return asked.join(known, "key", "left").select("key", F.coalesce("tier", F.lit("anonymous")).alias("tier"), F.coalesce("log", F.lit(False)).alias("log"))


def noise_floor(regrades: DataFrame) -> DataFrame:
    """One row from (key, first, second): how far two grades of the same text lie apart."""
    d = F.abs(F.col("first") - F.col("second"))
    return regrades.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(d >= 1, 1.0).otherwise(0.0)), 6).alias("share_off"), F.round(F.avg(d), 6).alias("mean_abs"))


def billed(seconds: Column, rate_per_hour: float, minimum: float = 0.0, surcharge: float = 0.0) -> Column:
    return F.greatest(seconds, F.lit(minimum)) / 3600 * (rate_per_hour + surcharge)


def spot_check(pool: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored pairs, undecided keys of the pool, keys outside the pool)."""
    keys = ["probe_id", "chunk_id"]
    v = verdicts.withColumn("label", text.normalize_label(F.col("verdict")))
    return pool.join(v.where("label IS NOT NULL"), keys), pool.join(v.where("label IS NOT NULL"), keys, "left_anti"), v.join(pool, keys, "left_anti")


def composition(sample: DataFrame) -> DataFrame:
    """(facet, value, n): counts by label, bank and each of the policies."""
    facets = F.array(F.struct(F.lit("label").alias("facet"), F.array("label").alias("vs")), F.struct(F.lit("bank").alias("facet"), F.array("bank").alias("vs")), F.struct(F.lit("policy").alias("facet"), F.col("policies").alias("vs")))
    return sample.select(F.inline(facets)).select("facet", F.explode("vs").alias("value")).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def best_arm(runs: DataFrame, metric: str = "qwk") -> DataFrame:
    """(arm, mean, sd, seeds) of the arm with the highest mean; smoke and serving runs are left out."""
    kept = runs.where(~F.col("file").rlike("smoke|^serve_"))
    per = kept.groupBy("arm").agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("sd"), F.count(F.lit(1)).alias("seeds"))
    return per.orderBy(F.desc("mean"), "arm").limit(1)


def collect_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """The JSON documents that match a glob, with ``name`` (the arm, ``-silver`` for that variant) and the
    file; smoke and serving runs are left out, the last file of a name and seed counts."""
    runs = spark.read.option("multiLine", True).json(pattern).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    for column, kind in (("smoke", "boolean"), ("variant", "string")):
        if column not in runs.columns:
            runs = runs.withColumn(column, F.lit(None).cast(kind))
    kept = runs.where(~F.coalesce(F.col("smoke"), F.lit(False)) & ~F.col("file").startswith("serve_"))
    kept = kept.withColumn("name", F.concat("arm", F.when(F.col("variant") == "silver", "-silver").otherwise("")))
    last = F.row_number().over(Window.partitionBy("name", "seed").orderBy(F.desc("file")))
    return kept.withColumn("_r", last).where("_r = 1").drop("_r")


def coverage_split(probes: DataFrame, candidates: DataFrame, arm: str = "bm25") -> DataFrame:
    """(split, total, covered, uncovered) of probes (probe_id, covered) and candidates (probe_id, label,
    attached_by): probes that ``arm`` leaves ungrounded, and candidates that each arm attaches unfairly - was a
    fair chunk there (a retrieval miss) or not (a content gap)?  A probe without a label is an error."""
    bad = ~F.coalesce(F.col("covered").isin("covered", "uncovered"), F.lit(False))
    checked = probes.where(F.when(bad, F.raise_error(F.concat(F.lit("no label: "), F.col("probe_id").cast("string"))).cast("boolean")).otherwise(F.lit(True)))
    counts = [F.count(F.lit(1)).alias("total"), F.count_if(F.col("covered") == "covered").alias("covered"), F.count_if(F.col("covered") == "uncovered").alias("uncovered")]
    grounded = candidates.where(F.array_contains("attached_by", arm)).select("probe_id").distinct()
    ungrounded = checked.join(grounded, "probe_id", "left_anti").agg(*counts).select(F.lit(f"ungrounded_{arm}").alias("split"), "total", "covered", "uncovered")
    unfair = candidates.where(F.col("label") == "no").select("probe_id", F.explode("attached_by").alias("arm")).join(checked.select("probe_id", "covered"), "probe_id")
    return ungrounded.unionByName(unfair.groupBy("arm").agg(*counts).select(F.concat(F.lit("unfair_"), "arm").alias("split"), "total", "covered", "uncovered"))


def policy_stats(decisions: DataFrame, fair: DataFrame, precision_min: float, coverage_min: float) -> DataFrame:
    """(policy, attached, fair, precision, coverage, attach_rate, passes) of decisions (probe_id, policy, chunk_id;
    null: nothing attached) and fair pairs (probe_id, chunk_id)."""
    n = decisions.agg(F.count_distinct("probe_id").alias("n"))
    judged = decisions.join(fair.select("probe_id", "chunk_id").distinct().withColumn("ok", F.lit(1)), ["probe_id", "chunk_id"], "left")
    per = judged.groupBy("policy").agg(F.count("chunk_id").alias("attached"), F.count(F.when(F.col("chunk_id").isNotNull(), F.col("ok"))).alias("fair"))
    precision, coverage = F.try_divide(F.col("fair"), F.col("attached")), F.col("fair") / F.col("n")
    passes = F.coalesce((precision >= precision_min) & (coverage >= coverage_min), F.lit(False))
    return per.crossJoin(F.broadcast(n)).select(
        "policy", "attached", "fair", F.round(precision, 4).alias("precision"), F.round(coverage, 4).alias("coverage"),
        F.round(F.col("attached") / F.col("n"), 4).alias("attach_rate"), passes.alias("passes"),
    )


def policy_winner(stats: DataFrame, simplest_first: list[str]) -> DataFrame:
    """The passing policy of the highest coverage, the simpler one at a tie: one row or none."""
    rank = F.array_position(F.array(*map(F.lit, simplest_first)), F.col("policy"))
    return stats.where("passes").orderBy(F.desc("coverage"), rank).limit(1)


def sentence_candidates(docs: DataFrame, low: int = 8, high: int = 32) -> DataFrame:
    """(id, n, sentence): clean prose of ``low`` to ``high`` words that begins with a capital or a digit."""
    s = docs.select("id", F.posexplode(F.split(F.regexp_replace("text", r"(?s)```.*?```", " "), r"(?<=[.!?])\s+")).alias("n", "sentence"))
    n = F.size(text.words(F.col("sentence")))
    return s.where(n.between(low, high) & F.col("sentence").rlike(r"^[\p{Lu}\p{N}]") & ~F.col("sentence").rlike(r"[{}<>=_`|\\]|\(\)"))


def trimmed_answer(sentences: DataFrame, cap: int = 70, least: int = 35) -> DataFrame:
    """(id, answer, words): leading sentences while they fit into ``cap`` words, if that makes ``least``."""
    w = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    counted = sentences.withColumn("w", F.size(text.words(F.col("sentence")))).withColumn("upto", F.sum("w").over(w)).where(F.col("upto") <= cap)
    return counted.groupBy("id").agg(lines_in_order(F.col("n"), F.col("sentence"), " ").alias("answer"), F.sum("w").alias("words")).where(F.col("words") >= least)


def build_lexicon(curated: DataFrame, corpus: DataFrame, extra: DataFrame) -> DataFrame:
    """(term, source): curated terms, then corpus terms that no term or alias names, then extras."""
    ranked = None
    for k, (name, d) in enumerate((("curated", curated), ("corpus", corpus), ("extra", extra))):
        aliases = F.coalesce("aliases", F.array()) if "aliases" in d.columns else F.array().cast("array<string>")
        one = d.select("pos", "term", aliases.alias("aliases"), F.lit(name).alias("source"), F.lit(k).alias("k"))
        ranked = one if ranked is None else ranked.unionByName(one)
    names = ranked.select("term", "source", "k", "pos", F.explode(F.array_distinct(F.transform(F.concat(F.array("term"), "aliases"), lambda x: F.lower(x)))).alias("name"))
    owner = names.groupBy("name").agg(F.min_by("term", F.struct("k", "pos")).alias("owner"))
    own = ranked.join(owner, F.lower("term") == F.col("name")).where("owner = term")
    return own.groupBy("term").agg(F.min_by("source", F.struct("k", "pos")).alias("source"))


def interleaved(items: DataFrame, key: str, seed: int) -> DataFrame:
    return items.orderBy(numeric.hash_order(seed, F.col(key)), key)


def pick(seed: Column, options: list[str]) -> Column:
    """One of the options by the digest of the seed."""
    at = F.pmod(F.conv(F.substring(F.sha1(seed), 1, 8), 16, 10).cast("bigint"), F.lit(len(options))).cast("int")
    return F.element_at(F.array(*map(F.lit, options)), at + 1)


def keywords(t: Column, n: int = 8) -> Column:
    """First distinct content words, without regard to case."""
    return F.slice(F.filter(F.array_distinct(text.tokens(t)), lambda w: (F.length(w) > 3) & ~w.isin(*text.STOP_WORDS)), 1, n)


def loop_summary(rows: DataFrame) -> DataFrame:
    """One row from (wer, cut_off, latency_ms): the mean of the answers' rates, the cut-off rate over all
    rows, and latency percentiles, where a latency of 0 is a measurement."""
    return rows.agg(
        F.round(F.avg("wer"), 6).alias("mean_wer"), F.round(F.avg(F.when(F.col("cut_off"), 1.0).otherwise(0.0)), 6).alias("cut_off_rate"),
        F.median("latency_ms").alias("p50"), F.percentile("latency_ms", 0.95).alias("p95"),
    )

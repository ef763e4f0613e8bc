"""Evaluation analytics: agreement of grades, classification scores, sweeps and rule verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import grade


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the average rank of ``column``.  Ranks come from the counts of distinct values, which are summed
    up in order; the rows themselves are never sorted in one place."""
    counts = df.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranks = counts.select("_v", (upto - (F.col("_n") - 1) / 2.0).alias(name))
    return df.join(ranks, df[column].eqNullSafe(ranks["_v"])).drop("_v")


def grade_metrics(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """One row: n, MAE, share within 1, exact share, Spearman and quadratic weighted kappa on labels 1..10."""
    t, p = grade(F.col(truth)), grade(F.col(pred))
    base = average_rank(average_rank(df.select(F.col(truth).alias("y"), F.col(pred).alias("z"), t.alias("t"), p.alias("p")), "y", "ry"), "z", "rz")
    flat = base.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(F.col("y") - F.col("z"))).alias("mae"),
        F.avg(F.when(F.abs(F.col("t") - F.col("p")) <= 1, 1.0).otherwise(0.0)).alias("within1"),
        F.avg(F.when(F.col("t") == F.col("p"), 1.0).otherwise(0.0)).alias("exact"),
        F.corr("ry", "rz").alias("spearman"),
        F.sum(F.pow(F.col("t") - F.col("p"), 2)).alias("observed"),
        F.sum("t").alias("st"), F.sum("p").alias("sp"), F.sum(F.col("t") * F.col("t")).alias("stt"), F.sum(F.col("p") * F.col("p")).alias("spp"),
    )
    # sum over i, j of (i - j)^2 n_i m_j / n, from the moments of both margins
    expected = F.col("stt") + F.col("spp") - 2 * F.col("st") * F.col("sp") / F.col("n")
    r = lambda c: F.round(c, 6)
    return flat.select(
        "n", r(F.col("mae")).alias("mae"), r(F.col("within1")).alias("within1"), r(F.col("exact")).alias("exact"),
        r(F.col("spearman")).alias("spearman"), r(1 - F.try_divide(F.col("observed"), expected)).alias("qwk"),
    )


def label_scores(df: DataFrame, truth: str, pred: str, hit: str = "hit") -> DataFrame:
    """One row: accuracy, macro F1 over the labels present on either side, F1 of ``hit``."""
    both = df.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("x"))
    margins = both.groupBy("x.label").agg(F.sum("x.t").alias("nt"), F.sum("x.p").alias("np"))
    right = df.where(F.col(truth) == F.col(pred)).groupBy(F.col(truth).alias("label")).agg(F.count(F.lit(1)).alias("tp"))
    f1 = margins.join(right, "label", "left").withColumn("f1", F.coalesce(F.try_divide(2.0 * F.coalesce("tp", F.lit(0)), F.col("nt") + F.col("np")), F.lit(0.0)))
    return f1.agg(
        F.round(F.sum(F.coalesce("tp", F.lit(0))) / F.sum("nt"), 6).alias("accuracy"),
        F.round(F.avg("f1"), 6).alias("macro_f1"),
        F.round(F.coalesce(F.max(F.when(F.col("label") == hit, F.col("f1"))), F.lit(0.0)), 6).alias("hit_f1"),
    )


def kappa(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Unweighted Cohen's kappa, per group if ``by``; null where chance agreement is 1."""
    by = by or []
    cells = df.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    margin = lambda side: cells.groupBy(*by, F.col(side).alias("label")).agg(F.sum("n").alias(f"n{side}"))
    chance = margin("a").join(margin("b"), [*by, "label"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("cross"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agree"))
    joined = (total.join(chance, by, "left") if by else total.crossJoin(F.broadcast(chance))).withColumn("pe", F.coalesce("cross", F.lit(0)) / (F.col("n") * F.col("n")))
    po = F.col("agree") / F.col("n")
    return joined.select(*by, "n", F.round(po, 6).alias("agreement"), F.round(F.when(F.col("pe") < 1, (po - F.col("pe")) / F.nullif(1 - F.col("pe"), F.lit(0.0))), 6).alias("kappa"))


def auc(df: DataFrame, positive: str, score: str) -> DataFrame:
    """Area under the ROC curve by average ranks; null with one class only."""
    ranked = average_rank(df.select(F.col(positive).alias("y"), F.col(score).alias("s")), "s", "r")
    one = ranked.agg(F.count_if("y").alias("n1"), F.count_if(~F.col("y")).alias("n0"), F.sum(F.when(F.col("y"), F.col("r"))).alias("sum1"))
    return one.select("n1", "n0", F.round(F.try_divide(F.col("sum1") - F.col("n1") * (F.col("n1") + 1) / 2.0, F.col("n1") * F.col("n0")), 6).alias("auc"))


def threshold_sweep(df: DataFrame) -> DataFrame:
    """(threshold, attached, precision, attach_rate) at each distinct score: what lies at or above it.
    Rows meet per distinct score first, so the running sums are over scores, not rows."""
    by = df.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.count_if("relevant").alias("r"))
    w = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    total = by.agg(F.sum("n").alias("all"))
    swept = by.select("score", F.sum("n").over(w).alias("attached"), F.sum("r").over(w).alias("r")).crossJoin(F.broadcast(total))
    return swept.select(
        F.col("score").alias("threshold"), "attached", F.round(F.col("r") / F.col("attached"), 6).alias("precision"), F.round(F.col("attached") / F.col("all"), 6).alias("attach_rate")
    )


def smallest_threshold(sweep: DataFrame, target: float) -> DataFrame:
    """The least threshold whose precision reaches ``target``."""
    return sweep.where(F.col("precision") >= target).agg(F.min("threshold").alias("threshold"))


def rule_grid(df: DataFrame, rules: dict[str, Column], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(rule, n, coverage, within1, mae) of each predicate, all from one pass."""
    close = F.when(F.abs(grade(F.col(pred)) - grade(F.col(truth))) <= 1, 1.0).otherwise(0.0)
    gap = F.abs(F.col(pred) - F.col(truth))
    per_rule = [
        F.struct(
            F.lit(name).alias("rule"), F.count_if(rule).alias("n"), F.round(F.count_if(rule) / F.count(F.lit(1)), 6).alias("coverage"),
            F.round(F.avg(F.when(rule, close)), 6).alias("within1"), F.round(F.avg(F.when(rule, gap)), 6).alias("mae"),
        )
        for name, rule in rules.items()
    ]
    return df.agg(F.array(*per_rule).alias("rules")).select(F.inline("rules"))


def cascade_rules(pred: str = "pred", frac: str = "frac_hit") -> dict[str, Column]:
    """The grid of routing rules: keep locally what is clearly weak or clearly strong."""
    p, f = F.col(pred), F.col(frac)
    rules = {"all": F.lit(True), "shipped": (p <= 2.5) & (f <= 0.25)}
    rules |= {f"high_{hi}_{fh}": (p >= hi) & (f >= fh) for hi in (7.5, 8.0) for fh in (0.6, 0.75)}
    rules |= {f"low_{lo}_{fl}": (p <= lo) & (f <= fl) for lo in (2.5, 3.0, 3.5) for fl in (0.15, 0.25)}
    for lo, hi in ((3.0, 8.0), (3.5, 7.5), (3.0, 7.5)):
        rules[f"extremes_{lo}_{hi}"] = ((p <= lo) & (f <= 0.25)) | ((p >= hi) & (f >= 0.6))
    for lo, hi in ((3.0, 8.0), (3.5, 7.5)):
        rules[f"escalated_{lo}_{hi}"] = ~rules[f"extremes_{lo}_{hi}"]
    return rules


def rule_verdict(challenger: DataFrame, incumbent: DataFrame, p95_ms: float | None, margin: float = 0.03, p95_max: float = 300.0) -> DataFrame:
    """One row: the challenger passes if every common seed has the QWK margin and a lower MAE and the
    latency, if measured, is in bounds; an unmeasured latency fails."""
    j = challenger.alias("c").join(incumbent.alias("i"), "seed")
    ok = (F.col("c.qwk") >= F.col("i.qwk") + margin) & (F.col("c.mae") < F.col("i.mae"))
    latency = F.lit(p95_ms is not None and p95_ms <= p95_max)
    return j.agg(F.count(F.lit(1)).alias("seeds"), F.coalesce(F.bool_and(ok), F.lit(False)).alias("quality_pass")).select(
        "seeds", "quality_pass", latency.alias("latency_pass"), (F.col("quality_pass") & latency).alias("pass")
    )


def regrade_consistency(df: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """One row from (key, pass, score) rows of two passes: n, exact share, MAE, largest difference."""
    a = df.where(F.col("pass") == first).select(key, F.col("score").alias("x"))
    b = df.where(F.col("pass") == second).select(key, F.col("score").alias("y"))
    gap = F.abs(F.col("x") - F.col("y"))
    return a.join(b, key).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(gap == 0, 1.0).otherwise(0.0)), 6).alias("exact"), F.round(F.avg(gap), 6).alias("mae"), F.max(gap).alias("max_diff")
    )


def nearest_rank(values: Column, q: float, style: str = "round") -> Column:
    """Percentiles by position in the sorted list: ``round`` takes round(q n) - 1, ``floor`` int(q n)."""
    s = F.array_sort(values)
    n = F.size(s)
    at = F.greatest(F.rint(F.lit(q) * n).cast("int") - 1, F.lit(0)) if style == "round" else F.least(n - 1, F.floor(F.lit(q) * n).cast("int"))
    return F.try_element_at(s, at + 1)

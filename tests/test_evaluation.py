import numpy as np
import pytest

from rillstone.operators import evaluation as E

Y = [1, 3, 5, 7, 9, 6, 6, 2, 8, 4]
OFFSET = [0.4, -0.6, 1.2, 0, -2, 0.5, -0.4, 0.9, 0.1, -1.1]


def test_grade_metrics(spark):
    pred = [y + o for y, o in zip(Y, OFFSET)]
    r = E.grade_metrics(spark.createDataFrame([(float(y), float(p)) for y, p in zip(Y, pred)], "truth double, pred double")).first()
    t, p = np.clip(np.rint(Y), 1, 10), np.clip(np.rint(pred), 1, 10)
    rank = lambda x: np.array([(np.sum(np.array(x) < v) + 1 + np.sum(np.array(x) <= v)) / 2 for v in x])
    o = np.mean((t - p) ** 2)
    e = np.mean([(a - b) ** 2 for a in t for b in p])
    assert r.mae == pytest.approx(np.mean(np.abs(OFFSET)), abs=1e-6) and r.within1 == pytest.approx(np.mean(np.abs(t - p) <= 1))
    assert r.spearman == pytest.approx(np.corrcoef(rank(Y), rank(pred))[0, 1], abs=1e-6) and r.qwk == pytest.approx(1 - o / e, abs=1e-6)


def test_label_scores(spark):
    df = spark.createDataFrame([("hit", "hit"), ("miss", "miss"), ("hit", "partial"), ("hit", "hit")], "t string, p string")
    r = E.label_scores(df, "t", "p").first()
    assert r.accuracy == 0.75 and r.hit_f1 == 0.8 and r.macro_f1 == pytest.approx(0.6, abs=1e-6)


def test_kappa(spark):
    df = spark.createDataFrame([("y", "y"), ("y", "n"), ("n", "n"), ("n", "n")], "a string, b string")
    assert E.kappa(df, "a", "b").first().kappa == 0.5
    same = spark.createDataFrame([("y", "y")] * 3, "a string, b string")
    assert E.kappa(same, "a", "b").first().kappa is None


def test_auc_and_sweep(spark):
    df = spark.createDataFrame([(True, 0.9), (True, 0.4), (False, 0.4), (False, 0.1)], "y boolean, s double")
    assert E.auc(df, "y", "s").first().auc == 0.875
    sweep = E.threshold_sweep(df.selectExpr("s as score", "y as relevant"))
    got = {r.threshold: (r.attached, r.precision) for r in sweep.collect()}
    assert got == {0.9: (1, 1.0), 0.4: (3, 0.666667), 0.1: (4, 0.5)} and E.smallest_threshold(sweep, 0.6).first().threshold == 0.4


def test_verdict(spark):
    new = spark.createDataFrame([(1, 0.9, 0.5), (2, 0.92, 0.6)], "seed int, qwk double, mae double")
    old = spark.createDataFrame([(1, 0.8, 1.0), (2, 0.8, 1.1)], "seed int, qwk double, mae double")
    assert E.rule_verdict(new, old, 100.0).first()["pass"] and not E.rule_verdict(new, old, None).first()["pass"] and not E.rule_verdict(old, new, 100.0).first()["pass"]

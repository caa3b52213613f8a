"""Draws along a tree of places against their distribution, and metrics of draws against repeated rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import bootstrap, metrics


def test_weights_add_up_and_are_multinomial(monkeypatch):
    monkeypatch.setattr(bootstrap, "LEAF", 7)
    n, draws = 45, 4000
    tree = bootstrap.WeightTree(n, draws, 5)
    w = np.concatenate([tree.weights(i) for i in range(tree.leaves)])
    assert w.shape == (n, draws) and (w.sum(axis=0) == n).all()
    assert (np.concatenate([bootstrap.WeightTree(n, draws, 5).weights(i) for i in reversed(range(tree.leaves))][::-1]) == w).all()
    # counts of one customer are binomial (n, 1 / n), and those of two have the covariance of a multinomial
    from math import comb

    want = np.array([comb(n, k) * (1 / n) ** k * (1 - 1 / n) ** (n - k) for k in range(5)])
    for i in (0, 6, 7, 44):
        seen = np.bincount(w[i], minlength=5)[:5]
        assert ((seen - draws * want) ** 2 / (draws * want)).sum() < 25
    assert np.cov(w[:, :])[np.triu_indices(n, 1)].mean() == pytest.approx(-1 / n, abs=0.004)
    assert w.mean() == 1 and w.var(axis=1).mean() == pytest.approx(1 - 1 / n, abs=0.03)


def predictions(spark):
    rng = np.random.default_rng(3)
    rows = []
    for arm in ("a", "b"):
        for i in range(120 if arm == "a" else 100):
            y, t = int(rng.random() < 0.4), float(rng.random() * 3)
            rows.append((arm, f"c{i:03d}", y, round(0.3 * y + rng.random(), 1), t, t + float(rng.normal()), t / 2, t / 2 + float(rng.normal())))
    return rows, spark.createDataFrame(rows, "arm string, customer_id string, repurchased int, prob double, t_spend double, spend double, t_invoices double, invoices double").repartition(5)


def test_draws_equal_metrics_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "LEAF", 16)
    rows, df = predictions(spark)
    ids = sorted({r[1] for r in rows})
    tree = bootstrap.WeightTree(len(ids), 6, 9)
    w = dict(zip(ids, np.concatenate([tree.weights(i) for i in range(tree.leaves)]), strict=True))
    got = {(r.arm, r.b, r.metric): r.value for r in bootstrap.metric_draws(df, 6, 9, ["arm"]).collect()}
    assert len(got) == 2 * 6 * 3
    for arm in ("a", "b"):
        own = [r for r in rows if r[0] == arm]
        for b in range(6):
            rep = [r for r in own for _ in range(w[r[1]][b])]
            y, s = np.array([r[2] for r in rep]), np.array([r[3] for r in rep])
            p, n = s[y == 1][:, None], s[y == 0]
            assert got[arm, b, "auc"] == pytest.approx(((p > n) + 0.5 * (p == n)).mean())
            for metric, k in (("spend_r2", 4), ("invoice_r2", 6)):
                t, f = np.array([r[k] for r in rep]), np.array([r[k + 1] for r in rep])
                assert got[arm, b, metric] == pytest.approx(1 - ((t - f) ** 2).sum() / ((t - t.mean()) ** 2).sum())


def test_comparisons_pool_seeds_and_origins(spark):
    rows = [(s, o, arm, b, "auc", 0.5 + 0.1 * (arm == "x") + 0.01 * b + 0.02 * s * (arm == "x")) for s in (0, 1) for o in ("p", "q") for arm in ("x", "y") for b in range(10)]
    draws = spark.createDataFrame(rows, "seed int, origin string, arm string, b int, metric string, value double")
    out = bootstrap.paired_comparisons(draws, draws.where("b = 0").drop("b"), [("x", "y")]).first()
    assert (out.comparison, out.metric) == ("x - y", "auc")
    assert (out.delta, out.delta_min, out.delta_max) == (pytest.approx(0.11), pytest.approx(0.1), pytest.approx(0.12))
    assert (out.ci_low, out.ci_high) == (pytest.approx(0.1), pytest.approx(0.12)) and out.p_boot == out.p_holm == pytest.approx(1 / 20)


def test_area_of_any_groups_equals_the_pairwise_one(spark):
    rng = np.random.default_rng(1)
    rows = [(g, int(rng.random() < 0.5), float(rng.integers(0, 12)), float(rng.integers(1, 4))) for g in range(3) for _ in range(80)]
    df = spark.createDataFrame(rows, "g int, y int, s double, w double").repartition(4)
    got = {r.g: r.auc for r in metrics.weighted_auc(df, "y", "s", "w", ["g"]).collect()}
    for g in range(3):
        y, s, w = (np.array([r[k] for r in rows if r[0] == g]) for k in (1, 2, 3))
        p, n = y == 1, y == 0
        pairs = ((s[p][:, None] > s[n]) + 0.5 * (s[p][:, None] == s[n])) * w[p][:, None] * w[n]
        assert got[g] == pytest.approx(pairs.sum() / (w[p].sum() * w[n].sum()))
    assert metrics.weighted_auc(df.drop("g"), "y", "s", "w").first().auc is not None
    assert metrics.weighted_auc(df.where(F.lit(False)), "y", "s").first().auc is None


def test_rank_correlation_with_ties(spark):
    import pandas as pd

    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 2)), float(rng.random()), float(rng.integers(0, 9)), float(rng.integers(0, 7))) for _ in range(200)]
    df = spark.createDataFrame(rows, "y int, prob double, t double, f double").repartition(4)
    out = metrics.error_metrics(df, "y", "prob", "t", "f").first()
    x = pd.DataFrame(rows, columns=["y", "prob", "t", "f"])
    assert out.spearman == pytest.approx(x["t"].rank().corr(x["f"].rank()))
    assert out.mae == pytest.approx((x["t"] - x["f"]).abs().mean()) and out.brier == pytest.approx(((x["prob"] - x["y"]) ** 2).mean())

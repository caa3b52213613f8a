"""Model fits from blocks of rows, global ranks by scans."""

import numpy as np
from pyspark.sql import functions as F

from cohortlens.functions.ranks import value_ranks
from cohortlens.operators import models


def test_equal_rows_are_one_row_of_a_block(spark):
    rows = [(r, i % 5, [float(i % 3), -0.0 if i % 2 else 0.0, 1.0][: 2 + r], i % 2, float(i), 1.0) for r in (0, 1) for i in range(600)]
    df = spark.createDataFrame(rows, "run int, inner int, x array<double>, y int, t double, u double").coalesce(1)
    packed = models.blocks(df, "y", ["t", "u"]).collect()
    assert {(b.run, b.p) for b in packed} == {(0, 3), (1, 4)}
    for b in packed:
        if b.kind == "rows":
            z = np.frombuffer(b.data).reshape(-1, b.p + 3)
            assert len(z) == 30 and z[:, -1].sum() == 600
    grams = models.added_grams(spark.createDataFrame(packed, "run int, inner int, p int, kind string, data binary"))
    own = np.array([[*r[2], 1, r[4], r[5]] for r in rows if r[0] == 1 and r[1] == 3])
    assert np.allclose(grams[1, 3], own.T @ own)


def test_newton_settles_where_the_gradient_is_none(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(int)
    rows = [(r, i % 4, [float(v) for v in x[i]], int(y[i])) for r in (0, 1) for i in range(400)]
    packed = models.blocks(spark.createDataFrame(rows, "run int, inner int, x array<double>, y int"), "y").localCheckpoint()
    tried = [(0, -1, 1.0), (1, 2, 10.0)]
    for (_, left, c), b in zip(tried, models.newton(packed, tried, tolerance=1e-12), strict=True):
        at = np.arange(400) % 4 != left
        a = np.hstack([x[at], np.ones((at.sum(), 1))])
        assert np.abs(c * a.T @ (1 / (1 + np.exp(-a @ b)) - y[at]) + b * [1, 1, 1, 0]).max() < 1e-4


def test_folds_of_many_seeds_are_dealt_at_once(spark):
    from cohortlens.operators import metrics

    cohort = spark.range(50).select(F.col("id").cast("string").alias("customer_id"), (F.col("id") % 2).cast("int").alias("repurchased"), F.lit(1.0).alias("R"), F.lit(1.0).alias("F"), F.lit(1.0).alias("M"), F.lit(0.0).alias("future_spend"), F.lit(0).alias("future_invoices"))
    runs = models.split_runs(cohort, [3, 4]).collect()
    for i, seed in enumerate((3, 4)):
        held = {r.customer_id for r in metrics.stratified_split(cohort, train=0.7, seed=seed).where("NOT is_train").collect()}
        assert held == {r.customer_id for r in runs if r.run == i and r.held} and sum(r.run == i for r in runs) == 50


def test_ranks_of_many_groups_need_no_task_a_group(spark):
    df = spark.range(900).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 101).alias("v"))
    ranks = value_ranks(df, "v", ["g"])
    plan = ranks._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    values = {}
    for r in df.collect():
        values.setdefault(r.g, []).append(r.v)
    for r in ranks.collect():
        own = values[r.g]
        assert (r.ties, r.before, r.dense, r.total) == (own.count(r.v), sum(v < r.v for v in own), len({v for v in own if v <= r.v}), len(own))

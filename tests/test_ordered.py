"""Fits that share one order of the rows, and runs as bits of a row."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import ranks
from cohortlens.operators import features, membership, metrics, scoring, stability


@pytest.fixture(scope="module")
def customers(spark):
    r = random.Random(3)
    rows = [(f"c{i}", r.randrange(300), 1 + int(r.lognormvariate(3, 0.9)), round(r.lognormvariate(5, 1.2), 2), i % 3 == 0) for i in range(700)]
    return spark.createDataFrame(rows, "customer_id string, R int, F int, M double, repurchased boolean").cache()


def rows(df):
    return sorted(map(str, df.collect()))


def ranked_calls(monkeypatch):
    calls, real = [], ranks.value_ranks
    counted = lambda *a, **k: calls.append(1) or real(*a, **k)
    for module in (ranks, scoring, metrics):
        monkeypatch.setattr(module, "value_ranks", counted)
    return calls


@pytest.mark.parametrize("arm", ["tail_product", "fuzzy_rfm_fca_denserank"])
def test_an_arm_ranks_its_customers_once(customers, monkeypatch, arm):
    calls = ranked_calls(monkeypatch)
    features.ARMS[arm](customers, customers)
    assert len(calls) == 1


def test_resamples_make_no_row_for_each_sample_to_rank(customers, monkeypatch):
    calls = ranked_calls(monkeypatch)
    stability.resample_sets(customers, 4).collect()
    assert not calls


def test_centroids_and_tail_from_shared_ranks(customers):
    ranked = scoring.ranked_dims(customers)
    cuts = scoring.fit_cutpoints(customers, strict=False, ranked=ranked)
    scored = scoring.score(customers, cuts)
    assert rows(membership.ranked_centroids(ranked, cuts)) == rows(membership.band_centroids(scored))
    assert rows(membership.ranked_tail(ranked, cuts)) == rows(membership.fit_tail(scored))


def test_dense_cutoffs_without_joined_ranks(customers):
    assert rows(scoring.fit_dense_ranks(customers)) == rows(scoring.dense_rank_cutoffs(scoring.dense_rank_scores(customers)))


def test_compiled_degrees_are_the_interpreted_ones(spark):
    df = spark.createDataFrame([(x / 4, c) for x in range(-4, 40) for c in ([1.0, 2.0, 4.0, 4.0, 8.0], [3.0] * 5)], "x double, c array<double>")
    out = df.select(membership.compiled_piecewise(F.col("x"), F.col("c"), 5).alias("a"), membership.piecewise(F.col("x"), F.col("c")).alias("b"))
    assert out.where("a <> b").count() == 0


def test_drawn_bits_are_the_subsamples(customers):
    seeds = [5, 6, 7]
    bits = metrics.drawn(customers, seeds, lambda n: F.floor(F.lit(0.8) * n))
    assert rows(metrics.runs_of(bits, 3, "sample").select("sample", "customer_id")) == rows(metrics.subsamples(customers, 0.8, seeds, "floor").select("sample", "customer_id"))
    split = metrics.drawn(customers, [42], lambda n: F.floor(F.lit(0.7) * n), ["repurchased"]).select("customer_id", (F.col("drawn") == 1).alias("is_train"))
    assert rows(split) == rows(metrics.stratified_split(customers).select("customer_id", "is_train"))


def test_runs_in_one_order_are_fitted_as_groups_are(customers):
    df = metrics.drawn(customers, [5, 6, 7], lambda n: F.floor(F.lit(0.6) * n)).cache()
    train = metrics.runs_of(df, 3, "run")
    ordered = ranks.Ordered(scoring.long_dims(df, ["drawn"]), 3)
    cuts = scoring.run_cutpoints(ordered)
    assert rows(cuts) == rows(scoring.fit_cutpoints(train, strict=False, by=["run"]).select(*cuts.columns))
    found = membership.run_centroids(ordered, cuts)
    assert rows(found) == rows(membership.band_centroids(scoring.score(train, cuts, ["run"]), by=["run"]).select(*found.columns))


def test_fuzzy_pair_by_rows_is_the_pair_by_concepts(customers, monkeypatch):
    second = customers.where("R % 7 <> 0").withColumn("M", F.col("M") * (1 + F.col("R") % 3))
    models = {id(df): stability.fit_fuzzy(df, 12) for df in (customers, second)}
    fit = lambda df, best=None: models[id(df)]
    monkeypatch.setattr(stability, "fit_fuzzy", fit)
    by_row = stability.temporal_fuzzy_pair(customers, second)
    by_concept = stability.temporal_pair(customers, second, fit=fit, project=stability.project_fuzzy)
    digits = lambda df: rows(df.select("subset", "n_customers", F.round("core_jaccard", 9), F.round("fuzzy_jaccard", 9)))
    assert digits(by_row) == digits(by_concept)

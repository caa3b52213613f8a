"""Queries of feature arms, splits, models, metrics, clusterings, inference and stability."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from cohortlens.functions.ranks import Ordered, checkpointed
from cohortlens.operators import bootstrap, clustering, cohorts, concepts, features, inference, lattice, membership, metrics, models, scoring, stability

from .base import COHORT, CRISP_COHORT, LONG, MU, SCORED_LONG, TX, cohort, fuzzy, query, rounded, scored, table, transactions, with_
from .cohort_queries import _origins
from .concept_queries import CRISP, fuzzy_c


def vectors(df, digits=6):
    """(customer_id, i, v) of feature rows."""
    return rounded(df.select("customer_id", F.posexplode("x").alias("i", "v")), digits)


_STD = """SELECT customer_id, i::BIGINT AS i, round(coalesce(({x} - avg({x}) OVER w) / nullif(stddev_pop({x}) OVER w, 0), 0), 6) AS v
FROM (SELECT *, CASE dim WHEN 'R' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS i FROM l) WINDOW w AS (PARTITION BY dim)"""


@query("a1_raw_std", with_(LONG, _STD.format(x="x")))
def a1(spark, d):
    df = cohort(spark, d)
    return vectors(features.ARMS["raw_std"](df, df))


@query("a1_log_rfm", with_(LONG, _STD.format(x="ln(1 + x)")))
def a1b(spark, d):
    df = cohort(spark, d)
    return vectors(features.ARMS["log_rfm"](df, df))


def _spline_sql() -> str:
    steps = [""", z AS (SELECT customer_id, CASE dim WHEN 'R' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS o, dim, ln(1 + x) AS z FROM l),
q AS (SELECT dim, quantile_cont(z, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM z GROUP BY 1),
t AS (SELECT dim, [q[1] - 3 * (q[2] - q[1]), q[1] - 2 * (q[2] - q[1]), q[1] - (q[2] - q[1])] || q || [q[5] + (q[5] - q[4]), q[5] + 2 * (q[5] - q[4]), q[5] + 3 * (q[5] - q[4])] AS t FROM q),
k0 AS (SELECT customer_id, o, z, t, i, CASE WHEN (i < 7 AND z >= t[i + 1] AND z < t[i + 2]) OR (i = 6 AND z = t[8]) THEN 1.0::DOUBLE ELSE 0 END AS b FROM z JOIN t USING (dim), range(10) r(i))"""]
    for k in (1, 2, 3):
        steps.append(f""", k{k} AS (SELECT a.customer_id, a.o, a.z, a.t, a.i, coalesce((a.z - a.t[a.i + 1]) / nullif(a.t[a.i + {k + 1}] - a.t[a.i + 1], 0), 0) * a.b
 + coalesce((a.t[a.i + {k + 2}] - a.z) / nullif(a.t[a.i + {k + 2}] - a.t[a.i + 2], 0), 0) * n.b AS b FROM k{k - 1} a JOIN k{k - 1} n ON n.customer_id = a.customer_id AND n.o = a.o AND n.i = a.i + 1)""")
    return with_(LONG, "".join(steps) + " SELECT customer_id, (o * 7 + i)::BIGINT AS i, round(b, 6) AS v FROM k3")


@query("a2_spline", _spline_sql())
def a2(spark, d):
    df = cohort(spark, d)
    return vectors(features.ARMS["spline_log_rfm"](df, df))


@query("a3_crisp_bands", with_(SCORED_LONG, ", n AS (SELECT customer_id, CASE dim WHEN 'R' THEN 0 WHEN 'F' THEN 5 ELSE 10 END AS o, s FROM s) SELECT customer_id, (o + b)::BIGINT AS i, (s = b + 1)::INT::DOUBLE AS v FROM n, range(5) r(b)"))
def a3(spark, d):
    df = cohort(spark, d)
    return vectors(features.ARMS["crisp_bands"](df, df))


@query("a3_fuzzy_bands", with_(MU, "SELECT customer_id, (CASE dim WHEN 'R' THEN 0 WHEN 'F' THEN 5 ELSE 10 END + band - 1)::BIGINT AS i, mu AS v FROM mu"))
def a3b(spark, d):
    df = cohort(spark, d)
    return vectors(features.ARMS["fuzzy_bands"](df, df), 9)


@query("a4_crisp_concepts", with_(CRISP, ", c AS (SELECT intent_mask, row_number() OVER (ORDER BY intent_mask) - 1 AS i FROM crisp WHERE intent_mask <> 0) SELECT customer_id, i, ((mask & intent_mask) = intent_mask)::INT::DOUBLE AS v FROM cm, c"))
def a4(spark, d):
    df = cohort(spark, d)
    return vectors(features.ARMS["crisp_rfm_fca"](df, df))


def _arm(name):
    @query(name.replace("/", "_"))
    def run(spark, d, arm=name.split("/")[1]):
        df = checkpointed(cohort(spark, d))
        return vectors(features.ARMS[arm](df, df))

    return run


for _name in ("a5/fuzzy_rfm_fca", "a5/fuzzy_rfm_fca_denserank", "a5/kuznetsov_fca", "a6/hybrid_fuzzy", "a6/hybrid_crisp", "a7/tail_min", "a7/tail_product", "a7/product_t_norm", "a8/family_gaussian", "a8/family_bell", "a8/family_log_gaussian"):
    _arm(_name)


@query("a9_passthrough", with_(LONG, "SELECT customer_id, CASE dim WHEN 'R' THEN 0 WHEN 'F' THEN 1 ELSE 2 END::BIGINT AS i, round(x, 6) AS v FROM l"))
def a9(spark, d):
    df = cohort(spark, d)
    return vectors(features.ARMS["gbm_raw_rfm"](df, df))


FOLDS = COHORT + ", folds AS (SELECT *, (row_number() OVER (PARTITION BY repurchased ORDER BY md5(customer_id || '|0'), customer_id) - 1) % 5 AS fold FROM cohort)"


@query("l1_folds", with_(FOLDS, "SELECT customer_id, fold::BIGINT AS fold FROM folds"))
def l1(spark, d):
    return rounded(metrics.stratified_folds(cohort(spark, d)).select("customer_id", "fold"))


@query("l2_split", with_(COHORT, "SELECT customer_id, row_number() OVER (PARTITION BY repurchased ORDER BY md5(customer_id || '|42'), customer_id) <= floor(0.7 * count(*) OVER (PARTITION BY repurchased)) AS is_train FROM cohort"))
def l2(spark, d):
    return metrics.stratified_split(cohort(spark, d)).select("customer_id", "is_train")


def _oof(spark, d, arm, **options):
    return models.out_of_fold(cohort(spark, d), arm, **options)


@query("l3_logistic")
def l3(spark, d):
    """Out-of-fold probabilities by logistic models; the penalty by inner folds."""
    return rounded(_oof(spark, d, "log_rfm").select("customer_id", "prob"), 4)


@query("l4_ridge")
def l4(spark, d):
    """Out-of-fold amounts by ridge models; the logistic penalty has no part in them."""
    return rounded(_oof(spark, d, "fuzzy_bands", cs=[1.0]).select("customer_id", "spend", "invoices"), 4)


@query("l5_boosted_trees")
def l5(spark, d):
    """Out-of-fold probabilities and amounts by boosted trees of raw features: 200 rounds, 15 leaves, three targets, five folds."""
    return rounded(_oof(spark, d, models.BOOSTED).select("customer_id", "fold", "prob", "spend", "invoices"), 4)


@query("l6_out_of_fold")
def l6(spark, d):
    """Every customer once, in a fold that its models didn't see; fails where one is missing."""
    said = checkpointed(_oof(spark, d, "crisp_bands"))
    total, once = cohort(spark, d).count(), said.select("customer_id").distinct().count()
    if total != once or total != said.count():
        raise ValueError("out-of-fold predictions aren't complete")
    return rounded(said, 4)


# A score that both engines make alike: the percent rank of F, coarse enough for ties.
_PRED = "pred AS (SELECT customer_id, repurchased, round(F / 10.0::DOUBLE, 1) AS prob, ln(1 + future_spend) AS y, round(ln(1 + M), 4) * 0.5::DOUBLE AS f, 1 + F % 3 AS w FROM cohort)"


def _pred(spark, d):
    return cohort(spark, d).select("customer_id", "repurchased", F.round(F.col("F") / 10.0, 1).alias("prob"), F.log1p("future_spend").alias("y"), (F.round(F.log1p("M"), 4) * 0.5).alias("f"), (1 + F.col("F") % 3).alias("w"))


def _auc_sql(w: str) -> str:
    return f"SELECT sum(CASE WHEN p.prob > n.prob THEN {w.format('p')} * {w.format('n')} WHEN p.prob = n.prob THEN 0.5 * {w.format('p')} * {w.format('n')} ELSE 0 END)::DOUBLE / sum({w.format('p')} * {w.format('n')}) AS v FROM pred p JOIN pred n ON p.repurchased = 1 AND n.repurchased = 0"


@query("l7_auc", with_(COHORT, f", {_PRED} SELECT round(v, 6) AS auc FROM ({_auc_sql('1')})"))
def l7(spark, d):
    return rounded(metrics.weighted_auc(_pred(spark, d), "repurchased", "prob"))


@query("l8_r2", with_(COHORT, f", {_PRED} SELECT round(1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*)), 6) AS r2 FROM pred"))
def l8(spark, d):
    return rounded(metrics.weighted_r2(_pred(spark, d), "y", "f"))


_WR2 = "1 - sum(w * (y - f) * (y - f)) / (sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w))"


@query("l9_weighted_metrics", with_(COHORT, f", {_PRED} SELECT (SELECT round(v, 6) FROM ({_auc_sql('{}.w')})) AS auc, (SELECT round({_WR2}, 6) FROM pred) AS r2"))
def l9(spark, d):
    p = _pred(spark, d)
    return rounded(metrics.weighted_auc(p, "repurchased", "prob", "w").crossJoin(metrics.weighted_r2(p, "y", "f", "w")))


@query("l10_error_metrics", with_(COHORT, f""", {_PRED}, r AS (SELECT *, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS a, rank() OVER (ORDER BY f) + (count(*) OVER (PARTITION BY f) - 1) / 2 AS b FROM pred)
SELECT round(avg((prob - repurchased) * (prob - repurchased)), 6) AS brier, round(avg(abs(f - y)), 6) AS mae, round(corr(a, b), 6) AS spearman FROM r"""))
def l10(spark, d):
    return rounded(metrics.error_metrics(_pred(spark, d), "repurchased", "prob", "y", "f"))


def _points(spark, d):
    return checkpointed(clustering.min_max_log(cohort(spark, d)))


@query("l11_k_means")
def l11(spark, d):
    return rounded(clustering.k_means(_points(spark, d), 4).select("customer_id", "label"))


@query("l12_ward")
def l12(spark, d):
    return rounded(clustering.ward(_points(spark, d), 4).select("customer_id", "label"))


@query("l13_fuzzy_c_means")
def l13(spark, d):
    u, _ = clustering.fuzzy_c_means(_points(spark, d), 4)
    return rounded(u.select("customer_id", F.posexplode("u").alias("cluster", "u")), 4)


_SCALED = LONG + """, e AS (SELECT dim, min(ln(1 + x)) AS lo, max(ln(1 + x)) AS hi FROM l GROUP BY 1),
sc AS (SELECT customer_id, dim, coalesce((ln(1 + x) - lo) / nullif(hi - lo, 0), 0) AS v FROM l JOIN e USING (dim)),
pt AS (SELECT customer_id, max(v) FILTER (dim = 'R') AS r, max(v) FILTER (dim = 'F') AS f, max(v) FILTER (dim = 'M') AS m FROM sc GROUP BY 1)"""
_CENTRES = [[0.2, 0.2, 0.2], [0.5, 0.5, 0.5], [0.9, 0.6, 0.7]]


@query("l13_fcm_assign", with_(_SCALED, ", c(j, a, b, c) AS (VALUES " + ", ".join(f"({j}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for j, (a, b, c) in enumerate(_CENTRES)) + """),
w AS (SELECT customer_id, j, 1 / ((r - a) * (r - a) + (f - b) * (f - b) + (m - c) * (m - c)) AS w FROM pt, c) SELECT customer_id, j::BIGINT AS cluster, round(w / sum(w) OVER (PARTITION BY customer_id), 6) AS u FROM w"""))
def l13b(spark, d):
    u = clustering.fcm_degrees(clustering.min_max_log(cohort(spark, d)), _CENTRES)
    return rounded(u.select("customer_id", F.posexplode("u").alias("cluster", "u")))


@query("l14_fuzzy_indices", with_(_SCALED, ", c(j, a, b, c) AS (VALUES " + ", ".join(f"({j}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for j, (a, b, c) in enumerate(_CENTRES)) + """),
w AS (SELECT customer_id, j, (r - a) * (r - a) + (f - b) * (f - b) + (m - c) * (m - c) AS d FROM pt, c), u AS (SELECT customer_id, d, (1 / d) / sum(1 / d) OVER (PARTITION BY customer_id) AS u FROM w),
g AS (SELECT min((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) + (p.c - q.c) * (p.c - q.c)) AS g FROM c p JOIN c q ON p.j < q.j)
SELECT round(sum(u * u) / count(DISTINCT customer_id), 6) AS fpc, round(sum(u * u * d) / (count(DISTINCT customer_id) * max(g)), 6) AS xie_beni FROM u, g"""))
def l14(spark, d):
    return rounded(clustering.fuzzy_indices(clustering.fcm_degrees(clustering.min_max_log(cohort(spark, d)), _CENTRES), _CENTRES))


def _labelled(spark, d):
    return clustering.min_max_log(cohort(spark, d)).join(cohort(spark, d).select("customer_id", F.least(F.col("F"), F.lit(6)).alias("f")), "customer_id").select("customer_id", "x", F.floor(F.col("f") / 3).cast("int").alias("label"))


_LABELLED = _SCALED + ", lb AS (SELECT pt.*, floor(least(cohort.F, 6) / 3)::INT AS label FROM pt JOIN cohort USING (customer_id))"


@query("l15_silhouette", with_(_LABELLED, """, few AS (SELECT * FROM lb ORDER BY md5(customer_id), customer_id LIMIT 2000),
ds AS (SELECT p.customer_id, p.label, q.label AS other, avg(sqrt((p.r - q.r) * (p.r - q.r) + (p.f - q.f) * (p.f - q.f) + (p.m - q.m) * (p.m - q.m))) AS d FROM few p JOIN few q ON p.customer_id <> q.customer_id GROUP BY 1, 2, 3),
ab AS (SELECT customer_id, min(d) FILTER (label = other) AS a, min(d) FILTER (label <> other) AS b FROM ds GROUP BY 1) SELECT round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) AS silhouette FROM ab"""))
def l15(spark, d):
    return rounded(clustering.silhouette(_labelled(spark, d), 2000))


@query("l15_davies_bouldin", with_(_LABELLED, """, ce AS (SELECT label, avg(r) AS r, avg(f) AS f, avg(m) AS m FROM lb GROUP BY 1),
s2 AS (SELECT lb.label, ce.r, ce.f, ce.m, avg(sqrt((lb.r - ce.r) * (lb.r - ce.r) + (lb.f - ce.f) * (lb.f - ce.f) + (lb.m - ce.m) * (lb.m - ce.m))) AS s FROM lb JOIN ce USING (label) GROUP BY ALL),
w AS (SELECT p.label, max((p.s + q.s) / sqrt((p.r - q.r) * (p.r - q.r) + (p.f - q.f) * (p.f - q.f) + (p.m - q.m) * (p.m - q.m))) AS w FROM s2 p JOIN s2 q ON p.label <> q.label GROUP BY 1) SELECT round(avg(w), 6) AS davies_bouldin FROM w"""))
def l15b(spark, d):
    return rounded(clustering.davies_bouldin(_labelled(spark, d)))


@query("l16_min_max_log", with_(_SCALED, "SELECT customer_id, round(r, 6) AS r, round(f, 6) AS f, round(m, 6) AS m FROM pt"))
def l16(spark, d):
    x = clustering.min_max_log(cohort(spark, d))
    return rounded(x.select("customer_id", *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate("rfm")]))


SPLIT_SEEDS = list(range(1000, 1010))


SPLIT_ARMS = ["raw_std", "log_rfm", "fuzzy_rfm_fca"]


@query("l17_repeated_splits")
def l17(spark, d):
    """Mean and spread of held-out metrics of three arms over ten 70/30 splits, and wins over the first; ten logistic and twenty ridge penalties."""
    df, rows = checkpointed(cohort(spark, d)), None
    runs = models.split_runs(df, SPLIT_SEEDS)
    for arm in SPLIT_ARMS:
        one = models.evaluate(checkpointed(models.repeated_splits(df, arm, SPLIT_SEEDS, runs=runs)), ["seed"]).select("seed", F.lit(arm).alias("arm"), "auc", "spend_r2", "invoice_r2")
        rows = one if rows is None else rows.unionByName(one)
    rows = checkpointed(rows)
    base = rows.where("arm = 'raw_std'").select("seed", F.col("auc").alias("base"))
    return rounded(rows.join(base, "seed").groupBy("arm").agg(F.avg("auc").alias("auc_mean"), F.stddev_samp("auc").alias("auc_std"), F.avg("spend_r2").alias("spend_r2_mean"), F.count_if(F.col("auc") > F.col("base")).alias("wins")), 4)


@query("l10_train_test_gap")
def l10b(spark, d):
    """Metrics of trained and held rows of five folds, averaged, and their gap."""
    splits, rows = models.folds_as_splits(cohort(spark, d)), None
    for arm in ("log_rfm", "crisp_bands"):
        said = models.predictions(splits, arm, trained_too=True)
        one = models.evaluate(said.withColumn("part", F.when(F.col("held"), "test").otherwise("train")), ["run", "part"]).withColumn("arm", F.lit(arm))
        rows = one if rows is None else rows.unionByName(one)
    names = ["auc", "spend_r2", "invoice_r2"]
    means = rows.groupBy("arm", "part").agg(*[F.avg(n).alias(n) for n in names])
    return rounded(metrics.train_test_gap(means, ["arm"], names), 4)


@query("l18_temporal_holdout")
def l18(spark, d):
    """One fixed 70/30 split of one origin's customers, whose outcomes are later, for several arms."""
    df, rows = checkpointed(cohort(spark, d)), None
    runs = models.split_runs(df, [42])
    for arm in ("log_rfm", "crisp_bands", "spline_log_rfm"):
        one = models.evaluate(checkpointed(models.repeated_splits(df, arm, [42], runs=runs))).withColumn("arm", F.lit(arm))
        rows = one if rows is None else rows.unionByName(one)
    return rounded(rows, 4)


@query("l19_harness")
def l19(spark, d):
    return rounded(models.evaluate(checkpointed(_oof(spark, d, "crisp_rfm_fca"))), 4)


B, SEED = 2000, 12345
_DRAWS = f""", nc AS (SELECT customer_id, row_number() OVER (ORDER BY customer_id) - 1 AS place FROM cohort), nn AS (SELECT count(*) AS n FROM nc),
dr AS (SELECT b, ('0x' || substr(md5(b || '|' || place || '|{SEED}'), 1, 8))::BIGINT % n AS place FROM nc, nn, range({B}) r(b)),
wt AS (SELECT b, customer_id, count(*) AS w FROM dr JOIN nc USING (place) GROUP BY 1, 2)"""


def _weights(spark, d):
    return inference.draw_weights(checkpointed(inference.number_customers(cohort(spark, d))), B, SEED)


@query("i1_bootstrap_weights", with_(COHORT, _DRAWS + " SELECT b, customer_id, w FROM wt"))
def i1(spark, d):
    return _weights(spark, d)


# Two arms' scores: F and M in coarse steps. The difference of their weighted R² against the spend is the statistic.
_ARMS2 = ", two AS (SELECT customer_id, repurchased, ln(1 + future_spend) AS y, round(ln(1 + M), 4) * 0.5::DOUBLE AS fa, round(ln(1 + F), 4) AS fb FROM cohort)"
_DELTA = _DRAWS + _ARMS2 + """, st AS (SELECT b, (1 - sum(w * (y - fa) * (y - fa)) / (sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w))) - (1 - sum(w * (y - fb) * (y - fb)) / (sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w))) AS delta
 FROM two JOIN wt USING (customer_id) GROUP BY 1)"""


def _deltas(spark, d):
    """One pass over the draws for both arms."""
    two = cohort(spark, d).select("customer_id", F.log1p("future_spend").alias("y"), (F.round(F.log1p("M"), 4) * 0.5).alias("fa"), F.round(F.log1p("F"), 4).alias("fb"))
    y, sums = F.col("y"), {"n": F.lit(1.0), "t": F.col("y"), "tt": F.col("y") * F.col("y")}
    sums |= {f: (y - F.col(f)) * (y - F.col(f)) for f in ("fa", "fb")}
    drawn = inference.draw_sums(two, B, SEED, sums)
    return drawn.select("b", ((F.col("fb") - F.col("fa")) / (F.col("tt") - F.col("t") * F.col("t") / F.col("w"))).alias("delta"))


@query("i2_clustered_bootstrap", "WITH " + TX + ", o(origin, pooled, horizon) AS (VALUES ('1997-01-01', true, 91), ('1998-01-01', true, 91))" + """, kk AS (SELECT *, origin::TIMESTAMP AS cutoff FROM o),
cc AS (SELECT origin, customer_id, count(DISTINCT invoice) FILTER (ts_ <= cutoff) AS F, coalesce(sum(v) FILTER (ts_ > cutoff), 0)::DOUBLE AS fs FROM tx JOIN kk ON ts_ <= cutoff + to_days(horizon) GROUP BY origin, cutoff, customer_id HAVING max(ts_) FILTER (ts_ <= cutoff) IS NOT NULL),
nc AS (SELECT customer_id, row_number() OVER (ORDER BY customer_id) - 1 AS place FROM (SELECT DISTINCT customer_id FROM cc)), nn AS (SELECT count(*) AS n FROM nc),
""" + f"dr AS (SELECT b, ('0x' || substr(md5(b || '|' || place || '|{SEED}'), 1, 8))::BIGINT % n AS place FROM nc, nn, range({B}) r(b))," + """ wt AS (SELECT b, customer_id, count(*) AS w FROM dr JOIN nc USING (place) GROUP BY 1, 2)
SELECT b, origin, round(sum(w * ln(1 + fs)) / sum(w), 6) AS mean_spend, sum(w)::BIGINT AS n FROM cc JOIN wt USING (customer_id) GROUP BY 1, 2""")
def i2(spark, d):
    """Draws from the union of customers; a customer drawn counts in every origin that has it."""
    df = checkpointed(cohorts.build_cohorts(transactions(spark, d), _origins(spark).where("origin IN ('1997-01-01', '1998-01-01')")))
    drawn = inference.draw_sums(df, B, SEED, {"spend": F.log1p("future_spend")}, ["origin"])
    return rounded(drawn.select("b", "origin", (F.col("spend") / F.col("w")).alias("mean_spend"), F.col("w").cast("long").alias("n")))


@query("i2_model_bootstrap")
def i2b(spark, d):
    """Two representations compared by out-of-fold metrics: five seeds of folds, two origins, one draw of the union of customers
    for all of them, the seeds' draws taken together; Holm over the metrics."""
    df = checkpointed(cohorts.build_cohorts(transactions(spark, d), _origins(spark).where("origin IN ('1997-01-01', '1998-01-01')")))
    arms = ("crisp_bands", "log_rfm")
    runs = models.seeds_and_origins_runs(df, [0, 1, 2, 3, 4])
    said = [models.seeds_and_origins(df, arm, [0, 1, 2, 3, 4], runs=runs).withColumn("arm", F.lit(arm)) for arm in arms]
    said = checkpointed(said[0].unionByName(said[1]))
    by = ["seed", "origin", "arm"]
    points = models.evaluate(said, by).unpivot(by, ["auc", "spend_r2", "invoice_r2"], "metric", "value")
    draws = checkpointed(bootstrap.metric_draws(said, B, SEED, by))
    return rounded(bootstrap.paired_comparisons(draws, checkpointed(points), [arms]), 4)


@query("i3_interval", with_(COHORT, _DELTA + " SELECT round(avg(delta), 6) AS mean, round(quantile_cont(delta, 0.025), 6) AS ci_low, round(quantile_cont(delta, 0.975), 6) AS ci_high FROM st"))
def i3(spark, d):
    return rounded(inference.interval(_deltas(spark, d), "delta", []).drop("p_boot"))


@query("i4_bootstrap_p", with_(COHORT, _DELTA + " SELECT round(greatest(least(2 * least(avg((delta <= 0)::INT), avg((delta >= 0)::INT)), 1), 1.0 / count(*))::DOUBLE, 6) AS p_boot FROM st"))
def i4(spark, d):
    return rounded(inference.interval(_deltas(spark, d), "delta", []).select("p_boot"))


@query("i5_one_sided_p", with_(COHORT, _DELTA + " SELECT round(avg((delta <= 0)::INT), 6) AS p FROM st"))
def i5(spark, d):
    return rounded(inference.one_sided_p(_deltas(spark, d), "delta", []))


_TESTS = "SELECT c_custkey AS test, c_nationkey::BIGINT AS family, round((c_custkey * 7919 % 1000) / 20000.0::DOUBLE, 6) AS p FROM customer"


@query("i6_holm", f"WITH t AS ({_TESTS}), s AS (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER w + 1) * p AS step FROM t WINDOW w AS (PARTITION BY family ORDER BY p, test)) SELECT test, family, p, round(least(1.0, max(step) OVER (PARTITION BY family ORDER BY p, test)), 6) AS p_holm FROM s")
def i6(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("test"), F.col("c_nationkey").cast("long").alias("family"), F.round((F.col("c_custkey") * 7919 % 1000) / 20000.0, 6).alias("p"))
    return rounded(inference.holm(t, by=["family"]))


_POINTS = "SELECT o_orderpriority AS metric, o_orderstatus AS origin, o_orderkey % 4 AS b, o_orderstatus <> 'P' AS pooled, round(avg(o_totalprice) - 150000, 4) AS delta FROM orders GROUP BY 1, 2, 3, 4"


def _point_rows(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("metric"), F.col("o_orderstatus").alias("origin"), (F.col("o_orderkey") % 4).alias("b"), (F.col("o_orderstatus") != "P").alias("pooled")).agg(F.round(F.avg("o_totalprice") - 150000, 4).alias("delta"))


@query("i7_pooled_draws", f"WITH p AS ({_POINTS}) SELECT metric, b, round(avg(delta), 3) AS delta FROM p WHERE pooled GROUP BY 1, 2")
def i7(spark, d):
    return rounded(inference.pooled(_point_rows(spark, d)), 3)


@query("i7_origins_positive", f"WITH p AS ({_POINTS}) SELECT metric, count(*) FILTER (delta > 0) || '/' || count(*) AS origins_positive FROM p WHERE pooled GROUP BY 1")
def i7b(spark, d):
    return inference.origins_positive(_point_rows(spark, d))


_DIFFS = "SELECT c_nationkey::BIGINT AS arm, c_custkey AS seed, round(c_acctbal / 10000, 4) AS diff FROM customer"


def _diffs(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("arm"), F.col("c_custkey").alias("seed"), F.round(F.col("c_acctbal") / 10000, 4).alias("diff"))


@query("i8_split_bootstrap", f"""WITH x AS ({_DIFFS}), n AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY seed) - 1 AS i, count(*) OVER (PARTITION BY arm) AS n FROM x),
d AS (SELECT arm, b, avg(q.diff) AS m FROM (SELECT arm, b, ('0x' || substr(md5(b || '|' || i || '|7'), 1, 8))::BIGINT % n AS i FROM n, range(2000) r(b)) s JOIN n q USING (arm, i) GROUP BY 1, 2)
SELECT arm, round(quantile_cont(m, 0.025), 3) AS ci_low, round(quantile_cont(m, 0.975), 3) AS ci_high FROM d GROUP BY 1""")
def i8(spark, d):
    """Interval of the mean of an arm's differences over splits, an arm having some splits."""
    return rounded(inference.interval(inference.split_means(_diffs(spark, d), "diff", ["arm"], "seed"), "m", ["arm"]).select("arm", "ci_low", "ci_high"), 3)


@query("i9_sign_flip")
def i9(spark, d):
    """Arms of more than 20 differences take 10,000 random patterns."""
    return rounded(inference.sign_flip_p(_diffs(spark, d), "diff", ["arm"], draws=10_000))


@query("i10_paired_t", f"""WITH x AS ({_DIFFS}), r AS (SELECT arm, diff, rank() OVER (PARTITION BY arm ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY arm, abs(diff)) - 1) / 2 AS r FROM x WHERE diff <> 0),
w AS (SELECT arm, least(coalesce(sum(r) FILTER (diff > 0), 0), coalesce(sum(r) FILTER (diff < 0), 0)) AS w FROM r GROUP BY 1)
SELECT arm, count(*) AS n, round(avg(diff) / (stddev_samp(diff) / sqrt(count(*))), 4) AS t, round(max(w)::DOUBLE, 4) AS wilcoxon FROM x JOIN w USING (arm) GROUP BY 1 HAVING count(*) > 1""")
def i10(spark, d):
    return rounded(inference.paired_t(_diffs(spark, d), "diff", ["arm"]).where("n > 1"), 4)


# Areas under both densities by the midpoint rule, all sign patterns of small groups, subsets of ranks by their sum.
@query("i10_paired_p", f"""WITH RECURSIVE x AS (SELECT arm, seed, round(diff - 0.45, 4) AS diff FROM ({_DIFFS})), r AS (SELECT arm, seed, diff, sign(diff) * (rank() OVER (PARTITION BY arm ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY arm, abs(diff)) - 1) / 2) AS r, count(*) OVER (PARTITION BY arm, abs(diff)) AS tied FROM x WHERE diff <> 0),
z AS (SELECT arm, count(*) AS m, sum(r) / 2 / sqrt((count(*) * (count(*) + 1) * (2 * count(*) + 1) - sum(tied * tied - 1) / 2) / 24) AS z FROM r GROUP BY 1),
q AS (SELECT arm, row_number() OVER (PARTITION BY arm ORDER BY seed) - 1 AS i, m, r FROM r JOIN z USING (arm) WHERE m <= 20),
fl AS (SELECT arm, k, sum(CASE WHEN (k >> i) & 1 = 1 THEN -r ELSE r END) AS s, sum(r) AS o FROM q JOIN range(1048576) p(k) ON k < (1 << m) GROUP BY 1, 2),
ex AS (SELECT arm, avg((abs(s) >= abs(o))::INT) AS p FROM fl GROUP BY 1),
dp AS (SELECT 0 AS n, list_transform(range(1276), lambda s: CASE WHEN s = 0 THEN 1.0::DOUBLE ELSE 0 END) AS c UNION ALL SELECT n + 1, list_transform(range(1276), lambda s: c[s + 1] + CASE WHEN s > n THEN c[s - n] ELSE 0 END) FROM dp WHERE n < 50),
un AS (SELECT arm, count(*) AS n, least(sum(r) FILTER (r > 0), -sum(r) FILTER (r < 0)) AS w FROM r GROUP BY 1 HAVING max(tied) = 1 AND count(*) <= 50),
ur AS (SELECT arm, least(1, 2 * list_sum(c[1:coalesce(w, 0)::INT + 1]) / 2.0 ** n) AS p FROM un JOIN dp USING (n)),
t AS (SELECT arm, count(*) AS n, abs(avg(diff) / (stddev_samp(diff) / sqrt(count(*)))) AS t FROM x GROUP BY 1),
pt AS (SELECT arm, n, 1 - 2 * sum(exp(lgamma(n / 2) - lgamma((n - 1) / 2) - ln((n - 1) * pi()) / 2 - n / 2 * ln(1 + (t * (k + 0.5::DOUBLE) / 20000) ** 2 / (n - 1)))) * max(t) / 20000 AS p FROM t, range(20000) g(k) WHERE n > 1 GROUP BY 1, 2),
pz AS (SELECT arm, 1 - 2 * sum(exp((z * (k + 0.5::DOUBLE) / 20000) ** 2 / -2)) * abs(max(z)) / 20000 / sqrt(2 * pi()) AS p FROM z, range(20000) g(k) GROUP BY arm)
SELECT pt.arm, n, round(pt.p, 4) AS p_t, round(coalesce(ex.p, ur.p, pz.p), 4) AS p_wilcoxon FROM pt LEFT JOIN pz USING (arm) LEFT JOIN ex USING (arm) LEFT JOIN ur USING (arm)""")
def i10b(spark, d):
    """Against a difference of 0.45, about the mean."""
    return rounded(inference.paired_p(_diffs(spark, d).withColumn("diff", F.round(F.col("diff") - 0.45, 4)), "diff", ["arm"]).where("n > 1"), 4)


@query("i11_subsample", with_(COHORT, "SELECT customer_id FROM (SELECT customer_id, row_number() OVER (ORDER BY md5(customer_id || '|2026'), customer_id) AS r FROM cohort) WHERE r <= round(0.8 * (SELECT count(*) FROM cohort))"))
def i11(spark, d):
    """80 % of the customers without replacement: sampling is the operator."""
    return metrics.subsample(cohort(spark, d), 0.8, 2026).select("customer_id")


@query("i12_verdicts", f"WITH t AS ({_TESTS}) SELECT test, CASE WHEN p < 0.05 AND test % 2 = 0 THEN 'better' WHEN p < 0.05 THEN 'worse' ELSE 'no difference' END AS by_p, CASE WHEN p - 0.03 > 0 THEN 'better' WHEN p - 0.01 < 0 THEN 'worse' ELSE 'no difference' END AS by_interval FROM t")
def i12(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("test"), F.round((F.col("c_custkey") * 7919 % 1000) / 20000.0, 6).alias("p"))
    delta = F.when(F.col("test") % 2 == 0, 1.0).otherwise(-1.0)
    return t.select("test", inference.verdict_by_p(F.col("p"), delta).alias("by_p"), inference.verdict_by_interval(F.col("p") - 0.03, F.col("p") - 0.01).alias("by_interval"))


@query("i13_factorial", """WITH c AS (SELECT o_orderpriority AS metric, o_orderstatus AS origin, avg(o_totalprice) FILTER (o_orderkey % 4 = 0) AS m0, avg(o_totalprice) FILTER (o_orderkey % 4 = 1) AS m1,
  avg(o_totalprice) FILTER (o_orderkey % 4 = 2) AS m2, avg(o_totalprice) FILTER (o_orderkey % 4 = 3) AS m3 FROM orders GROUP BY 1, 2),
e AS (SELECT metric, (m1 + m3 - m0 - m2) / 2 AS a, (m2 + m3 - m0 - m1) / 2 AS b, m3 - m2 - m1 + m0 AS x FROM c)
SELECT metric, count(*) AS origins, round(avg(a), 3) AS membership, round(avg(b), 3) AS t_norm, round(avg(x), 3) AS interaction, round(median(a), 3) AS median_membership, round(min(a), 3) AS min_membership, round(max(a), 3) AS max_membership, abs(sum(sign(a))) = count(*) AS sign_consistent FROM e GROUP BY 1""")
def i13(spark, d):
    cells = table(spark, d, "orders").withColumn("cell", F.concat(F.lit("m"), (F.col("o_orderkey") % 4).cast("string")))
    o = cells.groupBy(F.col("o_orderpriority").alias("metric"), F.col("o_orderstatus").alias("origin")).pivot("cell", ["m0", "m1", "m2", "m3"]).agg(F.avg("o_totalprice"))
    return rounded(inference.factorial_contrasts(o), 3)


@query("i14_split_comparisons", f"""WITH x AS ({_DIFFS}), b AS (SELECT seed % 5 AS s, avg(diff) AS base FROM x WHERE arm < 12 GROUP BY 1), a AS (SELECT arm, seed % 5 AS s, avg(diff) AS v FROM x WHERE arm >= 12 GROUP BY 1, 2),
e AS (SELECT arm, s, v - base AS e FROM a JOIN b USING (s)), n AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY arm) AS n FROM e),
dr AS (SELECT arm, b, avg(q.e) AS m FROM (SELECT arm, b, ('0x' || substr(md5(b || '|' || i || '|7'), 1, 8))::BIGINT % n AS i FROM n, range(2000) r(b)) w JOIN n q USING (arm, i) GROUP BY 1, 2),
ci AS (SELECT arm, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM dr GROUP BY 1),
fl AS (SELECT arm, k, round(abs(sum(CASE WHEN (k >> i) & 1 = 1 THEN -e ELSE e END)), 9) >= round(abs(sum(e)), 9) AS reached FROM n JOIN range(32) p(k) ON k < (1 << n) GROUP BY 1, 2),
p AS (SELECT arm, avg(reached::INT) AS p FROM fl GROUP BY 1)
SELECT arm, count(*) AS splits, round(avg(e), 6) AS mean, round(stddev_samp(e), 6) AS std, count(*) FILTER (e > 0) AS wins, count(*) FILTER (e < 0) AS losses, round(any_value(ci_low), 4) AS ci_low, round(any_value(ci_high), 4) AS ci_high, round(any_value(p), 6) AS p
FROM e JOIN ci USING (arm) JOIN p USING (arm) GROUP BY 1 HAVING count(*) > 1""")
def i14(spark, d):
    """Arms 12 and above against the mean of the others, over five splits."""
    x = _diffs(spark, d).withColumn("s", F.col("seed") % 5)
    base = x.where("arm < 12").groupBy("s").agg(F.avg("diff").alias("base"))
    paired = x.where("arm >= 12").groupBy("arm", "s").agg(F.avg("diff").alias("v")).join(base, "s").select("arm", "s", (F.col("v") - F.col("base")).alias("e"))
    out = rounded(inference.split_comparisons(checkpointed(paired), "e", ["arm"], "s").where("splits > 1"))
    return out.withColumns({c: F.round(c, 4) for c in ("ci_low", "ci_high")})


@query("i14_concept_counts")
def i14b(spark, d):
    """How many concepts each arm keeps on the training rows of ten 70/30 splits: fuzzy less crisp, paired by split."""
    df = metrics.drawn(checkpointed(cohort(spark, d)), SPLIT_SEEDS, lambda n: F.floor(F.lit(0.7) * n), ["repurchased"])
    df, runs = checkpointed(df.select(*scoring.DIMS, "drawn")), len(SPLIT_SEEDS)
    ordered = Ordered(scoring.long_dims(df, ["drawn"]), runs)
    cuts = checkpointed(scoring.run_cutpoints(ordered))
    fitted, train = (cuts, membership.run_centroids(ordered, cuts)), metrics.runs_of(df, runs, "run")
    counts = [features.run_concepts(train, kind, fitted)[1].groupBy("run").agg(F.count("*").cast("double").alias(n)) for kind, n in ((True, "fuzzy"), (False, "crisp"))]
    paired = counts[0].join(counts[1], "run").select(F.lit("concepts").alias("metric"), "run", (F.col("fuzzy") - F.col("crisp")).alias("e"))
    return rounded(inference.split_comparisons(checkpointed(paired), "e", ["metric"], "run"), 4)


@query("i15_unit_weights", with_(COHORT, f", {_PRED} SELECT (SELECT round(v, 6) FROM ({_auc_sql('1')})) AS auc, (SELECT round(1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*)), 6) FROM pred) AS r2"))
def i15(spark, d):
    p = _pred(spark, d).withColumn("w", F.lit(1))
    return rounded(metrics.weighted_auc(p, "repurchased", "prob", "w").crossJoin(metrics.weighted_r2(p, "y", "f", "w")))


@query("t1_projection", with_(CRISP, "SELECT customer_id, intent_mask AS band_mask, 1.0::DOUBLE AS mu FROM cm JOIN crisp ON (mask & intent_mask) = intent_mask AND intent_mask <> 0"))
def t1(spark, d):
    df = cohort(spark, d)
    return stability.project_crisp(df, stability.fit_crisp(df))


_PAIR = f"WITH a AS ({with_(CRISP_COHORT.format(cut='1998-01-01'), 'SELECT * FROM proj')}), b AS ({with_(CRISP_COHORT.format(cut='1999-01-01'), 'SELECT * FROM proj')})"


@query("t2_similarity", _PAIR + " SELECT round(count(*) FILTER (a.m IS NOT NULL AND b.m IS NOT NULL) / count(*), 6) AS core_jaccard, round(sum(least(coalesce(a.mu, 0), coalesce(b.mu, 0))) / sum(greatest(coalesce(a.mu, 0), coalesce(b.mu, 0))), 6) AS fuzzy_jaccard FROM a FULL JOIN b ON a.customer_id = b.customer_id AND a.m = b.m")
def t2(spark, d):
    a, b = cohort(spark, d), cohorts.one_cohort(transactions(spark, d), "1999-01-01 00:00:00")
    return rounded(stability.similarity(stability.project_crisp(a, stability.fit_crisp(a)), stability.project_crisp(b, stability.fit_crisp(b))))


# Crisp concepts of subsamples in SQL: sk (b, customer_id, mask) and sn (b, m).
def _subsamples_sql(b: int, seed: int, how: str) -> str:
    return f""", dr AS (SELECT b, cohort.*, row_number() OVER (PARTITION BY b ORDER BY md5(customer_id || '|' || (b + {seed})), customer_id) AS place FROM cohort, range({b}) t(b)),
sb AS (SELECT * FROM dr WHERE place <= {how}(0.8 * (SELECT count(*) FROM cohort))),
sq AS (SELECT b, list_transform(quantile_cont(R::DOUBLE, [0.2, 0.4, 0.6, 0.8]), lambda v: round(v, 6)) AS qr, list_transform(quantile_cont(F::DOUBLE, [0.2, 0.4, 0.6, 0.8]), lambda v: round(v, 6)) AS qf,
  list_transform(quantile_cont(M, [0.2, 0.4, 0.6, 0.8]), lambda v: round(v, 6)) AS qm FROM sb GROUP BY b),
sl AS (SELECT b, customer_id, 4 - len(list_filter(qr, lambda c: R::DOUBLE > c)) AS rs, 5 + len(list_filter(qf, lambda c: F::DOUBLE > c)) AS fs, 10 + len(list_filter(qm, lambda c: M > c)) AS ms FROM cohort, sq),
sk AS (SELECT b, customer_id, rs, fs, ms, ((1 << rs) + (1 << fs) + (1 << ms))::BIGINT AS mask FROM sl),
sn AS (SELECT DISTINCT b, m FROM (SELECT b, count(*) AS n, bit_and(mask) AS m FROM sk SEMI JOIN sb USING (b, customer_id) GROUP BY GROUPING SETS ((b), (b, rs), (b, fs), (b, ms), (b, rs, fs), (b, rs, ms), (b, fs, ms), (b, rs, fs, ms)))
  WHERE n >= 0.04 * (SELECT count(*) FROM sb WHERE b = 0) AND m <> 0)"""


_REFERENCE = ", rn AS (SELECT intent_mask AS m FROM crisp WHERE intent_mask <> 0)"


@query("t3_refit_study", with_(CRISP, _subsamples_sql(30, 2026, "round") + _REFERENCE + """, ra AS (SELECT customer_id, m FROM cm JOIN rn ON (mask & m) = m), fb AS (SELECT b, customer_id, m FROM sk JOIN sn USING (b) WHERE (mask & m) = m),
i AS (SELECT b, count(*) AS c FROM ra JOIN fb USING (customer_id, m) GROUP BY 1), e AS (SELECT b, count(*) AS f FROM fb GROUP BY 1), w AS (SELECT b, count(*) AS nf, count(*) FILTER (m IN (SELECT m FROM rn)) AS again FROM sn GROUP BY 1)
SELECT b AS subsample, round(c / ((SELECT count(*) FROM ra) + f - c), 6) AS core_jaccard, round(c / ((SELECT count(*) FROM ra) + f - c), 6) AS fuzzy_jaccard,
 round(again / (SELECT count(*) FROM rn), 6) AS concept_recurrence, (SELECT count(*) FROM rn) AS n_concepts_ref, nf AS n_concepts_fit FROM i JOIN e USING (b) JOIN w USING (b)"""))
def t3(spark, d):
    """Thirty subsamples of 80 % of the customers."""
    return rounded(stability.crisp_refits(cohort(spark, d), [2026 + s for s in range(30)]))


@query("t4_temporal_pair", _PAIR + """, pa AS (SELECT customer_id, R, F, M FROM (""" + with_(CRISP_COHORT.format(cut="1998-01-01"), "SELECT * FROM pct") + """)), pb AS (SELECT customer_id, R, F, M FROM (""" + with_(CRISP_COHORT.format(cut="1999-01-01"), "SELECT * FROM pct") + """)),
cm AS (SELECT pa.customer_id, round(greatest(abs(pa.R - pb.R), abs(pa.F - pb.F), abs(pa.M - pb.M)), 9) <= 0.05 AS stable FROM pa JOIN pb USING (customer_id)),
sb AS (SELECT customer_id, 'all' AS subset FROM cm UNION ALL SELECT customer_id, 'stable' FROM cm WHERE stable),
j AS (SELECT coalesce(x.subset, y.subset) AS subset, x.mu AS p, y.mu AS q FROM (SELECT * FROM a JOIN sb USING (customer_id)) x FULL JOIN (SELECT * FROM b JOIN sb USING (customer_id)) y ON x.customer_id = y.customer_id AND x.m = y.m AND x.subset = y.subset)
SELECT subset, n AS n_customers, round(count(*) FILTER (p IS NOT NULL AND q IS NOT NULL) / count(*), 6) AS core_jaccard, round(sum(least(coalesce(p, 0), coalesce(q, 0))) / sum(greatest(coalesce(p, 0), coalesce(q, 0))), 6) AS fuzzy_jaccard
FROM j JOIN (SELECT subset, count(*) AS n FROM sb GROUP BY 1) USING (subset) GROUP BY 1, 2""")
def t4(spark, d):
    a, b = checkpointed(cohort(spark, d)), checkpointed(cohorts.one_cohort(transactions(spark, d), "1999-01-01 00:00:00"))
    return rounded(stability.temporal_pair(a, b))


@query("t5_matched_count")
def t5(spark, d):
    """As many fuzzy concepts as crisp ones, between two origins."""
    a, b = checkpointed(cohort(spark, d)), checkpointed(cohorts.one_cohort(transactions(spark, d), "1999-01-01 00:00:00"))
    k = stability.fit_crisp(a)[1].count()
    return rounded(stability.temporal_fuzzy_pair(a, b, k))


RESAMPLES = 50


@query("t6_resample_sets", with_(COHORT, _subsamples_sql(RESAMPLES, 7, "floor") + """, z AS (SELECT b, count(*) AS n FROM sn GROUP BY 1), c AS (SELECT x.b AS a, y.b, count(*) AS c FROM sn x JOIN sn y ON x.m = y.m AND x.b < y.b GROUP BY 1, 2)
SELECT p.b AS a, q.b, round(coalesce(c, 0) / (p.n + q.n - coalesce(c, 0)), 6) AS jaccard FROM z p JOIN z q ON p.b < q.b LEFT JOIN c ON c.a = p.b AND c.b = q.b"""))
def t6(spark, d):
    sets = checkpointed(stability.resample_sets(checkpointed(cohort(spark, d)), RESAMPLES))
    return rounded(stability.set_jaccards(sets, "b"))


@query("t6_recurrence", with_(CRISP, _subsamples_sql(RESAMPLES, 7, "floor") + _REFERENCE + f" SELECT rn.m AS band_mask, round(count(sn.b) / {RESAMPLES}, 6) AS share FROM rn LEFT JOIN sn USING (m) GROUP BY 1"))
def t6b(spark, d):
    """How often fifty resamples have each concept of all customers."""
    df = checkpointed(cohort(spark, d))
    return rounded(stability.set_recurrence(stability.fit_crisp(df)[1], checkpointed(stability.resample_sets(df, RESAMPLES)), "b"))


_FOLD_SETS = FOLDS + """, tr AS (SELECT g.i AS run, customer_id, R::DOUBLE AS R, F::DOUBLE AS F, M FROM folds, range(5) g(i) WHERE fold <> g.i),
qt AS (SELECT run, list_transform(quantile_cont(R, [0.2, 0.4, 0.6, 0.8]), lambda v: round(v, 6)) AS qr, list_transform(quantile_cont(F, [0.2, 0.4, 0.6, 0.8]), lambda v: round(v, 6)) AS qf,
  list_transform(quantile_cont(M, [0.2, 0.4, 0.6, 0.8]), lambda v: round(v, 6)) AS qm FROM tr GROUP BY run),
kt AS (SELECT run, 4 - len(list_filter(qr, lambda c: R > c)) AS rs, 5 + len(list_filter(qf, lambda c: F > c)) AS fs, 10 + len(list_filter(qm, lambda c: M > c)) AS ms FROM tr JOIN qt USING (run)),
mt AS (SELECT *, ((1 << rs) + (1 << fs) + (1 << ms))::BIGINT AS mask FROM kt), nt AS (SELECT run, count(*) AS t FROM mt GROUP BY run),
ct AS (SELECT run, count(*) AS n, bit_and(mask) AS m FROM mt GROUP BY run, CUBE (rs, fs, ms)), sn AS (SELECT DISTINCT run, m FROM ct JOIN nt USING (run) WHERE n >= 0.04 * t AND m <> 0)"""


def _fold_concepts(spark, d, fuzzy):
    """(cuts, concepts, centroids) of five folds' training rows, fitted at once."""
    folds = functools.reduce(lambda a, b: a.unionByName(b), [x.withColumn("run", F.lit(f)) for f, x in enumerate(models.folds_as_splits(cohort(spark, d)))])
    return features.run_concepts(checkpointed(folds.where("NOT held")), fuzzy)


@query("t7_fold_jaccards", with_(_FOLD_SETS, """, z AS (SELECT run, count(*) AS n FROM sn GROUP BY 1), c AS (SELECT x.run AS a, y.run AS b, count(*) AS c FROM sn x JOIN sn y ON x.m = y.m AND x.run < y.run GROUP BY 1, 2)
SELECT p.run AS a, q.run AS b, round(coalesce(c, 0) / (p.n + q.n - coalesce(c, 0)), 6) AS jaccard FROM z p JOIN z q ON p.run < q.run LEFT JOIN c ON c.a = p.run AND c.b = q.run"""))
def t7(spark, d):
    """Crisp concept sets of five folds, each fitted on the other four."""
    return rounded(stability.set_jaccards(_fold_concepts(spark, d, False)[1].select("run", "band_mask"), "run"))


@query("t7_fold_jaccards_fuzzy")
def t7b(spark, d):
    """Kept fuzzy concepts of the same folds."""
    return rounded(stability.set_jaccards(_fold_concepts(spark, d, True)[1].select("run", "band_mask"), "run"))


@query("t8_equal_segments", with_(CRISP_COHORT.format(cut="1998-01-01"), """, co AS (SELECT list(customer_id ORDER BY customer_id) AS c FROM proj GROUP BY m), fe AS (SELECT c FROM co WHERE len(c) >= 0.1 * (SELECT count(*) FROM m0))
SELECT (SELECT count(*) FROM (SELECT c FROM co EXCEPT ALL SELECT c FROM fe)) AS only_first, (SELECT count(*) FROM (SELECT c FROM fe EXCEPT ALL SELECT c FROM co)) AS only_second"""))
def t8(spark, d):
    """Segments of a model against those of a refit that asks for more support, on the customers in another order."""
    df = cohort(spark, d)
    cuts, found = stability.fit_crisp(df)
    other = df.orderBy(F.desc("M"))
    cuts2, found2 = stability.fit_crisp(other)
    held = F.col("n_customers") >= 0.1 * F.lit(df.count())
    return stability.equal_columns(stability.project_crisp(df, (cuts, found)), stability.project_crisp(other, (cuts2, found2.where(held))))


@query("m9_lower_neighbours")
def m9(spark, d):
    """How many maximal sub-extents each concept has."""
    import pandas as pd

    df = fuzzy(spark, d)
    rows, found = checkpointed(concepts.profiles(df)), fuzzy_c(spark, d)
    met = rows.groupBy("mask").agg(F.sum("n").alias("n")).join(F.broadcast(found.select("intent_mask")), F.col("mask").bitwiseAND(F.col("intent_mask")) == F.col("intent_mask"))

    def count(frames):
        for f in frames:
            yield pd.DataFrame({"intent_mask": f["intent_mask"], "n_lower": [len(lattice.lower_neighbours({int(m): 1 for m in g}, int(i))) for i, g in zip(f["intent_mask"], f["g"], strict=True)]})

    return met.groupBy("intent_mask").agg(F.collect_list("mask").alias("g")).mapInPandas(count, "intent_mask long, n_lower long")


def _kuznetsov(spark, d):
    return lattice.kuznetsov(fuzzy_c(spark, d), checkpointed(concepts.profiles(fuzzy(spark, d))))


@query("m10_kuznetsov_stability")
def m10(spark, d):
    """The exact number of generating sets, as powers of two, and the share that it is."""
    return rounded(_kuznetsov(spark, d).select("intent_mask", "n_generators", "stability", "log2_loss", "status"))


@query("m11_log2_stability")
def m11(spark, d):
    """Twelve leading digits and their power of ten: stabilities next to 1 have logarithms next to 0."""
    return _kuznetsov(spark, d).select("intent_mask", F.round(F.col("log2_stability") * F.pow(F.lit(10.0), 11 - F.floor(F.log10(F.abs("log2_stability")))), 0).alias("digits"), F.floor(F.log10(F.abs("log2_stability"))).alias("exponent"))


@query("m12_loss_grid")
def m12(spark, d):
    """Concepts kept at each loss of the grid, and how many the state limit leaves uncounted."""
    k = checkpointed(_kuznetsov(spark, d))
    grid = spark.createDataFrame([(v,) for v in lattice.LOSS_GRID], "max_loss double")
    return grid.join(F.broadcast(k), (F.col("status") == "exact") & (1 - F.col("stability") <= F.col("max_loss")), "left").groupBy("max_loss").agg(F.count("intent_mask").alias("kept")).crossJoin(F.broadcast(k.agg(F.count_if(F.col("status") == "capped").alias("capped"))))

"""Queries of memberships, contexts, concepts and their pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions.ranks import checkpointed
from cohortlens.operators import concepts, membership, pruning, scoring

from .base import CENTROIDS, COHORT, MU, SCORED_LONG, cohort, fuzzy, query, rounded, scored, with_

DEGREES = ["R", "F", "M"]


def mu_columns(df, digits=6):
    """(customer_id, R1 ... M5) of the degree arrays."""
    return rounded(df.select("customer_id", *[F.get(f"{d}_mu", F.lit(b)).alias(f"{d}{b + 1}") for d in DEGREES for b in range(5)]), digits)


MU_WIDE = ", ".join(f"round({d}_mu[{b}], 6) AS {d}{b}" for d in DEGREES for b in range(1, 6))


@query("f1_band_centroids", with_(CENTROIDS, "SELECT dim, band::BIGINT AS band, round(c, 6) AS centroid FROM cen"))
def f1(spark, d):
    c = membership.band_centroids(scored(spark, d))
    return rounded(c.select("dim", F.posexplode("cuts").alias("i", "centroid")).select("dim", (F.col("i") + 1).alias("band"), "centroid"))


@query("f2_piecewise", with_(MU, f"SELECT customer_id, {MU_WIDE} FROM mus"))
def f2(spark, d):
    return mu_columns(fuzzy(spark, d))


@query("f3_piecewise_levels", with_(COHORT, """, q AS (SELECT customer_id, F::DOUBLE AS x, 1 + (F > 3)::INT + (F > 5)::INT AS s FROM cohort),
c AS (SELECT s, median(x) AS c FROM q GROUP BY 1), p AS (SELECT s, c, lag(c) OVER (ORDER BY c) AS lo, lead(c) OVER (ORDER BY c) AS hi FROM c)
SELECT customer_id, s::BIGINT AS band, round(greatest(0.0, least(1.0, CASE WHEN lo IS NULL THEN 1.0 ELSE (x - lo) / (c - lo) END, CASE WHEN hi IS NULL THEN 1.0 ELSE (hi - x) / (hi - c) END)), 6) AS mu
FROM (SELECT customer_id, x FROM q) CROSS JOIN p"""))
def f3(spark, d):
    """Three levels of F."""
    df = cohort(spark, d).select("customer_id", F.col("F").cast("double").alias("x"))
    band = 1 + (F.col("x") > 3).cast("int") + (F.col("x") > 5).cast("int")
    c = df.agg(*[F.median(F.when(band == b, F.col("x"))).alias(f"c{b}") for b in (1, 2, 3)])
    mu = membership.piecewise(F.col("x"), F.array_compact(F.array("c1", "c2", "c3")))
    out = df.crossJoin(F.broadcast(c)).select("customer_id", F.posexplode(mu).alias("i", "mu"))
    return rounded(out.select("customer_id", (F.col("i") + 1).alias("band"), "mu"))


@query("f4_fuzzify_new_customers")
def f4(spark, d):
    """Centroids fitted on customers of even id hash, projected onto the others."""
    df = cohort(spark, d).withColumn("part", F.conv(F.substring(F.md5(F.col("customer_id").cast("binary")), 1, 4), 16, 10).cast("long") % 2)
    train, test = df.where("part = 0").drop("part"), df.where("part = 1").drop("part")
    cuts = scoring.fit_cutpoints(train, strict=False)
    return mu_columns(membership.fuzzify(test, membership.band_centroids(scoring.score(train, cuts))))


@query("f5_coincident_centroids", "SELECT band::BIGINT AS band, (CASE WHEN band = 3 THEN 1.0::DOUBLE ELSE 0 END) AS mu FROM (SELECT unnest(range(1, 6)) AS band)")
def f5(spark, d):
    """Coincident centroids: the middle level has degree 1."""
    df = spark.range(1).select(membership.guarded_piecewise(F.lit(2.0), F.array(*[F.lit(2.0)] * 5)).alias("mu"))
    return rounded(df.select(F.posexplode("mu").alias("i", "mu")).select((F.col("i") + 1).alias("band"), "mu"))


def _family_sql(x: str, c: str, raw: str) -> str:
    return with_(CENTROIDS, f""", cc AS (SELECT dim, band, p, {c} AS c FROM pos),
g AS (SELECT dim, p, c, lead(c) OVER (PARTITION BY dim ORDER BY p) - c AS gap FROM cc),
mg AS (SELECT dim, median(gap) AS m FROM g WHERE gap > 0 GROUP BY 1),
gg AS (SELECT g.dim, p, c, CASE WHEN gap IS NULL THEN NULL WHEN gap > 0 THEN gap ELSE coalesce(m, 1.0) END AS gap FROM g LEFT JOIN mg USING (dim)),
w AS (SELECT dim, p, c, greatest(1e-12 * greatest(1.0, max(abs(c)) OVER (PARTITION BY dim)), CASE WHEN p = 1 THEN gap / 2 WHEN gap IS NULL THEN lag(gap) OVER (PARTITION BY dim ORDER BY p) / 2
  ELSE (gap + lag(gap) OVER (PARTITION BY dim ORDER BY p)) / 4 END) AS w FROM gg),
z AS (SELECT customer_id, l.dim, w.p, ({x} - w.c) / w.w AS z FROM l JOIN w USING (dim)),
e AS (SELECT *, -0.5 * z * z - max(-0.5 * z * z) OVER (PARTITION BY customer_id, dim) AS e FROM z),
r AS (SELECT customer_id, dim, p, {raw} AS raw FROM e),
n AS (SELECT customer_id, dim, p, round(raw / sum(raw) OVER (PARTITION BY customer_id, dim), 9) AS mu FROM r)
SELECT customer_id, n.dim, band::BIGINT AS band, mu FROM n JOIN pos USING (dim, p)""")


def _family(spark, d, family):
    df = fuzzy(spark, d, family)
    parts = [df.select("customer_id", F.lit(c).alias("dim"), F.posexplode(f"{c}_mu").alias("i", "mu")) for c in DEGREES]
    out = parts[0].union(parts[1]).union(parts[2])
    return rounded(out.select("customer_id", "dim", (F.col("i") + 1).alias("band"), "mu"), 9)


@query("f6_gaussian", _family_sql("x", "c", "exp(e)"))
def f6(spark, d):
    return _family(spark, d, "gaussian")


@query("f7_bell", _family_sql("x", "c", "1 / (1 + pow(abs(z), 4))"))
def f7(spark, d):
    return _family(spark, d, "bell")


@query("f8_log_gaussian", _family_sql("ln(1 + greatest(x, 0))", "ln(1 + greatest(c, 0))", "exp(e)"))
def f8(spark, d):
    return _family(spark, d, "log_gaussian")


@query("f9_adjacent_widths", _family_sql("x", "c", "1").split("\nz AS")[0].rstrip(",") + " SELECT dim, p::BIGINT AS place, round(w, 6) AS width FROM w")
def f9(spark, d):
    c = membership.band_centroids(scored(spark, d)).withColumn("c", F.array_sort("cuts"))
    c = membership.with_widths(c, "c", "w").select("dim", F.posexplode("w").alias("i", "width"))
    return rounded(c.select("dim", (F.col("i") + 1).alias("place"), "width"))


TAIL = SCORED_LONG + """, zz AS (SELECT dim, ln(1 + x) AS z, s FROM s WHERE dim <> 'R'),
an AS (SELECT dim, [round(median(z) FILTER (s = 1), 9), round(median(z) FILTER (s = 2), 9), round(median(z) FILTER (s = 3), 9), round(median(z) FILTER (s = 4), 9)] AS a,
  round(quantile_cont(z, 0.75) FILTER (s = 5) - quantile_cont(z, 0.25) FILTER (s = 5), 9) AS iqr, avg(z) FILTER (s = 5) AS top FROM zz GROUP BY 1),
tail AS (SELECT dim, a, CASE WHEN iqr > 0 THEN iqr ELSE round(top - a[4], 9) END AS st FROM an)"""


@query("f10_recency_fit", with_(CENTROIDS, "SELECT band::BIGINT AS band, round(c, 6) AS centroid FROM cen WHERE dim = 'R'"))
def f10(spark, d):
    """Recency parameters: strict cutpoints, then the centroids in score order."""
    c = membership.band_centroids(scored(spark, d)).where("dim = 'R'")
    return rounded(c.select(F.posexplode("cuts").alias("i", "centroid")).select((F.col("i") + 1).alias("band"), "centroid"))


@query("f11_tail_fit", with_(TAIL, "SELECT dim, round(a[1], 6) AS a1, round(a[2], 6) AS a2, round(a[3], 6) AS a3, round(a[4], 6) AS a4, round(st, 6) AS s_tail FROM tail"))
def f11(spark, d):
    t = membership.fit_tail(scored(spark, d))
    return rounded(t.select("dim", *[F.col("anchors")[i].alias(f"a{i + 1}") for i in range(4)], "s_tail"))


TAIL_MU = TAIL + """, tz AS (SELECT customer_id, l.dim, ln(1 + x) AS z, a, st FROM l JOIN tail USING (dim)),
tb AS (SELECT customer_id, dim, z, a, st, unnest(range(1, 6)) AS band FROM tz),
tm AS (SELECT customer_id, dim, band, round(CASE
  WHEN band = 5 THEN CASE WHEN z > a[4] THEN (z - a[4]) / (z - a[4] + st) ELSE 0.0 END
  WHEN band = 4 AND z > a[4] THEN 1 - (z - a[4]) / (z - a[4] + st)
  ELSE greatest(0.0, least(1.0, CASE WHEN band = 1 THEN 1.0 ELSE (least(z, a[4]) - a[band - 1]) / (a[band] - a[band - 1]) END,
    CASE WHEN band = 4 THEN 1.0 ELSE (a[band + 1] - least(z, a[4])) / (a[band + 1] - a[band]) END)) END, 9) AS mu FROM tb)"""


@query("f12_tail_memberships", with_(TAIL_MU, "SELECT customer_id, dim, band::BIGINT AS band, round(mu, 6) AS mu FROM tm"))
def f12(spark, d):
    df = _tail(spark, d)
    parts = [df.select("customer_id", F.lit(c).alias("dim"), F.posexplode(f"{c}_mu").alias("i", "mu")) for c in ("F", "M")]
    return rounded(parts[0].union(parts[1]).select("customer_id", "dim", (F.col("i") + 1).alias("band"), "mu"))


def _tail(spark, d):
    df = scored(spark, d)
    return membership.fuzzify_tail(df, membership.band_centroids(df), membership.fit_tail(df))


@query("f13_fit_transform", with_(MU, "SELECT customer_id, round(R_mu[1], 6) AS R1, round(R_mu[5], 6) AS R5 FROM mus"))
def f13(spark, d):
    """Fit and transform in one: the recency degrees of the tail variant are the piecewise ones."""
    return rounded(_tail(spark, d).select("customer_id", F.get("R_mu", F.lit(0)).alias("R1"), F.get("R_mu", F.lit(4)).alias("R5")))


@query("f14_input_guard", with_(COHORT, "SELECT count(*) AS n, min(R)::BIGINT AS low FROM cohort"))
def f14(spark, d):
    return rounded(membership.check_values(cohort(spark, d)).agg(F.count("*").alias("n"), F.min("R").alias("low"), F.max("F").alias("__f"), F.max("M").alias("__m")).drop("__f", "__m"))


@query("f15_tail_uniqueness", with_(TAIL_MU, """, tt AS (SELECT l.dim, x, list(mu ORDER BY band) AS mu, customer_id FROM l JOIN cuts USING (dim) JOIN tm USING (dim, customer_id) WHERE x >= cuts[4] GROUP BY l.dim, x, customer_id),
gr AS (SELECT dim, sum(n) AS n, sum(n * (n - 1) / 2) AS tied FROM (SELECT dim, x, count(*) AS n FROM tt GROUP BY 1, 2) GROUP BY 1),
gm AS (SELECT dim, sum(n * (n - 1) / 2) AS tied FROM (SELECT dim, mu, count(*) AS n FROM tt GROUP BY 1, 2) GROUP BY 1)
SELECT dim, n::BIGINT AS n_tail, (n * (n - 1) / 2)::BIGINT AS total_pairs, gr.tied::BIGINT AS tied_raw_pairs, round(coalesce((n * (n - 1) / 2 - gm.tied) / nullif(n * (n - 1) / 2 - gr.tied, 0), 1), 6) AS d_mem FROM gr JOIN gm USING (dim)"""))
def f15(spark, d):
    df = _tail(spark, d)
    return rounded(membership.tail_uniqueness(df, scoring.fit_cutpoints(cohort(spark, d))))


CONTEXT = MU + ", ctx AS (SELECT customer_id, sum(CASE WHEN mu >= t.v THEN (1::BIGINT << (((CASE dim WHEN 'R' THEN 0 WHEN 'F' THEN 5 ELSE 10 END) + band - 1) * 3 + t.i)) ELSE 0 END)::BIGINT AS mask FROM mu CROSS JOIN (VALUES (0, 0.3), (1, 0.5), (2, 0.7)) t(i, v) GROUP BY 1)"


@query("f16_context_diversity", with_(CONTEXT, ", p AS (SELECT mask, count(*) AS n FROM ctx GROUP BY 1) SELECT count(*) AS d_ctx, round(-sum(n / t * log2(n / t)), 6) AS h_ctx FROM p, (SELECT count(*) AS t FROM ctx)"))
def f16(spark, d):
    masks = fuzzy(spark, d).select(concepts.fuzzy_mask().alias("mask"))
    return rounded(masks.agg(F.countDistinct("mask").alias("d_ctx")).crossJoin(F.broadcast(scoring.entropy_bits(masks, [], "mask").withColumnRenamed("entropy", "h_ctx"))))


@query("f17_membership_spread", with_(MU, """, sh AS (SELECT customer_id, dim, mu / sum(mu) OVER (PARTITION BY customer_id, dim) AS p FROM mu),
h AS (SELECT customer_id, dim, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) / ln(5.0) AS h, 1 / sum(p * p) AS o FROM sh GROUP BY 1, 2)
SELECT dim, round(avg(h), 6) AS entropy, round(avg(o), 6) AS overlap FROM h GROUP BY 1"""))
def f17(spark, d):
    return rounded(membership.membership_spread(fuzzy(spark, d)))


@query("m1_context_masks", with_(CONTEXT, "SELECT customer_id, mask FROM ctx"))
def m1(spark, d):
    return fuzzy(spark, d).select("customer_id", concepts.fuzzy_mask().alias("mask"))


CRISP = SCORED_LONG + """, cm AS (SELECT customer_id, R_score, F_score, M_score, ((1 << (R_score - 1)) + (1 << (F_score + 4)) + (1 << (M_score + 9)))::BIGINT AS mask FROM scored),
cube AS (SELECT count(*) AS n, bit_and(mask) AS intent_mask, grouping(R_score, F_score, M_score) AS g FROM cm GROUP BY CUBE (R_score, F_score, M_score)),
crisp AS (SELECT intent_mask, max(n) AS n_customers, max(n / t) AS support FROM cube, (SELECT count(*) AS t FROM cm) WHERE n >= 0.04 * t OR g = 7 GROUP BY 1)"""


def crisp(spark, d):
    return concepts.crisp_concepts(scored(spark, d))


@query("m2_crisp_concepts", with_(CRISP, "SELECT intent_mask, n_customers, round(support, 6) AS support FROM crisp"))
def m2(spark, d):
    return rounded(crisp(spark, d))


_PROFILE = CONTEXT + ", pr AS (SELECT mask, R_score + 10 * F_score + 100 * M_score AS triple, count(*) AS n FROM ctx JOIN scored USING (customer_id) GROUP BY 1, 2)"
_PATTERN = ", a{i} AS (SELECT DISTINCT (mask >> {s}) & 32767 AS p FROM pr), b{i} AS (SELECT DISTINCT x.p & y.p AS p FROM a{i} x, a{i} y), c{i} AS (SELECT DISTINCT x.p & y.p AS p FROM b{i} x, b{i} y UNION SELECT 0)"
FUZZY_C = (
    _PROFILE
    + "".join(_PATTERN.format(i=i, s=15 * i) for i in range(3))
    + """, cand AS (SELECT c0.p + (c1.p << 15) + (c2.p << 30) AS key, sum(n) AS n, bit_and(mask) AS intent_mask, count(DISTINCT triple) AS triples FROM pr
  JOIN c0 ON (mask & c0.p) = c0.p JOIN c1 ON ((mask >> 15) & c1.p) = c1.p JOIN c2 ON ((mask >> 30) & c2.p) = c2.p GROUP BY 1),
fc AS (SELECT intent_mask::BIGINT AS intent_mask, max(n)::BIGINT AS n_customers, max(n / t) AS support, max(CASE WHEN n <= 1 THEN 1.0::DOUBLE ELSE 1 - triples / n END) AS stability_proxy
  FROM cand, (SELECT sum(n) AS t FROM pr) WHERE n >= 0.04 * t AND intent_mask <> 0 GROUP BY 1)"""
)


def fuzzy_c(spark, d):
    return concepts.fuzzy_concepts(fuzzy(spark, d))


@query("m3_fuzzy_concepts", with_(FUZZY_C, "SELECT intent_mask, n_customers, round(support, 6) AS support FROM fc"))
def m3(spark, d):
    return rounded(fuzzy_c(spark, d).drop("stability_proxy"))


@query("m4_stability_proxy", with_(FUZZY_C, "SELECT intent_mask, round(stability_proxy, 6) AS stability_proxy FROM fc"))
def m4(spark, d):
    return rounded(fuzzy_c(spark, d).select("intent_mask", "stability_proxy"))


KNEE = FUZZY_C + "".join(
    f""", k{c[:2]} AS (SELECT {c} AS y, (row_number() OVER (ORDER BY {c} DESC, intent_mask) - 1)::DOUBLE AS i FROM fc),
e{c[:2]} AS (SELECT max(i) AS last, max(y) AS hi, min(y) AS lo FROM k{c[:2]}),
t{c[:2]} AS (SELECT CASE WHEN max(last) < 2 THEN min(y) ELSE arg_max(y, [round(1 - coalesce(i / nullif(last, 0), 0) - coalesce((y - lo) / nullif(hi - lo, 0), 0), 9), -i]) END AS knee FROM k{c[:2]}, e{c[:2]})"""
    for c in ("support", "stability_proxy")
)


@query("m5_knee_flags", with_(KNEE, "SELECT intent_mask, support >= (SELECT knee FROM tsu) AND stability_proxy >= (SELECT knee FROM tst) AS is_knee FROM fc"))
def m5(spark, d):
    return concepts.knee_flags(fuzzy_c(spark, d)).select("intent_mask", "is_knee")


BASE = "list_sum(list_transform(range(15), lambda b: CASE WHEN (intent_mask & (7::BIGINT << (b * 3))) <> 0 THEN 1 << b ELSE 0 END))::BIGINT"


@query("m6_base_bands", with_(FUZZY_C, f"SELECT intent_mask, {BASE} AS band_mask FROM fc"))
def m6(spark, d):
    return fuzzy_c(spark, d).select("intent_mask", concepts.base_bands(F.col("intent_mask")).alias("band_mask"))


PROFILES = FUZZY_C + f", fb AS (SELECT *, {BASE} AS band_mask FROM fc), fd AS (SELECT * FROM fb QUALIFY row_number() OVER (PARTITION BY band_mask ORDER BY n_customers DESC, bit_count(intent_mask), intent_mask) = 1)"


def profiles(spark, d):
    return concepts.distinct_profiles(fuzzy_c(spark, d))


@query("m7_distinct_profiles", with_(PROFILES, "SELECT intent_mask, band_mask, n_customers FROM fd"))
def m7(spark, d):
    return profiles(spark, d).select("intent_mask", "band_mask", "n_customers")


@query("m8_closure_check", with_(FUZZY_C, "SELECT intent_mask, n_customers AS extent, true AS closed FROM fc"))
def m8(spark, d):
    """Both derivations: the customers that hold the intent, and what they have in common."""
    df = fuzzy(spark, d)
    return rounded(concepts.verify_closures(concepts.fuzzy_concepts(df), concepts.profiles(df)))


@query("m13_reconciliation", with_(CRISP, """, p(intent, n_published) AS (VALUES ('R5', 1::BIGINT), ('F1', 2), ('R1 & F1', 3), ('(universal root)', 1480), ('X9', 5)),
i AS (SELECT n_customers, CASE WHEN intent_mask = 0 THEN '(universal root)' ELSE array_to_string(list_transform(list_filter(range(15), lambda b: (intent_mask & (1 << b)) <> 0), lambda b: 'RFM'[b // 5 + 1] || (b % 5 + 1)), ' & ') END AS intent FROM crisp)
SELECT intent, n_published, coalesce(n_customers, 0) AS n_customers, coalesce(n_customers = n_published, false) AS exact FROM p LEFT JOIN i USING (intent)"""))
def m13(spark, d):
    published = spark.createDataFrame([("R5", 1), ("F1", 2), ("R1 & F1", 3), ("(universal root)", 1480), ("X9", 5)], "intent string, n_published long")
    mined = crisp(spark, d).withColumn("intent", concepts.intent_text(F.col("intent_mask"), ()))
    return concepts.reconcile(mined, published).withColumn("n_customers", F.coalesce("n_customers", F.lit(0).cast("long")))


GODEL = PROFILES + ", al AS (SELECT customer_id, (CASE dim WHEN 'R' THEN 0 WHEN 'F' THEN 5 ELSE 10 END) + band - 1 AS b, mu FROM mu), dg AS (SELECT customer_id, band_mask, round(min(mu), 9) AS mu FROM fd JOIN al ON (band_mask & (1 << b)) <> 0 GROUP BY 1, 2)"


def degrees(spark, d, t_norm="min"):
    return pruning.concept_degrees(fuzzy(spark, d), profiles(spark, d), t_norm)


@query("g1_godel", with_(GODEL, "SELECT customer_id, band_mask, round(mu, 6) AS mu FROM dg"))
def g1(spark, d):
    return rounded(degrees(spark, d))


@query("g2_product", with_(GODEL, "SELECT customer_id, band_mask, round(product(mu), 6) AS mu FROM fd JOIN al ON (band_mask & (1 << b)) <> 0 GROUP BY 1, 2"))
def g2(spark, d):
    return rounded(degrees(spark, d, "product"))


CORE = GODEL + """, cr AS (SELECT customer_id, band_mask FROM dg WHERE mu >= 0.5), sz AS (SELECT band_mask, count(*) AS n FROM cr GROUP BY 1),
ov AS (SELECT x.band_mask AS a, y.band_mask AS b, count(*) AS common FROM cr x JOIN cr y ON x.customer_id = y.customer_id AND x.band_mask < y.band_mask GROUP BY 1, 2),
jc AS (SELECT a, b, common, p.n AS size_a, q.n AS size_b, common / (p.n + q.n - common) AS jaccard FROM ov JOIN sz p ON p.band_mask = a JOIN sz q ON q.band_mask = b)"""


@query("g3_core_overlaps", with_(CORE, "SELECT a, b, common, size_a, size_b, round(jaccard, 6) AS jaccard FROM jc"))
def g3e(spark, d):
    return rounded(pruning.core_overlaps(mined(spark, d)[1]))


def mined(spark, d):
    """(concepts by band set, core profiles), each worked out once."""
    degrees = checkpointed(fuzzy(spark, d))
    found = checkpointed(concepts.distinct_profiles(concepts.fuzzy_concepts(degrees)))
    return found, checkpointed(pruning.core_profiles(degrees, found))


def kept(spark, d, **options):
    return pruning.suppress(*mined(spark, d), **options)


def _greedy_sql(order: str, select: str) -> str:
    """The concepts one by one, with the list of those kept so far."""
    return with_(CORE, f""", nr AS (SELECT m, list(o) AS near FROM (SELECT a AS m, b AS o FROM jc WHERE jaccard >= 0.8 UNION ALL SELECT b, a FROM jc WHERE jaccard >= 0.8) GROUP BY m),
od AS MATERIALIZED (SELECT fd.*, coalesce(near, []::BIGINT[]) AS near, row_number() OVER (ORDER BY {order}) AS i FROM fd JOIN sz USING (band_mask) LEFT JOIN nr ON m = band_mask WHERE band_mask <> 0),
wk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT od.i, CASE WHEN list_has_any(kept, near) THEN kept ELSE list_append(kept, band_mask::BIGINT) END FROM wk JOIN od ON od.i = wk.i + 1),
kp AS (SELECT unnest(kept) AS band_mask FROM wk WHERE i = (SELECT max(i) FROM wk))
{select}""").replace("WITH ", "WITH RECURSIVE ", 1)


_KEPT = "SELECT fd.band_mask, intent_mask, n_customers FROM fd JOIN kp USING (band_mask)"
_BY_QUALITY = "n_customers DESC, bit_count(band_mask), stability_proxy DESC, band_mask"


@query("g3_greedy_suppression", _greedy_sql(_BY_QUALITY, _KEPT))
def g3(spark, d):
    return rounded(kept(spark, d).select("band_mask", "intent_mask", "n_customers"))


@query("g4_suppression_by_support", _greedy_sql("n_customers DESC, band_mask", _KEPT))
def g4(spark, d):
    return rounded(kept(spark, d, by_support_only=True).select("band_mask", "intent_mask", "n_customers"))


@query("g5_hard_labels", with_(GODEL, "SELECT customer_id, band_mask, round(mu, 6) AS mu FROM dg JOIN fd USING (band_mask) QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY round(mu, 6) DESC, n_customers DESC, bit_count(band_mask), band_mask) = 1"))
def g5(spark, d):
    return rounded(pruning.hard_labels(degrees(spark, d), profiles(spark, d)))


@query("g6_top_k_labels", with_(GODEL, ", tk AS (SELECT band_mask, row_number() OVER (ORDER BY n_customers DESC, band_mask) AS place FROM fd QUALIFY place <= 4) SELECT customer_id, arg_max(band_mask, [mu, -place]) AS band_mask FROM dg JOIN tk USING (band_mask) GROUP BY 1"))
def g6(spark, d):
    return pruning.top_k_labels(degrees(spark, d), profiles(spark, d))


@query("g7_matrix_info", with_(GODEL, ", cl AS (SELECT band_mask, list(mu ORDER BY customer_id) AS c, count(*) FILTER (mu >= 0.5) AS core FROM dg GROUP BY 1) SELECT count(*) AS n_features, count(DISTINCT c) AS n_distinct_columns, count(*) FILTER (core = 0) AS n_empty_core FROM cl"))
def g7(spark, d):
    return rounded(pruning.matrix_info(degrees(spark, d)))


COMPLEX = CORE + """, pc AS (SELECT customer_id, max(mu) AS top, count(*) FILTER (mu >= 0.5) AS k, list(band_mask ORDER BY band_mask) FILTER (mu >= 0.5) AS prof FROM dg GROUP BY 1),
cx AS (SELECT avg((top > 0)::INT) AS coverage_any, avg((k > 0)::INT) AS coverage_core, avg(k) AS concepts_per_customer, avg((k > 1)::INT) AS multi_share, count(DISTINCT coalesce(prof, [])) AS unique_profiles FROM pc),
kk AS (SELECT count(*) AS k, count(*) * (count(*) - 1) / 2 AS pairs, avg(bit_count(band_mask)) AS intent_length FROM fd),
jj AS (SELECT coalesce(sum(jaccard), 0) AS s, count(*) FILTER (jaccard >= 0.8) AS d FROM jc)"""


@query("g8_complexity", with_(COMPLEX, "SELECT round(coverage_any, 6) AS coverage_any, round(coverage_core, 6) AS coverage_core, round(concepts_per_customer, 6) AS concepts_per_customer, round(multi_share, 6) AS multi_share, unique_profiles, round(s / pairs, 6) AS mean_jaccard, round(d / pairs, 6) AS near_duplicate_share FROM cx, kk, jj"))
def g8(spark, d):
    return rounded(pruning.complexity(*reversed(mined(spark, d))))


@query("g9_interpretability", with_(COMPLEX, "SELECT k, round(coverage_core, 6) AS coverage, round(intent_length, 6) AS intent_length, round(concepts_per_customer / coverage_core, 6) AS core_load, round(s / pairs, 6) AS overlap FROM cx, kk, jj"))
def g9(spark, d):
    return rounded(pruning.interpretability(*reversed(mined(spark, d))))


@query("g10_greedy_cover")
def g10(spark, d):
    return rounded(pruning.greedy_cover(mined(spark, d)[1]))


@query("g11_lattice_summary")
def g11(spark, d):
    found, profiles_ = mined(spark, d)
    return rounded(pruning.lattice_summary(found, pruning.suppress(found, profiles_), profiles_))


@query("g12_best_k", with_(PROFILES, ", nk AS (SELECT count(*) AS k FROM (WITH " + CRISP + " SELECT * FROM crisp WHERE intent_mask <> 0)) SELECT band_mask, place FROM (SELECT band_mask, row_number() OVER (ORDER BY n_customers DESC, bit_count(band_mask), round(stability_proxy, 9) DESC, band_mask) AS place FROM fd), nk WHERE place <= k"))
def g12(spark, d):
    """As many fuzzy concepts as there are crisp ones. The number is the feature."""
    k = crisp(spark, d).where("intent_mask <> 0").count()
    best = pruning.best_k(profiles(spark, d).withColumn("stability_proxy", F.round("stability_proxy", 9)), k)
    return rounded(best.select("band_mask", "place"))

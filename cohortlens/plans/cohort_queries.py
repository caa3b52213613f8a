"""Queries of the sources, scalar operators, cohorts and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import cohorts, scoring

from .base import COHORT, CUTOFF, CUTS, LONG, SCORED_LONG, TX, cohort, query, rounded, scored, table, transactions, with_

LINES = """lines AS (SELECT o_custkey::VARCHAR AS customer_id, o_orderkey AS invoice, o_orderdate AS ts_,
  (l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(4,2)))::DECIMAL(18,4) AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 0 AND l_extendedprice > 0 AND l_returnflag <> 'R' AND o_custkey IS NOT NULL)"""


@query("s1_clean_lines", with_(LINES, "SELECT customer_id, count(*) AS n_lines, count(DISTINCT invoice) AS invoices, round(sum(v)::DOUBLE, 4) AS value FROM lines GROUP BY 1"))
def s1(spark, d):
    lines = cohorts.clean_lines(table(spark, d, "lineitem"), table(spark, d, "orders"))
    return rounded(lines.groupBy("customer_id").agg(F.count("*").alias("n_lines"), F.countDistinct("invoice").alias("invoices"), F.sum("value").cast("double").alias("value")), 4)


@query("s2_pruned_scan", "SELECT o_custkey, o_orderkey, datediff('day', DATE '1995-01-01', o_orderdate::DATE)::BIGINT AS day, round(o_totalprice, 2) AS value FROM orders")
def s2(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_custkey", "o_orderkey", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long").alias("day"), F.round("o_totalprice", 2).alias("value"))


@query("s5_fixed_cohort", with_(TX, """, obs AS (SELECT customer_id, max(datediff('day', DATE '1995-01-01', ts_::DATE)) AS last_day, count(DISTINCT invoice) AS F, sum(v)::DOUBLE AS M FROM tx
 WHERE datediff('day', DATE '1995-01-01', ts_::DATE) <= 1096 GROUP BY 1),
h AS (SELECT customer_id, count(DISTINCT invoice) AS fi, sum(v)::DOUBLE AS fs FROM tx WHERE datediff('day', DATE '1995-01-01', ts_::DATE) > 1096 AND datediff('day', DATE '1995-01-01', ts_::DATE) <= 1187 GROUP BY 1)
SELECT customer_id, (1096 - last_day)::BIGINT AS R, F, round(M, 2) AS M, coalesce(fi, 0) AS future_invoices, round(coalesce(fs, 0), 2) AS future_spend FROM obs LEFT JOIN h USING (customer_id)"""))
def s5(spark, d):
    day = F.datediff(F.col("at").cast("date"), F.lit("1995-01-01").cast("date"))
    origin = spark.createDataFrame([("day 1096", True, 1096, 91)], "origin string, pooled boolean, cutoff int, horizon int")
    df = cohorts.build_cohorts(transactions(spark, d).withColumn("at", day), origin, by_day=True)
    return rounded(df.select("customer_id", "R", "F", "M", "future_invoices", "future_spend"), 2)


@query("p1_range_filter", f"SELECT count(*) FILTER (o_orderdate <= TIMESTAMP '{CUTOFF}') AS observed, count(*) FILTER (o_orderdate > TIMESTAMP '{CUTOFF}' AND o_orderdate <= TIMESTAMP '{CUTOFF}' + INTERVAL 91 DAY) AS held FROM orders")
def p1(spark, d):
    o, cut = table(spark, d, "orders"), F.lit(CUTOFF).cast("timestamp_ntz")
    at = F.col("o_orderdate")
    return o.agg(F.count_if(at <= cut).alias("observed"), F.count_if((at > cut) & (at <= cut + F.expr("INTERVAL 91 DAY"))).alias("held"))


@query("p2_isin", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'purchase', 'click') GROUP BY 1")
def p2(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("view", "purchase", "click")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("p3_string_filters", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE NOT starts_with(o_orderpriority, '1') AND contains(o_orderpriority, '-') GROUP BY 1")
def p3(spark, d):
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").where(~p.startswith("1") & p.contains("-")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("p4_top_exclusion", with_(COHORT, """, z AS (SELECT stddev_samp(F) AS sf, stddev_samp(M) AS sm FROM cohort),
r AS (SELECT customer_id, F, M, row_number() OVER (ORDER BY round(F / sf + M / sm, 9) DESC, customer_id) AS place FROM cohort, z)
SELECT customer_id, F, round(M, 2) AS M FROM r WHERE place > 50"""))
def p4(spark, d):
    """Without the 50 customers of largest F / std + M / std: a limit is the feature; it is a top-k, so only 50 ids are ever sorted together."""
    df = cohort(spark, d)
    std = df.agg(F.stddev_samp("F").alias("sf"), F.stddev_samp("M").alias("sm"))
    top = df.crossJoin(F.broadcast(std)).orderBy(F.desc(F.round(F.col("F") / F.col("sf") + F.col("M") / F.col("sm"), 9)), "customer_id").limit(50)
    return rounded(df.join(F.broadcast(top.select("customer_id")), "customer_id", "left_anti").select("customer_id", "F", "M"), 2)


@query("p5_iqr_filter", with_(LONG, """, q AS (SELECT dim, quantile_cont(x, [0.25, 0.75]) AS q FROM l GROUP BY dim),
bad AS (SELECT DISTINCT customer_id FROM l JOIN q USING (dim) WHERE x < round(q[1] - 1.5 * (q[2] - q[1]), 6) OR x > round(q[2] + 1.5 * (q[2] - q[1]), 6))
SELECT customer_id, R::BIGINT AS R, F, round(M, 2) AS M FROM cohort ANTI JOIN bad USING (customer_id)"""))
def p5(spark, d):
    """Customers within 1.5 quartile ranges of the quartiles in every dimension."""
    from cohortlens.functions.ranks import exact_quantiles

    df = cohort(spark, d)
    q = exact_quantiles(scoring.long_dims(df, []), "x", [0.25, 0.75], ["dim"])
    lo, hi = F.col("quantiles")[0], F.col("quantiles")[1]
    fences = q.select("dim", F.array(F.round(lo - 1.5 * (hi - lo), 6), F.round(hi + 1.5 * (hi - lo), 6)).alias("cuts"))
    kept = df.crossJoin(F.broadcast(scoring.as_row(fences)))
    for c in scoring.DIMS:
        kept = kept.where(F.col(c).between(F.col(f"{c}_cuts")[0], F.col(f"{c}_cuts")[1]))
    return rounded(kept.select("customer_id", "R", "F", "M"), 2)


@query("p6_fill_clip", "SELECT c_custkey, round(greatest(coalesce(c_acctbal, 0), 0), 2) AS balance FROM customer")
def p6(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(F.greatest(F.coalesce("c_acctbal", F.lit(0.0)), F.lit(0.0)), 2).alias("balance"))


@query("p7_numeric", "SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS log1p, round(exp(o_totalprice / 1e6) - 1, 6) AS expm1, round(sqrt(abs(o_totalprice)), 6) AS root, ceil(o_totalprice)::BIGINT AS up, round(log2(o_totalprice), 6) AS log2, round(pow(o_totalprice, 0.25), 6) AS power FROM orders")
def p7(spark, d):
    p = F.col("o_totalprice")
    out = table(spark, d, "orders").select(
        "o_orderkey", F.log1p(p).alias("log1p"), F.expm1(p / 1e6).alias("expm1"), F.sqrt(F.abs(p)).alias("root"), F.ceil(p).alias("up"), F.log2(p).alias("log2"), F.pow(p, F.lit(0.25)).alias("power")
    )
    return rounded(out)


@query("p8_dates", f"SELECT o_orderkey, datesub('day', o_orderdate, TIMESTAMP '{CUTOFF}')::BIGINT AS full_days, strftime(o_orderdate + INTERVAL 91 DAY, '%Y-%m-%d') AS later, strftime(strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d'), '%Y-%m-%d') AS parsed FROM orders")
def p8(spark, d):
    at = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", F.timestamp_diff("DAY", at, F.lit(CUTOFF).cast("timestamp_ntz")).cast("long").alias("full_days"),
        F.date_format(at + F.expr("INTERVAL 91 DAY"), "yyyy-MM-dd").alias("later"), F.date_format(F.to_date(F.date_format(at, "yyyyMMdd"), "yyyyMMdd"), "yyyy-MM-dd").alias("parsed"),
    )


INTENT = "(SELECT DISTINCT 'R' || (o_orderkey % 5 + 1) || '@0.3 & R' || (o_orderkey % 5 + 1) || '@0.5 & F' || (o_custkey % 5 + 1) || '@0.7' AS intent FROM orders)"


@query("p9_intent_strings", f"SELECT intent, array_to_string(list_sort(list_distinct(list_transform(string_split(intent, ' & '), lambda x: string_split(x, '@')[1]))), ' & ') AS bands, array_to_string(list_sort(list_distinct(list_transform(string_split(intent, ' & '), lambda x: x[1]))), '') AS dims FROM {INTENT}")
def p9(spark, d):
    k, c = F.col("o_orderkey") % 5 + 1, F.col("o_custkey") % 5 + 1
    made = table(spark, d, "orders").select(F.concat(F.lit("R"), k.cast("string"), F.lit("@0.3 & R"), k.cast("string"), F.lit("@0.5 & F"), c.cast("string"), F.lit("@0.7")).alias("intent")).distinct()
    parts = F.split("intent", " & ")
    bands = F.array_sort(F.array_distinct(F.transform(parts, lambda x: F.substring_index(x, "@", 1))))
    return made.select("intent", F.array_join(bands, " & ").alias("bands"), F.array_join(F.array_sort(F.array_distinct(F.transform(parts, lambda x: F.substring(x, 1, 1)))), "").alias("dims"))


@query("p10_set_jaccard", """WITH a AS (SELECT c_custkey, (c_custkey * 7919 % 32768)::BIGINT AS a, (c_custkey * 104729 % 32768)::BIGINT AS b FROM customer)
SELECT c_custkey, bit_count(a & b)::BIGINT AS common, bit_count(a | b)::BIGINT AS together, bit_count(a & ~b)::BIGINT AS only_a, round(bit_count(a & b) / nullif(bit_count(a | b), 0), 9) AS jaccard FROM a""")
def p10(spark, d):
    a, b = F.col("c_custkey") * 7919 % 32768, F.col("c_custkey") * 104729 % 32768
    common, together = F.bit_count(a.bitwiseAND(b)), F.bit_count(a.bitwiseOR(b))
    out = table(spark, d, "customer").select("c_custkey", common.alias("common"), together.alias("together"), F.bit_count(a.bitwiseAND(F.bitwise_not(b))).alias("only_a"), F.try_divide(common, together).alias("jaccard"))
    return rounded(out, 9)


@query("p11_searchsorted", "SELECT o_orderkey, ((o_totalprice > 50000)::INT + (o_totalprice > 100000)::INT + (o_totalprice > 200000)::INT)::BIGINT AS left_side, ((o_totalprice >= 50000)::INT + (o_totalprice >= 100000)::INT + (o_totalprice >= 200000)::INT)::BIGINT AS right_side FROM orders")
def p11(spark, d):
    cuts = F.array(*[F.lit(float(c)) for c in (50000, 100000, 200000)])
    return rounded(table(spark, d, "orders").select("o_orderkey", F.size(F.filter(cuts, lambda c: F.col("o_totalprice") > c)).alias("left_side"), F.size(F.filter(cuts, lambda c: F.col("o_totalprice") >= c)).alias("right_side")))


@query("p12_regexp", "SELECT event_id, coalesce(array_to_string(regexp_extract_all(props, '[0-9]+'), ','), '') AS numbers FROM events")
def p12(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.array_join(F.regexp_extract_all("props", F.lit("[0-9]+"), F.lit(0)), ","), F.lit("")).alias("numbers"))


@query("p13_fingerprint", "SELECT c_nationkey::BIGINT AS c_nationkey, sha1(string_agg(c_custkey::VARCHAR, '|' ORDER BY c_custkey)) AS fingerprint FROM customer GROUP BY 1")
def p13(spark, d):
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("c_custkey")), lambda x: x.cast("string")), "|")
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("c_nationkey")).agg(F.sha1(ids).alias("fingerprint"))


@query("p14_signed_labels", "SELECT c_custkey, printf('%+.4f', c_acctbal) AS label, printf('[%+.2f, %+.2f]', c_acctbal - 1, c_acctbal + 1) AS span FROM customer")
def p14(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.format_string("%+.4f", b).alias("label"), F.format_string("[%+.2f, %+.2f]", b - 1, b + 1).alias("span"))


@query("c1_rfm", with_(COHORT, "SELECT customer_id, R::BIGINT AS R, F, round(M, 2) AS M FROM rfm"))
def c1(spark, d):
    tx = transactions(spark, d).where(F.col("at") <= F.lit(CUTOFF).cast("timestamp_ntz"))
    return rounded(cohorts.aggregate_rfm(tx, CUTOFF), 2)


ORIGINS = [("1996-01-01", True, 91), ("1997-01-01", True, 91), ("1998-01-01", True, 91), ("1999-01-01", True, 91), ("1998-01-01/365", False, 365)]


def _origins(spark):
    rows = spark.createDataFrame(ORIGINS, "origin string, pooled boolean, horizon int")
    return rows.select("origin", "pooled", "horizon", F.substring("origin", 1, 10).cast("timestamp_ntz").alias("cutoff"))


_ORIGIN_SQL = "o(origin, pooled, horizon) AS (VALUES " + ", ".join(f"('{a}', {b}, {c})" for a, b, c in ORIGINS) + ")"


@query("c2_day_axis_cohorts", "WITH " + TX + """, t AS (SELECT customer_id, invoice, v, datediff('day', DATE '1995-01-01', ts_::DATE) AS day FROM tx),
o(origin, cutoff) AS (VALUES ('d365', 365), ('d731', 731), ('d1096', 1096), ('d1461', 1461)),
b AS (SELECT origin, customer_id, cutoff - max(day) FILTER (day <= cutoff) AS R, count(DISTINCT invoice) FILTER (day <= cutoff) AS F, sum(v) FILTER (day <= cutoff)::DOUBLE AS M,
  count(DISTINCT invoice) FILTER (day > cutoff) AS fi, coalesce(sum(v) FILTER (day > cutoff), 0)::DOUBLE AS fs FROM t JOIN o ON day <= cutoff + 91 GROUP BY origin, cutoff, customer_id)
SELECT origin, customer_id, R::BIGINT AS R, F, round(M, 2) AS M, fi AS future_invoices, round(fs, 2) AS future_spend, (fi > 0)::BIGINT AS repurchased FROM b WHERE R IS NOT NULL""")
def c2(spark, d):
    origins = spark.createDataFrame([("d365", 365), ("d731", 731), ("d1096", 1096), ("d1461", 1461)], "origin string, cutoff int").withColumns({"horizon": F.lit(91), "pooled": F.lit(True)})
    day = F.datediff(F.col("at").cast("date"), F.lit("1995-01-01").cast("date"))
    return rounded(cohorts.build_cohorts(transactions(spark, d).withColumn("at", day), origins, by_day=True).drop("pooled"), 2)


@query("c3_rolling_cohorts", "WITH " + TX + ", " + _ORIGIN_SQL + """, k AS (SELECT *, substr(origin, 1, 10)::TIMESTAMP AS cutoff FROM o),
b AS (SELECT origin, pooled, customer_id, datesub('day', max(ts_) FILTER (ts_ <= cutoff), cutoff) AS R, count(DISTINCT invoice) FILTER (ts_ <= cutoff) AS F, sum(v) FILTER (ts_ <= cutoff)::DOUBLE AS M,
  count(DISTINCT invoice) FILTER (ts_ > cutoff) AS fi, coalesce(sum(v) FILTER (ts_ > cutoff), 0)::DOUBLE AS fs FROM tx JOIN k ON ts_ <= cutoff + to_days(horizon) GROUP BY origin, pooled, cutoff, customer_id)
SELECT origin, pooled, customer_id, R::BIGINT AS R, F, round(M, 2) AS M, fi AS future_invoices, round(fs, 2) AS future_spend, (fi > 0)::BIGINT AS repurchased FROM b WHERE R IS NOT NULL""")
def c3(spark, d):
    return rounded(cohorts.build_cohorts(transactions(spark, d), _origins(spark)), 2)


@query("c4_purchase_day_cohorts", """WITH e AS (SELECT user_id::VARCHAR AS customer_id, ts::DATE AS day, coalesce(value, 0)::DECIMAL(18,2) AS v FROM events WHERE event_type = 'purchase'),
c AS (SELECT min(day) + 20 AS cutoff FROM e)
SELECT customer_id, (cutoff - max(day))::BIGINT AS R, count(DISTINCT day) AS F, round(sum(v)::DOUBLE, 2) AS M FROM e, c WHERE day <= cutoff GROUP BY customer_id, cutoff""")
def c4(spark, d):
    """An order is a distinct customer and day; the cutoff is day 20 of the data."""
    e = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("customer_id"), F.col("ts").cast("date").alias("day"), F.coalesce("value", F.lit(0.0)).alias("value"))
    cut = e.agg(F.date_add(F.min("day"), 20).alias("cutoff"))
    seen = e.crossJoin(F.broadcast(cut)).where("day <= cutoff")
    return rounded(seen.groupBy("customer_id").agg(F.datediff(F.first("cutoff"), F.max("day")).alias("R"), F.countDistinct("day").alias("F"), cohorts.money(F.col("value")).alias("M")), 2)


@query("c5_outcomes", with_(COHORT, "SELECT customer_id, future_invoices, round(future_spend, 2) AS future_spend, repurchased::BIGINT AS repurchased FROM cohort"))
def c5(spark, d):
    return rounded(cohort(spark, d).select("customer_id", "future_invoices", "future_spend", "repurchased"), 2)


@query("c6_tenure", with_(TX, "SELECT customer_id, strftime(min(ts_), '%Y-%m-%d') AS first_day, strftime(max(ts_), '%Y-%m-%d') AS last_day, count(DISTINCT invoice) AS orders, round(sum(v)::DOUBLE, 2) AS value, datesub('day', min(ts_), max(ts_))::BIGINT AS tenure FROM tx GROUP BY 1"))
def c6(spark, d):
    t = cohorts.with_tenure(transactions(spark, d))
    return rounded(t.select("customer_id", F.date_format("first_at", "yyyy-MM-dd").alias("first_day"), F.date_format("last_at", "yyyy-MM-dd").alias("last_day"), "orders", "value", "tenure"), 2)


@query("c7_audit", with_(TX, "SELECT count(*) AS n_rows, count(DISTINCT customer_id) AS customers, count(DISTINCT invoice) AS invoices, count(*) FILTER (customer_id IS NULL OR v IS NULL) AS nulls, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM tx)) AS repeated_rows FROM tx"))
def c7(spark, d):
    return rounded(cohorts.audit(transactions(spark, d)).drop("first_at", "last_at"))


@query("c7_basket_histogram", "SELECT least(n, 8)::BIGINT AS lines, count(*) AS orders FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def c7b(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).groupBy(F.least(F.col("n"), F.lit(8)).alias("lines")).agg(F.count("*").alias("orders"))


@query("c8_reconciliation", "SELECT count(*) FILTER (l_returnflag = 'R') AS cancelled, count(*) FILTER (l_discount = 0) AS undiscounted, count(DISTINCT l_orderkey) FILTER (l_returnflag <> 'R') AS orders_kept, count(DISTINCT l_orderkey) AS orders_all FROM lineitem")
def c8(spark, d):
    kept = F.when(F.col("l_returnflag") != "R", F.col("l_orderkey"))
    return table(spark, d, "lineitem").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("cancelled"), F.count_if(F.col("l_discount") == 0).alias("undiscounted"), F.countDistinct(kept).alias("orders_kept"), F.countDistinct("l_orderkey").alias("orders_all")
    )


@query("c9_customer_union", "WITH " + TX + ", " + _ORIGIN_SQL + " SELECT customer_id, row_number() OVER (ORDER BY customer_id) - 1 AS place FROM (SELECT DISTINCT customer_id FROM tx JOIN o ON ts_ <= substr(origin, 1, 10)::TIMESTAMP)")
def c9(spark, d):
    """All customers of any origin, numbered by id."""
    from cohortlens.operators.inference import number_customers

    return rounded(number_customers(cohorts.build_cohorts(transactions(spark, d), _origins(spark))))


@query("c10_rebuild_check", with_(COHORT, "SELECT 0::BIGINT AS only_first, 0::BIGINT AS only_second, (SELECT count(*) FROM cohort) AS customers, (SELECT count(*) FROM range(DATE '1998-01-02', DATE '1998-04-03', INTERVAL 1 DAY)) AS holdout_days"))
def c10(spark, d):
    """The cohort built again from days and a left join equals the one-pass build; days of the holdout calendar."""
    tx, cut = transactions(spark, d), F.lit(CUTOFF).cast("timestamp_ntz")
    first = cohort(spark, d).select("customer_id", "R", "F", F.round("M", 2).alias("M"), "future_invoices")
    obs = cohorts.aggregate_rfm(tx.where(F.col("at") <= cut), CUTOFF)
    held = tx.where((F.col("at") > cut) & (F.col("at") <= cut + F.expr("INTERVAL 91 DAY"))).select("customer_id", "invoice").distinct().groupBy("customer_id").agg(F.count("*").alias("fi"))
    second = obs.join(held, "customer_id", "left").select("customer_id", F.col("R").cast("long").alias("R"), "F", F.round("M", 2).alias("M"), F.coalesce("fi", F.lit(0)).cast("long").alias("future_invoices"))
    days = spark.range(1).select(F.explode(F.sequence(F.lit("1998-01-02").cast("date"), F.lit("1998-04-02").cast("date"))).alias("day")).agg(F.count("*").alias("holdout_days"))
    a = first.exceptAll(second).agg(F.count("*").alias("only_first"))
    return a.crossJoin(second.exceptAll(first).agg(F.count("*").alias("only_second"))).crossJoin(second.agg(F.count("*").alias("customers"))).crossJoin(days)


@query("r1_cutpoints", with_(CUTS, "SELECT dim, cuts[1] AS c1, cuts[2] AS c2, cuts[3] AS c3, cuts[4] AS c4 FROM cuts"))
def r1(spark, d):
    return scoring.fit_cutpoints(cohort(spark, d)).select("dim", *[F.col("cuts")[i].alias(f"c{i + 1}") for i in range(4)])


SCORES = "R_score::BIGINT AS R_score, F_score::BIGINT AS F_score, M_score::BIGINT AS M_score"


def _scores(df):
    return rounded(df.select("customer_id", "R_score", "F_score", "M_score"))


@query("r2_quintile_scores", with_(SCORED_LONG, f"SELECT customer_id, {SCORES} FROM scored"))
def r2(spark, d):
    return _scores(scored(spark, d))


_TIED = SCORED_LONG.replace("1998-01-01", "1997-01-01")


@query("r3_merged_cutpoints", with_(_TIED, """, m AS (SELECT dim, list_sort(list_distinct(cuts)) AS cuts FROM cuts), b AS (SELECT DISTINCT dim, cuts, len(list_filter(cuts, lambda c: x > c)) AS b FROM l JOIN m USING (dim)),
u AS (SELECT dim, cuts, list(b) AS used, max(b) AS top FROM b GROUP BY 1, 2)
SELECT dim, array_to_string(list_transform(list_filter(range(len(cuts)), lambda i: list_contains(used, i) AND i < top), lambda i: printf('%.6f', cuts[i + 1])), ',') AS cuts FROM u"""))
def r3(spark, d):
    """Tied cutpoints of the 1997 cohort merged; empty bands taken out."""
    df = cohorts.one_cohort(transactions(spark, d), "1997-01-01 00:00:00")
    merged = scoring.merge_cutpoints(df, scoring.fit_cutpoints(df, strict=False))
    return merged.select("dim", F.array_join(F.transform("cuts", lambda c: F.format_string("%.6f", c)), ",").alias("cuts"))


@query("r4_merged_scores", with_(_TIED, """, m AS (SELECT dim, list_sort(list_distinct(cuts)) AS cuts FROM cuts), b AS (SELECT DISTINCT dim, cuts, len(list_filter(cuts, lambda c: x > c)) AS b FROM l JOIN m USING (dim)),
u AS (SELECT dim, cuts, list(b) AS used, max(b) AS top FROM b GROUP BY 1, 2),
f AS (SELECT dim, list_transform(list_filter(range(len(cuts)), lambda i: list_contains(used, i) AND i < top), lambda i: cuts[i + 1]) AS cuts FROM u),
g AS (SELECT customer_id, dim, CASE WHEN dim = 'R' THEN len(cuts) + 1 - len(list_filter(cuts, lambda c: x > c)) ELSE 1 + len(list_filter(cuts, lambda c: x > c)) END AS s FROM l JOIN f USING (dim))
SELECT customer_id, max(s) FILTER (dim = 'R')::BIGINT AS R_score, max(s) FILTER (dim = 'F')::BIGINT AS F_score, max(s) FILTER (dim = 'M')::BIGINT AS M_score FROM g GROUP BY 1"""))
def r4(spark, d):
    df = cohorts.one_cohort(transactions(spark, d), "1997-01-01 00:00:00")
    return _scores(scoring.score(df, scoring.merge_cutpoints(df, scoring.fit_cutpoints(df, strict=False))))


_DENSE = LONG + """, dr AS (SELECT customer_id, dim, x, dense_rank() OVER (PARTITION BY dim ORDER BY x) AS k FROM l),
dt AS (SELECT dim, max(k) AS top FROM dr GROUP BY 1),
ds AS (SELECT customer_id, dim, x, greatest(1, least(5, ceil(5.0::DOUBLE * k / top)))::INT AS raw FROM dr JOIN dt USING (dim)),
dense AS (SELECT customer_id, dim, x, CASE WHEN dim = 'R' THEN 6 - raw ELSE raw END AS s FROM ds)"""
_WIDE = "SELECT customer_id, max(s) FILTER (dim = 'R')::BIGINT AS R_score, max(s) FILTER (dim = 'F')::BIGINT AS F_score, max(s) FILTER (dim = 'M')::BIGINT AS M_score FROM {} GROUP BY 1"


@query("r5_dense_rank_scores", with_(_DENSE, _WIDE.format("dense")))
def r5(spark, d):
    return _scores(scoring.dense_rank_scores(cohort(spark, d)))


_DENSE_CUTS = _DENSE + ", sp AS (SELECT dim, s, min(x) AS lo, max(x) AS hi FROM dense GROUP BY 1, 2), dc AS (SELECT dim, (hi + lead(lo) OVER (PARTITION BY dim ORDER BY lo)) / 2 AS c FROM sp)"


@query("r6_dense_rank_cutoffs", with_(_DENSE_CUTS, "SELECT dim, array_to_string(list_transform(list(c ORDER BY c) FILTER (c IS NOT NULL), lambda c: printf('%.4f', c)), ',') AS cuts FROM dc GROUP BY 1"))
def r6(spark, d):
    cuts = scoring.dense_rank_cutoffs(scoring.dense_rank_scores(cohort(spark, d)))
    return cuts.select("dim", F.array_join(F.transform("cuts", lambda c: F.format_string("%.4f", c)), ",").alias("cuts"))


@query("r7_frozen_cutoffs", with_(_DENSE_CUTS, """, fc AS (SELECT dim, list(c ORDER BY c) FILTER (c IS NOT NULL) AS cuts FROM dc GROUP BY 1),
nx AS (SELECT customer_id, datesub('day', max(ts_), TIMESTAMP '1999-01-01') AS R, count(DISTINCT invoice) AS F, sum(v)::DOUBLE AS M FROM tx WHERE ts_ <= TIMESTAMP '1999-01-01' GROUP BY 1),
nl AS (SELECT customer_id, 'R' AS dim, R::DOUBLE AS x FROM nx UNION ALL SELECT customer_id, 'F', F::DOUBLE FROM nx UNION ALL SELECT customer_id, 'M', M FROM nx),
g AS (SELECT customer_id, dim, CASE WHEN dim = 'R' THEN len(cuts) + 1 - len(list_filter(cuts, lambda c: x > c)) ELSE 1 + len(list_filter(cuts, lambda c: x > c)) END AS s FROM nl JOIN fc USING (dim))
""" + _WIDE.format("g")))
def r7(spark, d):
    """Cutpoints of the 1998 cohort's dense ranks applied to the 1999 cohort."""
    cuts = scoring.dense_rank_cutoffs(scoring.dense_rank_scores(cohort(spark, d)))
    return _scores(scoring.score(cohorts.one_cohort(transactions(spark, d), "1999-01-01 00:00:00"), cuts))


@query("r8_positional_quintiles", with_(LONG, ", q AS (SELECT customer_id, dim, (floor((row_number() OVER (PARTITION BY dim ORDER BY x, customer_id) - 1) * 5 / count(*) OVER (PARTITION BY dim)) + 1)::INT AS p FROM l), g AS (SELECT customer_id, dim, CASE WHEN dim = 'R' THEN 6 - p ELSE p END AS s FROM q) " + _WIDE.format("g")))
def r8(spark, d):
    return _scores(scoring.paper_quintiles(cohort(spark, d)))


@query("r9_percent_ranks", with_(LONG, ", q AS (SELECT customer_id, dim, round((rank() OVER (PARTITION BY dim ORDER BY x) + (count(*) OVER (PARTITION BY dim, x) - 1) / 2.0) / count(*) OVER (PARTITION BY dim), 9) AS p FROM l) SELECT customer_id, max(p) FILTER (dim = 'R')::DOUBLE AS R_pct, max(p) FILTER (dim = 'F')::DOUBLE AS F_pct, max(p) FILTER (dim = 'M')::DOUBLE AS M_pct FROM q GROUP BY 1"))
def r9(spark, d):
    return rounded(scoring.percent_ranks(cohort(spark, d)).select("customer_id", "R_pct", "F_pct", "M_pct"), 9)


@query("r10_occupancy", with_(SCORED_LONG, ", b AS (SELECT dim, unnest(range(1, 6)) AS band FROM (SELECT DISTINCT dim FROM l)) SELECT dim, band::BIGINT AS band, count(x) AS n, round(100.0 * count(x) / (SELECT count(*) FROM cohort), 6)::DOUBLE AS pct, round(min(x), 6) AS raw_min, round(max(x), 6) AS raw_max, round(median(x), 6) AS median FROM b LEFT JOIN s USING (dim) WHERE s.s = band OR s.s IS NULL GROUP BY 1, 2"))
def r10(spark, d):
    return rounded(scoring.occupancy(scored(spark, d)))


@query("r11_score_entropy", with_(SCORED_LONG, ", n AS (SELECT dim, s, count(*) AS n FROM s GROUP BY 1, 2), p AS (SELECT dim, n / sum(n) OVER (PARTITION BY dim) AS p FROM n) SELECT dim, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1"))
def r11(spark, d):
    from cohortlens.operators.membership import long_scored

    return rounded(scoring.entropy_bits(long_scored(scored(spark, d)), ["dim"], "s"))


@query("r12_statistics", with_(LONG, 'SELECT dim, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std, min(x) AS min, round(quantile_cont(x, 0.25), 4) AS p25, round(median(x), 4) AS median, round(quantile_cont(x, 0.75), 4) AS p75, round(quantile_cont(x, 0.9), 4) AS p90, round(quantile_cont(x, 0.95), 4) AS p95, max(x) AS max FROM l GROUP BY 1'))
def r12(spark, d):
    return rounded(scoring.statistics(cohort(spark, d)), 4)


@query("r13_frequency", with_(SCORED_LONG, "SELECT round(avg(CASE WHEN F = (SELECT min(F) FROM cohort) THEN 100.0::DOUBLE ELSE 0 END), 6) AS pct_min, round(avg(CASE WHEN F >= 2 THEN 100.0::DOUBLE ELSE 0 END), 6) AS pct_two_or_more, count(DISTINCT F) AS distinct_values, round(var_pop(F) FILTER (F_score = 1), 6) AS var_lowest_band FROM scored"))
def r13(spark, d):
    return rounded(scoring.frequency_analysis(scored(spark, d)))


@query("r14_train_test_scores", with_(LONG, """, sp AS (SELECT customer_id, row_number() OVER (PARTITION BY repurchased ORDER BY md5(customer_id || '|42'), customer_id) <= floor(0.7 * count(*) OVER (PARTITION BY repurchased)) AS is_train FROM cohort),
tc AS (SELECT dim, list_transform(quantile_cont(x, [0.2, 0.4, 0.6, 0.8]), lambda q: round(q, 6)) AS cuts FROM l JOIN sp USING (customer_id) WHERE is_train GROUP BY 1),
g AS (SELECT customer_id, dim, is_train, CASE WHEN dim = 'R' THEN 5 - len(list_filter(cuts, lambda c: x > c)) ELSE 1 + len(list_filter(cuts, lambda c: x > c)) END AS s FROM l JOIN sp USING (customer_id) JOIN tc USING (dim))
SELECT customer_id, is_train, max(s) FILTER (dim = 'R')::BIGINT AS R_score, max(s) FILTER (dim = 'F')::BIGINT AS F_score, max(s) FILTER (dim = 'M')::BIGINT AS M_score FROM g GROUP BY 1, 2"""))
def r14(spark, d):
    from cohortlens.operators.metrics import stratified_split

    df = stratified_split(cohort(spark, d))
    return rounded(scoring.score(df, scoring.fit_cutpoints(df.where("is_train"))).select("customer_id", "is_train", "R_score", "F_score", "M_score"))

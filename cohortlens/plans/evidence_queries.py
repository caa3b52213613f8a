"""Queries of files, result tables and checks on them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortlens.functions.ranks import shared_folder
from cohortlens.operators import evidence
from cohortlens.sources import files

from .base import query, rounded, table

# Result rows of a made-up study: order priorities are arms, order status and year datasets and origins.
_POINTS = """points AS (SELECT o_orderstatus AS dataset, year(o_orderdate)::VARCHAR AS origin, o_orderpriority AS arm, year(o_orderdate) < 2000 AS pooled,
  round(avg(o_totalprice) / 300000, 4) AS auc, round(avg(o_totalprice) / 200000 - 0.5, 4) AS spend_r2, round(max(o_totalprice) / 600000, 4) AS invoice_r2 FROM orders GROUP BY 1, 2, 3, 4)"""
_MEANS = f"WITH {_POINTS}, means AS (SELECT dataset, arm, avg(auc) AS auc, avg(spend_r2) AS spend_r2, avg(invoice_r2) AS invoice_r2 FROM points WHERE pooled GROUP BY 1, 2)"


def points(spark, d):
    year = F.year("o_orderdate")
    g = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("dataset"), year.cast("string").alias("origin"), F.col("o_orderpriority").alias("arm"), (year < 2000).alias("pooled"))
    return g.agg(F.round(F.avg("o_totalprice") / 300000, 4).alias("auc"), F.round(F.avg("o_totalprice") / 200000 - 0.5, 4).alias("spend_r2"), F.round(F.max("o_totalprice") / 600000, 4).alias("invoice_r2"))


def _folder(spark):
    return f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"


@query("s3_text_scan", "SELECT o_custkey::VARCHAR AS customer_id, strftime(o_orderdate, '%Y-%m-%d') AS day, round(o_totalprice, 2) AS value FROM orders WHERE o_totalprice > 0")
def s3(spark, d):
    """Orders as headerless text lines, written, read and parsed."""
    o = table(spark, d, "orders")
    path = _folder(spark)
    o.select(F.format_string("  %s %s  1 %.2f", F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyyMMdd"), "o_totalprice").alias("value")).write.text(path)
    return files.music_purchases(spark, path).select("customer_id", F.date_format("at", "yyyy-MM-dd").alias("day"), F.col("value").cast("double").alias("value"))


@query("s4_result_rescan", f"WITH {_POINTS} SELECT dataset, origin, arm, auc FROM points WHERE pooled AND arm = '1-URGENT'")
def s4(spark, d):
    """Results written once and read again with a filter."""
    path = _folder(spark)
    files.write_new(points(spark, d), path)
    return spark.read.parquet(path).where("pooled AND arm = '1-URGENT'").select("dataset", "origin", "arm", "auc")


@query("s6_file_digest")
def s6(spark, d):
    return files.file_digests(spark, f"{d}/benchmark.parquet").select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "sha256")


@query("k1_csv_round_trip", f"WITH {_POINTS} SELECT dataset, origin, arm, pooled, auc, spend_r2, invoice_r2 FROM points")
def k1(spark, d):
    path, rows = _folder(spark), points(spark, d)
    files.write_csv(rows, path)
    return spark.read.csv(path, header=True, schema=rows.schema)


@query("k2_parameters", """SELECT '{"customers": ' || count(DISTINCT o_custkey) || ', "first_day": "' || strftime(min(o_orderdate), '%Y-%m-%d') || '", "folds": 5, "last_day": "' || strftime(max(o_orderdate), '%Y-%m-%d') || '"}' AS value FROM orders""")
def k2(spark, d):
    """A run's parameters: its settings and what its input says of itself."""
    path = _folder(spark)
    of = table(spark, d, "orders").agg(F.countDistinct("o_custkey").alias("customers"), F.min("o_orderdate").cast("date").alias("first_day"), F.max("o_orderdate").cast("date").alias("last_day")).first()
    files.write_parameters(spark, path, {"folds": 5, "customers": of.customers, "first_day": str(of.first_day), "last_day": str(of.last_day)})
    return spark.read.text(path)


@query("k3_report", f"""{_MEANS}, t AS (SELECT '| arm | auc |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || arm || ' | ' || printf('%.3f', auc) || ' |', chr(10) ORDER BY arm) AS t FROM means WHERE dataset = 'O')
SELECT '# Arms by mean' || chr(10) || chr(10) || '## Scope' || chr(10) || chr(10) || (SELECT count(*) FROM points) || ' results' || chr(10) || chr(10) || '## Means' || chr(10) || chr(10) || t AS report FROM t""")
def k3b(spark, d):
    """A report is written and read back whole."""
    path, rows = _folder(spark), points(spark, d)
    means = evidence.means_by_arm(rows).where("dataset = 'O'").select("arm", "auc").orderBy("arm")
    files.write_report(spark, path, "Arms by mean", [("Scope", f"{rows.count()} results"), ("Means", means)], floats="%.3f")
    return spark.read.text(path, wholetext=True).select(F.rtrim(F.regexp_replace("value", "\\s+$", "")).alias("report"))


@query("k3_markdown", f"{_MEANS} SELECT '| arm | auc |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || arm || ' | ' || printf('%.3f', auc) || ' |', chr(10) ORDER BY arm) AS report FROM means WHERE dataset = 'O'")
def k3(spark, d):
    means = evidence.means_by_arm(points(spark, d)).where("dataset = 'O'").select("arm", "auc").orderBy("arm")
    return spark.createDataFrame([(files.markdown(means, floats="%.3f"),)], "report string")


@query("k5_resume", f"WITH {_POINTS} SELECT dataset, origin, arm, auc FROM points")
def k5(spark, d):
    """A study cut short after one dataset goes on with what is missing."""
    path, rows = _folder(spark), points(spark, d).select("dataset", "origin", "arm", "auc")
    files.append_missing(rows.where("dataset = 'O'"), path, ["dataset", "origin"])
    return files.append_missing(rows, path, ["dataset", "origin"]).select("dataset", "origin", "arm", "auc")


@query("e1_means_by_arm", f"{_MEANS} SELECT dataset, arm, round(auc, 6) AS auc, round(spend_r2, 6) AS spend_r2, round(invoice_r2, 6) AS invoice_r2 FROM means")
def e1(spark, d):
    return rounded(evidence.means_by_arm(points(spark, d)))


@query("e2_headline_deltas", f"""{_MEANS} SELECT m.dataset, m.arm, round(m.auc - b.auc, 6) AS delta_auc, round(m.spend_r2 - b.spend_r2, 6) AS delta_spend_r2, round(m.invoice_r2 - b.invoice_r2, 6) AS delta_invoice_r2,
 round((m.auc - b.auc) / abs(b.auc), 6) AS gain_auc, round((m.spend_r2 - b.spend_r2) / abs(b.spend_r2), 6) AS gain_spend_r2, round((m.invoice_r2 - b.invoice_r2) / abs(b.invoice_r2), 6) AS gain_invoice_r2
 FROM means m JOIN means b USING (dataset) WHERE b.arm = '5-LOW' AND m.arm <> '5-LOW'""")
def e2(spark, d):
    return rounded(evidence.headline_deltas(evidence.means_by_arm(points(spark, d)), "5-LOW"))


@query("e3_metric_matrix", f"WITH {_POINTS} SELECT dataset, origin, max(auc) FILTER (arm = '1-URGENT') AS urgent, max(auc) FILTER (arm = '5-LOW') AS low FROM points GROUP BY 1, 2")
def e3(spark, d):
    return evidence.metric_matrix(points(spark, d), "auc", ["1-URGENT", "5-LOW"]).withColumnsRenamed({"1-URGENT": "urgent", "5-LOW": "low"})


@query("e4_long_metrics", f"WITH {_POINTS} SELECT dataset, origin, arm, metric, value FROM points UNPIVOT (value FOR metric IN (auc, spend_r2, invoice_r2))")
def e4(spark, d):
    return evidence.unpivoted(points(spark, d))


@query("e5_labels", f"WITH {_POINTS} SELECT DISTINCT arm, CASE arm WHEN '1-URGENT' THEN 'Urgent' ELSE arm END AS label FROM points")
def e5(spark, d):
    return evidence.labelled(points(spark, d).select("arm").distinct(), spark.createDataFrame([("1-URGENT", "Urgent")], "arm string, label string"))


@query("e6_duplicate_keys", "SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def e6(spark, d):
    return evidence.duplicate_keys(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"])


@query("e7_coverage", "SELECT c_nationkey::BIGINT AS c_nationkey, c_mktsegment FROM (SELECT DISTINCT c_nationkey FROM customer), (SELECT DISTINCT c_mktsegment FROM customer) EXCEPT SELECT c_nationkey, c_mktsegment FROM customer")
def e7(spark, d):
    return rounded(evidence.missing_pairs(table(spark, d, "customer").select("c_nationkey", "c_mktsegment"), ["c_nationkey", "c_mktsegment"]))


@query("v1_parity", f"""WITH {_POINTS}, a AS (UNPIVOT (SELECT dataset, origin, arm, auc, spend_r2, invoice_r2 FROM points) ON auc, spend_r2, invoice_r2 INTO NAME metric VALUE was),
b AS (SELECT dataset, origin, arm, metric, was + CASE WHEN metric = 'auc' AND arm = '1-URGENT' THEN 0.001::DOUBLE ELSE 0 END AS now FROM a WHERE NOT (dataset = 'P' AND arm = '5-LOW'))
SELECT metric, count(*) AS compared, count(*) FILTER (now IS NULL) AS missing, round(coalesce(max(abs(was - now)), 0), 6) AS worst, count(*) FILTER (now IS NULL) = 0 AND coalesce(max(abs(was - now)), 0) <= 1e-12 AS ok FROM a LEFT JOIN b USING (dataset, origin, arm, metric) GROUP BY 1""")
def v1(spark, d):
    """Results computed again against the written ones: one arm's area has moved, and an arm of one dataset is missing."""
    path, now = _folder(spark), points(spark, d)
    files.write_new(now, path)
    now = now.where("NOT (dataset = 'P' AND arm = '5-LOW')").withColumn("auc", F.col("auc") + F.when(F.col("arm") == "1-URGENT", 0.001).otherwise(0.0))
    return rounded(evidence.parity(spark.read.parquet(path), now, ["dataset", "origin", "arm"]))


@query("v2_claims", f"{_MEANS}, c(claim, dataset, arm, stated) AS (VALUES (1::BIGINT, 'O', '5-LOW', 0.5::DOUBLE), (2, 'F', '5-LOW', 9.0), (3, 'X', 'none', 0.0)) SELECT claim, coalesce(round(auc, 4) = round(stated, 4), false) AS ok FROM c LEFT JOIN means USING (dataset, arm)")
def v2(spark, d):
    claims = spark.createDataFrame([(1, "O", "5-LOW", "auc", 0.5), (2, "F", "5-LOW", "auc", 9.0), (3, "X", "none", "auc", 0.0)], "claim long, dataset string, arm string, metric string, stated double")
    return evidence.check_claims(claims, points(spark, d)).select("claim", "ok")

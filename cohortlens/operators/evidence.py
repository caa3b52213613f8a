"""Result tables of studies: means, deltas, audits, parity and duplicate checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Metrics of a per-origin result row.
METRICS = ("auc", "spend_r2", "invoice_r2")


def means_by_arm(points: DataFrame) -> DataFrame:
    """(dataset, arm, mean of each metric) over the pooled origins."""
    return points.where("pooled").groupBy("dataset", "arm").agg(*[F.avg(m).alias(m) for m in METRICS])


def headline_deltas(means: DataFrame, base: str) -> DataFrame:
    """(dataset, arm, delta and relative gain of each metric) against the base arm of the dataset."""
    b = means.where(F.col("arm") == base).select("dataset", *[F.col(m).alias(f"base_{m}") for m in METRICS])
    out = means.where(F.col("arm") != base).join(F.broadcast(b), "dataset")
    return out.select("dataset", "arm", *[(F.col(m) - F.col(f"base_{m}")).alias(f"delta_{m}") for m in METRICS], *[F.try_divide(F.col(m) - F.col(f"base_{m}"), F.abs(f"base_{m}")).alias(f"gain_{m}") for m in METRICS])


def unpivoted(points: DataFrame) -> DataFrame:
    """(dataset, origin, arm, metric, value)."""
    return points.unpivot(["dataset", "origin", "arm"], list(METRICS), "metric", "value")


def metric_matrix(points: DataFrame, metric: str, arms: list[str]) -> DataFrame:
    """(dataset, origin, a column an arm) of one metric."""
    return points.groupBy("dataset", "origin").pivot("arm", arms).agg(F.first(metric))


def labelled(rows: DataFrame, labels: DataFrame, key: str = "arm") -> DataFrame:
    """rows with ``label`` from labels (key, label); what has none keeps its key."""
    return rows.join(F.broadcast(labels), key, "left").withColumn("label", F.coalesce("label", key))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n) of keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Combinations of the keys' values that no row has: the coverage check of a full design; values are few."""
    spine = rows.select(keys[0]).distinct()
    for k in keys[1:]:
        spine = spine.crossJoin(F.broadcast(rows.select(k).distinct()))
    return spine.join(rows, keys, "left_anti")


def parity(frozen: DataFrame, now: DataFrame, keys: list[str], tolerance: float = 1e-12) -> DataFrame:
    """(metric, compared, missing, worst, ok): each metric of now against the frozen ones."""
    a = frozen.unpivot(keys, list(METRICS), "metric", "was")
    b = now.unpivot(keys, list(METRICS), "metric", "is_now")
    both = a.join(b, [*keys, "metric"], "full")
    gap = F.abs(F.col("was") - F.col("is_now"))
    missing = F.count_if(F.col("was").isNull() | F.col("is_now").isNull())
    return both.groupBy("metric").agg(F.count("*").alias("compared"), missing.alias("missing"), F.coalesce(F.max(gap), F.lit(0.0)).alias("worst"), ((missing == 0) & (F.coalesce(F.max(gap), F.lit(0.0)) <= tolerance)).alias("ok"))


def guard(check: DataFrame) -> DataFrame:
    """The rows of a parity check, raising where one isn't ok."""
    return check.withColumn("ok", F.when(F.col("ok"), True).otherwise(F.raise_error(F.concat(F.lit("not reproduced: "), F.col("metric")))))


def check_claims(claims: DataFrame, points: DataFrame, digits: int = 4) -> DataFrame:
    """claims (claim, dataset, arm, metric, stated) with the value that the means give and whether it is the stated one."""
    long = means_by_arm(points).unpivot(["dataset", "arm"], list(METRICS), "metric", "found")
    out = claims.join(F.broadcast(long), ["dataset", "arm", "metric"], "left")
    return out.withColumn("ok", F.coalesce(F.round("found", digits) == F.round("stated", digits), F.lit(False)))

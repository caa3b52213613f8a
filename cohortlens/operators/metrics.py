"""Prediction metrics with ties and weights, splits by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.ranks import checkpointed, small_methods, value_ranks


def hash_order(seed: int | Column, c: str = "customer_id") -> Column:
    """A pseudo-random key of a row, the same in any engine."""
    return F.md5(F.concat(F.col(c).cast("string"), F.lit("|"), (seed if isinstance(seed, Column) else F.lit(seed)).cast("string")).cast("binary"))


def placed(df: DataFrame, by: list[str], seed: int | Column, run: list[str] = []) -> DataFrame:
    """df, a row a customer (and run), with how many rows of its group come before it in hash order (``__before``) and how many there are
    (``__total``): global ranks, so no task holds a group."""
    keyed = df.select(*run, *by, F.struct(hash_order(seed).alias("h"), "customer_id").alias("__key"))
    ranks = value_ranks(keyed, "__key", [*run, *by]).select(*run, F.col("__key.customer_id").alias("customer_id"), F.col("before").alias("__before"), F.col("total").alias("__total"))
    return df.join(ranks, [*run, "customer_id"])


def stratified_folds(df: DataFrame, label: str = "repurchased", k: int = 5, seed: int = 0) -> DataFrame:
    """df with ``fold`` 0 to k - 1: rows of each label in hash order are dealt in turn, so folds differ by one row a label."""
    return placed(df, [label], seed).withColumn("fold", (F.col("__before") % k).cast("int")).drop("__before", "__total")


def stratified_split(df: DataFrame, label: str = "repurchased", train: float = 0.7, seed: int = 42) -> DataFrame:
    """df with ``is_train``: the first floor(train * n) rows of each label in hash order."""
    return placed(df, [label], seed).withColumn("is_train", F.col("__before") < F.floor(F.lit(train) * F.col("__total"))).drop("__before", "__total")


def subsample(df: DataFrame, share: float, seed: int, how: str = "round") -> DataFrame:
    """round(share * n) rows (or its whole part) in hash order, without replacement."""
    n = F.lit(share) * F.col("__total")
    return placed(df, [], seed).where(F.col("__before") < (F.round(n) if how == "round" else F.floor(n)).cast("long")).drop("__before", "__total")


def subsamples(df: DataFrame, share: float, seeds: list[int], how: str = "round") -> DataFrame:
    """df's columns and ``sample``: the ``subsample`` of each seed, numbered from 0, all in one pass."""
    samples = F.explode(F.array(*[F.struct(F.lit(i).alias("sample"), F.lit(s).alias("seed")) for i, s in enumerate(seeds)])).alias("s")
    keyed = df.select("customer_id", samples).select("s.sample", F.struct(hash_order(F.col("s.seed")).alias("h"), "customer_id").alias("__key"))
    ranks = value_ranks(keyed, "__key", ["sample"])
    n = F.lit(share) * F.col("total")
    kept = ranks.where(F.col("before") < (F.round(n) if how == "round" else F.floor(n)).cast("long")).select("sample", F.col("__key.customer_id").alias("customer_id"))
    return kept.join(df, "customer_id")


def drawn(df: DataFrame, seeds: list[int], size, by: list[str] = []) -> DataFrame:
    """df, a row a customer, with ``drawn``: bit i is set for the first size(n) of the n rows of its group in the hash order of seed i.

    Hashes are counted by their first digits; only those that share them with the last row drawn are ordered. No row is made for each seed.
    """
    if len(seeds) > 63:
        raise ValueError("63 seeds at most")
    small_methods(df.sparkSession)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("seed")) for i, s in enumerate(seeds)])).alias("s")
    keyed = df.select(*by, "customer_id", each).select(*by, "customer_id", "s.i", hash_order(F.col("s.seed")).alias("h")).withColumn("__digits", F.substring("h", 1, 3))
    whole = Window.partitionBy(*by, "i")
    counts = keyed.groupBy(*by, "i", "__digits").agg(F.count("*").alias("n")).withColumn("__upto", F.sum("n").over(whole.orderBy("__digits"))).withColumn("__k", size(F.sum("n").over(whole)).cast("long"))
    before = F.col("__upto") - F.col("n")
    last = checkpointed(counts.where((before < F.col("__k")) & (F.col("__k") <= F.col("__upto"))).select(*by, "i", "__digits", (F.col("__k") - before).alias("__rest")))
    near = keyed.join(F.broadcast(last), [*by, "i", "__digits"]).withColumn("__place", F.row_number().over(whole.orderBy("h", "customer_id"))).where(F.col("__place") == F.col("__rest"))
    ends = checkpointed(near.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("h", "customer_id")))).alias("__ends")))
    rows = df.join(F.broadcast(ends), by, "left") if by else df.join(F.broadcast(ends), F.lit(True), "left")
    inside = lambda i, s: F.struct(hash_order(s).alias("h"), "customer_id") <= F.try_element_at("__ends", F.lit(i))
    return rows.withColumn("drawn", sum((F.when(inside(i, s), F.lit(1 << i)).otherwise(0) for i, s in enumerate(seeds)), F.lit(0).cast("long")).cast("long")).drop("__ends")


def runs_of(df: DataFrame, runs: int, name: str) -> DataFrame:
    """df's rows (..., drawn) once for each run they take part in, numbered from 0."""
    return df.withColumn(name, F.explode(F.filter(F.sequence(F.lit(0), F.lit(runs - 1)), lambda i: F.getbit("drawn", i) == 1))).drop("drawn")


def weighted_auc(df: DataFrame, y: str, score: str, weight: str | None = None, by: list[str] = []) -> DataFrame:
    """(by..., auc): probability that a positive scores higher than a negative, ties one half, rows weighted; by may not hold nulls.

    Scores are grouped first and range-partitioned; the negatives below a score
    are those of its partition and, a row a partition and group, of the partitions before.
    The layout is checkpointed, as range bounds are sampled anew on each evaluation.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    g = df.groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0.0)).alias("p"), F.sum(F.when(F.col(y) == 1, 0.0).otherwise(w)).alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = checkpointed(g.repartitionByRange(parts, *by, "s").withColumn("__pid", F.spark_partition_id()))
    upto = Window.partitionBy("__pid", *by).orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = laid.withColumn("below", F.sum("n").over(upto) - F.col("n") / 2)
    sums = sums.groupBy("__pid", *by).agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(F.col("p") * F.col("below")).alias("area"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return sums.withColumn("area", F.col("area") + F.col("p") * before).groupBy(*by).agg(F.try_divide(F.sum("area"), F.sum("p") * F.sum("n")).alias("auc"))


def weighted_r2(df: DataFrame, y: str, f: str, weight: str | None = None, by: list[str] = []) -> DataFrame:
    """(by..., r2): 1 less the squared error over the squared deviation from the mean, rows weighted. One pass."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    t, e = F.col(y).cast("double"), F.col(y).cast("double") - F.col(f)
    sums = df.groupBy(*by).agg(F.sum(w).alias("w"), F.sum(w * t).alias("t"), F.sum(w * t * t).alias("tt"), F.sum(w * e * e).alias("ee"))
    return sums.select(*by, (1 - F.try_divide(F.col("ee"), F.col("tt") - F.col("t") * F.col("t") / F.col("w"))).alias("r2"))


def rank_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """(spearman) of two columns, tied values sharing their mean rank: distinct pairs of values meet the global ranks of each."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    pairs = checkpointed(pairs)
    for c in ("a", "b"):
        values = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a if c == "a" else b).alias(c))
        rank = value_ranks(values, c).select(c, (F.col("before") + (F.col("ties") + 1) / 2).alias(f"r{c}"))
        pairs = pairs.join(rank, c)
    n, x, y = F.col("n"), F.col("ra"), F.col("rb")
    sums = pairs.agg(F.sum(n).alias("n"), F.sum(n * x).alias("x"), F.sum(n * y).alias("y"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"), F.sum(n * x * y).alias("xy"))
    spread = F.sqrt((F.col("xx") - F.col("x") * F.col("x") / F.col("n")) * (F.col("yy") - F.col("y") * F.col("y") / F.col("n")))
    return sums.select(F.try_divide(F.col("xy") - F.col("x") * F.col("y") / F.col("n"), spread).alias("spearman"))


def error_metrics(df: DataFrame, y: str, prob: str, target: str, predicted: str) -> DataFrame:
    """One row: Brier score of prob, mean absolute error and Spearman correlation of predicted."""
    errors = df.agg(F.avg(F.pow(F.col(prob) - F.col(y), F.lit(2.0))).alias("brier"), F.avg(F.abs(F.col(predicted) - F.col(target))).alias("mae"))
    return errors.crossJoin(rank_correlation(df, target, predicted))


def train_test_gap(metrics: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """(by..., name_train, name_test, name_gap): metrics (by..., part, names) of the rows trained on less those of the rows held out."""
    of = lambda part, n: F.max(F.when(F.col("part") == part, F.col(n)))
    columns = [c for n in names for c in (of("train", n).alias(f"{n}_train"), of("test", n).alias(f"{n}_test"), (of("train", n) - of("test", n)).alias(f"{n}_gap"))]
    return metrics.groupBy(*by).agg(*columns)

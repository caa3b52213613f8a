"""Ordinal scores: fitted cutpoints, quintiles, dense ranks, occupancy and statistics.

What is fitted is a frame of one row (or one for each group) with arrays; what
scores takes it explicitly, so training data alone can decide it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.ranks import Ordered, exact_quantiles, ranked_quantiles, value_ranks

DIMS = ("R", "F", "M")
QUINTILES = [0.2, 0.4, 0.6, 0.8]


def long_dims(df: DataFrame, keep: list[str] = ["customer_id"]) -> DataFrame:
    """(keep..., dim, x): a row for each dimension."""
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("double").alias("x")) for d in DIMS])).alias("p")).select(*keep, "p.dim", "p.x")


def ranked_dims(df: DataFrame, by: list[str] = []) -> DataFrame:
    """(by..., dim, x, ties, before, dense, total): ``value_ranks`` of each dimension. Cutpoints, and whatever else is fitted by order, share them."""
    return value_ranks(long_dims(df, by), "x", [*by, "dim"])


def fit_cutpoints(df: DataFrame, strict: bool = True, digits: int = 6, by: list[str] = [], ranked: DataFrame | None = None) -> DataFrame:
    """(by..., dim, cuts): the 20, 40, 60 and 80 % quantiles of each dimension; strict ones must increase. ``ranked`` are df's ``ranked_dims``, if made before."""
    ranked = ranked_dims(df, by) if ranked is None else ranked
    cuts = ranked_quantiles(ranked, "x", QUINTILES, [*by, "dim"]).select(*by, "dim", F.transform("quantiles", lambda q: F.round(q, digits)).alias("cuts"))
    if strict:
        ok = F.size(F.array_distinct("cuts")) == 4
        cuts = cuts.withColumn("cuts", F.when(ok, F.col("cuts")).otherwise(F.raise_error(F.concat(F.lit("tied cutpoints of "), F.col("dim")))))
    return cuts


def run_cutpoints(ordered: Ordered, by: str = "run", digits: int = 6) -> DataFrame:
    """(by, dim, cuts) of each run of dimensions in order: the ``fit_cutpoints`` of its rows, not strict."""
    found = ordered.quantiles({(dim, run): (dim, run, 0, int(n)) for dim, totals in ordered.totals.items() for run, n in enumerate(totals)}, QUINTILES)
    rows = ordered.laid.sparkSession.createDataFrame([(run, dim, q) for (dim, run), q in found.items()], f"{by} int, dim string, quantiles array<double>")
    return rows.select(by, "dim", F.transform("quantiles", lambda q: F.round(q, digits)).alias("cuts"))


def as_row(cuts: DataFrame, by: list[str] = []) -> DataFrame:
    """The fitted rows of all dimensions as one row (a group) of columns R_cuts, F_cuts, M_cuts."""
    return cuts.groupBy(*by).agg(*[F.max(F.when(F.col("dim") == d, F.col("cuts"))).alias(f"{d}_cuts") for d in DIMS])


def beside(df: DataFrame, fitted: DataFrame, by: list[str] = []) -> DataFrame:
    """df with the columns of the one fitted row, or of that of its own group, of which there are a few."""
    return df.join(F.broadcast(fitted), by) if by else df.crossJoin(F.broadcast(fitted))


def band(x: Column, cuts: Column, invert: bool = False, most: int = 4) -> Column:
    """1 + the cutpoints below x, of which there are ``most`` at most; inverted, the best is the lowest. Compiled, where a filter would be interpreted."""
    above = sum((F.when(x > F.get(cuts, F.lit(i)), 1).otherwise(0) for i in range(most)), F.lit(0))
    above = F.when(F.size(cuts) > most, F.raise_error(F.lit(f"more than {most} cutpoints")).cast("int")).otherwise(above)
    return (F.size(cuts) + 1 - above if invert else 1 + above).cast("int")


def score(df: DataFrame, cuts: DataFrame, by: list[str] = []) -> DataFrame:
    """df with R_score, F_score, M_score by fitted cutpoints, of its own group where there are groups (a few); R is inverted."""
    scored = beside(df, as_row(cuts, by), by)
    for d in DIMS:
        scored = scored.withColumn(f"{d}_score", band(F.col(d).cast("double"), F.col(f"{d}_cuts"), d == "R"))
    return scored.drop(*[f"{d}_cuts" for d in DIMS])


def merge_cutpoints(df: DataFrame, cuts: DataFrame) -> DataFrame:
    """(dim, cuts) with tied cutpoints made one and those of empty bands taken out.

    A band without rows loses its upper cutpoint, the top band its lower one.
    With ties gone, a cutpoint that no row lies at or below, or none above, is
    all that can leave a band empty next to it: bands are kept whose rows exist.
    """
    distinct = cuts.select("dim", F.array_distinct("cuts").alias("cuts"))
    inside = long_dims(df, []).join(F.broadcast(distinct), "dim").select("dim", "cuts", F.size(F.filter("cuts", lambda c: F.col("x") > c)).alias("b")).distinct()
    used = inside.groupBy("dim", "cuts").agg(F.sort_array(F.collect_set("b")).alias("used"))
    # cut i (from 0) closes band i: it stays if band i has rows and some band above has
    kept = F.filter(F.transform("cuts", lambda c, i: F.when(F.array_contains("used", i) & (i < F.array_max("used")), c)), lambda c: c.isNotNull())
    return used.select("dim", kept.alias("cuts"))


def dense_rank_scores(df: DataFrame, levels: int = 5) -> DataFrame:
    """df with scores from dense ranks: ceil(levels * rank / greatest rank), R inverted."""
    out = df
    for d in DIMS:
        ranks = value_ranks(df, d).select(F.col(d).alias(f"__{d}"), "dense")
        top = ranks.agg(F.max("dense").alias("top"))
        s = F.greatest(F.lit(1), F.least(F.lit(levels), F.ceil(F.lit(float(levels)) * F.col("dense") / F.col("top")))).cast("int")
        ranks = ranks.crossJoin(F.broadcast(top)).select(f"__{d}", (levels + 1 - s if d == "R" else s).alias(f"{d}_score"))
        out = out.join(ranks, F.col(d) == F.col(f"__{d}"), "left").drop(f"__{d}")
    return out


def fit_dense_ranks(df: DataFrame, levels: int = 5, ranked: DataFrame | None = None) -> DataFrame:
    """The ``dense_rank_cutoffs`` of df's dense rank scores, from the ranks of its distinct values: customers aren't joined with their ranks."""
    ranks = ranked_dims(df) if ranked is None else ranked
    top = F.broadcast(ranks.groupBy("dim").agg(F.max("dense").alias("top")))
    s = F.greatest(F.lit(1), F.least(F.lit(levels), F.ceil(F.lit(float(levels)) * F.col("dense") / F.col("top"))))
    s = F.when(F.col("dim") == "R", levels + 1 - s).otherwise(s)
    return _midpoints(ranks.join(top, "dim").select("dim", "x", s.alias("s")))


def dense_rank_cutoffs(scored: DataFrame) -> DataFrame:
    """(dim, cuts): midpoints between neighbouring bands' extremes, ascending in raw values."""
    rows = scored.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("double").alias("x"), F.col(f"{d}_score").alias("s")) for d in DIMS])).alias("p")).select("p.*")
    return _midpoints(rows)


def _midpoints(rows: DataFrame) -> DataFrame:
    """(dim, cuts) of rows (dim, x, s)."""
    spans = rows.groupBy("dim", "s").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    spans = spans.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("b"))  # five bands
    mids = F.transform(F.sequence(F.lit(1), F.size("b") - 1), lambda i: (F.element_at("b", i).hi + F.element_at("b", i + 1).lo) / 2)
    return spans.select("dim", mids.alias("cuts"))


def paper_quintiles(df: DataFrame) -> DataFrame:
    """df with quintiles by position: rows ordered by the value, then the id as a string; floor(5 * position / n) + 1, R inverted."""
    out = df
    for d in DIMS:
        pair = df.select("customer_id", F.struct(F.col(d).alias("v"), "customer_id").alias("pair"))
        ranks = value_ranks(pair, "pair").select("pair.customer_id", (F.floor(F.col("before") * 5 / F.col("total")) + 1).cast("int").alias("s"))
        out = out.join(ranks.select("customer_id", (6 - F.col("s") if d == "R" else F.col("s")).alias(f"{d}_score")), "customer_id")
    return out


def percent_ranks(df: DataFrame) -> DataFrame:
    """df with R_pct, F_pct, M_pct: average rank of ties over the number of rows."""
    out = df
    for d in DIMS:
        ranks = value_ranks(df, d).select(F.col(d).alias(f"__{d}"), ((F.col("before") + (F.col("ties") + 1) / 2) / F.col("total")).alias(f"{d}_pct"))
        out = out.join(ranks, F.col(d) == F.col(f"__{d}")).drop(f"__{d}")
    return out


def occupancy(scored: DataFrame, levels: int = 5) -> DataFrame:
    """(dim, band, n, pct, raw_min, raw_max, median) of every band, empty ones too."""
    rows = scored.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("double").alias("x"), F.col(f"{d}_score").alias("band")) for d in DIMS])).alias("p")).select("p.*")
    spine = scored.sparkSession.createDataFrame([(d, b) for d in DIMS for b in range(1, levels + 1)], "dim string, band int")
    stats = rows.groupBy("dim", "band").agg(F.count("*").alias("n"), F.min("x").alias("raw_min"), F.max("x").alias("raw_max"))
    stats = stats.join(exact_quantiles(rows, "x", [0.5], ["dim", "band"]).select("dim", "band", F.col("quantiles")[0].alias("median")), ["dim", "band"])
    total = scored.agg(F.count("*").alias("total"))
    return spine.join(stats, ["dim", "band"], "left").crossJoin(F.broadcast(total)).select(
        "dim", "band", F.coalesce("n", F.lit(0)).alias("n"), (100.0 * F.coalesce("n", F.lit(0)) / F.col("total")).alias("pct"), "raw_min", "raw_max", "median"
    )


def entropy_bits(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., entropy) of the distribution of value, in bits."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    total = n.groupBy(*by).agg(F.sum("n").alias("t"))
    joined = n.join(F.broadcast(total), by) if by else n.crossJoin(F.broadcast(total))
    p = F.col("n") / F.col("t")
    return joined.groupBy(*by).agg((-F.sum(p * F.log2(p))).alias("entropy"))


def statistics(df: DataFrame) -> DataFrame:
    """(dim, mean, std, min, p25, median, p75, p90, p95, max): std of the population."""
    rows = long_dims(df, [])
    base = rows.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    q = exact_quantiles(rows, "x", [0.25, 0.5, 0.75, 0.9, 0.95], ["dim"])
    return base.join(q, "dim").select("dim", "mean", "std", "min", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("p25", "median", "p75", "p90", "p95"))], "max")


def frequency_analysis(scored: DataFrame) -> DataFrame:
    """One row on F: share at its minimum, share of two or more, distinct values, variance within the lowest band."""
    low = scored.agg(F.min("F").alias("low"))
    return scored.crossJoin(F.broadcast(low)).agg(
        F.avg(F.when(F.col("F") == F.col("low"), 100.0).otherwise(0.0)).alias("pct_min"),
        F.avg(F.when(F.col("F") >= 2, 100.0).otherwise(0.0)).alias("pct_two_or_more"),
        F.countDistinct("F").alias("distinct_values"),
        F.var_pop(F.when(F.col("F_score") == 1, F.col("F"))).alias("var_lowest_band"),
    )

"""Resampling and tests. Draws come from hashes, so each arm and engine sees the same ones."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.draws import draw_counts, flipped_sums, weights_of


#: Places that meet all draws of their group in one task.
SUM_CHUNK, ROW_CHUNK = 4096, 512


def draw_weights(customers: DataFrame, b: int, seed: int) -> DataFrame:
    """(b, customer_id, w): how often each of b resamples of the customers, with replacement, holds a customer.

    customers (customer_id, place) are numbered from 0. A slot takes the place
    that an md5 of (b, slot, seed) gives; resamples are counted where they are
    hashed (see ``draw_counts``), and a range of places meets its counts of all resamples.
    """
    n = customers.count()
    counts = draw_counts(customers.sparkSession.createDataFrame([(0, n)], "g long, n long"), b, seed, ROW_CHUNK, n)
    held = customers.withColumn("chunk", F.expr(f"place div {ROW_CHUNK}"))

    def rows(drawn: pa.Table, own: pa.Table) -> pa.Table:
        own = own.sort_by("place")
        ids, at = own["customer_id"].combine_chunks(), own["place"].to_numpy() % ROW_CHUNK
        parts = []
        for block, w in zip(drawn["block"].to_pylist(), drawn["w"].to_pylist(), strict=True):
            first, weights = weights_of(block, w, b, ROW_CHUNK)
            draw, who = np.nonzero(weights[:, at])
            parts.append(pa.table({"b": pa.array(first + draw), "customer_id": ids.take(pa.array(who)), "w": pa.array(weights[draw, at[who]].astype(np.int64))}))
        return pa.concat_tables(parts) if parts else pa.table({"b": pa.array([], pa.int64()), "customer_id": ids[:0], "w": pa.array([], pa.int64())})

    kind = customers.schema["customer_id"].dataType.simpleString()
    return counts.groupBy("chunk").cogroup(held.groupBy("chunk")).applyInArrow(rows, f"b long, customer_id {kind}, w long")


def _weighted_sums(counts: DataFrame, placed: DataFrame, b: int, names: list[str], by: list[str]) -> DataFrame:
    """(by..., b, w, names): placed (__id, __place, by..., names) added up with the weights of counts, a range of places in a task."""
    held = placed.select("__id", F.expr(f"__place div {SUM_CHUNK}").alias("__chunk"), (F.col("__place") % SUM_CHUNK).alias("__at"), *by, *names)
    kinds = "".join(f"{c} {held.schema[c].dataType.simpleString()}, " for c in by)

    def add(drawn: pa.Table, own: pa.Table) -> pa.Table:
        at = own["__at"].to_numpy()
        values = np.stack([np.ones(len(at)), *[own[c].to_numpy().astype(float) for c in names]], axis=1)
        keys = own.select(by)
        row = pa.array(np.arange(len(at)))
        which = keys.append_column("__row", row).group_by(by).aggregate([("__row", "list")])["__row_list"].to_pylist() if by else [np.arange(len(at))]
        parts = []
        for rows in (np.asarray(r, np.int64) for r in which):
            if not len(rows):
                continue
            sums, firsts = [], []
            for block, w in zip(drawn["block"].to_pylist(), drawn["w"].to_pylist(), strict=True):
                first, weights = weights_of(block, w, b, SUM_CHUNK)
                firsts.append(first + np.arange(len(weights)))
                sums.append(weights[:, at[rows]].astype(float) @ values[rows])
            if sums:
                whole = np.concatenate(sums)
                same = keys.take(pa.array(np.full(len(whole), rows[0])))
                parts.append(pa.table([*same.columns, pa.array(np.concatenate(firsts)), *[pa.array(x) for x in whole.T]], names=[*by, "b", "w", *names]))
        if parts:
            return pa.concat_tables(parts)
        return pa.table([*keys.slice(0, 0).columns, pa.array([], pa.int64()), *[pa.array([], pa.float64())] * (1 + len(names))], names=[*by, "b", "w", *names])

    schema = kinds + "b long, " + ", ".join(f"{c} double" for c in ("w", *names))
    added = counts.groupBy("g", "chunk").cogroup(held.groupBy("__id", "__chunk")).applyInArrow(add, schema)
    return added.groupBy(*by, "b").agg(*[F.sum(c).alias(c) for c in ("w", *names)]).where("w > 0")


def draw_sums(df: DataFrame, b: int, seed: int, values: dict[str, Column], by: list[str] = []) -> DataFrame:
    """(by..., b, w, values): how many rows each of b resamples of df's customers has, and sums of values over them.

    The draws are those of ``draw_weights``. Counts of draws and customers' rows are dealt
    out by ranges of customers, so what is shuffled is a byte a customer and draw, and in the end a row a range, draw and group.
    """
    from cohortlens.functions.ranks import checkpointed

    customers = checkpointed(number_customers(df))
    n = customers.count()
    counts = draw_counts(df.sparkSession.createDataFrame([(0, n)], "g long, n long"), b, seed, SUM_CHUNK, n)
    rows = df.select("customer_id", *by, *[v.cast("double").alias(c) for c, v in values.items()])
    placed = rows.join(customers.hint("merge"), "customer_id").withColumnRenamed("place", "__place").withColumn("__id", F.lit(0).cast("long"))
    return _weighted_sums(counts, placed, b, list(values), by)


def number_customers(df: DataFrame) -> DataFrame:
    """(customer_id, place): distinct customers numbered from 0 in the order of ids."""
    from cohortlens.functions.ranks import value_ranks

    return value_ranks(df.select("customer_id").distinct(), "customer_id").select("customer_id", F.col("before").alias("place"))


def interval(draws: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., mean, ci_low, ci_high, p_boot): 95 % percentile interval and two-sided p, at least one in the number of draws."""
    p = 2 * F.least(F.avg((F.col(value) <= 0).cast("double")), F.avg((F.col(value) >= 0).cast("double")))
    return draws.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.percentile(value, F.lit(0.025)).alias("ci_low"), F.percentile(value, F.lit(0.975)).alias("ci_high"), F.greatest(F.least(p, F.lit(1.0)), 1.0 / F.count("*")).alias("p_boot")
    )


def one_sided_p(draws: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., p): share of draws at or below 0."""
    return draws.groupBy(*by).agg(F.avg((F.col(value) <= 0).cast("double")).alias("p"))


def holm(df: DataFrame, p: str = "p", by: list[str] = [], tie: str = "test") -> DataFrame:
    """df with ``p_holm``: step-down adjusted p-values within each family, a few tests each."""
    family = Window.partitionBy(*by)
    order = family.orderBy(p, tie)
    step = (F.count("*").over(family) - F.row_number().over(order) + 1) * F.col(p)
    return df.withColumn("__s", step).withColumn("p_holm", F.least(F.lit(1.0), F.max("__s").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))).drop("__s")


def pooled(draws: DataFrame, value: str = "delta") -> DataFrame:
    """(metric, b, delta) means over pooled origins of each draw."""
    return draws.where("pooled").groupBy("metric", "b").agg(F.avg(value).alias(value))


def origins_positive(points: DataFrame, value: str = "delta") -> DataFrame:
    """(metric, origins_positive) as "a/b": pooled origins of positive difference, of all."""
    return points.where("pooled").groupBy("metric").agg(F.concat_ws("/", F.count_if(F.col(value) > 0).cast("string"), F.count("*").cast("string")).alias("origins_positive"))


def sign_flip_p(differences: DataFrame, value: str, by: list[str], draws: int | None = None, seed: int = 42) -> DataFrame:
    """(by..., n, p): two-sided sign-flip test of a zero mean, exact over all 2^n patterns for n of 20 at most.

    Larger groups take ``draws`` random patterns, of r that reach the observed
    sum p is (r + 1) / (draws + 1); without ``draws`` they raise. Patterns are
    numbered: their signs are the bits of the number, or of hashes of number,
    place and seed. Sums of patterns are made a part of a larger group at a time and added up, so none is ever in one place.
    """
    own = Window.partitionBy(*by)
    counted = differences.select(*by, F.col(value).cast("double").alias("__v")).withColumn("__n", F.count("__v").over(own))
    n = F.size("d")
    few = counted.where("__n <= 20").groupBy(*by).agg(F.sort_array(F.collect_list("__v")).alias("d"))
    patterns = F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), n) - 1)
    total = F.aggregate("d", F.lit(0.0), lambda a, x: a + x)
    bit = lambda i: F.getbit(F.col("pattern").cast("long"), F.least(i, F.lit(20)))
    flipped = F.abs(F.aggregate(F.transform("d", lambda x, i: F.when(bit(i) == 1, -x).otherwise(x)), F.lit(0.0), lambda a, x: a + x))
    rows = few.withColumn("observed", F.abs(total)).withColumn("pattern", F.explode(patterns))
    reached = rows.groupBy(*by, F.size("d").cast("long").alias("n")).agg((F.count_if(F.round(flipped, 9) >= F.round(F.col("observed"), 9)) / F.count("*")).alias("p"))
    many = counted.where("__n > 20 AND __v IS NOT NULL")
    if draws is None:
        last = many.groupBy(*by).agg(F.raise_error(F.lit("more than 20 differences: sample patterns instead")).cast("double").alias("p"), F.count("*").alias("n"))
        return reached.select(*by, "n", "p").unionByName(last.select(*by, "n", "p"))
    kinds = "".join(f"{c} {many.schema[c].dataType.simpleString()}, " for c in by)

    def add(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("__i")
        sums = flipped_sums(chunk["__v"].to_numpy(), chunk["__i"][0].as_py(), draws, seed)
        same = chunk.select(by).take(pa.array(np.zeros(draws, np.int64)))
        return pa.table([*same.columns, pa.array(np.arange(draws)), pa.array(sums)], names=[*by, "pattern", "__s"])

    numbered = many.withColumn("__i", (F.row_number().over(own.orderBy("__v")) - 1).cast("long")).withColumn("__c", F.expr(f"__i div {SUM_CHUNK}"))
    # few bytes and much work: without a number of its own Spark would put all parts in one task
    tasks = int(differences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = numbered.repartition(tasks, *by, "__c").groupBy(*by, "__c").applyInArrow(add, kinds + "pattern long, __s double").groupBy(*by, "pattern").agg(F.abs(F.sum("__s")).alias("__s"))
    observed = many.groupBy(*by).agg(F.abs(F.sum("__v")).alias("__o"), F.count("*").alias("n"))
    same = functools.reduce(lambda x, y: x & y, [F.col(f"__f.{c}").eqNullSafe(F.col(f"__g.{c}")) for c in by])
    met = sums.alias("__f").join(observed.alias("__g"), same).groupBy(*[F.col(f"__g.{c}") for c in by], "n")
    sampled = met.agg(((F.count_if(F.round("__s", 9) >= F.round("__o", 9)) + 1) / (F.count("*") + 1)).alias("p"))
    return reached.select(*by, "n", "p").unionByName(sampled.select(*by, "n", "p"))


def paired_t(differences: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., n, t, wilcoxon): paired t and the Wilcoxon signed-rank statistic, the smaller of the two rank sums."""
    w = Window.partitionBy(*by)
    nonzero = differences.where(F.col(value) != 0).withColumn("__a", F.abs(value))
    rank = F.rank().over(w.orderBy("__a")) + (F.count("*").over(w.partitionBy(*by, "__a")) - 1) / 2
    ranks = nonzero.withColumn("__r", rank).groupBy(*by).agg(F.least(F.sum(F.when(F.col(value) > 0, F.col("__r")).otherwise(0.0)), F.sum(F.when(F.col(value) < 0, F.col("__r")).otherwise(0.0))).alias("wilcoxon"))
    t = differences.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(F.avg(value), F.stddev_samp(value) / F.sqrt(F.count("*").cast("double"))).alias("t"))
    return t.join(ranks, by)


def _series(last: Column, ratio) -> Column:
    """1 + r(1) + r(1) r(2) + ... up to r(1) ... r(last)."""
    steps = F.when(last >= 1, F.sequence(F.lit(1), last.cast("int"))).otherwise(F.array().cast("array<int>"))

    def add(done, i):
        term = done["term"] * ratio(i)
        return F.struct(term.alias("term"), (done["total"] + term).alias("total"))

    return F.aggregate(steps, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")), add, lambda done: done["total"])


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t with a whole number of degrees of freedom: the finite series in the angle whose tangent is t / sqrt(df)."""
    cos2, sin = df / (df + t * t), F.abs(t) / F.sqrt(df + t * t)
    even = sin * _series(df / 2 - 1, lambda i: cos2 * (2 * i - 1) / (2 * i))
    product = F.when(df > 1, sin * F.sqrt(cos2) * _series((df - 3) / 2, lambda i: cos2 * 2 * i / (2 * i + 1))).otherwise(0.0)
    odd = (F.asin(sin) + product) * 2 / F.pi()
    p = 1 - F.when(df % 2 == 0, even).otherwise(odd)
    return F.when(p < 0, 0.0).otherwise(p)


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal value, by the error function's series of positive terms; beyond 8.5 it is that of 8.5."""
    x = F.when(F.abs(z) > 8.5, 8.5).otherwise(F.abs(z)) / F.sqrt(F.lit(2.0))
    erf = 2 * x / F.sqrt(F.pi()) * F.exp(-x * x) * _series(F.lit(60) + F.ceil(4 * x * x), lambda i: 2 * x * x / (2 * i + 1))
    return F.when(erf > 1, 0.0).otherwise(1 - erf)


#: Untied differences up to so many have the exact signed-rank distribution.
EXACT_RANKS = 50


def signed_rank_p(n: Column, w: Column) -> Column:
    """Two-sided p of a signed-rank sum of w or less among n untied differences: how many subsets of the ranks 1 to n have each sum,
    rank by rank; counts up to 2^50 are exact in doubles."""
    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), (n * (n + 1) / 2).cast("int")))
    with_rank = lambda counts, i: F.transform(counts, lambda c, s: c + F.when(s >= i, F.get(counts, s - i)).otherwise(0.0))
    counts = F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, with_rank)
    return F.least(F.lit(1.0), 2 * F.aggregate(F.slice(counts, F.lit(1), w.cast("int") + 1), F.lit(0.0), lambda a, c: a + c) / F.pow(F.lit(2.0), n))


def paired_p(differences: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., n, p_t, p_wilcoxon): two-sided p-values of ``paired_t``'s statistics; by may not hold nulls.

    The signed-rank test is the sign-flip test of the signed ranks: exact for
    20 differences other than 0 at most, and for ``EXACT_RANKS`` if none are tied, beyond
    that normal with the correction for ties. Groups without such a difference have no p_wilcoxon, groups of one no p_t.
    """
    w = Window.partitionBy(*by)
    tied = F.count("*").over(w.partitionBy(*by, "__a"))
    ranks = differences.where(F.col(value) != 0).withColumn("__a", F.abs(value)).select(*by, value, tied.alias("__tied"), (F.rank().over(w.orderBy("__a")) + (tied - 1) / 2).alias("__r"))
    signed = ranks.withColumn("__s", F.signum(value) * F.col("__r"))
    few = signed.join(signed.groupBy(*by).count().where("count <= 20").drop("count"), by)
    exact = sign_flip_p(few, "__s", by).select(*by, F.col("p").alias("__exact"))
    # each of a tie's rows adds its square less 1, so the tie its cube less its size
    m, ties = F.count("*").cast("double"), F.sum(F.col("__tied") * F.col("__tied") - 1)
    plus = F.sum(F.when(F.col("__s") > 0, F.col("__r")).otherwise(0.0))
    z = signed.groupBy(*by).agg((F.sum("__s") / 2 / F.sqrt((m * (m + 1) * (2 * m + 1) - ties / 2) / 24)).alias("__z"), F.count("*").alias("__m"), (F.max("__tied") == 1).alias("__untied"), F.least(plus, F.sum("__r") - plus).alias("__w"))
    table = F.when(F.col("__untied") & (F.col("__m") <= EXACT_RANKS), signed_rank_p(F.col("__m"), F.col("__w")))
    t = paired_t(differences, value, by).select(*by, "t")
    n = differences.groupBy(*by).agg(F.count("*").alias("n"))
    out = n.join(t, by, "left").join(z, by, "left").join(exact, by, "left")
    return out.select(*by, "n", F.when(F.col("n") > 1, student_p(F.col("t"), F.col("n").cast("double") - 1)).alias("p_t"), F.coalesce("__exact", table, normal_p(F.col("__z"))).alias("p_wilcoxon"))


def split_means(differences: DataFrame, value: str, by: list[str], order: str, b: int = 2000, seed: int = 7) -> DataFrame:
    """(by..., b, m): means of b resamples, with replacement, of each group's differences, its splits numbered by order; a group has one at least."""
    from cohortlens.functions.ranks import checkpointed

    numbers = differences.groupBy(*by).agg(F.count("*").alias("__n"))
    numbers = checkpointed(numbers.withColumn("__id", F.row_number().over(Window.orderBy(*by)).cast("long")))  # a row a group
    most = numbers.agg(F.max("__n")).first()[0]
    same = functools.reduce(lambda x, y: x & y, [F.col(f"__x.{c}").eqNullSafe(F.col(f"__g.{c}")) for c in by])
    x = differences.alias("__x").join(F.broadcast(numbers.alias("__g")), same).select("__x.*", "__id")
    x = x.withColumn("__place", (F.row_number().over(Window.partitionBy("__id").orderBy(order)) - 1).cast("long"))
    # a null difference has a place, but no part in a mean
    x = x.select("__id", "__place", *by, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("__v"), F.col(value).isNotNull().cast("double").alias("__k"))
    counts = draw_counts(numbers.select(F.col("__id").alias("g"), F.col("__n").alias("n")), b, seed, SUM_CHUNK, most or 0)
    return _weighted_sums(counts, x, b, ["__v", "__k"], by).select(*by, "b", F.try_divide("__v", "__k").alias("m"))


def split_comparisons(differences: DataFrame, value: str, by: list[str], order: str, b: int = 2000) -> DataFrame:
    """(by..., splits, mean, std, wins, losses, ci_low, ci_high, p): paired differences of an arm to the baseline, a row a split:
    their sample deviation and signs, the bootstrap interval of the mean and the sign-flip p (10,000 patterns beyond 20 splits)."""
    v = F.col(value)
    point = differences.groupBy(*by).agg(F.count("*").alias("splits"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count_if(v > 0).alias("wins"), F.count_if(v < 0).alias("losses"))
    ends = interval(split_means(differences, value, by, order, b), "m", by).select(*by, "ci_low", "ci_high")
    return point.join(ends, by).join(sign_flip_p(differences, value, by, draws=10_000).select(*by, "p"), by)


def verdict_by_p(p: Column, delta: Column, alpha: float = 0.05) -> Column:
    return F.when((p < alpha) & (delta > 0), "better").when((p < alpha) & (delta < 0), "worse").otherwise("no difference")


def verdict_by_interval(low: Column, high: Column) -> Column:
    return F.when(low > 0, "better").when(high < 0, "worse").otherwise("no difference")


def factorial_contrasts(cells: DataFrame) -> DataFrame:
    """(metric, origins, membership, t_norm, interaction, median, sign_consistent) from (metric, origin, m0, m1, m2, m3):
    m0 to m3 are the arms (membership, t-norm) = (0,0), (1,0), (0,1), (1,1)."""
    e = cells.select(
        "metric", "origin",
        ((F.col("m1") + F.col("m3") - F.col("m0") - F.col("m2")) / 2).alias("membership"),
        ((F.col("m2") + F.col("m3") - F.col("m0") - F.col("m1")) / 2).alias("t_norm"),
        (F.col("m3") - F.col("m2") - F.col("m1") + F.col("m0")).alias("interaction"),
    )
    return e.groupBy("metric").agg(
        F.count("*").alias("origins"), F.avg("membership").alias("membership"), F.avg("t_norm").alias("t_norm"), F.avg("interaction").alias("interaction"),
        F.median("membership").alias("median_membership"), F.min("membership").alias("min_membership"), F.max("membership").alias("max_membership"),
        (F.abs(F.sum(F.signum("membership"))) == F.count("*")).alias("sign_consistent"),
    )

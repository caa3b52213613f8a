"""Customers' degrees in concepts, redundancy, hard labels and what a set of concepts covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.ranks import checkpointed

from .scoring import DIMS, beside

MU_CUT = 0.5
J_MAX = 0.80


def bands_long(fuzzy: DataFrame) -> DataFrame:
    """(customer_id, band, mu): bit number of each band and the customer's degree in it."""
    parts = [F.struct(F.lit(5 * i + b).alias("band"), F.get(f"{d}_mu", F.lit(b)).alias("mu")) for i, d in enumerate(DIMS) for b in range(5)]
    return fuzzy.select("customer_id", F.explode(F.array(*parts)).alias("p")).select("customer_id", "p.*")


def concept_degrees(fuzzy: DataFrame, concepts: DataFrame, t_norm: str = "min") -> DataFrame:
    """(customer_id, band_mask, mu) for every customer and concept (band_mask): the least degree of its bands, or their product.

    The concepts are few (support bounds them) and go to every task; a
    customer's row is widened once, without a shuffle. The empty intent has degree 1.
    """
    if t_norm not in ("min", "product"):
        raise ValueError(f"unknown t-norm {t_norm}")
    degrees = F.concat(*[f"{d}_mu" for d in DIMS])
    bands = F.filter(F.sequence(F.lit(0), F.lit(14)), lambda b: F.getbit(F.col("band_mask"), b) == 1)
    combine = (lambda a, v: F.least(a, v)) if t_norm == "min" else (lambda a, v: a * v)
    mu = F.aggregate(F.transform("bands", lambda b: F.get("degrees", b)), F.lit(1.0), combine)
    few = concepts.select("band_mask", bands.alias("bands")).distinct()
    return fuzzy.select("customer_id", degrees.alias("degrees")).crossJoin(F.broadcast(few)).select("customer_id", "band_mask", mu.alias("mu"))


def masks_of(concepts: DataFrame, by: list[str] = []) -> DataFrame:
    """(by..., masks): the concepts' masks in ascending order. They are few; support bounds them."""
    return concepts.groupBy(*by).agg(F.sort_array(F.collect_set("band_mask")).alias("masks"))


def core_profiles(fuzzy: DataFrame, concepts: DataFrame, t_norm: str = "min", by: list[str] = []) -> DataFrame:
    """(by..., core, any, n): how many customers are core to just the concepts ``core`` (ascending masks), and whether they have a degree in any.

    By the least degree a customer is core to the concepts whose bands it is
    all core to, so customers are first counted by their core bands and those
    of any degree; a product is worked out in the customer's own row. Either
    way only counts are shuffled, never customers times concepts.
    """
    degrees = F.concat(*[f"{d}_mu" for d in DIMS])

    def bits(least):  # column by column, so that it is compiled
        return sum((F.when(least(F.get(f"{d}_mu", F.lit(b))), 1 << (5 * i + b)).otherwise(0) for i, d in enumerate(DIMS) for b in range(5)), F.lit(0)).cast("long")

    high, some = bits(lambda mu: mu >= MU_CUT).alias("high"), bits(lambda mu: mu > 0).alias("some")
    within = lambda of: lambda m: m.bitwiseAND(F.col(of)) == m
    if t_norm == "min":
        counted = fuzzy.select(*by, high, some).groupBy(*by, "high", "some").agg(F.count("*").alias("n"))
        sets = beside(counted, masks_of(concepts, by), by).select(*by, F.filter("masks", within("high")).alias("core"), F.exists("masks", within("some")).alias("any"), "n")
    else:
        # no degree is above 1, so a product of MU_CUT or more has no factor below; the others aren't worked out
        product = lambda m: F.aggregate(F.transform("degrees", lambda mu, i: F.when(F.getbit(m, i) == 1, mu).otherwise(1.0)), F.lit(1.0), lambda a, v: a * v)
        rows = fuzzy.select(*by, degrees.alias("degrees"), high, some)
        sets = beside(rows, masks_of(concepts, by), by).select(*by, F.filter("masks", lambda m: within("high")(m) & (product(m) >= MU_CUT)).alias("core"), F.exists("masks", within("some")).alias("any"), F.lit(1).alias("n"))
    return sets.groupBy(*by, "core", "any").agg(F.sum("n").alias("n"))


def core_overlaps(profiles: DataFrame, by: list[str] = []) -> DataFrame:
    """(by..., a, b, common, size_a, size_b, jaccard) of concept pairs a < b with common core customers, from core profiles (core, n):
    pairs are made of sets of concepts, not of customers."""
    one = profiles.select(*by, F.col("core").alias("s"), "n", F.explode("core").alias("a"))
    sizes = one.groupBy(*by, "a").agg(F.sum("n").alias("size"))
    pairs = one.select(*by, "n", "a", F.explode(F.filter("s", lambda b: b > F.col("a"))).alias("b")).groupBy(*by, "a", "b").agg(F.sum("n").alias("common"))
    both = pairs.join(F.broadcast(sizes.withColumnRenamed("size", "size_a")), [*by, "a"]).join(F.broadcast(sizes.select(*by, F.col("a").alias("b"), F.col("size").alias("size_b"))), [*by, "b"])
    return both.select(*by, "a", "b", "common", "size_a", "size_b", (F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common"))).alias("jaccard"))


def suppress(concepts: DataFrame, profiles: DataFrame, j_max: float = J_MAX, by_support_only: bool = False, by: list[str] = []) -> DataFrame:
    """The concepts (band_mask, n_customers, ...) that greedy suppression keeps.

    In order of support, then fewer attributes, higher proxy and mask, a
    concept stays unless its core customers are none or overlap those of one
    kept before by a Jaccard index of ``j_max`` or more. The order makes it
    sequential: one fold over the concepts of a group, which support bounds,
    each with its close ones. profiles are the core profiles of the same concepts.
    """
    close, key = core_overlaps(profiles, by).where(F.col("jaccard") >= j_max), [*by, "band_mask"]
    ends = F.explode(F.array(F.struct(F.col("a").alias("band_mask"), F.col("b").alias("near")), F.struct(F.col("b").alias("band_mask"), F.col("a").alias("near"))))
    near = close.select(*by, ends.alias("e")).select(*by, "e.*").groupBy(*key).agg(F.collect_set("near").alias("near"))
    cores = profiles.select(*by, F.explode("core").alias("band_mask")).distinct()
    able = concepts.where("band_mask <> 0").join(F.broadcast(cores), key).join(F.broadcast(near), key, "left")
    proxy = F.col("stability_proxy") if "stability_proxy" in concepts.columns else F.lit(1.0)
    rank = [-F.col("n_customers"), *([] if by_support_only else [F.bit_count("band_mask").cast("long"), -proxy]), F.col("band_mask")]
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(rank)], F.coalesce("near", F.array().cast("array<bigint>")).alias("near"))
    keep = lambda kept, c: F.when(F.arrays_overlap(kept, c.near), kept).otherwise(F.array_append(kept, c[f"o{len(rank) - 1}"]))
    kept = able.groupBy(*by).agg(F.aggregate(F.array_sort(F.collect_list(order)), F.array().cast("array<bigint>"), keep).alias("kept"))
    return concepts.join(F.broadcast(kept.select(*by, F.explode("kept").alias("band_mask"))), key, "left_semi")


def hard_labels(degrees: DataFrame, concepts: DataFrame) -> DataFrame:
    """(customer_id, band_mask, mu): the concept of highest degree; ties within 1e-6 by support, then fewer bands, then mask."""
    best = Window.partitionBy("customer_id").orderBy(F.desc(F.round("mu", 6)), F.desc("n_customers"), F.bit_count("band_mask"), "band_mask")
    rows = degrees.where("band_mask <> 0").join(F.broadcast(concepts.select("band_mask", "n_customers")), "band_mask")
    return rows.withColumn("r", F.row_number().over(best)).where("r = 1").select("customer_id", "band_mask", "mu")


def top_k_labels(degrees: DataFrame, concepts: DataFrame, k: int = 4) -> DataFrame:
    """(customer_id, band_mask): the concept of highest degree among the k of most support; ties go to the earlier."""
    first = concepts.where("band_mask <> 0").withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_customers"), "band_mask"))).where(F.col("place") <= k)
    rows = degrees.join(F.broadcast(first.select("band_mask", "place")), "band_mask")
    return rows.groupBy("customer_id").agg(F.max_by("band_mask", F.struct("mu", -F.col("place"))).alias("band_mask"))


def matrix_info(degrees: DataFrame) -> DataFrame:
    """One row: concepts, distinct columns (12 digits), concepts without core customers.

    A column's identity is a sum of hashes of its entries, so no column is collected.
    """
    entry = F.xxhash64("customer_id", F.round("mu", 12)).cast("decimal(20,0)")
    columns = degrees.groupBy("band_mask").agg(F.sum(entry).alias("h"), F.count_if(F.col("mu") >= MU_CUT).alias("core"))
    return columns.agg(F.count("*").alias("n_features"), F.countDistinct("h").alias("n_distinct_columns"), F.count_if(F.col("core") == 0).alias("n_empty_core"))


def complexity(profiles: DataFrame, concepts: DataFrame) -> DataFrame:
    """One row: share of customers with any degree and with a core one, core concepts a customer, share with several,
    mean Jaccard of core pairs, share of pairs at .8 or more, distinct core profiles. Pairs without common customers count as 0."""
    k, n = F.size("core"), F.col("n")
    share = lambda condition: F.sum(F.when(condition, n).otherwise(0)) / F.sum(n)
    one = profiles.agg(
        share(F.col("any")).alias("coverage_any"), share(k > 0).alias("coverage_core"), (F.sum(k * n) / F.sum(n)).alias("concepts_per_customer"),
        share(k > 1).alias("multi_share"), F.countDistinct("core").alias("unique_profiles"),
    )
    pairs = core_overlaps(profiles).agg(F.coalesce(F.sum("jaccard"), F.lit(0.0)).alias("s"), F.count_if(F.col("jaccard") >= J_MAX).alias("d"))
    k = concepts.select("band_mask").distinct().agg((F.count("*") * (F.count("*") - 1) / 2).alias("pairs"))
    out = one.crossJoin(F.broadcast(pairs)).crossJoin(F.broadcast(k))
    return out.select(*one.columns, F.coalesce(F.try_divide("s", "pairs"), F.lit(0.0)).alias("mean_jaccard"), F.coalesce(F.try_divide("d", "pairs"), F.lit(0.0)).alias("near_duplicate_share"))


def interpretability(profiles: DataFrame, concepts: DataFrame) -> DataFrame:
    """One row: concepts K, coverage, mean intent length, core concepts a covered customer, mean overlap of pairs."""
    c = complexity(profiles, concepts)
    length = concepts.select("band_mask").distinct().agg(F.count("*").alias("k"), F.avg(F.bit_count("band_mask")).alias("intent_length"))
    return c.crossJoin(F.broadcast(length)).select(
        "k", F.col("coverage_core").alias("coverage"), "intent_length", F.coalesce(F.try_divide("concepts_per_customer", "coverage_core"), F.lit(0.0)).alias("core_load"), F.col("mean_jaccard").alias("overlap")
    )


def greedy_cover(profiles: DataFrame, share: float = 0.8) -> DataFrame:
    """(step, band_mask, covered): concepts chosen one by one for most new core customers until ``share`` of the coverable is covered.

    Works on core profiles and their counts; ties go to the smaller mask.
    """
    sets = checkpointed(profiles.where(F.size("core") > 0).groupBy("core").agg(F.sum("n").alias("n")))
    goal = (sets.agg(F.sum("n")).first()[0] or 0) * share
    done, chosen, left = 0, [], sets
    while done < goal:
        best = left.select("n", F.explode("core").alias("c")).groupBy("c").agg(F.sum("n").alias("gain")).orderBy(F.desc("gain"), "c").first()
        done += best.gain
        chosen.append((len(chosen) + 1, best.c, done))
        left = sets.where(~F.arrays_overlap("core", F.array(*[F.lit(c) for _, c, _ in chosen])))
    return profiles.sparkSession.createDataFrame(chosen, "step int, band_mask long, covered long")


def lattice_summary(concepts: DataFrame, kept: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row: raw and kept concepts, their ratio, core concepts a customer, mean and greatest extents."""
    n = concepts.agg(F.count("*").alias("raw"))
    k = kept.agg(F.count("*").alias("kept"), F.avg("n_customers").alias("mean_extent"), F.max("n_customers").alias("max_extent"))
    per = beside(profiles, masks_of(kept)).agg((F.sum(F.size(F.array_intersect("core", "masks")) * F.col("n")) / F.sum("n")).alias("concepts_per_customer"))
    return n.crossJoin(k).crossJoin(per).select("raw", "kept", F.try_divide("kept", "raw").alias("ratio"), "concepts_per_customer", "mean_extent", "max_extent")


def best_k(concepts: DataFrame, k: int) -> DataFrame:
    """The k best concepts by support, fewer bands, higher proxy, mask."""
    order = Window.orderBy(F.desc("n_customers"), F.bit_count("band_mask"), F.desc("stability_proxy"), "band_mask")
    return concepts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)

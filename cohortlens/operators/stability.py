"""How stable segments are between refits and between origins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.ranks import Ordered, checkpointed

from . import concepts as mining
from . import features, membership, metrics, pruning, scoring

MU_CUT = 0.5
RANK_TOLERANCE = 0.05


def fit_crisp(train: DataFrame, by: list[str] = []) -> tuple[DataFrame, DataFrame]:
    """(cutpoints, concepts keyed by band_mask) of a cohort, or of each group of rows."""
    cuts = scoring.fit_cutpoints(train, strict=False, by=by)
    found = mining.crisp_concepts(scoring.score(train, cuts, by), by=by).where("intent_mask <> 0").withColumnRenamed("intent_mask", "band_mask")
    return cuts, found


def fit_crisp_runs(df: DataFrame, runs: int, by: str = "sample") -> tuple[DataFrame, DataFrame]:
    """``fit_crisp`` of each run of df (R, F, M, drawn), whose rows have the runs they take part in as bits."""
    cuts = scoring.run_cutpoints(Ordered(scoring.long_dims(df, ["drawn"]), runs), by)
    scored = scoring.score(metrics.runs_of(df.select(*scoring.DIMS, "drawn"), runs, by), cuts, [by])
    return cuts, mining.crisp_concepts(scored, by=[by]).where("intent_mask <> 0").withColumnRenamed("intent_mask", "band_mask")


def project_crisp(df: DataFrame, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(customer_id, band_mask, mu) of the concepts a customer is in; what is missing is 0."""
    cuts, found = model
    masked = scoring.score(df, cuts).select("customer_id", mining.crisp_mask().alias("mask"))
    few = F.broadcast(found.select("band_mask"))
    return masked.join(few, F.col("mask").bitwiseAND(F.col("band_mask")) == F.col("band_mask")).select("customer_id", "band_mask", F.lit(1.0).alias("mu"))


def fit_fuzzy(train: DataFrame, best: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cutpoints, centroids, kept concepts); ``best`` keeps the best so many before suppression's order."""
    ranked = scoring.ranked_dims(train)
    cuts = checkpointed(scoring.fit_cutpoints(train, strict=False, ranked=ranked))
    centroids = checkpointed(membership.ranked_centroids(ranked, cuts))
    fuzzy = membership.fuzzify(scoring.score(train, cuts), centroids)
    found = checkpointed(mining.distinct_profiles(mining.fuzzy_concepts(fuzzy)))
    kept = pruning.suppress(found, checkpointed(pruning.core_profiles(fuzzy, found)))
    return cuts, centroids, checkpointed(pruning.best_k(kept, best) if best else kept)


def project_fuzzy(df: DataFrame, model: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    cuts, centroids, kept = model
    return pruning.concept_degrees(membership.fuzzify(scoring.score(df, cuts), centroids), kept).where("mu > 0")


def similarity(a: DataFrame, b: DataFrame, by: list[str] = []) -> DataFrame:
    """(by..., core_jaccard, fuzzy_jaccard) of two profiles (by..., customer_id, band_mask, mu): cores in common over
    cores in either, and sum of minima over sum of maxima; nothing in either is 1. A missing pair has degree 0."""
    both = a.withColumnRenamed("mu", "mu_a").join(b.withColumnRenamed("mu", "mu_b"), [*by, "customer_id", "band_mask"], "full")
    x, y = F.coalesce("mu_a", F.lit(0.0)), F.coalesce("mu_b", F.lit(0.0))
    core_a, core_b = x >= MU_CUT, y >= MU_CUT
    out = both.groupBy(*by).agg(F.count_if(core_a & core_b).alias("c"), F.count_if(core_a | core_b).alias("e"), F.sum(F.least(x, y)).alias("lo"), F.sum(F.greatest(x, y)).alias("hi"))
    return out.select(*by, F.coalesce(F.try_divide("c", "e"), F.lit(1.0)).alias("core_jaccard"), F.coalesce(F.try_divide("lo", "hi"), F.lit(1.0)).alias("fuzzy_jaccard"))


def recurrence(reference: DataFrame, fitted: DataFrame) -> DataFrame:
    """One row: share of the reference's concepts that a refit has too, and both counts."""
    r, f = reference.select("band_mask"), fitted.select("band_mask")
    common = r.join(f, "band_mask", "left_semi").agg(F.count("*").alias("c"))
    return common.crossJoin(r.agg(F.count("*").alias("n_concepts_ref"))).crossJoin(f.agg(F.count("*").alias("n_concepts_fit"))).select(
        F.try_divide("c", "n_concepts_ref").alias("concept_recurrence"), "n_concepts_ref", "n_concepts_fit"
    )


def refit_study(cohort: DataFrame, subsamples: int = 3, share: float = 0.8, seed: int = 2026, fit=fit_crisp, project=project_crisp) -> DataFrame:
    """(subsample, core_jaccard, fuzzy_jaccard, concept_recurrence, n_concepts_ref, n_concepts_fit): models of
    subsamples against the model of all customers, both projected on all."""
    cohort = checkpointed(cohort)
    reference = fit(cohort)
    ref_profile = checkpointed(project(cohort, reference))
    parts = []
    for s in range(subsamples):
        model = fit(metrics.subsample(cohort, share, seed + s))
        row = similarity(ref_profile, project(cohort, model)).crossJoin(recurrence(reference[-1], model[-1]))
        parts.append(row.select(F.lit(s).alias("subsample"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def crisp_refits(cohort: DataFrame, seeds: list[int], share: float = 0.8) -> DataFrame:
    """What ``refit_study`` gives for crisp models, a row a seed: all subsamples are fitted as groups of one table.

    A customer's concepts are those of few whose bands it has, so both models'
    are arrays in its row and the overlaps add up without a shuffle of customers.
    """
    cohort, by = checkpointed(cohort), ["sample"]
    cuts, found = fit_crisp(cohort)
    fits = fit_crisp_runs(checkpointed(metrics.drawn(cohort, seeds, lambda n: F.round(F.lit(share) * n))), len(seeds))
    fit_cuts, fit_found = checkpointed(fits[0]), checkpointed(fits[1])
    # the mask is bound once for a row, not worked out for each concept
    held = lambda c: F.get(F.transform(F.array("mask"), lambda mask: F.filter(c, lambda m: mask.bitwiseAND(m) == m)), F.lit(0))
    masked = scoring.score(cohort, cuts).crossJoin(F.broadcast(found.agg(F.collect_list("band_mask").alias("all")))).select(*scoring.DIMS, "all", mining.crisp_mask().alias("mask"))
    models = scoring.as_row(fit_cuts, by).join(fit_found.groupBy("sample").agg(F.collect_list("band_mask").alias("fitted")), by, "left").withColumn("fitted", F.coalesce("fitted", F.array().cast("array<bigint>")))
    sets = masked.select(*scoring.DIMS, "all", held("all").alias("a")).crossJoin(F.broadcast(models))
    for d in scoring.DIMS:
        sets = sets.withColumn(f"{d}_score", scoring.band(F.col(d).cast("double"), F.col(f"{d}_cuts"), d == "R"))
    sets = sets.select("sample", "all", "fitted", "a", mining.crisp_mask().alias("mask")).withColumn("b", held("fitted"))
    common, either = F.sum(F.size(F.array_intersect("a", "b"))), F.sum(F.size(F.array_union("a", "b")))
    out = sets.groupBy("sample").agg(F.coalesce(F.try_divide(common, either), F.lit(1.0)).alias("core_jaccard"), F.first("all").alias("all"), F.first("fitted").alias("fitted"))
    return out.select(
        F.col("sample").alias("subsample"), "core_jaccard", F.col("core_jaccard").alias("fuzzy_jaccard"),
        F.try_divide(F.size(F.array_intersect("all", "fitted")), F.size("all")).alias("concept_recurrence"), F.size("all").cast("long").alias("n_concepts_ref"), F.size("fitted").cast("long").alias("n_concepts_fit"),
    )


def _common(first: DataFrame, second: DataFrame) -> DataFrame:
    """(customer_id, stable) of two cohorts' common customers: whether their percent ranks moved ``RANK_TOLERANCE`` at most in each dimension."""
    a, b = scoring.percent_ranks(first), scoring.percent_ranks(second)
    pair = a.select("customer_id", *[F.col(f"{d}_pct").alias(f"{d}_a") for d in scoring.DIMS]).join(b.select("customer_id", *[F.col(f"{d}_pct").alias(f"{d}_b") for d in scoring.DIMS]), "customer_id")
    moved = F.greatest(*[F.abs(F.col(f"{d}_a") - F.col(f"{d}_b")) for d in scoring.DIMS])
    return pair.select("customer_id", (F.round(moved, 9) <= RANK_TOLERANCE).alias("stable"))


def temporal_fuzzy_pair(first: DataFrame, second: DataFrame, best: int | None = None) -> DataFrame:
    """What ``temporal_pair`` gives for fuzzy models: a customer's degrees in both models' concepts are an array of its row, so a row a customer is joined, not one a concept."""
    models = [fit_fuzzy(df, best) for df in (first, second)]
    every = checkpointed(models[0][2].select("band_mask").union(models[1][2].select("band_mask")).distinct())
    sides = []
    for name, df, (cuts, centroids, kept) in zip("xy", (first, second), models, strict=True):
        own = pruning.masks_of(every).crossJoin(pruning.masks_of(kept).withColumnRenamed("masks", "own")).select(F.transform("masks", lambda m: F.array_contains("own", m)).alias("own"))
        degrees = features.concept_features(membership.fuzzify(scoring.score(df, cuts), centroids), every)
        sides.append(scoring.beside(degrees, checkpointed(own)).select("customer_id", F.zip_with("x", "own", lambda v, o: F.when(o, v).otherwise(0.0)).alias(name)))
    both = F.arrays_zip("x", "y")
    add = lambda f: F.aggregate(both, F.lit(0.0), lambda a, p: a + f(p.x, p.y))
    one = lambda condition: F.when(condition, 1.0).otherwise(0.0)
    sums = _common(first, second).join(sides[0], "customer_id").join(sides[1], "customer_id").select(
        F.explode(F.when(F.col("stable"), F.array(F.lit("all"), F.lit("stable"))).otherwise(F.array(F.lit("all")))).alias("subset"),
        add(lambda x, y: one((x >= MU_CUT) & (y >= MU_CUT))).alias("c"), add(lambda x, y: one((x >= MU_CUT) | (y >= MU_CUT))).alias("e"), add(F.least).alias("lo"), add(F.greatest).alias("hi"),
    )
    out = sums.groupBy("subset").agg(F.count("*").alias("n_customers"), *[F.sum(v).alias(v) for v in ("c", "e", "lo", "hi")])
    return out.select("subset", "n_customers", F.coalesce(F.try_divide("c", "e"), F.lit(1.0)).alias("core_jaccard"), F.coalesce(F.try_divide("lo", "hi"), F.lit(1.0)).alias("fuzzy_jaccard"))


def temporal_pair(first: DataFrame, second: DataFrame, fit=fit_crisp, project=project_crisp) -> DataFrame:
    """(subset, n_customers, core_jaccard, fuzzy_jaccard) of two cohorts' common customers: all of them, and those whose
    percent ranks moved ``RANK_TOLERANCE`` at most in each dimension. Each cohort has its own model."""
    subsets = _common(first, second).select("customer_id", F.explode(F.when(F.col("stable"), F.array(F.lit("all"), F.lit("stable"))).otherwise(F.array(F.lit("all")))).alias("subset"))
    x, y = project(first, fit(first)).join(subsets, "customer_id"), project(second, fit(second)).join(subsets, "customer_id")
    n = subsets.groupBy("subset").agg(F.count("*").alias("n_customers"))
    return n.join(similarity(x, y, ["subset"]), "subset").select("subset", "n_customers", "core_jaccard", "fuzzy_jaccard")


def resample_sets(cohort: DataFrame, b: int, share: float = 0.8, seed: int = 7) -> DataFrame:
    """(b, band_mask): crisp concepts of each of several subsamples, fitted as groups of one table."""
    drawn = checkpointed(metrics.drawn(cohort, [seed + i for i in range(b)], lambda n: F.floor(F.lit(share) * n)).select(*scoring.DIMS, "drawn"))
    return fit_crisp_runs(drawn, b)[1].select(F.col("sample").alias("b"), "band_mask")


def set_jaccards(sets: DataFrame, key: str) -> DataFrame:
    """(a, b, jaccard) of every pair a < b of concept sets (key, band_mask); sets are few."""
    sizes = sets.groupBy(key).agg(F.count("*").alias("n"))
    x, y = sizes.select(F.col(key).alias("a"), F.col("n").alias("na")), sizes.select(F.col(key).alias("b"), F.col("n").alias("nb"))
    shared = sets.select(F.col(key).alias("a"), "band_mask").join(sets.select(F.col(key).alias("b"), "band_mask"), "band_mask").where("a < b").groupBy("a", "b").agg(F.count("*").alias("c"))
    c = F.coalesce("c", F.lit(0))
    return x.join(F.broadcast(y), F.col("a") < F.col("b")).join(shared, ["a", "b"], "left").select("a", "b", (c / (F.col("na") + F.col("nb") - c)).alias("jaccard"))


def set_recurrence(reference: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """(band_mask, share): the share of concept sets (key, band_mask) that hold each concept of reference (band_mask); none without sets."""
    n = sets.select(key).distinct().agg(F.count("*").alias("n"))
    held = sets.select(key, "band_mask").distinct().groupBy("band_mask").agg(F.count("*").alias("c"))
    return reference.select("band_mask").distinct().join(held, "band_mask", "left").crossJoin(F.broadcast(n)).select("band_mask", F.try_divide(F.coalesce("c", F.lit(0)), "n").alias("share"))


def equal_columns(a: DataFrame, b: DataFrame, digits: int = 9) -> DataFrame:
    """One row: columns of degrees that only one side has, as multisets of whole columns, whatever their keys."""
    entry = F.xxhash64("customer_id", F.round("mu", digits)).cast("decimal(20,0)")
    columns = lambda df: df.where(F.round("mu", digits) > 0).groupBy("band_mask").agg(F.sum(entry).alias("h")).select("h")
    x, y = columns(a), columns(b)
    return x.exceptAll(y).agg(F.count("*").alias("only_first")).crossJoin(y.exceptAll(x).agg(F.count("*").alias("only_second")))


def consecutive(cohorts: DataFrame) -> DataFrame:
    """(origin, next_origin) of the pooled cohorts in order: a few rows."""
    o = cohorts.where("pooled").select("origin").distinct()
    return o.withColumn("next_origin", F.lead("origin").over(Window.orderBy("origin"))).where(F.col("next_origin").isNotNull())

"""Feature arms: (customer_id, x array<double>) from training-only fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.ranks import checkpointed

from . import concepts as mining
from . import membership, pruning, scoring
from .scoring import DIMS

KNOTS = [0.0, 0.25, 0.5, 0.75, 1.0]


def standardized(train: DataFrame, df: DataFrame, log: bool, by: list[str] = [], keep: list[str] = ["customer_id"]) -> DataFrame:
    """R, F, M (or their log1p) less the training mean over the training population deviation; a constant has 0."""
    x = {d: F.log1p(F.col(d).cast("double")) if log else F.col(d).cast("double") for d in DIMS}
    fit = train.groupBy(*by).agg(*[F.avg(x[d]).alias(f"{d}_mean") for d in DIMS], *[F.stddev_pop(x[d]).alias(f"{d}_std") for d in DIMS])
    scaled = [F.coalesce(F.try_divide(x[d] - F.col(f"{d}_mean"), F.col(f"{d}_std")), F.lit(0.0)) for d in DIMS]
    return scoring.beside(df, checkpointed(fit), by).select(*dict.fromkeys([*by, *keep]), F.array(*scaled).alias("x"))


def raw(df: DataFrame) -> DataFrame:
    return df.select("customer_id", F.array(*[F.col(d).cast("double") for d in DIMS]).alias("x"))


def spline_fit(train: DataFrame) -> DataFrame:
    """(dim, cuts): eleven knots of a cubic spline: five training quantiles of log1p, three more at each side, as far apart as the outer ones."""
    from cohortlens.functions.ranks import exact_quantiles

    rows = scoring.long_dims(train, []).withColumn("x", F.log1p("x"))
    q = exact_quantiles(rows, "x", KNOTS, ["dim"])
    first, last = F.col("quantiles")[1] - F.col("quantiles")[0], F.col("quantiles")[4] - F.col("quantiles")[3]
    left = F.transform(F.sequence(F.lit(3), F.lit(1), F.lit(-1)), lambda i: F.col("quantiles")[0] - i * first)
    right = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.col("quantiles")[4] + i * last)
    return q.select("dim", F.concat(left, "quantiles", right).alias("cuts"))


def _indicator(condition):
    return lambda i: F.when(condition(i), 1.0).otherwise(0.0)


def _basis_step(t: Column, x: Column):
    """One step of the recursion, from the values b of degree k - 1 to those of degree k; empty intervals add nothing."""

    def step(b, k):
        def value(i):
            left = F.try_divide(x - F.get(t, i), F.get(t, i + k) - F.get(t, i))
            right = F.try_divide(F.get(t, i + k + 1) - x, F.get(t, i + k + 1) - F.get(t, i + 1))
            return F.coalesce(left, F.lit(0.0)) * F.get(b, i) + F.coalesce(right, F.lit(0.0)) * F.get(b, i + 1)

        return F.transform(F.sequence(F.lit(0), 9 - k), value)

    return step


def spline_basis(df: DataFrame, fit: DataFrame) -> DataFrame:
    """The seven cubic basis values of each dimension by the Cox-de Boor recursion; constant beyond the outer knots."""
    out = df.crossJoin(F.broadcast(scoring.as_row(fit)))
    for d in DIMS:
        t = F.col(f"{d}_cuts")
        x = F.greatest(t[3], F.least(t[7], F.log1p(F.col(d).cast("double"))))
        # the last of the inner intervals takes its right end
        inside = lambda i, t=t, x=x: ((i < 7) & (x >= F.get(t, i)) & (x < F.get(t, i + 1))) | ((i == 6) & (x == F.get(t, i + 1)) & (F.get(t, i) < F.get(t, i + 1)))
        first = F.transform(F.sequence(F.lit(0), F.lit(9)), _indicator(inside))
        # a fold holds each degree's values once; columns would be written into each other and computed over and over
        out = out.withColumn(f"{d}_basis", F.aggregate(F.sequence(F.lit(1), F.lit(3)), first, _basis_step(t, x)))
    return out.select("customer_id", F.concat(*[f"{d}_basis" for d in DIMS]).alias("x"))


def crisp_bands(scored: DataFrame, by: list[str] = [], keep: list[str] = ["customer_id"]) -> DataFrame:
    """Fifteen indicators of bands."""
    return scored.select(*dict.fromkeys([*by, *keep]), F.array(*[(F.col(f"{d}_score") == b).cast("double") for d in DIMS for b in range(1, 6)]).alias("x"))


def fuzzy_bands(fuzzy: DataFrame, by: list[str] = [], keep: list[str] = ["customer_id"]) -> DataFrame:
    return fuzzy.select(*dict.fromkeys([*by, *keep]), F.concat(*[f"{d}_mu" for d in DIMS]).alias("x"))


def concept_features(fuzzy: DataFrame, kept: DataFrame, t_norm: str = "min", by: list[str] = [], keep: list[str] = ["customer_id"]) -> DataFrame:
    """Degrees in the kept concepts (band_mask), ordered by mask: one row a customer, without a shuffle."""
    degrees = F.concat(*[f"{d}_mu" for d in DIMS])
    combine = (lambda a, v: F.least(a, v)) if t_norm == "min" else (lambda a, v: a * v)
    # the bands of a mask are worked out once, not for each customer
    bands = pruning.masks_of(kept, by).select(*by, F.transform("masks", lambda m: F.filter(F.sequence(F.lit(0), F.lit(14)), lambda b: F.getbit(m, b) == 1)).alias("bands"))
    degree = lambda bs: F.aggregate(bs, F.lit(1.0), lambda a, b: combine(a, F.get("degrees", b)))
    kept_columns = list(dict.fromkeys([*by, *keep]))
    return scoring.beside(fuzzy.select(*kept_columns, degrees.alias("degrees")), checkpointed(bands), by).select(*kept_columns, F.transform("bands", degree).alias("x"))


def scores_as_degrees(scored: DataFrame) -> DataFrame:
    """Scores as degrees 0 and 1, so that crisp concepts are features in the same way."""
    return scored.withColumns({f"{d}_mu": F.array(*[(F.col(f"{d}_score") == b).cast("double") for b in range(1, 6)]) for d in DIMS})


def joined(*arms: DataFrame) -> DataFrame:
    """Arms side by side by customer."""
    out = arms[0]
    for a in arms[1:]:
        out = out.join(a.withColumnRenamed("x", "__more"), "customer_id").select("customer_id", F.concat("x", "__more").alias("x"))
    return out


#: Arms by name; the builder takes (train, df) with R, F, M and gives df's features. The registry is the way to add one.
ARMS: dict = {}


def arm(name: str):
    def add(f):
        ARMS[name] = f
        return f

    return add


def _fit_fuzzy(train, df, family="piecewise", dense=False):
    ranked = scoring.ranked_dims(train)
    cuts = checkpointed(scoring.fit_dense_ranks(train, ranked=ranked) if dense else scoring.fit_cutpoints(train, strict=False, ranked=ranked))
    scored = scoring.score(train, cuts)
    centroids = checkpointed(membership.ranked_centroids(ranked, cuts))
    return membership.fuzzify(scored, centroids, family), membership.fuzzify(scoring.score(df, cuts), centroids, family)


def _kept(fuzzy_train, t_norm="min"):
    found = checkpointed(mining.distinct_profiles(mining.fuzzy_concepts(fuzzy_train)))
    return checkpointed(pruning.suppress(found, checkpointed(pruning.core_profiles(fuzzy_train, found, t_norm))))


@arm("raw_std")
def _(train, df):
    return standardized(train, df, log=False)


@arm("log_rfm")
def _(train, df):
    return standardized(train, df, log=True)


@arm("spline_log_rfm")
def _(train, df):
    return spline_basis(df, spline_fit(train))


@arm("gbm_raw_rfm")
def _(train, df):
    return raw(df)


@arm("crisp_bands")
def _(train, df):
    return crisp_bands(scoring.score(df, scoring.fit_cutpoints(train, strict=False)))


@arm("fuzzy_bands")
def _(train, df):
    return fuzzy_bands(_fit_fuzzy(train, df)[1])


@arm("crisp_rfm_fca")
def _(train, df):
    cuts = scoring.fit_cutpoints(train, strict=False)
    found = mining.crisp_concepts(scoring.score(train, cuts)).where("intent_mask <> 0").select(F.col("intent_mask").alias("band_mask"))
    return concept_features(scores_as_degrees(scoring.score(df, cuts)), found)


@arm("fuzzy_rfm_fca")
def _(train, df):
    a, b = _fit_fuzzy(train, df)
    return concept_features(b, _kept(a))


@arm("fuzzy_rfm_fca_denserank")
def _(train, df):
    a, b = _fit_fuzzy(train, df, dense=True)
    return concept_features(b, _kept(a))


@arm("kuznetsov_fca")
def _(train, df):
    from .lattice import stability_filter

    a, b = _fit_fuzzy(train, df)
    found = checkpointed(mining.distinct_profiles(stability_filter(checkpointed(mining.fuzzy_concepts(a)), checkpointed(mining.profiles(a)))))
    return concept_features(b, checkpointed(pruning.suppress(found, checkpointed(pruning.core_profiles(a, found)))))


@arm("hybrid_fuzzy")
def _(train, df):
    return joined(ARMS["fuzzy_rfm_fca"](train, df), ARMS["log_rfm"](train, df))


@arm("hybrid_crisp")
def _(train, df):
    return joined(ARMS["crisp_rfm_fca"](train, df), ARMS["log_rfm"](train, df))


@arm("product_t_norm")
def _(train, df):
    a, b = _fit_fuzzy(train, df)
    return concept_features(b, _kept(a, "product"), "product")


def _tail_pair(train, df):
    ranked = scoring.ranked_dims(train)
    cuts = checkpointed(scoring.fit_cutpoints(train, strict=False, ranked=ranked))
    scored = scoring.score(train, cuts)
    r, t = checkpointed(membership.ranked_centroids(ranked, cuts)), checkpointed(membership.ranked_tail(ranked, cuts))
    return membership.fuzzify_tail(scored, r, t), membership.fuzzify_tail(scoring.score(df, cuts), r, t)


for _norm in ("min", "product"):

    @arm(f"tail_{_norm}")
    def _(train, df, t_norm=_norm):
        a, b = _tail_pair(train, df)
        return concept_features(b, _kept(a, t_norm), t_norm)


for _family in ("gaussian", "bell", "log_gaussian"):

    @arm(f"family_{_family}")
    def _(train, df, family=_family):
        a, b = _fit_fuzzy(train, df, family)
        return concept_features(b, _kept(a))


#: Arms whose features are fitted for all runs at once: the builder takes (train, df) with a column run and gives (keep, x), a row for each of df.
RUN_ARMS: dict = {}
RUN = ["run"]
RUN_KEPT = ["run", "customer_id"]


def run_arm(name: str):
    def add(f):
        RUN_ARMS[name] = f
        return f

    return add


@run_arm("raw_std")
def _(train, df, keep=RUN_KEPT):
    return standardized(train, df, log=False, by=RUN, keep=keep)


@run_arm("log_rfm")
def _(train, df, keep=RUN_KEPT):
    return standardized(train, df, log=True, by=RUN, keep=keep)


@run_arm("gbm_raw_rfm")
def _(train, df, keep=RUN_KEPT):
    return df.select(*keep, F.array(*[F.col(d).cast("double") for d in DIMS]).alias("x"))


@run_arm("crisp_bands")
def _(train, df, keep=RUN_KEPT):
    return crisp_bands(scoring.score(df, checkpointed(scoring.fit_cutpoints(train, strict=False, by=RUN)), RUN), RUN, keep)


def run_concepts(train: DataFrame, fuzzy: bool, fitted: tuple[DataFrame, DataFrame | None] | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(cuts, concepts, centroids) fitted for each run on its training rows: concepts (run, band_mask, ...), fuzzy ones after suppression.

    Scores and degrees are worked out from a row and the fitted parameters wherever they are asked for; only what is fitted is stored.
    ``fitted`` are the cutpoints and centroids, if known before."""
    ranked = None if fitted else scoring.ranked_dims(train, RUN)
    cuts = fitted[0] if fitted else checkpointed(scoring.fit_cutpoints(train, strict=False, by=RUN, ranked=ranked))
    scored = scoring.score(train, cuts, RUN)
    if not fuzzy:
        return cuts, checkpointed(mining.crisp_concepts(scored, by=RUN).where("intent_mask <> 0").withColumn("band_mask", F.col("intent_mask"))), None
    centroids = fitted[1] if fitted else checkpointed(membership.ranked_centroids(ranked, cuts, by=RUN))
    degrees = membership.fuzzify(scored, centroids, by=RUN)
    found = checkpointed(mining.distinct_profiles(mining.fuzzy_concepts(degrees, by=RUN), RUN))
    return cuts, checkpointed(pruning.suppress(found, checkpointed(pruning.core_profiles(degrees, found, by=RUN)), by=RUN)), centroids


@run_arm("fuzzy_bands")
def _(train, df, keep=RUN_KEPT):
    ranked = scoring.ranked_dims(train, RUN)
    cuts = checkpointed(scoring.fit_cutpoints(train, strict=False, by=RUN, ranked=ranked))
    centroids = checkpointed(membership.ranked_centroids(ranked, cuts, by=RUN))
    return fuzzy_bands(membership.fuzzify(scoring.score(df, cuts, RUN), centroids, by=RUN), RUN, keep)


@run_arm("crisp_rfm_fca")
def _(train, df, keep=RUN_KEPT):
    cuts, found, _ = run_concepts(train, fuzzy=False)
    return concept_features(scores_as_degrees(scoring.score(df, cuts, RUN)), found, by=RUN, keep=keep)


@run_arm("fuzzy_rfm_fca")
def _(train, df, keep=RUN_KEPT):
    cuts, found, centroids = run_concepts(train, fuzzy=True)
    return concept_features(membership.fuzzify(scoring.score(df, cuts, RUN), centroids, by=RUN), found, by=RUN, keep=keep)

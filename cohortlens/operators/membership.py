"""Fuzzy memberships of raw values in ordered bands.

Fitted state is a frame (dim, centroids) or (dim, anchors, ...); memberships
are arrays with one degree a band, bands in score order (5 is best). R scores
fall as R rises, so its centroids descend: they are sorted for the shapes and
the degrees are put back in score order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.ranks import Ordered, exact_quantiles, ranked_quantiles, small_methods

from .scoring import DIMS, as_row, band, beside

EPS = 1e-9


def long_scored(scored: DataFrame, by: list[str] = []) -> DataFrame:
    """(by..., dim, x, s) of scored customers."""
    return scored.select(*by, F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("double").alias("x"), F.col(f"{d}_score").alias("s")) for d in DIMS])).alias("p")).select(*by, "p.*")


def band_centroids(scored: DataFrame, levels: int = 5, by: list[str] = []) -> DataFrame:
    """(by..., dim, cuts): median raw value of each band in score order; an empty band takes the median of all.

    The column is named as fitted arrays are, so that as_row turns it into a row of R_cuts, F_cuts, M_cuts.
    Medians come from global ranks, with all rows as a band 0 of their own.
    """
    rows = long_scored(scored, by).select(*by, "dim", "x", F.explode(F.array("s", F.lit(0))).alias("s"))
    return _centroids(exact_quantiles(rows, "x", [0.5], [*by, "dim", "s"]), levels, by)


def banded(ranked: DataFrame, cuts: DataFrame, by: list[str] = []) -> DataFrame:
    """(by..., dim, s, x, ties, before, total): ``scoring.ranked_dims`` within the bands of fitted cutpoints (by..., dim, cuts), which are
    stretches of the order: a band's ranks are those of its dimension less its first."""
    key = [*by, "dim"]
    s = F.when(F.col("dim") == "R", band(F.col("x"), F.col("cuts"), True)).otherwise(band(F.col("x"), F.col("cuts")))
    rows = ranked.join(F.broadcast(cuts), key).select(*key, s.alias("s"), "x", "ties", "before")
    spans = rows.groupBy(*key, "s").agg(F.min("before").alias("__first"), F.sum("ties").alias("total"))
    return rows.join(F.broadcast(spans), [*key, "s"]).select(*key, "s", "x", "ties", (F.col("before") - F.col("__first")).alias("before"), "total")


def ranked_centroids(ranked: DataFrame, cuts: DataFrame, levels: int = 5, by: list[str] = []) -> DataFrame:
    """The ``band_centroids`` of rows scored by cuts, from the ``scoring.ranked_dims`` of the same rows: nothing is ranked again."""
    every = ranked.select(*by, "dim", F.lit(0).alias("s"), "x", "ties", "before", "total")
    return _centroids(ranked_quantiles(every.unionByName(banded(ranked, cuts, by)), "x", [0.5], [*by, "dim", "s"]), levels, by)


def run_centroids(ordered: Ordered, cuts: DataFrame, by: str = "run", levels: int = 5) -> DataFrame:
    """(by, dim, cuts): the ``band_centroids`` of each run of dimensions in order, scored by its own cutpoints (by, dim, cuts)."""
    limits = {(r["dim"], r[by]): sorted(r.cuts) for r in cuts.collect()}
    ends, stretches = ordered.upto(limits), {}
    for (dim, run), c in limits.items():
        edges = [0, *(ends[dim, run, v] for v in c), int(ordered.totals[dim][run])]
        stretches[dim, run, 0] = dim, run, 0, edges[-1]
        for b, (first, end) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            stretches[dim, run, len(c) + 1 - b if dim == "R" else 1 + b] = dim, run, first, end - first
    medians = ordered.quantiles(stretches, [0.5])
    rows = [(run, dim, [medians.get((dim, run, b), medians[dim, run, 0])[0] for b in range(1, levels + 1)]) for dim, run in limits]
    return ordered.laid.sparkSession.createDataFrame(rows, f"{by} int, dim string, cuts array<double>")


def _centroids(medians: DataFrame, levels: int, by: list[str]) -> DataFrame:
    of = lambda b: F.max(F.when(F.col("s") == b, F.col("quantiles")[0]))
    return medians.groupBy(*by, "dim").agg(F.array(*[F.coalesce(of(b), of(0)) for b in range(1, levels + 1)]).alias("cuts"))


def piecewise(x: Column, centroids: Column) -> Column:
    """Degrees in bands of ascending centroids: linear in between, 1 beyond the outer ones; one band has degree 1."""
    n = F.size(centroids)

    def degree(c, i):
        before, after = F.get(centroids, i - 1), F.get(centroids, i + 1)
        left = F.when((i == 0) | ((i == n - 1) & (x >= c)), 1.0).otherwise((x - before) / _gap(c - before))
        right = F.when((i == n - 1) | ((i == 0) & (x <= c)), 1.0).otherwise((after - x) / _gap(after - c))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), left, right))

    return F.transform(centroids, degree)


def compiled_piecewise(x: Column, centroids: Column, n: int) -> Column:
    """``piecewise`` of exactly n centroids, a column a degree: Spark compiles it, where it interprets a function of an array's elements."""
    c = [F.get(centroids, F.lit(i)) for i in range(n)]
    out = []
    for i in range(n):
        left = F.lit(1.0) if i == 0 else (x - c[i - 1]) / _gap(c[i] - c[i - 1])
        right = F.lit(1.0) if i == n - 1 else (c[i + 1] - x) / _gap(c[i + 1] - c[i])
        left = F.when(x >= c[i], 1.0).otherwise(left) if i == n - 1 and i else left
        right = F.when(x <= c[i], 1.0).otherwise(right) if i == 0 and i < n - 1 else right
        out.append(F.greatest(F.lit(0.0), F.least(F.lit(1.0), left, right)))
    return F.array(*out)


def rounded_degrees(mu: str, n: int = 5, invert: bool = False) -> Column:
    """Nine digits of the n degrees, the last first if inverted; most are 0 or 1, which need no rounding."""
    v = [F.get(F.col(mu), F.lit(i)) for i in range(n)]
    return F.array(*[F.when((x == 0) | (x == 1), x).otherwise(F.round(x, 9)) for x in (reversed(v) if invert else v)])


def _gap(g: Column) -> Column:
    return F.when(g == 0, EPS).otherwise(g)


def guarded_piecewise(x: Column, centroids: Column) -> Column:
    """As piecewise, but where all centroids coincide the middle level has degree 1 and no other any."""
    middle = F.floor(F.size(centroids) / 2)
    alone = F.transform(centroids, lambda c, i: F.when(i == middle, 1.0).otherwise(0.0))
    return F.when(F.array_min(centroids) == F.array_max(centroids), alone).otherwise(piecewise(x, centroids))


def with_widths(df: DataFrame, centroids: str, out: str) -> DataFrame:
    """df with the band widths of ascending centroids: half the gap to the neighbour at the ends, half the mean of both
    gaps inside; no gap takes the median positive one; and a tiny floor. In steps, on a fitted frame of a few rows."""
    n = F.size(centroids)
    gaps = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.get(centroids, i + 1) - F.get(centroids, i))
    df = df.withColumn("__gaps", gaps).withColumn("__pos", F.array_sort(F.filter("__gaps", lambda g: g > 0)))
    size = F.size("__pos")
    middle = (F.get("__pos", F.floor((size - 1) / 2).cast("int")) + F.get("__pos", F.floor(size / 2).cast("int"))) / 2
    df = df.withColumn("__mid", F.coalesce(middle, F.lit(1.0))).withColumn("__floor", 1e-12 * F.greatest(F.lit(1.0), F.array_max(F.transform(centroids, F.abs))))
    df = df.withColumn("__filled", F.transform("__gaps", lambda g: F.when(g > 0, g).otherwise(F.col("__mid"))))

    def width(c, i):
        left, right = F.get("__filled", i - 1), F.get("__filled", i)
        return F.greatest(F.col("__floor"), F.when(i == 0, right / 2).when(i == n - 1, left / 2).otherwise((left + right) / 4))

    return df.withColumn(out, F.transform(centroids, width)).drop("__gaps", "__pos", "__mid", "__floor", "__filled")


def normalized(df: DataFrame, x: Column, centroids: str, widths: str, shape: str, out: str) -> DataFrame:
    """df with degrees that add up to 1: ``gaussian`` exp(-z^2 / 2), shifted by the largest exponent, or ``bell`` 1 / (1 + z^4)."""
    df = df.withColumn("__z", F.zip_with(centroids, widths, lambda c, w: (x - c) / w))
    if shape == "gaussian":
        df = df.withColumn("__z", F.transform("__z", lambda v: -0.5 * v * v)).withColumn("__z", F.transform("__z", lambda v: F.exp(v - F.array_max("__z"))))
    else:
        df = df.withColumn("__z", F.transform("__z", lambda v: 1 / (1 + F.pow(F.abs(v), F.lit(4.0)))))
    df = df.withColumn("__t", F.aggregate("__z", F.lit(0.0), lambda a, b: a + b))
    return df.withColumn(out, F.transform("__z", lambda v: v / F.col("__t"))).drop("__z", "__t")


def fuzzify(df: DataFrame, centroids: DataFrame, family: str = "piecewise", by: list[str] = [], levels: int = 5) -> DataFrame:
    """df with R_mu, F_mu, M_mu: degrees in score order by a family: piecewise, gaussian, bell or log_gaussian."""
    small_methods(df.sparkSession)
    params, shape = as_row(centroids, by), family.removeprefix("log_")
    for d in DIMS:
        c = F.col(f"{d}_cuts")
        params = params.withColumn(f"{d}_cuts", F.array_sort(F.transform(c, lambda v: F.log1p(F.greatest(v, F.lit(0.0)))) if family == "log_gaussian" else c))
        if shape != "piecewise":
            params = with_widths(params, f"{d}_cuts", f"{d}_widths")
    out = beside(df, params, by)
    for d in DIMS:
        x = F.col(d).cast("double")
        x = F.log1p(F.greatest(x, F.lit(0.0))) if family == "log_gaussian" else x
        if shape == "piecewise":
            out = out.withColumn(f"{d}_mu", compiled_piecewise(x, F.col(f"{d}_cuts"), levels))
        else:
            out = normalized(out, x, f"{d}_cuts", f"{d}_widths", shape, f"{d}_mu")
        out = out.withColumn(f"{d}_mu", rounded_degrees(f"{d}_mu", levels, d == "R"))
    return out.drop(*[f"{d}_{c}" for d in DIMS for c in ("cuts", "widths")])


def fit_tail(scored: DataFrame) -> DataFrame:
    """(dim, anchors, s_tail) of F and M in log coordinates: medians of bands 1 to 4 and the spread of band 5.

    The spread is the quartile range of band 5; without one, the mean excess
    over the fourth anchor. Anchors that don't rise are degenerate and raise.
    """
    rows = long_scored(scored).where(F.col("dim") != "R").select("dim", F.log1p("x").alias("z"), "s")
    quartiles = exact_quantiles(rows, "z", [0.25, 0.5, 0.75], ["dim", "s"])
    return _tail(quartiles, rows.groupBy("dim").agg(F.avg(F.when(F.col("s") == 5, F.col("z"))).alias("top")))


def ranked_tail(ranked: DataFrame, cuts: DataFrame) -> DataFrame:
    """The ``fit_tail`` of rows scored by cuts, from the ``scoring.ranked_dims`` of the same rows."""
    rows = banded(ranked.where("dim <> 'R'"), cuts).withColumn("z", F.log1p("x"))
    top = F.when(F.col("s") == 5, F.col("ties"))
    return _tail(ranked_quantiles(rows, "z", [0.25, 0.5, 0.75], ["dim", "s"]), rows.groupBy("dim").agg((F.sum(top * F.col("z")) / F.sum(top)).alias("top")))


def _tail(quartiles: DataFrame, tops: DataFrame) -> DataFrame:
    of = lambda b, q: F.max(F.when(F.col("s") == b, F.col("quantiles")[q]))
    fitted = quartiles.groupBy("dim").agg(F.array(*[F.round(of(b, 1), 9) for b in range(1, 5)]).alias("anchors"), F.round(of(5, 2) - of(5, 0), 9).alias("iqr"))
    fitted = fitted.join(tops, "dim")
    rises = F.forall(F.sequence(F.lit(0), F.lit(2)), lambda i: F.get("anchors", i + 1) > F.get("anchors", i))
    spread = F.when(F.col("iqr") > 0, F.col("iqr")).otherwise(F.round(F.col("top") - F.get("anchors", F.lit(3)), 9))
    return fitted.select("dim", F.when(rises, F.col("anchors")).otherwise(F.raise_error(F.lit("degenerate training data: anchors don't rise"))).alias("anchors"), spread.alias("s_tail"))


def tail_degrees(x: Column, anchors: Column, s_tail: Column) -> Column:
    """Five degrees: linear in log(1 + x) up to the fourth anchor, then bands 4 and 5 share 1 as s and the excess do."""
    z = F.log1p(x)
    low = compiled_piecewise(F.least(z, F.get(anchors, F.lit(3))), anchors, 4)
    over = F.greatest(F.lit(0.0), z - F.get(anchors, F.lit(3)))
    share = over / (over + s_tail)
    first = [F.get(low, F.lit(i)) for i in range(4)]
    return F.array(*first[:3], F.when(over > 0, 1 - share).otherwise(first[3]), F.when(over > 0, share).otherwise(0.0))


def fuzzify_tail(df: DataFrame, recency: DataFrame, tail: DataFrame) -> DataFrame:
    """df with R_mu piecewise from fitted centroids, F_mu and M_mu with an unsaturated upper tail."""
    small_methods(df.sparkSession)
    params = tail.agg(*[F.max(F.when(F.col("dim") == d, F.struct("anchors", "s_tail"))).alias(f"{d}_tail") for d in ("F", "M")])
    r = as_row(recency).select("R_cuts")
    out = df.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(params))
    out = out.withColumn("R_cuts", F.array_sort("R_cuts"))
    out = out.withColumn("R_mu", compiled_piecewise(F.col("R").cast("double"), F.col("R_cuts"), 5))
    for d in ("F", "M"):
        out = out.withColumn(f"{d}_mu", tail_degrees(F.col(d).cast("double"), F.col(f"{d}_tail.anchors"), F.col(f"{d}_tail.s_tail")))
    out = out.drop("R_cuts", "F_tail", "M_tail")
    return out.withColumns({f"{d}_mu": rounded_degrees(f"{d}_mu", invert=d == "R") for d in DIMS})


def check_values(df: DataFrame) -> DataFrame:
    """df, raising where R, F or M isn't a finite number of 0 or more."""
    for d in DIMS:
        x = F.col(d).cast("double")
        bad = x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf"))
        df = df.withColumn(d, F.when(bad, F.raise_error(F.lit(f"{d} must be finite and not negative"))).otherwise(F.col(d)))
    return df


def tail_uniqueness(fuzzy: DataFrame, cuts: DataFrame) -> DataFrame:
    """(dim, n_tail, total_pairs, tied_raw_pairs, d_mem): among customers at or above the top cutpoint, pairs of
    different raw values that degrees tell apart, over all such pairs; counted by groups, never by pairs."""
    top = as_row(cuts)
    parts = []
    for d in ("F", "M"):
        tail = fuzzy.crossJoin(F.broadcast(top)).where(F.col(d) >= F.element_at(f"{d}_cuts", -1)).select(F.lit(d).alias("dim"), F.col(d).cast("double").alias("x"), F.col(f"{d}_mu").alias("mu"))
        parts.append(tail)
    rows = parts[0].union(parts[1])
    n = rows.groupBy("dim", "x", "mu").agg(F.count("*").alias("n"))
    pairs = lambda c: c * (c - 1) / 2
    raw = n.groupBy("dim", "x").agg(F.sum("n").alias("n")).groupBy("dim").agg(F.sum("n").alias("n_tail"), F.sum(pairs(F.col("n"))).alias("tied_raw"))
    same = n.groupBy("dim", "mu").agg(F.sum("n").alias("n")).groupBy("dim").agg(F.sum(pairs(F.col("n"))).alias("tied_mu"))
    total = pairs(F.col("n_tail"))
    return raw.join(same, "dim").select(
        "dim", F.col("n_tail"), total.cast("long").alias("total_pairs"), F.col("tied_raw").cast("long").alias("tied_raw_pairs"),
        F.coalesce((total - F.col("tied_mu")) / F.nullif(total - F.col("tied_raw"), F.lit(0.0)), F.lit(1.0)).alias("d_mem"),
    )


def membership_spread(fuzzy: DataFrame) -> DataFrame:
    """(dim, entropy, overlap): mean entropy of degrees over ln of their number, and mean 1 / sum of squares, of shares."""
    rows = fuzzy.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(f"{d}_mu").alias("mu")) for d in DIMS])).alias("p")).select("p.*")
    total = F.aggregate("mu", F.lit(0.0), lambda a, b: a + b)
    share = F.transform("mu", lambda v: v / total)
    h = F.aggregate(share, F.lit(0.0), lambda a, p: a + F.when(p > 0, -p * F.ln(p)).otherwise(0.0)) / F.ln(F.size("mu").cast("double"))
    spread = 1 / F.aggregate(share, F.lit(0.0), lambda a, p: a + p * p)
    return rows.select("dim", h.alias("h"), spread.alias("o")).groupBy("dim").agg(F.avg("h").alias("entropy"), F.avg("o").alias("overlap"))

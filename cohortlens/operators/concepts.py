"""Formal contexts as bit masks of customers, and the closed concepts in them.

A crisp customer is a mask of 15 bits, one a band; a fuzzy one has 45, three
thresholds a band. A concept's intent is the bitwise and of its extent's
masks, so mining is grouping, whatever the number of customers.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.ranks import checkpointed

from .scoring import DIMS, beside

THRESHOLDS = (0.3, 0.5, 0.7)
MIN_SUPPORT = 0.04


def crisp_mask(prefix: str = "") -> Column:
    """Bit 5 * dim + band - 1 for each score."""
    out = F.lit(0).cast("long")
    for i, d in enumerate(DIMS):
        out = out + F.call_function("shiftleft", F.lit(1).cast("long"), F.col(f"{prefix}{d}_score") - 1 + 5 * i)
    return out


def fuzzy_mask(thresholds=THRESHOLDS) -> Column:
    """Bit (5 * dim + band - 1) * thresholds + t where a degree reaches threshold t."""
    out = F.lit(0).cast("long")
    for i, d in enumerate(DIMS):
        for b in range(5):
            for t, least in enumerate(thresholds):
                out = out + F.when(F.get(f"{d}_mu", F.lit(b)) >= least, F.lit(1 << ((5 * i + b) * len(thresholds) + t))).otherwise(F.lit(0)).cast("long")
    return out


def crisp_concepts(scored: DataFrame, min_support: float = MIN_SUPPORT, by: list[str] = []) -> DataFrame:
    """(by..., intent_mask, n_customers, support): closed band sets with support, and the root where it is closed.

    A set of bands holds one band a dimension at most, so the grouping sets of
    the three scores have every extent; its masks' bitwise and is the closure.
    """
    scores = [f"{d}_score" for d in DIMS]
    # customers are counted by their scores first; the sets are made of these few rows
    counted = checkpointed(scored.groupBy(*by, *scores).agg(F.count("*").alias("n")))
    masked = counted.select(*by, *scores, "n", crisp_mask().alias("mask"))
    sets = [[*by, *kept] for n in range(4) for kept in combinations(scores, n)]
    cube = masked.groupingSets(sets, *by, *scores).agg(F.sum("n").alias("n_customers"), F.bit_and("mask").alias("intent_mask"), F.grouping_id().alias("g"))
    total = F.broadcast(masked.groupBy(*by).agg(F.sum("n").alias("total")))
    kept = (cube.join(total, by) if by else cube.crossJoin(total)).where((F.col("n_customers") >= min_support * F.col("total")) | (F.col("g") == 7))
    return kept.groupBy(*by, "intent_mask").agg(F.max("n_customers").alias("n_customers"), F.max(F.col("n_customers") / F.col("total")).alias("support"))


def profiles(fuzzy: DataFrame, thresholds=THRESHOLDS, by: list[str] = []) -> DataFrame:
    """(by..., mask, triple, n): customers by mask and score triple. All further mining works on these few rows."""
    triple = sum(F.col(f"{d}_score") * 10**i for i, d in enumerate(DIMS))
    return fuzzy.select(*by, fuzzy_mask(thresholds).alias("mask"), triple.alias("triple")).groupBy(*by, "mask", "triple").agg(F.count("*").alias("n"))


def _patterns(masks: DataFrame, shift: int, width: int) -> DataFrame:
    """Distinct patterns of one dimension, their intersections, and the empty one: as many as bands and thresholds allow."""
    part = F.shiftright("mask", shift).bitwiseAND(F.lit((1 << width) - 1))
    found = masks.select(part.alias("p")).distinct()
    for _ in range(2):
        found = checkpointed(found.alias("a").join(found.alias("b"), F.col("a.p") <= F.col("b.p")).select(F.col("a.p").bitwiseAND(F.col("b.p")).alias("p")).distinct())
    return found.union(found.sparkSession.range(1).select(F.lit(0).cast("long").alias("p"))).distinct()


def fuzzy_concepts(fuzzy: DataFrame, min_support: float = MIN_SUPPORT, thresholds=THRESHOLDS, by: list[str] = []) -> DataFrame:
    """(by..., intent_mask, n_customers, support, stability_proxy): closed attribute sets with support, without the empty one.

    Any extent is given by the patterns a dimension's attributes can have in
    common. Each profile meets the patterns it holds, dimension by dimension;
    each combination is grouped, and the closure is the bitwise and of the masks.
    The proxy is 1 less the distinct score triples over the customers, 1 for a single customer.
    Groups share the patterns: one that a group lacks gives it an extent as well, closed like any other.
    """
    width = 5 * len(thresholds)
    rows = checkpointed(profiles(fuzzy, thresholds, by))
    total = rows.groupBy(*by).agg(F.sum("n").alias("total"))
    met = rows
    for i in range(3):
        p = _patterns(rows, i * width, width).select(F.shiftleft("p", i * width).alias(f"p{i}"))
        met = met.join(F.broadcast(p), F.col("mask").bitwiseAND(F.col(f"p{i}")) == F.col(f"p{i}"))
    key = F.col("p0").bitwiseOR(F.col("p1")).bitwiseOR(F.col("p2"))
    found = met.groupBy(*by, key.alias("key")).agg(F.sum("n").alias("n_customers"), F.bit_and("mask").alias("intent_mask"), F.countDistinct("triple").alias("triples"))
    kept = beside(found, total, by).where((F.col("n_customers") >= min_support * F.col("total")) & (F.col("intent_mask") != 0))
    proxy = F.when(F.col("n_customers") <= 1, 1.0).otherwise(1 - F.col("triples") / F.col("n_customers"))
    return kept.groupBy(*by, "intent_mask").agg(F.max("n_customers").alias("n_customers"), F.max(F.col("n_customers") / F.col("total")).alias("support"), F.max(proxy).alias("stability_proxy"))


def base_bands(mask: Column, thresholds: int = 3) -> Column:
    """The 15-bit band set of a 45-bit intent: a band is in it at whatever threshold."""
    out = F.lit(0).cast("long")
    for band in range(15):
        inside = mask.bitwiseAND(F.lit(((1 << thresholds) - 1) << (band * thresholds))) != 0
        out = out + F.when(inside, F.lit(1 << band)).otherwise(F.lit(0)).cast("long")
    return out


def intent_text(mask: Column, thresholds=THRESHOLDS) -> Column:
    """An intent in words: ``R5@0.3 & F1@0.5``; without thresholds ``R5 & F1``; ``(universal root)`` if empty."""
    parts = []
    for i, d in enumerate(DIMS):
        for b in range(5):
            for t, least in enumerate(thresholds or (None,)):
                bit = (5 * i + b) * len(thresholds or (None,)) + t
                parts.append(F.when(mask.bitwiseAND(F.lit(1 << bit)) != 0, F.lit(f"{d}{b + 1}" + (f"@{least:.1f}" if least is not None else ""))))
    text = F.array_join(F.array_compact(F.array(*parts)), " & ")
    return F.when(mask == 0, "(universal root)").otherwise(text)


def knee_flags(concepts: DataFrame, columns=("support", "stability_proxy")) -> DataFrame:
    """concepts with ``is_knee``: at or above the knee threshold of every column.

    Values in descending order are a curve; its knee is where the curve,
    scaled to the unit square, lies furthest below the chord; fewer than three
    values have the last as knee. Works on the concepts, a bounded number by support.
    """
    out = concepts
    flags = F.lit(True)
    for c in columns:
        order = Window.orderBy(F.desc(c), "intent_mask")
        curve = concepts.select(F.col(c).alias("y"), (F.row_number().over(order) - 1).cast("double").alias("i"))
        ends = curve.agg(F.max("i").alias("last"), F.max("y").alias("hi"), F.min("y").alias("lo"))
        x, y = F.col("i") / F.nullif(F.col("last"), F.lit(0.0)), (F.col("y") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
        far = F.round(1 - F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)), 9)
        knee = curve.crossJoin(F.broadcast(ends)).agg(
            F.when(F.max("last") < 2, F.min("y")).otherwise(F.max_by("y", F.struct(far, -F.col("i")))).alias(f"__{c}")
        )
        out = out.crossJoin(F.broadcast(knee))
        flags = flags & (F.col(c) >= F.col(f"__{c}"))
    return out.withColumn("is_knee", flags).drop(*[f"__{c}" for c in columns])


def distinct_profiles(concepts: DataFrame, by: list[str] = []) -> DataFrame:
    """The first concept of each band set, by support, then fewer attributes, then mask."""
    size = F.bit_count("intent_mask")
    order = Window.partitionBy(*by, base_bands(F.col("intent_mask"))).orderBy(F.desc("n_customers"), size, "intent_mask")
    return concepts.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r").withColumn("band_mask", base_bands(F.col("intent_mask")))


def verify_closures(concepts: DataFrame, rows: DataFrame) -> DataFrame:
    """(intent_mask, extent, closed): customers of profiles that hold the intent, and whether their masks' and is the intent."""
    met = rows.join(F.broadcast(concepts.select("intent_mask")), F.col("mask").bitwiseAND(F.col("intent_mask")) == F.col("intent_mask"))
    return met.groupBy("intent_mask").agg(F.sum("n").alias("extent"), (F.bit_and("mask") == F.first("intent_mask")).alias("closed"))


def reconcile(concepts: DataFrame, published: DataFrame) -> DataFrame:
    """published (intent, n_published) with the mined count and whether it is the same."""
    mined = concepts.select("intent", "n_customers")
    return published.join(mined, "intent", "left").withColumn("exact", F.coalesce(F.col("n_customers") == F.col("n_published"), F.lit(False)))

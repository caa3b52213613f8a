"""Clusterings of customers and the indices that judge them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scoring import DIMS


def min_max_log(df: DataFrame) -> DataFrame:
    """(customer_id, x): log1p of R, F, M scaled to [0, 1]; a constant has 0."""
    ends = df.agg(*[F.min(F.log1p(F.col(d).cast("double"))).alias(f"{d}_lo") for d in DIMS], *[F.max(F.log1p(F.col(d).cast("double"))).alias(f"{d}_hi") for d in DIMS])
    scaled = [F.coalesce(F.try_divide(F.log1p(F.col(d).cast("double")) - F.col(f"{d}_lo"), F.col(f"{d}_hi") - F.col(f"{d}_lo")), F.lit(0.0)) for d in DIMS]
    return df.crossJoin(F.broadcast(ends)).select("customer_id", F.array(*scaled).alias("x"))


def squared_distance(a, b):
    return F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)


def k_means(points: DataFrame, k: int, seed: int = 0, starts: int = 10) -> DataFrame:
    """(customer_id, x, label): the best of several k-means runs by within-cluster cost."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = points.withColumn("v", array_to_vector("x")).cache()
    best = min((KMeans(k=k, featuresCol="v", seed=seed + i, maxIter=50).fit(data) for i in range(starts)), key=lambda m: m.summary.trainingCost)
    return best.transform(data).select("customer_id", "x", F.col("prediction").alias("label"))


def _ward_tree(x: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """Labels of weighted points after merging to k clusters, each time the pair of least added variance.

    Merges are found by a chain of nearest neighbours over centres and weights,
    in memory of the number of points, and then done in the order of their variance.
    """
    n = len(x)
    centre, size, node = x.astype(float).copy(), w.astype(float).copy(), np.arange(n)
    chain: list[int] = []
    merges: list[tuple[float, int, int]] = []
    left = n
    while left > 1:
        if 2 * left < len(size) and len(size) > 64:
            kept = np.flatnonzero(size)
            place = np.cumsum(size > 0) - 1
            centre, size, node, chain = centre[kept], size[kept], node[kept], [int(place[c]) for c in chain]
        if not chain:
            chain = [int(np.flatnonzero(size)[0])]
        a = chain[-1]
        gap = centre - centre[a]
        d = np.einsum("ij,ij->i", gap, gap) * (size[a] * size / (size[a] + size))
        d[size == 0] = np.inf
        d[a] = np.inf
        b = int(d.argmin())
        if len(chain) > 1 and d[chain[-2]] <= d[b]:
            b = chain[-2]
            del chain[-2:]
            merges.append((float(d[b]), int(node[a]), int(node[b])))
            a, b = min(a, b), max(a, b)
            centre[a] = (centre[a] * size[a] + centre[b] * size[b]) / (size[a] + size[b])
            size[a] += size[b]
            size[b] = 0
            node[a] = min(node[a], node[b])
            left -= 1
        else:
            chain.append(b)
    return _cut(merges, n, k)


def _cut(merges: list[tuple[float, int, int]], n: int, k: int) -> np.ndarray:
    """Labels of n points after the merges of least variance that leave k clusters."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for _, a, b in sorted(merges, key=lambda m: m[0])[: max(0, n - k)]:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]


#: Points of a block of the search for nearest clusters, and clusters beyond which blocks are searched by Spark's tasks.
BLOCK, ON_DRIVER = 256, 20_000


def _blocks(centre: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Clusters of like size (by powers of two) and place, ascending indices of up to ``BLOCK`` each."""
    kind = np.floor(np.log2(size))
    waiting, out = [np.flatnonzero(kind == v) for v in np.unique(kind)], []
    while waiting:
        at = waiting.pop()
        if len(at) <= BLOCK:
            out.append(np.sort(at))
            continue
        own = centre[at]
        order = np.argpartition(own[:, np.ptp(own, axis=0).argmax()], len(at) // 2)
        waiting += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return out


def _nearest(centre: np.ndarray, size: np.ndarray, blocks: list[np.ndarray], asked: list[tuple[int, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(clusters, nearest, added variance) of the asked (block, clusters of it): exact, ties to the smaller index.

    Blocks are met in the order of a lower bound, from their boxes and least sizes, until it exceeds what every asked cluster has found.
    """
    low, high = np.stack([centre[b].min(axis=0) for b in blocks]), np.stack([centre[b].max(axis=0) for b in blocks])
    least, out = np.array([size[b].min() for b in blocks]), []
    for of, q in asked:
        x, w = centre[q], size[q]
        apart = np.maximum(0, np.maximum(low - x.max(axis=0), x.min(axis=0) - high))
        bound = (apart**2).sum(axis=1) * (w.min() * least / (w.min() + least)) * (1 - 1e-12)
        found, best = np.full(len(q), len(centre)), np.full(len(q), np.inf)
        for b in np.argsort(bound, kind="stable"):
            if bound[b] > best.max():
                break
            far = np.maximum(0, np.maximum(low[b] - x, x - high[b]))
            rows = np.flatnonzero((far**2).sum(axis=1) * (w * least[b] / (w + least[b])) * (1 - 1e-12) <= best)
            if not len(rows):
                continue
            other = blocks[b]
            d = sum((x[rows, None, i] - centre[None, other, i]) ** 2 for i in range(x.shape[1]))
            d *= w[rows, None] * size[None, other] / (w[rows, None] + size[None, other])
            d[q[rows, None] == other] = np.inf
            at = d.argmin(axis=1)
            value, index = d[np.arange(len(rows)), at], other[at]
            better = (value < best[rows]) | ((value == best[rows]) & (index < found[rows]))
            best[rows[better]], found[rows[better]] = value[better], index[better]
        out.append((q, found, best))
    return out


def _ward_rounds(spark, x: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """What ``_ward_tree`` gives, for many points: in a round all pairs that are each other's nearest merge.

    Ward's distance is reducible, so such merges are those of the hierarchy in
    whatever order they are made, and a cluster's nearest stays so until it merges. Tasks search for
    nearest clusters by blocks; the driver holds centres and sizes.
    """
    n = len(x)
    centre, size, node = x.astype(float).copy(), w.astype(float).copy(), np.arange(n)
    nearest, gap = np.full(n, -1), np.full(n, np.inf)
    merges: list[tuple[float, int, int]] = []
    while len(centre) > 1:
        blocks = _blocks(centre, size)
        asked = [(i, q) for i, b in enumerate(blocks) if len(q := b[nearest[b] < 0])]
        if sum(len(q) for _, q in asked) > ON_DRIVER:
            sc = spark.sparkContext
            sent, tasks = sc.broadcast((centre, size, blocks, asked)), 4 * sc.defaultParallelism
            search = lambda t, sent=sent, tasks=tasks: _nearest(*sent.value[:3], sent.value[3][t::tasks])
            results = sc.parallelize(range(tasks), tasks).flatMap(search).collect()
            sent.destroy()
        else:
            results = _nearest(centre, size, blocks, asked)
        for q, found, best in results:
            nearest[q], gap[q] = found, best
        a = np.flatnonzero((nearest[nearest] == np.arange(len(centre))) & (np.arange(len(centre)) < nearest))
        if not len(a):
            raise ValueError("points must be finite")
        b = nearest[a]
        merges += zip(gap[a].tolist(), node[a].tolist(), node[b].tolist())
        centre[a] = (centre[a] * size[a, None] + centre[b] * size[b, None]) / (size[a] + size[b])[:, None]
        size[a] += size[b]
        node[a] = np.minimum(node[a], node[b])
        gone, changed = np.zeros(len(centre), bool), np.zeros(len(centre), bool)
        gone[b] = changed[a] = changed[b] = True
        nearest[changed | changed[nearest]] = -1
        place = np.cumsum(~gone) - 1
        nearest = np.where(nearest >= 0, place[nearest], -1)[~gone]
        centre, size, node, gap = centre[~gone], size[~gone], node[~gone], gap[~gone]
    return _cut(merges, n, k)


#: Distinct points up to which one chain of nearest neighbours is as quick.
CHAINED = 5_000


def ward(points: DataFrame, k: int, most: int | None = None) -> DataFrame:
    """(customer_id, x, label) by Ward's method over the distinct points, which the driver holds once; beyond ``CHAINED``
    of them nearest clusters are searched in Spark's tasks. Only if a caller gives ``most`` and there are more, over the weighted centres of ``most`` k-means clusters."""
    if most is None or points.select("x").distinct().count() <= most:
        keyed = points.withColumn("key", F.to_json(F.struct("x")))
        centres = keyed.groupBy("key").agg(F.first("x").alias("c"), F.count("*").alias("w"))
    else:
        small = k_means(points, most, starts=1).withColumn("key", F.col("label").cast("string"))
        centres = small.groupBy("key").agg(F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(3)]).alias("c"), F.count("*").alias("w"))
        keyed = small.drop("label")
    rows = centres.orderBy("key").toPandas()
    x, w = np.array(rows["c"].tolist(), float).reshape(len(rows), -1), rows["w"].to_numpy()
    labels = _ward_tree(x, w, k) if len(rows) <= CHAINED else _ward_rounds(points.sparkSession, x, w, k)
    table = points.sparkSession.createDataFrame(pd.DataFrame({"key": rows["key"], "label": labels.astype(np.int32)}), "key string, label int")
    return keyed.join(table, "key").select("customer_id", "x", "label")


def fcm_degrees(points: DataFrame, centres: list[list[float]], m: float = 2.0) -> DataFrame:
    """(customer_id, x, u): degrees in each centre; a point on a centre belongs to the first such one alone."""
    table = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres])
    d = F.transform(table, lambda c: F.sqrt(squared_distance(F.col("x"), c)))
    out = points.withColumn("__d", d).withColumn("__on", F.array_position(F.transform("__d", lambda v: v < 1e-12), F.lit(True)))
    out = out.withColumn("__p", F.transform("__d", lambda v: F.when(F.col("__on") > 0, 0.0).otherwise(F.pow(F.greatest(v, F.lit(1e-300)), F.lit(-2.0 / (m - 1))))))
    out = out.withColumn("__t", F.aggregate("__p", F.lit(0.0), lambda a, v: a + v))
    u = F.when(F.col("__on") > 0, F.transform("__d", lambda v, i: F.when(i + 1 == F.col("__on"), 1.0).otherwise(0.0))).otherwise(F.transform("__p", lambda v: v / F.col("__t")))
    return out.select("customer_id", "x", u.alias("u"))


def fuzzy_c_means(points: DataFrame, k: int, m: float = 2.0, tolerance: float = 1e-7, rounds: int = 100, seed: int = 0) -> tuple[DataFrame, list[list[float]]]:
    """Degrees and centres: from k-means++ centres, centres and degrees in turn until the centres move less than the tolerance.

    A round is one aggregation over the points; only k centres reach the driver.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    size = len(points.select("x").first().x)
    start = KMeans(k=k, featuresCol="v", seed=seed, maxIter=1).fit(points.select(array_to_vector("x").alias("v")))
    centres = sorted([float(v) for v in c] for c in start.clusterCenters())
    for _ in range(rounds):
        weight = lambda j: F.pow(F.get("u", F.lit(j)), F.lit(m))
        sums = fcm_degrees(points, centres, m).agg(
            *[F.sum(weight(j)).alias(f"w{j}") for j in range(k)], *[F.sum(weight(j) * F.get("x", F.lit(i))).alias(f"s{j}_{i}") for j in range(k) for i in range(size)]
        ).first()
        new = [[sums[f"s{j}_{i}"] / sums[f"w{j}"] for i in range(size)] for j in range(k)]
        moved = max(abs(a - b) for p, q in zip(new, centres, strict=True) for a, b in zip(p, q, strict=True))
        centres = new
        if moved < tolerance:
            break
    return fcm_degrees(points, centres, m), centres


def fuzzy_indices(degrees: DataFrame, centres: list[list[float]], m: float = 2.0) -> DataFrame:
    """One row: partition coefficient (mean sum of squared degrees) and Xie-Beni (scatter over n times the least squared gap of centres)."""
    table = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres])
    squares = F.aggregate("u", F.lit(0.0), lambda a, v: a + v * v)
    scatter = F.aggregate(F.zip_with("u", table, lambda u, c: F.pow(u, F.lit(m)) * squared_distance(F.col("x"), c)), F.lit(0.0), lambda a, v: a + v)
    gap = min(sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for i, p in enumerate(centres) for q in centres[:i])
    return degrees.agg(F.avg(squares).alias("fpc"), (F.sum(scatter) / (F.count("*") * gap)).alias("xie_beni"))


def silhouette(labelled: DataFrame, sample: int = 2000) -> DataFrame:
    """One row: the mean silhouette of ``sample`` customers at most, those of least id hash; Euclidean, a cluster of one counts 0.

    Sampling is the operator; each of the sample meets the whole sample, which is broadcast.
    """
    few = labelled.orderBy(F.md5(F.col("customer_id").cast("binary")), "customer_id").limit(sample)
    other = few.select(F.col("customer_id").alias("id2"), F.col("x").alias("x2"), F.col("label").alias("label2"))
    far = few.crossJoin(F.broadcast(other)).where("customer_id <> id2")
    mean = far.groupBy("customer_id", "label", "label2").agg(F.avg(F.sqrt(squared_distance(F.col("x"), F.col("x2")))).alias("d"))
    per = mean.groupBy("customer_id").agg(F.min(F.when(F.col("label") == F.col("label2"), F.col("d"))).alias("a"), F.min(F.when(F.col("label") != F.col("label2"), F.col("d"))).alias("b"))
    return per.agg(F.avg(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("silhouette"))


def davies_bouldin(labelled: DataFrame, size: int = 3) -> DataFrame:
    """One row: mean over clusters of the worst (scatter + scatter) / distance of centres."""
    centres = labelled.groupBy("label").agg(F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(size)]).alias("c"))
    s = labelled.join(F.broadcast(centres), "label").groupBy("label", "c").agg(F.avg(F.sqrt(squared_distance(F.col("x"), F.col("c")))).alias("s"))
    o = s.select(F.col("label").alias("l2"), F.col("c").alias("c2"), F.col("s").alias("s2"))
    ratio = (F.col("s") + F.col("s2")) / F.sqrt(squared_distance(F.col("c"), F.col("c2")))
    return s.join(F.broadcast(o), F.col("label") != F.col("l2")).groupBy("label").agg(F.max(ratio).alias("r")).agg(F.avg("r").alias("davies_bouldin"))

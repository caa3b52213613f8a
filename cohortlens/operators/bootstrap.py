"""Bootstrap of model metrics: every row works out its own weights of all draws, and statistics are vectors over draws."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.ranks import checkpointed

from .inference import holm, interval, number_customers

#: Customers of one leaf of the tree.
LEAF = 256
AMOUNTS = {"spend_r2": ("t_spend", "spend"), "invoice_r2": ("t_invoices", "invoices")}


class WeightTree:
    """Multinomial weights: each draw has as many balls as there are customers, each falling on any of them alike.

    A node of the binary tree over customer places deals its balls to its
    halves by binomial numbers seeded with the node; a leaf throws its own on
    its customers. So the weights of any leaf follow from the leaf's number
    alone, by as many steps as the tree is deep, wherever they are asked for.
    """

    def __init__(self, n: int, draws: int, seed: int):
        self.n, self.draws, self.seed = n, draws, seed
        self.leaves = -(-n // LEAF)

    def _random(self, low: int, high: int) -> np.random.Generator:
        return np.random.Generator(np.random.Philox(np.random.SeedSequence([self.seed, low, high])))

    def _size(self, low: int, high: int) -> int:
        return min(high * LEAF, self.n) - low * LEAF

    def balls(self, leaf: int) -> np.ndarray:
        low, high, balls = 0, self.leaves, np.full(self.draws, self.n, np.int64)
        while high - low > 1:
            middle = (low + high) // 2
            left = self._random(low, high).binomial(balls, self._size(low, middle) / self._size(low, high))
            if leaf < middle:
                high, balls = middle, left
            else:
                low, balls = middle, balls - left
        return balls

    def weights(self, leaf: int) -> np.ndarray:
        """(customer of the leaf, draw)."""
        balls, size = self.balls(leaf), self._size(leaf, leaf + 1)
        at = self._random(leaf, leaf).integers(0, size, int(balls.sum()))
        draw = np.repeat(np.arange(self.draws), balls)
        return np.bincount(at * self.draws + draw, minlength=size * self.draws).reshape(size, self.draws)


def _by_leaf(df: DataFrame, draws: int, seed: int) -> tuple[DataFrame, WeightTree]:
    """df's rows with their customers' places, dealt out by leaf."""
    places = checkpointed(number_customers(df))
    tree = WeightTree(places.count(), draws, seed)
    rows = df.join(places, "customer_id").withColumn("leaf", F.expr(f"place div {LEAF}"))
    return rows.repartition("leaf").sortWithinPartitions("leaf"), tree


def _with_weights(frames, tree: WeightTree) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """The rows of each leaf with their weights; a leaf's matrix is made once, as its rows come together."""
    now, matrix = None, None
    for frame in frames:
        for leaf, own in frame.groupby("leaf", sort=False):
            if leaf != now:
                now, matrix = leaf, tree.weights(int(leaf))
            yield own, matrix[own["place"].to_numpy() - int(leaf) * LEAF]


def r2_draws(predicted: DataFrame, draws: int, seed: int, by: list[str]) -> DataFrame:
    """(by..., b, spend_r2, invoice_r2) of every draw from the customers of predicted (by..., customer_id, amounts and their predictions): one pass of sums a draw."""
    rows, tree = _by_leaf(predicted.select(*by, "customer_id", *[c for pair in AMOUNTS.values() for c in pair]), draws, seed)
    names = [f"{m}_{s}" for m in AMOUNTS for s in ("t", "tt", "ee")]

    def add(frames):
        sums: dict[tuple, np.ndarray] = {}
        for own, w in _with_weights(frames, tree):
            for key, part in own.assign(row=np.arange(len(own))).groupby(by):
                parts = [np.ones(len(part))]
                for y, f in AMOUNTS.values():
                    t, e = part[y].to_numpy(float), part[y].to_numpy(float) - part[f].to_numpy(float)
                    parts += [t, t * t, e * e]
                sums[key] = sums.get(key, 0) + np.stack(parts) @ w[part["row"].to_numpy()]
        for key, total in sums.items():
            yield pd.DataFrame({**dict(zip(by, key, strict=True)), "b": np.arange(tree.draws), "w": total[0], **dict(zip(names, total[1:], strict=True))})

    schema = _schema(predicted, by) + "b int, w double, " + ", ".join(f"{n} double" for n in names)
    total = rows.mapInPandas(add, schema).groupBy(*by, "b").agg(*[F.sum(c).alias(c) for c in ("w", *names)])
    r2 = {m: 1 - F.try_divide(F.col(f"{m}_ee"), F.col(f"{m}_tt") - F.col(f"{m}_t") * F.col(f"{m}_t") / F.col("w")) for m in AMOUNTS}
    return total.select(*by, "b", *[c.alias(m) for m, c in r2.items()])


#: Rows of a group, about, in one range of its scores; rows that are added up at once; draws of one final task.
RANGE_ROWS, CHUNK, DRAWS = 8192, 512, 256


def packed_weights(w: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Weights (row, draw) in two bits each, and what those from three on have above it, row by row."""
    codes = np.zeros((len(w), -(-w.shape[1] // 4) * 4), np.uint8)
    codes[:, : w.shape[1]] = np.minimum(w, 3)
    rows, cols = np.nonzero(w >= 3)
    above = w[rows, cols] - 3
    above = above.astype(np.uint8 if above.max(initial=0) < 255 else np.uint32)
    ends = np.cumsum(np.bincount(rows, minlength=len(w)))[:-1]
    return codes[:, ::4] | codes[:, 1::4] << 2 | codes[:, 2::4] << 4 | codes[:, 3::4] << 6, [x.tobytes() for x in np.split(above, ends)]


def unpacked_weights(codes: list[bytes], above: list[bytes], draws: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    w = np.empty((len(codes), packed.shape[1] * 4))
    for j in range(4):
        w[:, j::4] = packed >> (2 * j) & 3
    high = w == 3
    each = high.sum(axis=1)
    w[high] += np.concatenate([np.frombuffer(x, np.uint8 if len(x) == n else np.uint32) for x, n in zip(above, each.tolist(), strict=True)])
    return w[:, :draws]


def auc_draws(predicted: DataFrame, draws: int, seed: int, by: list[str]) -> DataFrame:
    """(by..., b, auc) of every draw from the customers of predicted (by..., customer_id, repurchased, prob).

    A group's scores are cut into ranges at quantiles; the same range of all groups is one task's, as scores of one customer
    lie near each other in most. A customer's weights go to a task once, whatever number of its rows do, in two bits a draw and some.
    A score that fills ranges of its own is dealt over their tasks: its pairs are ties. What a range holds of a draw, positives, negatives
    and their pairs in order, are whole or half numbers, so sums are exact and any cut gives the same.
    """
    scored = predicted.select(*by, "customer_id", F.col("repurchased").cast("int").alias("y"), F.col("prob").cast("double").alias("s"))
    rows, tree = _by_leaf(scored, draws, seed)
    ranges = max(1, -(-tree.n // RANGE_ROWS))
    ends = F.percentile_approx("s", [i / ranges for i in range(1, ranges)], 10_000) if ranges > 1 else F.array().cast("array<double>")
    found = scored.groupBy(*by).agg(ends.alias("ends")).orderBy(*by).collect()
    keys = [tuple(r[c] for c in by) for r in found]
    cuts = {key: (g, np.array(r.ends or [], float)) for g, (key, r) in enumerate(zip(keys, found, strict=True))}

    def attach(frames):
        for own, w in _with_weights(frames, tree):
            g, low, high = np.zeros(len(own), np.int16), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            s, y, place = own["s"].to_numpy(float), own["y"].to_numpy(), own["place"].to_numpy()
            for key, at in own.groupby(by).indices.items():
                g[at], end = cuts[key if isinstance(key, tuple) else (key,)]
                low[at], high[at] = np.searchsorted(end, s[at], "left"), np.searchsorted(end, s[at], "right")
            lone = high - low >= 2
            unit = (2 * low + lone).astype(np.int32)
            task = np.where(lone, low + (place * 2654435761 >> 7) % (high - low + 1), low)
            order = np.lexsort((place, task))
            first = np.flatnonzero(np.r_[True, (task[order][1:] != task[order][:-1]) | (place[order][1:] != place[order][:-1])])
            codes, above = packed_weights(w[order[first]])
            parts = [[x.tobytes() for x in np.split(v[order], first[1:])] for v in (g, unit, (y == 1), s)]
            yield pd.DataFrame({"task": task[order[first]].astype(np.int32), "codes": [x.tobytes() for x in codes], "above": above, **dict(zip(("g", "unit", "y", "s"), parts, strict=True))})

    dealt = rows.mapInPandas(attach, "task int, codes binary, above binary, g binary, unit binary, y binary, s binary")

    def told(parts):
        frame = pd.concat(parts)
        kinds = {"g": np.int16, "unit": np.int32, "y": bool, "s": float}
        g, unit, y, s = (np.frombuffer(b"".join(frame[c]), kind) for c, kind in kinds.items())
        owner = np.repeat(np.arange(len(frame)), [len(x) for x in frame["y"]])
        codes, above = frame["codes"].to_numpy(), frame["above"].to_numpy()
        order = np.lexsort((s, unit, g))
        starts = np.flatnonzero(np.r_[True, (g[order][1:] != g[order][:-1]) | (unit[order][1:] != unit[order][:-1])])
        for at in np.split(order, starts[1:]):
            p, n, area = _range_sums(s[at], y[at], lambda k, at=at: unpacked_weights(codes[owner[at[k]]].tolist(), above[owner[at[k]]].tolist(), draws), draws)
            for b in range(0, draws, DRAWS):
                yield int(g[at[0]]), int(unit[at[0]]), b, *(v[b : b + DRAWS].tobytes() for v in (p, n, area))

    def add(frames):
        now, waiting = None, []
        for frame in frames:
            for task, own in frame.groupby("task", sort=False):
                if task != now and waiting:
                    yield pd.DataFrame(told(waiting), columns=["g", "unit", "b", "p", "n", "area"])
                    waiting = []
                now = task
                waiting.append(own)
        if waiting:
            yield pd.DataFrame(told(waiting), columns=["g", "unit", "b", "p", "n", "area"])

    tasks = dealt.repartition("task").sortWithinPartitions("task")
    sums = tasks.mapInPandas(add, "g int, unit int, b int, p binary, n binary, area binary")

    def whole(own: pd.DataFrame) -> pd.DataFrame:
        width, below = len(own["p"].iloc[0]) // 8, 0.0
        p_all, n_all, area_all = (np.zeros(width) for _ in range(3))
        for unit, part in own.groupby("unit"):
            p, n, area = (sum(np.frombuffer(x) for x in part[c]) for c in ("p", "n", "area"))
            area_all += (p * n / 2 if unit % 2 else area) + p * below
            below = below + n
            p_all, n_all = p_all + p, n_all + n
        pairs = p_all * n_all
        auc = pd.Series(np.divide(area_all, pairs, out=np.zeros(width), where=pairs > 0), dtype="Float64").mask(pairs == 0)
        key = keys[int(own["g"].iloc[0])]
        return pd.DataFrame({**{c: [v] * width for c, v in zip(by, key, strict=True)}, "b": own["b"].iloc[0] + np.arange(width), "auc": auc})

    return sums.groupBy("g", "b").applyInPandas(whole, _schema(predicted, by) + "b int, auc double")


def _range_sums(s: np.ndarray, y: np.ndarray, weights, draws: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors over draws of rows in order of s: weights of positives, of negatives, and of their pairs in order, ties one half; weights(k) are those of rows k."""
    below, ups, area = np.zeros(draws), np.zeros(draws), np.zeros(draws)
    tie = None  # the last score, whose rows may go on: score, positives, negatives
    for at in range(0, len(s), CHUNK):
        k = np.arange(at, min(at + CHUNK, len(s)))
        w, starts = weights(k), np.flatnonzero(np.r_[True, s[k][1:] != s[k][:-1]])
        up, down = np.add.reduceat(w * y[k, None], starts), np.add.reduceat(w * ~y[k, None], starts)
        if tie and tie[0] == s[at]:
            up[0] += tie[1]
            down[0] += tie[2]
        elif tie:
            area, ups, below = area + tie[1] * (below + tie[2] / 2), ups + tie[1], below + tie[2]
        upto = below + np.cumsum(down[:-1], axis=0)
        area = area + (up[:-1] * (upto - down[:-1] / 2)).sum(axis=0)
        ups, below = ups + up[:-1].sum(axis=0), below + down[:-1].sum(axis=0)
        tie = s[k[-1]], up[-1], down[-1]
    return ups + tie[1], below + tie[2], area + tie[1] * (below + tie[2] / 2)


def _schema(df: DataFrame, by: list[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"{c} {kinds[c]}, " for c in by)


def metric_draws(predicted: DataFrame, draws: int, seed: int, by: list[str]) -> DataFrame:
    """(by..., b, metric, value): auc, spend_r2 and invoice_r2 of each draw of customers, the same draw in every group.

    predicted has rows (by..., customer_id, repurchased, prob, t_spend, spend,
    t_invoices, invoices); draws are from all its customers, so a customer
    counts alike in every arm, seed and origin that holds it.
    """
    both = auc_draws(predicted, draws, seed, by).join(r2_draws(predicted, draws, seed, by), [*by, "b"])
    return both.unpivot([*by, "b"], ["auc", *AMOUNTS], "metric", "value")


def paired_comparisons(draws: DataFrame, points: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(comparison, metric, delta, delta_min, delta_max, ci_low, ci_high, p_boot, p_holm) of pairs of arms.

    draws (seed, origin, arm, b, metric, value) and points, the same without
    b. Differences are averaged over origins; the interval is of all seeds'
    draws together, delta the mean of the seeds' own, with the least and the greatest of them.
    """
    spark = draws.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(f"{a} - {b}", a, b) for a, b in pairs], "comparison string, first string, second string"))

    def deltas(df: DataFrame, keys: list[str]) -> DataFrame:
        sides = df.join(wanted, (F.col("arm") == F.col("first")) | (F.col("arm") == F.col("second")))
        signed = F.sum(F.when(F.col("arm") == F.col("first"), F.col("value")).otherwise(-F.col("value")))
        return sides.groupBy("comparison", "metric", *keys, "origin").agg(signed.alias("delta")).groupBy("comparison", "metric", *keys).agg(F.avg("delta").alias("delta"))

    ends = interval(deltas(draws, ["seed", "b"]), "delta", ["comparison", "metric"]).drop("mean")
    own = deltas(points, ["seed"]).groupBy("comparison", "metric").agg(F.avg("delta").alias("delta"), F.min("delta").alias("delta_min"), F.max("delta").alias("delta_max"))
    return holm(own.join(ends, ["comparison", "metric"]).withColumn("test", F.concat_ws(" ", "comparison", "metric")), "p_boot").drop("test")

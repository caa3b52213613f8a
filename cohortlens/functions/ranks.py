"""Global ranks and exact quantiles without a one-task window."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset a temporary one on one machine, as in tests, and an error on a cluster."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small_methods(spark: SparkSession) -> None:
    """Has Spark split generated methods of more than 8,000 bytes, which the JVM would run uncompiled; for wide expressions."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def value_ranks(df: DataFrame, value: str, by: list[str] = []) -> DataFrame:
    """(by..., value, ties, before, dense, total): for each distinct value of a group how many rows
    have it, how many have a smaller one, its dense rank and the rows of the group. Nulls are left out.

    Distinct values are counted with partial aggregates, range-partitioned and
    summed in a scan of each partition; the partitions' and groups' totals, a row
    each, are all that is ever brought together. The scanned layout is
    checkpointed, as range bounds are sampled anew on each evaluation. Groups are few.
    """
    keys = [*by, value]
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("ties"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = StructType([*counts.schema.fields, *[StructField(c, LongType()) for c in ("__upto", "__row", "__pid")]])

    def scan(batches):
        upto = row = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sums = upto + np.cumsum(batch.column("ties").to_numpy())
            rows = np.arange(row + 1, row + 1 + batch.num_rows)
            upto, row = int(sums[-1]), row + batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums), pa.array(rows), pa.array(np.full(batch.num_rows, TaskContext.get().partitionId()))], names=schema.names)

    laid = checkpointed(counts.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(scan, schema))
    parts = laid.groupBy("__pid").agg(F.max("__upto").alias("n"), F.max("__row").alias("d"))
    earlier = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("__pid", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__n0"), F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("__d0"))
    # groups follow each other in the order of the ranges, so what lies before a group are the totals of those before it
    base = laid.groupBy(*by).agg(F.sum("ties").alias("total"), F.count("*").alias("d"))
    before = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    first = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)) if by else F.lit(0)
    base = F.broadcast(base.select(*by, "total", first("total").alias("__b"), first("d").alias("__d")))
    ranks = laid.join(F.broadcast(offsets), "__pid")  # a row for each partition
    ranks = ranks.join(base, by) if by else ranks.crossJoin(base)
    return ranks.select(*keys, "ties", (F.col("__n0") + F.col("__upto") - F.col("ties") - F.col("__b")).alias("before"), (F.col("__d0") + F.col("__row") - F.col("__d")).alias("dense"), "total")


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] = []) -> DataFrame:
    """(by..., quantiles): linearly interpolated quantiles, exact at any size, as an array in the order of probs."""
    return ranked_quantiles(value_ranks(df, value, by), value, probs, by)


def ranked_quantiles(ranks: DataFrame, value: str, probs: list[float], by: list[str] = []) -> DataFrame:
    """The ``exact_quantiles`` of values whose ranks (by..., value, ties, before, total) are known."""
    places = [F.lit(float(p)) * (F.col("total") - 1) for p in probs]

    def stat(pos):
        return F.max(F.when((F.col("before") <= pos) & (pos < F.col("before") + F.col("ties")), F.col(value).cast("double")))

    ends = [c for i, place in enumerate(places) for c in (stat(F.floor(place)).alias(f"__lo{i}"), stat(F.ceil(place)).alias(f"__hi{i}"))]
    found = ranks.groupBy(*by).agg(F.max("total").alias("total"), *ends)
    values = [F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * (place - F.floor(place)) for i, place in enumerate(places)]
    return found.select(*by, F.array(*values).alias("quantiles"))


class Ordered:
    """Values of few groups in order, for many runs: what a run has is a bit of a row's number, so a row is laid out once, not once a run.

    df has (dim, x, drawn): the group, the value (nulls are left out) and, as bits 0 to runs - 1, the runs that the row takes part in. Rows are
    range-partitioned, sorted and checkpointed. Only counts by partition and group, and what is asked for, come to the driver.
    """

    def __init__(self, df: DataFrame, runs: int):
        if not 0 < runs < 64:
            raise ValueError("1 to 63 runs")
        self.runs, spark = runs, df.sparkSession
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = df.select("dim", F.col("x").cast("double").alias("x"), F.col("drawn").cast("long").alias("drawn")).where(F.col("x").isNotNull())
        self.laid = checkpointed(rows.repartitionByRange(n, "dim", "x", "drawn").sortWithinPartitions("dim", "x"))

        def count(pid, dim, x, upto, until):
            sums[dim] = until[-1]

        sums: dict[str, np.ndarray] = {}
        found = self._scan(lambda pid: (count, lambda: [(dim, run, pid, float(v)) for dim, c in sums.items() for run, v in enumerate(c)]))
        self.pids = sorted({int(p) for _, _, p, _ in found})
        self.counts = {}  # by dim and partition, those of all runs
        for dim, run, pid, v in found:
            self.counts.setdefault(dim, {}).setdefault(int(pid), np.zeros(runs, np.int64))[run] = int(v)
        self.totals = {dim: sum(by.values()) for dim, by in self.counts.items()}

    def _scan(self, start) -> list[tuple[str, int, float, float]]:
        """Passes over the partitions: start(pid) gives (see, end): see(pid, dim, x, upto, until) has a batch's values of a group, each run's rows
        before them and, a row a value, up to and with it; end() the (dim, run, at, value) to return."""
        runs = self.runs

        def scan(batches):
            pid = TaskContext.get().partitionId()
            see, end = start(pid)
            upto: dict[str, np.ndarray] = {}
            for batch in batches:
                dims = np.array(batch.column("dim").to_pylist(), object)
                x, drawn = batch.column("x").to_numpy(), batch.column("drawn").to_numpy()
                edges = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1), len(dims)]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if a < b:
                        before = upto.get(dims[a], np.zeros(runs, np.int64))
                        until = before + np.cumsum((drawn[a:b, None] >> np.arange(runs)) & 1, axis=0)
                        see(pid, dims[a], x[a:b], before, until)
                        upto[dims[a]] = until[-1]
            out = end()
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.float64()), pa.array([r[3] for r in out], pa.float64())], names=["dim", "run", "at", "v"])

        return [tuple(r) for r in self.laid.mapInArrow(scan, "dim string, run int, at double, v double").collect()]

    def at(self, wanted: dict[tuple[str, int], set[int]]) -> dict[tuple[str, int, int], float]:
        """The values at places (from 0) of a group and run."""
        todo: dict[int, dict[str, list[tuple[int, int, int]]]] = {}
        for (dim, run), places in wanted.items():
            first = 0
            for pid, counts in sorted(self.counts[dim].items()):
                for place in places:
                    if first <= place < first + counts[run]:
                        todo.setdefault(pid, {}).setdefault(dim, []).append((run, int(place), int(place - first)))
                first += int(counts[run])

        def start(pid):
            mine, out = todo.get(pid, {}), []

            def see(pid, dim, x, upto, until):
                for run, place, local in mine.get(dim, []):
                    if upto[run] <= local < until[-1, run]:
                        out.append((dim, run, float(place), float(x[np.searchsorted(until[:, run], local + 1)])))

            return see, lambda: out

        return {(dim, run, int(place)): v for dim, run, place, v in self._scan(start)}

    def upto(self, wanted: dict[tuple[str, int], list[float]]) -> dict[tuple[str, int, float], int]:
        """How many values of a group and run are no greater than each one asked for."""

        def start(pid):
            sums: dict[tuple[str, int, float], int] = {}

            def see(pid, dim, x, upto, until):
                for (d, run), limits in wanted.items():
                    if d == dim:
                        for limit in limits:
                            k = int(np.searchsorted(x, limit, side="right"))
                            if k:
                                sums[dim, run, limit] = int(until[k - 1, run])

            return see, lambda: [(d, run, limit, float(n)) for (d, run, limit), n in sums.items()]

        out = {(d, run, limit): 0 for (d, run), limits in wanted.items() for limit in limits}
        for d, run, limit, n in self._scan(start):
            out[d, run, limit] += int(n)
        return out

    def quantiles(self, stretches: dict[tuple, tuple[str, int, int, int]], probs: list[float]) -> dict[tuple, list[float]]:
        """By key, linearly interpolated quantiles of a stretch (group, run, first place, length) of the order; an empty one has none."""
        full = {key: s for key, s in stretches.items() if s[3] > 0}
        wanted: dict[tuple[str, int], set[int]] = {}
        for dim, run, first, n in full.values():
            for p in probs:
                place = p * (n - 1)
                wanted.setdefault((dim, run), set()).update((first + int(np.floor(place)), first + int(np.ceil(place))))
        found, out = self.at(wanted), {}
        for key, (dim, run, first, n) in full.items():
            for p in probs:
                place = p * (n - 1)
                lo, hi = found[dim, run, first + int(np.floor(place))], found[dim, run, first + int(np.ceil(place))]
                out.setdefault(key, []).append(float(lo + (hi - lo) * (place - np.floor(place))))
        return out

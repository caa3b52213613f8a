"""Operator 11: nearest neighbours by multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Bits of a code and the substrings that it is split into; each substring has a table of its own.
BITS, TABLES = 512, 16
WIDTH = BITS // TABLES
#: Vectors, about, from which rotations and first radii are learned.
SAMPLE = 10_000
#: A query's radius grows until it holds this many vectors; the first radius aims at more.
WANTED, AIM = 300, 400
#: Codes of a table that share a cell, about; codes, queries and vectors of one code that meet in one task at a time, at most.
CELL, CODES, ASKING, SAME_CODE = 8192, 8192, 4096, 2048
#: Substring pairs compared at once.
BLOCK = 1 << 20


def matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    """A list column as a matrix; shorter lists are filled up with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    size = np.diff(offsets)
    if (size == width).all():
        return values[offsets[0] : offsets[-1]].reshape(-1, width).astype(kind, copy=False)
    out = np.zeros((len(size), width), kind)
    out[np.arange(width) < size[:, None]] = values[offsets[0] : offsets[-1]]
    return out


def lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), pa.array(rows.reshape(-1)))


class Codes:
    """Rotations learned from a sample so that its rotated vectors lie near the corners of a cube; a code is the corner's signs.

    Inner products become angles by one more coordinate that gives all vectors
    of a band the same length; candidates are centred, which changes no order.
    """

    def __init__(self, sample: np.ndarray, seed: int = 11, steps: int = 30):
        rng = np.random.default_rng(seed)
        self.mean = sample.mean(axis=0)
        x = sample - self.mean
        size = min(BITS, x.shape[1])
        axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :size]
        x, parts = x @ axes, []
        for _ in range(-(-BITS // size)):
            turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
            for _ in range(steps):
                u, _, w = np.linalg.svd(np.where(x @ turn > 0, 1.0, -1.0).T @ x)
                turn = (u @ w).T
            parts.append(axes @ turn)
        self.turn = np.hstack(parts)[:, :BITS]
        self.shift = self.mean @ self.turn

    @staticmethod
    def lengthened(v: np.ndarray, below_top: np.ndarray) -> np.ndarray:
        """Vectors scaled by 2 ** -below_top and a coordinate that makes their length 1."""
        u = v / np.abs(v).max(axis=1, keepdims=True)
        u *= (2.0**-below_top / np.sqrt((u * u).sum(axis=1)))[:, None]
        return np.hstack([u, np.sqrt(np.maximum(0, 1 - (u * u).sum(axis=1)))[:, None]])

    def of_candidates(self, v: np.ndarray, below_top: np.ndarray) -> np.ndarray:
        return self._packed(self.lengthened(v, below_top) @ self.turn - self.shift)

    def of_queries(self, v: np.ndarray) -> np.ndarray:
        return self._packed(self.lengthened(v, np.zeros(len(v))) @ self.turn)

    @staticmethod
    def _packed(x: np.ndarray) -> np.ndarray:
        return np.packbits(x > 0, axis=1).view(np.int32)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of codes, row by row."""
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(axis=1, dtype=np.int32)


def table_radii(radius: np.ndarray) -> np.ndarray:
    """Radii of the substrings: codes within the radius lie within one of these in some table at least, and with any of them smaller they might not."""
    spare = radius.astype(np.int32) - (TABLES - 1)
    return spare[:, None] // TABLES + (np.arange(TABLES) < (spare % TABLES)[:, None])


def first_radius(d: np.ndarray, all_codes: int) -> int:
    """A radius that holds AIM of all_codes vectors, as the sorted distances to a sample of them have it; beyond the sample's reach a count falls by a third a bit."""
    if not len(d):
        return BITS // 4
    share = AIM * len(d) / all_codes
    return int(d[min(len(d), math.ceil(share)) - 1]) if share >= 1 else max(0, int(d[0] + math.log(share) / 0.4))


def runs(batches, n_keys: int) -> Iterator[tuple[bool, pa.RecordBatch, bool]]:
    """Slices of equal keys (the first columns) and side (the one after), of rows sorted by these; whether the key is a new one, the slice, its side."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(n_keys + 1)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(keys[:n_keys, start])
            yield key != last, batch.slice(start, end - start), bool(keys[n_keys, start])
            last = key


def near_codes(batches) -> Iterator[pa.RecordBatch]:
    """Of rows (band, table, cell, part, asking part, side, ka, kb, n, least, code), cell by cell codes and then queries:
    the pairs with a distance above ``least`` and up to the query's radius, each in the first of the tables that hold it."""
    names = ["ka", "kb", "band", "ck", "n"]
    held: list[tuple] = []
    for new, rows, asks in runs(batches, 5):
        held = [] if new else held
        code = matrix(rows.column(10), TABLES, np.int32).view(np.uint32)
        if not asks:
            held.append((code, rows.column(6).to_numpy(), rows.column(8).to_numpy()))
            continue
        if not held:
            continue
        held = [tuple(np.concatenate(x) for x in zip(*held, strict=True))]
        codes, ck, n = held[0]
        table, band = rows.column(1)[0].as_py(), rows.column(0)[0].as_py()
        radius, least = rows.column(8).to_numpy().astype(np.int32), rows.column(9).to_numpy()
        radii = table_radii(radius)
        ka, kb = rows.column(6).to_numpy(), rows.column(7).to_numpy()
        own = np.ascontiguousarray(codes[:, table])
        step = max(1, BLOCK // len(codes))
        for start in range(0, len(code), step):
            q = slice(start, start + step)
            i, j = np.nonzero(np.bitwise_count(code[q, table][:, None] ^ own) <= radii[q, table][:, None])
            i += start
            d = np.concatenate([distances(code[i[k : k + BLOCK]], codes[j[k : k + BLOCK]]) for k in range(0, max(1, len(i)), BLOCK)])
            near = (d <= radius[i]) & (d > least[i])
            i, j = i[near], j[near]
            first = (np.bitwise_count(code[i] ^ codes[j]) <= radii[i]).argmax(axis=1) == table
            i, j = i[first], j[first]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(ka[i]), pa.array(kb[i]), pa.array(np.full(len(i), band, np.int32)), pa.array(ck[j]), pa.array(n[j].astype(np.int64))], names=names)


def rescored(dims: int, k: int) -> Callable:
    """Of rows (ck, part, side, ka, kb, low, v), code by code vectors and then queries: inner products in double precision, coordinate by coordinate;
    of a code's vectors the best k for each query."""
    names = ["ka", "kb", "ca", "cb", "low", "score"]

    def work(batches):
        held: list[tuple] = []
        for new, rows, asks in runs(batches, 2):
            held = [] if new else held
            v = matrix(rows.column(6), dims, np.float64)
            own = (v, *(rows.column(c).to_numpy() for c in (3, 4, 5)))
            if not asks:
                held.append(own)
                continue
            if not held:
                continue
            held = [tuple(np.concatenate(x) for x in zip(*held, strict=True))]
            other, ca, cb, low = held[0]
            step = max(1, BLOCK // len(other))
            for start in range(0, len(v), step):
                asking = v[start : start + step]
                score = np.zeros((len(asking), len(other)))
                for d in range(dims):
                    score += asking[:, d, None] * other[:, d]
                i = np.repeat(np.arange(len(asking)), min(k, len(other)))
                if len(other) > k:
                    j = np.concatenate([np.lexsort((low, -s))[:k] for s in score])
                else:
                    j = np.tile(np.arange(len(other)), len(asking))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own[1][start + i], own[2][start + i], ca[j], cb[j], low[j], score[i, j])], names=names)

    def joined(batches):
        # small batches of many codes are handed on together
        held, size = [], 0
        for batch in work(batches):
            held.append(batch)
            size += batch.num_rows
            if size >= 20_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


def usable(rows: DataFrame) -> DataFrame:
    """(id, v, ka, kb, height): rows with an id and a finite vector other than 0; equal vectors have equal 128 bits of hash, and height is log2 of the length."""
    fine = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    most = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x.cast("double") / F.col("most")) * (x.cast("double") / F.col("most")))
    rows = rows.withColumn("most", most).withColumn("height", F.log2("most") + 0.5 * F.log2(squares)).drop("most")
    return rows.withColumns({"ka": F.xxhash64("v"), "kb": F.xxhash64(F.lit(1), "v")})


def meeting(left: DataFrame, right: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """work over both frames' rows, dealt out by keys; of each key left's rows come first. Nothing is collected: work streams."""
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    rest = [c for c in left.columns if c not in keys]
    dealt = both.select(*keys, "side", *rest).repartition(*keys).sortWithinPartitions(*keys, "side")
    return dealt.mapInArrow(work, schema)


def code_pairs(codes: DataFrame, asking: DataFrame, n_codes: int) -> DataFrame:
    """(ka, kb, band, ck, n): codes (band, ck, n, code) within the radius r of asking (ka, kb, band, least, r, code), and farther than ``least``.

    Every code is filed in each table by its substring there, under the cell
    of its leading bits; every query goes to the cells that hold substrings
    within its table's radius. Cells of many codes or queries are met part by
    part, each in a task of its own.
    """
    bits = max(0, min(16, math.ceil(math.log2(max(1, n_codes / CELL)))))
    cell = F.shiftrightunsigned("sub", WIDTH - bits).cast("int") if bits else F.lit(0)
    at = ["band", "t", "cell"]
    filed = codes.select("band", F.col("ck").alias("ka"), F.lit(0).cast("long").alias("kb"), F.col("n").alias("n"), F.lit(0).alias("least"), "code", F.posexplode("code").alias("t", "sub"))
    filed = filed.withColumn("cell", cell).drop("sub")
    radius = F.expr(f"floor((r - {TABLES - 1}) / {TABLES}) + if(t < pmod(r - {TABLES - 1}, {TABLES}), 1, 0)")
    probes = asking.select("ka", "kb", "band", "least", "r", "code", F.posexplode("code").alias("t", "sub")).withColumn("own", cell).withColumn("reach", radius).where("reach >= 0")
    cells = F.filter(F.sequence(F.lit(0), F.lit((1 << bits) - 1)), lambda x: F.bit_count(x.bitwiseXOR(F.col("own"))) <= F.col("reach"))
    probes = probes.withColumn("cell", F.explode(cells)).select(*at, "ka", "kb", F.col("r").cast("long").alias("n"), "least", "code")
    sizes = filed.groupBy(*at).agg(F.ceil(F.count("*") / CODES).alias("parts")).join(probes.groupBy(*at).agg(F.ceil(F.count("*") / ASKING).alias("turns")), at)

    def numbers(name: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))

    filed = filed.join(sizes, at).withColumn("part", F.pmod("ka", "parts")).withColumn("turn", numbers("turns"))
    probes = probes.join(sizes, at).withColumn("part", numbers("parts")).withColumn("turn", F.pmod("ka", "turns"))
    keys = [*at, "part", "turn"]
    columns = [*keys, "ka", "kb", "n", "least", "code"]
    return meeting(filed.select(*columns), probes.select(*columns), keys, near_codes, "ka long, kb long, band int, ck long, n long")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows (id, v) that ask, the k rows found of largest inner product, nearest first, ties to smaller ids.

    Null ids and vectors, and vectors that are zero or hold null or
    non-finite components take no part; shorter vectors are filled up with
    zeros. Rows of the query's own id are no candidates. Rows that repeat both
    id and vector count once; equal vectors are searched once, whatever their
    number. Queries with fewer candidates get all of them. An empty table
    gives no row.

    Recall is a matter of the radius, which grows for each query until it
    holds WANTED vectors of every band of lengths (all, if there are fewer);
    within it every code is found, whatever its bucket. Rotations and first
    radii come from about SAMPLE vectors; all vectors are indexed.
    """
    kind = {"float": "float", "double": "double"}.get(dict(vectors.dtypes)["v"].removeprefix("array<").removesuffix(">"), "double")
    rows = usable(vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast(f"array<{kind}>").alias("v"), is_query.alias("asks")))
    total = rows.agg(F.count("*").alias("n"), F.max("height").alias("top"), F.max(F.size("v")).alias("dims")).first()
    if not total.n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    top, dims = total.top, total.dims
    share = min(1 << 30, math.ceil(SAMPLE * (1 << 30) / total.n))
    sample = rows.where(F.pmod("ka", F.lit(1 << 30)) < share).select("ka", "kb", "v", "height").dropDuplicates(["ka", "kb"]).toArrow()
    if not sample.num_rows:
        sample = rows.select("ka", "kb", "v", "height").limit(1).toArrow()
    drop = top - sample["height"].to_numpy()
    sampled, sampled_band = matrix(sample["v"], dims, np.float64), np.floor(drop).astype(np.int32)
    model = Codes(Codes.lengthened(sampled, drop - sampled_band))
    sampled_codes = model.of_candidates(sampled, drop - sampled_band)

    def encode(batches):
        for batch in batches:
            v, drop = matrix(batch.column(5), dims, np.float64), top - batch.column(4).to_numpy()
            band = np.floor(drop).astype(np.int32)
            code = model.of_candidates(v, drop - band) if len(v) else np.zeros((0, TABLES), np.int32)
            query = model.of_queries(v) if len(v) else code
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(band), lists(code), lists(query), batch.column(5)], names=["ka", "kb", "low", "asks", "band", "code", "query", "v"])

    classes = rows.groupBy("ka", "kb").agg(F.min("id").alias("low"), F.max("asks").alias("asks"), F.first("height").alias("height"), F.first("v").alias("v"))
    coded = classes.mapInArrow(encode, f"ka long, kb long, low long, asks boolean, band int, code array<int>, query array<int>, v array<{kind}>")
    coded = checkpointed(coded.withColumn("ck", F.xxhash64("band", "code")))  # a clash of hashes only adds candidates
    codes = checkpointed(coded.groupBy("band", "code").agg(F.first("ck").alias("ck"), F.count("*").alias("n")))
    sizes = {r.band: (r.codes, r.n) for r in codes.groupBy("band").agg(F.count("*").alias("codes"), F.sum("n").alias("n")).collect()}

    def radii(batches):
        for batch in batches:
            query = matrix(batch.column(2), TABLES, np.int32)
            for band, (_, n) in sizes.items():
                near = sampled_codes[sampled_band == band]
                r = [first_radius(np.sort(distances(np.broadcast_to(q, near.shape).copy(), near)), n) for q in query]
                here = [pa.array(np.full(len(r), x, kind)) for x, kind in ((band, np.int32), (-1, np.int32))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *here, pa.array(r, pa.int32()), batch.column(2)], names=["ka", "kb", "band", "least", "r", "code"])

    asking = checkpointed(coded.where("asks").select("ka", "kb", "query").mapInArrow(radii, "ka long, kb long, band int, least int, r int, code array<int>").withColumn("found", F.lit(0).cast("long")))
    members = F.create_map(*[F.lit(x) for band, (_, n) in sizes.items() for x in (band, n)])
    pairs = None
    while not asking.isEmpty():
        new = checkpointed(code_pairs(codes, asking, sum(c for c, _ in sizes.values())))
        pairs = new if pairs is None else pairs.union(new)
        more = new.groupBy("ka", "kb", "band").agg(F.sum("n").alias("more"))
        asking = asking.join(more, ["ka", "kb", "band"], "left").withColumn("found", F.col("found") + F.coalesce("more", F.lit(0))).drop("more")
        asking = asking.where((F.col("found") < F.least(F.lit(WANTED), members[F.col("band")])) & (F.col("r") < BITS))
        farther = F.col("r") + 1 + F.ceil(F.log(AIM / F.greatest("found", F.lit(1))) / 0.3)
        asking = checkpointed(asking.select("ka", "kb", "band", F.col("r").alias("least"), F.least(F.lit(BITS), farther).cast("int").alias("r"), "code", "found"))
    if pairs is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    large = codes.where(F.col("n") > SAME_CODE).groupBy("ck").agg(F.sum("n").alias("n"))
    in_parts = F.ceil(F.col("n") / SAME_CODE)
    left = coded.select("ck", "ka", "kb", "low", "v").join(large, "ck", "left").withColumn("part", F.coalesce(F.pmod("ka", in_parts), F.lit(0)))
    asked = pairs.groupBy("ka", "kb", "ck").agg(F.sum("n").alias("n"))
    right = asked.join(coded.where("asks").select("ka", "kb", "low", "v"), ["ka", "kb"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), in_parts - 1)))
    columns = ["ck", "part", "ka", "kb", "low", "v"]
    scored = meeting(left.select(*columns), right.select(*columns), ["ck", "part"], rescored(dims, k + 1), "ka long, kb long, ca long, cb long, low long, score double")
    place = F.row_number().over(Window.partitionBy("ka", "kb").orderBy(F.desc("score"), "low", "ca", "cb"))
    best = scored.withColumn("place", place).where(F.col("place") <= k + 1)

    ids = rows.select("ka", "kb", "id").distinct()
    nth = F.row_number().over(Window.partitionBy("ka", "kb").orderBy("id"))
    copies = ids.withColumn("nth", nth).where(F.col("nth") <= k + 1).select(F.col("ka").alias("ca"), F.col("kb").alias("cb"), F.col("id").alias("vec_id"))
    entry = F.struct((-F.col("score")).alias("away"), "vec_id", "score")
    found = best.join(copies, ["ca", "cb"]).groupBy("ka", "kb").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k + 1).alias("found"))  # k + 1 vectors of k + 1 ids at most
    queries = rows.where("asks").select(F.col("id").alias("query_id"), "ka", "kb").distinct()
    others = F.slice(F.filter("found", lambda x: x.vec_id != F.col("query_id")), 1, k)
    out = queries.join(found, ["ka", "kb"]).select("query_id", F.posexplode(others).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")


def neighbour_digest(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose vec_id is divisible by ``every``, of all rows (see ``nearest``)."""
    return nearest(embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), F.col("id") % every == 0, k)

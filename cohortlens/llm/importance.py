"""Operator 13: importance resampling towards a target distribution over hashed n-grams, from suffix arrays of word ids."""

from __future__ import annotations

import functools
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, columns, free_names, lean_batches, map_rows, with_fields
from .kernels import pieces, words

#: Longest run of words that is a feature.
DEPTH = 3
BUCKETS = 10_000
#: Text bytes of one suffix array, about; a longer text has one of its own.
ARRAY_BYTES = 2 << 20


@functools.cache
def _zeros_appended(power: int) -> np.ndarray:
    """What 2**power zero bytes do to a crc32: four tables, one for each byte of the crc."""
    if power:
        half = _zeros_appended(power - 1)
        image = _advance(_advance(np.uint32(1) << np.arange(32, dtype=np.uint32), half), half)
    else:
        one = [zlib.crc32(b"\0", int(c) ^ 0xFFFFFFFF) for c in 1 << np.arange(32, dtype=np.int64)]
        rest = zlib.crc32(b"\0", 0xFFFFFFFF)
        image = np.array([x ^ rest for x in one], np.uint32)
    out = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        out[bit // 8] ^= np.where(np.arange(256) >> (bit % 8) & 1, image[bit], 0).astype(np.uint32)
    return out


def _advance(crc: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


def crc_joined(left: np.ndarray, right: np.ndarray, right_size: np.ndarray) -> np.ndarray:
    """crc32 of concatenations, from the crc32 of both parts and the right part's bytes; a crc32 is linear over its message."""
    out, left_bits = left.copy(), int(right_size.max(initial=0)).bit_length()
    for power in range(left_bits):
        at = np.flatnonzero(right_size >> power & 1)
        out[at] = _advance(out[at], _zeros_appended(power))
    return out ^ right


class SuffixArray:
    """All suffixes of a block of texts in the order of their first DEPTH word ids.

    Suffixes end with their text. ``lcp[k]`` is how many leading words suffix
    ``order[k]`` shares with the one before it, DEPTH at most, so the runs
    between places where it is below n are the distinct n-grams, each with all
    its occurrences side by side.
    """

    def __init__(self, texts: list[bytes | None]):
        lists = [words(t or b"") for t in texts]
        self.n_words = np.array([len(x) for x in lists], np.int64)
        self.owner = np.repeat(np.arange(len(lists)), self.n_words)
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for x in lists for w in x], np.int64) + 1
        self.vocab = list(number)
        size = len(ids)
        self.word = np.zeros((DEPTH, size), np.int64)
        for n in range(DEPTH):  # 0 beyond the end of the text
            self.word[n, : max(0, size - n)] = np.where(self.owner[n:] == self.owner[: max(0, size - n)], ids[n:], 0)
        if len(self.vocab) < (1 << 21) - 1 and DEPTH == 3:
            self.order = np.argsort(self.word[0] << 42 | self.word[1] << 21 | self.word[2], kind="stable")
        else:
            self.order = np.lexsort(self.word[::-1])
        same = np.ones(max(0, size - 1), bool)
        self.lcp = np.zeros(size, np.int64)
        for n in range(DEPTH):
            w = self.word[n][self.order]
            same &= (w[1:] == w[:-1]) & (w[1:] > 0)
            self.lcp[1:] += same

    def buckets(self, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of every feature's every occurrence, and the text it is in; each run is hashed once."""
        crc = np.array([0, *(zlib.crc32(w) for w in self.vocab)], np.uint32)
        size = np.array([0, *map(len, self.vocab)], np.int64)
        space, one = np.uint32(zlib.crc32(b" ")), np.ones(1, np.int64)
        found, owners = [], []
        for n in range(1, DEPTH + 1):
            heads = self.lcp < n
            there = self.word[n - 1][self.order] > 0
            first = self.order[heads & there]
            h = crc[self.word[0][first]]
            for k in range(1, n):
                w = self.word[k][first]
                h = crc_joined(crc_joined(h, space, np.broadcast_to(one, h.shape)), crc[w], size[w])
            run = np.cumsum(heads & there)[there] - 1
            found.append((h % np.uint32(n_buckets)).astype(np.int64)[run])
            owners.append(self.owner[self.order[there]])
        return np.concatenate(found), np.concatenate(owners)


def bucket_counts(texts: DataFrame, n_buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of the first column's texts in each bucket that has any; each task adds up its own before the shuffle."""
    lean_batches(texts.sparkSession)

    def count(batches):
        total = np.zeros(n_buckets, np.int64)
        for piece in pieces(batches, 0, ARRAY_BYTES):
            found, _ = SuffixArray([t.as_py() for t in piece.column(0).cast(pa.large_binary())]).buckets(n_buckets)
            total += np.bincount(found, minlength=n_buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, n_buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket in thousandths: floor(1000 ln) of how much more often the target's features fall into it than those of docs, all counts plus one.

    The two count vectors have ``n_buckets`` numbers, whatever the tables' sizes; they come to the driver.
    """
    counts = []
    for texts in (docs, target):
        n = [0] * n_buckets
        for row in bucket_counts(texts.select("text"), n_buckets).collect():
            n[row.bucket] = row.n
        counts.append(n)
    here, there = counts
    all_here, all_there = float(sum(here) + n_buckets), float(sum(there) + n_buckets)
    return [math.floor(1000 * math.log((t + 1) * all_here / ((s + 1) * all_there))) for s, t in zip(map(float, here), map(float, there), strict=True)]


def _noise(ident: str, seed: int) -> int:
    """Gumbel noise in thousandths from the first 32 bits of a sha256."""
    h = int(hashlib.sha256(f"{seed}:{ident}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def importance_scores(docs: DataFrame, gains: list[int], seed: int = 42) -> DataFrame:
    """docs with ``n_words``, ``n_features``, ``weight`` and ``score`` at the end, all long.

    weight sums the gains of all features of the whole text, repeats counted;
    score adds Gumbel noise hashed from seed and doc_id. A null text has no
    words and weight 0; a null doc_id counts as an empty one; repeated rows
    score alike. Other columns pass through, whatever their names; an added
    column whose name is taken has underscores at its end.
    """
    lean_batches(docs.sparkSession)
    at, out = docs.columns.index("text"), free_names(docs, "n_words", "n_features", "weight", "score")
    ident = docs.select(*columns(docs), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(free_names(docs, "ident")[0]))
    gain, n_buckets, last = np.array(gains, np.float64), len(gains), len(docs.columns)
    names = [*docs.columns, *out]

    def score(batches):
        for piece in pieces(batches, at, ARRAY_BYTES):
            block = SuffixArray([t.as_py() for t in piece.column(at).cast(pa.large_binary())])
            found, owner = block.buckets(n_buckets)
            n = len(block.n_words)
            weight = np.bincount(owner, gain[found], minlength=n).astype(np.int64)  # sums of integers, exact in doubles
            noise = np.array([_noise(x, seed) for x in piece.column(last).to_pylist()], np.int64)
            features = np.bincount(owner, minlength=n)
            yield pa.RecordBatch.from_arrays([*piece.columns[:last], *map(pa.array, (block.n_words, features.astype(np.int64), weight, weight + noise))], names=names)

    return map_rows(ident, score, with_fields(docs, *((name, "long") for name in out)))


def draw_ranks(scored: DataFrame, share: tuple[int, int], min_words: int) -> DataFrame:
    """scored (doc_id, n_words, score, ...) with ``rank`` at the end: 1, 2, ... of the drawn rows, null of the others.

    Of the rows with ``min_words`` words or more, floor(share of them) are
    drawn: those of highest score, ties to smaller doc_id (a null one last).
    Ranks are places in a range partitioning plus the sizes of the partitions
    before, so no task sorts all rows; the layout is checkpointed, since its
    bounds are sampled.
    """
    rank, tie, part, place, before = free_names(scored, "rank", "tie", "part", "place", "before")
    able = F.col("n_words") >= min_words
    order: list[Column] = [able.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col(tie)]
    n = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = checkpointed(scored.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()))
    parts = laid.groupBy(part).agg(F.count("*").alias("n"), F.count_if(able).alias("able"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.select(part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before), (F.sum("able").over(Window.partitionBy()) * share[0]).alias("drawn"))
    placed = laid.withColumn(place, F.row_number().over(Window.partitionBy(part).orderBy(*order))).join(F.broadcast(sums), part)  # a row for each partition
    at = F.col(before) + F.col(place)
    return placed.select(*columns(scored), F.when(able & (at * share[1] <= F.col("drawn")), at).cast("long").alias(rank))


def importance_digest(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), min_words: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs, drawn towards the texts of target.

    Empty tables give no row, or gains against no features; nulls, repeated
    rows and ties are as in ``importance_scores`` and ``draw_ranks``.
    """
    scored = importance_scores(docs.select("doc_id", "text"), bucket_gains(docs, target)).drop("text")
    return draw_ranks(checkpointed(scored), share, min_words).select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), min_words: int = 20, seed: int = 42) -> DataFrame:
    """The rows of docs that are drawn, with ``rank`` at the end; the columns of docs are unchanged. Only rows that are drawn are joined to a rank."""
    row, = free_names(docs, "row")
    kept = checkpointed(docs.withColumn(row, F.monotonically_increasing_id()))  # row numbers must be the same in both branches
    scored = importance_scores(kept.select("doc_id", "text", F.col(row).alias("row_")), bucket_gains(docs, target), seed).drop("text")
    drawn = draw_ranks(scored, share, min_words).where("rank IS NOT NULL").select(F.col("row_").alias(row), F.col("rank").alias(free_names(docs, "rank")[0]))
    return kept.join(drawn, row).drop(row)


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"

IMPORTANCE_SQL = f"""
WITH RECURSIVE crc AS (SELECT b AS c, b, 0 AS k FROM range(256) t(b) UNION ALL SELECT {_STEP}, b, k + 1 FROM crc WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM crc WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
e AS (SELECT {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
g AS (SELECT 1 AS here, r, array_to_string(w[i:i + s - 1], ' ') AS f FROM (SELECT r, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM d, range(1, 4) t(s))
  UNION ALL SELECT 0, 0, array_to_string(w[i:i + s - 1], ' ') FROM (SELECT w, s, unnest(range(1, len(w) - s + 2)) AS i FROM e, range(1, 4) t(s))),
x AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM g)),
h AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM x, tab),
o AS (SELECT here, r, bucket FROM g JOIN h USING (f)),
n AS (SELECT bucket, count(*) FILTER (here = 1)::DOUBLE AS s, count(*) FILTER (here = 0)::DOUBLE AS t FROM o GROUP BY bucket),
z AS (SELECT coalesce(sum(s), 0) + 10000.0 AS s0, coalesce(sum(t), 0) + 10000.0 AS t0 FROM n),
v AS (SELECT bucket, floor(1000 * ln((t + 1) * s0 / ((s + 1) * t0)))::BIGINT AS gain FROM n, z),
a AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM o JOIN v USING (bucket) WHERE here = 1 GROUP BY r),
b AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296))))::BIGINT AS score FROM d LEFT JOIN a USING (r)),
p AS (SELECT *, row_number() OVER (ORDER BY n_words >= 20 DESC, score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_words >= 20) OVER () AS able FROM b)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * able // 100 THEN place END::BIGINT AS rank FROM p
"""

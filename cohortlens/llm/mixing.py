"""Operator 9: mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, free_names

#: A source is broadcast with its cumulated probabilities up to so many of these; 8 bytes each.
BROADCAST_ROWS = 1_000_000
#: Means above this are drawn as a sum of independent parts, so that exp(-mean) stays far from 0.
PART = 64.0


def square_root_weights(docs: DataFrame) -> DataFrame:
    """(source, n, weight): target weights in proportion to the square root of a source's documents."""
    return docs.groupBy("source").agg(F.count("*").alias("n")).withColumn("weight", F.sqrt(F.col("n").cast("double")))


def replication_rates(sources: DataFrame, scale: float = 1.0) -> DataFrame:
    """(source, mean): copies of a document of the source that give its weight a share of ``scale`` times all documents.

    sources has one row a source: (source, n, weight). Sums run over it in
    one row, never over documents.
    """
    total = sources.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_weight"))
    return sources.crossJoin(F.broadcast(total)).select("source", (F.lit(scale) * F.col("all_n") * F.col("weight") / F.col("all_weight") / F.col("n")).alias("mean"))


def _uniform(*parts) -> F.Column:
    """A number in (0, 1) from the first 52 bits of an md5, the same in any engine."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_replicate(docs: DataFrame, rates: DataFrame, seed: int = 9) -> DataFrame:
    """docs with ``copy`` (0, 1, ...), ``n_copies`` and ``shuffle_key`` at the end: each row as often as its draw says, to be ordered by the key.

    The draw is Poisson with the mean of the row's source, by inversion of a
    uniform hash of seed, doc_id and a part number: the least k whose
    cumulated probability exceeds it. Equal ids draw alike, so repeated rows
    are repeated alike. A null doc_id or source is a value like any other; a
    source without a rate has mean 0. Texts aren't looked at. Other columns
    pass through, whatever their names; an added column whose name is taken
    has underscores at its end.
    """
    copy, n_copies, key, source, parts, cdf, salt = free_names(docs, "copy", "n_copies", "shuffle_key", "source_key", "parts", "cdf", "salt")
    source_key = F.coalesce(F.to_json(F.struct("source")), F.lit("{}")).alias(source)
    grid = rates.where("mean > 0").select(source_key, F.greatest(F.lit(1), F.ceil(F.col("mean") / PART)).cast("int").alias(parts), F.col("mean"))
    part_mean = F.col("mean") / F.col(parts)
    # ln P(k) = -m + k ln m - ln k!, cumulated; the tail beyond the grid has less than 1e-18
    step = F.explode(F.sequence(F.lit(0), (F.ceil(part_mean + 10 * F.sqrt(part_mean)) + 20).cast("int"))).alias("k")
    steps = grid.select(source, parts, part_mean.alias("m"), step)
    at = Window.partitionBy(source).orderBy("k")
    log_factorial = F.sum(F.log(F.greatest(F.col("k"), F.lit(1)).cast("double"))).over(at)
    steps = steps.withColumn("p", F.exp(-F.col("m") + F.col("k") * F.log("m") - log_factorial)).withColumn("c", F.sum("p").over(at))
    tables = steps.groupBy(source, parts).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x.c).alias(cdf))
    keyed = docs.select(*columns(docs), source_key)
    if steps.count() <= BROADCAST_ROWS:
        joined = keyed.join(F.broadcast(tables), source)
    else:  # salted: no task gets all rows of a large source
        salts = 32
        keyed = keyed.withColumn(salt, F.pmod(F.xxhash64(F.col("doc_id")), F.lit(salts)))
        spread = tables.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        joined = keyed.join(spread, [source, salt])
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    uniforms = F.transform(F.sequence(F.lit(1), F.col(parts)), lambda j: _uniform(F.lit(str(seed)), ident, j.cast("string")))
    draw = F.aggregate(uniforms, F.lit(0), lambda total, u: total + F.size(F.filter(cdf, lambda c: c <= u)))
    drawn = joined.withColumn(n_copies, draw).where(F.col(n_copies) > 0)
    copies = drawn.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(n_copies) - 1)))
    order = F.md5(F.concat_ws("|", F.lit(f"order{seed}"), ident, F.col(copy).cast("string")).cast("binary"))
    return copies.select(*columns(docs), copy, n_copies, order.alias(key))


def shuffled_globally(replicated: DataFrame, key: str = "shuffle_key") -> DataFrame:
    """Rows in the order of ``key`` over all partitions: a range partitioning, sorted within."""
    n = int(replicated.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return replicated.repartitionByRange(n, key).sortWithinPartitions(key)


def mixed_sources(docs: DataFrame) -> DataFrame:
    """docs repeated to square-root source weights, in a global random order, with ``copy`` at the end to number repeats (see ``poisson_replicate``)."""
    copy, _, key = free_names(docs, "copy", "n_copies", "shuffle_key")
    mixed = poisson_replicate(docs, replication_rates(square_root_weights(docs)))
    return shuffled_globally(mixed, key).select(*columns(docs), copy)


def mixture_digest(docs: DataFrame) -> DataFrame:
    """doc_id, source, copy, n_copies, shuffle_key of every copy, mixed to square-root weights."""
    rows = docs.select("doc_id", "source")
    out = shuffled_globally(poisson_replicate(rows, replication_rates(square_root_weights(rows))))
    return out.select("doc_id", "source", F.col("copy").cast("long").alias("copy"), F.col("n_copies").cast("long").alias("n_copies"), "shuffle_key")


MIXTURE_SQL = """
WITH s AS (SELECT source, count(*) AS n, sqrt(count(*)::DOUBLE) AS weight FROM documents GROUP BY source),
t AS (SELECT sum(n)::DOUBLE AS all_n, sum(weight) AS all_weight FROM s),
r AS (SELECT source, all_n * weight / all_weight / n AS mean FROM s, t),
g AS (SELECT source, greatest(1, ceil(mean / 64.0))::INT AS parts, mean / greatest(1, ceil(mean / 64.0)) AS m FROM r),
k AS (SELECT source, parts, m, unnest(range(0, (ceil(m + 10 * sqrt(m)) + 21)::BIGINT)) AS k FROM g),
p AS (SELECT *, exp(-m + k * ln(m) - sum(ln(greatest(k, 1)::DOUBLE)) OVER (PARTITION BY source ORDER BY k)) AS p FROM k),
c AS (SELECT source, parts, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM p),
a AS (SELECT source, parts, list(c ORDER BY c) AS cdf FROM c GROUP BY ALL),
d AS (SELECT doc_id, documents.source, list_sum(list_transform(range(1, parts + 1), lambda j: len(list_filter(cdf, lambda x: x <=
  ((('0x' || substr(md5('9|' || coalesce(doc_id::VARCHAR, '') || '|' || j), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0))))::BIGINT AS n_copies
  FROM documents JOIN a ON documents.source IS NOT DISTINCT FROM a.source),
e AS (SELECT doc_id, source, n_copies, unnest(range(0, n_copies)) AS copy FROM d)
SELECT doc_id, source, copy, n_copies, md5('order9|' || coalesce(doc_id::VARCHAR, '') || '|' || copy) AS shuffle_key FROM e
"""

"""Operator 12: divergence of sources within a language, with each distinct count column evaluated once."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, lean_batches
from .kernels import LOWER, pieces

#: bytes.translate table of the terms ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``: A-Z lower-cased, anything that is no letter or high byte a space.
TERM_TABLE = bytes(int(LOWER[b]) if ord("a") <= LOWER[b] <= ord("z") or b >= 128 else 32 for b in range(256))
#: Entries that a task counts up before it hands them on.
HELD = 1_000_000
#: Sources and distinct count columns of one block of pairs, about.
SOURCES, COLUMNS = 128, 2048
UNIT, PRIOR = 1_000_000_000, 5


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences of each term in a source's documents, and how many of these have it; null lang, source and text are ''.
    The rows of a term lie in one partition; tasks have added up their own before, so there are some a task and source.
    """
    lean_batches(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def flush(held: dict):
        for (lang, source), (n, df) in held.items():
            for start in range(0, len(n), 50_000):
                terms = list(n)[start : start + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([n[t] for t in terms], pa.int64()), pa.array([df[t] for t in terms], pa.int64())],
                    names=["lang", "source", "term", "n", "df"],
                )

    def count(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for piece in pieces(batches, 2, 4 << 20):
            for lang, source, text in zip(*(piece.column(k).to_pylist() for k in (0, 1)), piece.column(2).cast(pa.large_binary()), strict=True):
                found = Counter(text.as_py().translate(TERM_TABLE).split())
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                n.update(found)
                df.update(found.keys())
                size += len(n)
                if size >= HELD:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    counted = rows.mapInArrow(count, "lang string, source string, term string, n long, df long")
    return counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def kept_counts(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n, lang_n, sig, sig2, first) of the terms that ``min_docs`` documents of their language have.

    ``sig`` and ``sig2`` are the same for terms of the same column, that is of
    the same sources with the same counts; ``first`` marks one row a term.
    """
    term = Window.partitionBy("lang", "term")
    mark = {name: F.bit_xor(F.xxhash64(F.lit(k), "source", "n")).over(term) for k, name in enumerate(("sig", "sig2"))}
    rows = term_counts(docs).withColumn("all_df", F.sum("df").over(term)).where(F.col("all_df") >= min_docs).drop("df", "all_df")
    return rows.withColumns({"lang_n": F.sum("n").over(term), **mark, "first": F.row_number().over(term.orderBy("source")) == 1})


def smoothed(count: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT (count + PRIOR) / (total + PRIOR terms)), exactly: long division, three decimal digits a step, so that nothing overflows."""
    below = f"({total} + {PRIOR} * {terms})"
    out, rest = "1L", f"({count} + {PRIOR}L)"
    for scale in (UNIT // 1000, UNIT // 1000_000, 1):
        out += f" + {scale}L * ({rest} * 1000L div {below})"
        rest = f"({rest} * 1000L % {below})"
    return F.expr(out)


def _pair_sums(key, entries: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """Sums of mult * |p - q| over the count columns of a block, for its pairs of sources."""
    _, low, high, _ = key
    sources = sources.sort_values(["block", "source"])
    names = sources["source"].to_numpy(object)
    at = {s: i for i, s in enumerate(names)}
    row, columns = pd.factorize(pd.Series(list(zip(entries["sig"], entries["sig2"], strict=True)), dtype=object))
    p = np.tile(sources["zero"].to_numpy(np.int64), (len(columns), 1))
    p[row, np.array([at[s] for s in entries["source"]], np.int64)] = entries["p"].to_numpy(np.int64)
    mult = np.zeros(len(columns), np.int64)
    mult[row] = entries["mult"].to_numpy(np.int64)
    block = sources["block"].to_numpy()
    firsts, seconds, values = [], [], []
    for a in np.flatnonzero(block == low):
        others = np.arange(a + 1, len(names)) if low == high else np.flatnonzero(block == high)
        firsts += [names[a]] * len(others)
        seconds += names[others].tolist()
        values.append(mult @ np.abs(p[:, others] - p[:, [a]]))
    values = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pd.DataFrame({"lang": pd.Series([key[0]] * len(firsts), dtype=object), "a": pd.Series(firsts, dtype=object), "b": pd.Series(seconds, dtype=object), "value": values})


def source_divergence(docs: DataFrame, min_docs: int = 30, top_terms: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source's term distribution lies from each other source's and from its language's.

    Terms of a language are those in ``min_docs`` of its documents or more.
    Shares are whole numbers in units of 1e-9, smoothed by ``PRIOR``. Part
    ``pair`` has each other source of the language with the sum of absolute
    differences; part ``term`` the ``top_terms`` terms that a source uses more
    than its language does. Terms whose sources have the same counts share one
    column, told apart by two 64-bit hashes: it is evaluated once for a pair
    of sources and multiplied by its terms. Blocks of sources meet blocks of
    columns, so a task's matrices are bounded, and no row is made for a term
    and a pair. Counts are added up in the tasks before they are shuffled.

    Null lang, source and text are ''; repeated rows count each; a group
    without terms has pairs of value by smoothing alone, or 0 in a language
    without kept terms; an empty table gives no row.
    """
    empty = F.lit("")
    groups = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source")).distinct()
    counts = checkpointed(kept_counts(docs, min_docs))
    kept = counts.where("first")
    # the first term of a column stands for all of them
    shared = kept.groupBy("lang", "sig", "sig2").agg(F.min("term").alias("term"), F.count("*").alias("mult"))
    langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(shared.groupBy("lang").agg(F.count("*").alias("columns")), "lang", "left")
    sizes = sizes.select("lang", F.ceil(F.col("sources") / SOURCES).alias("blocks"), F.greatest(F.lit(1), F.ceil(F.coalesce("columns", F.lit(0)) / COLUMNS)).alias("parts"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "lang_total", "terms"]).join(sizes, "lang")
    groups = checkpointed(groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks"))))
    entries = counts.drop("first").join(shared.drop("sig", "sig2"), ["lang", "term"]).join(groups, ["lang", "source"])
    entries = checkpointed(entries.withColumn("p", smoothed("n", "total", "terms")))

    partner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    key = ["lang", "low", "high", "part"]
    ends = F.least("block", "partner").alias("low"), F.greatest("block", "partner").alias("high")
    left = entries.withColumn("partner", partner).select("lang", *ends, F.pmod("sig", "parts").alias("part"), "sig", "sig2", "source", "p", "mult")
    zero = F.when(F.col("terms") > 0, smoothed("0L", "total", "terms")).otherwise(0)
    right = groups.withColumn("zero", zero).withColumn("partner", partner).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    right = right.select("lang", *ends, "part", "source", "block", "zero")
    sums = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_pair_sums, "lang string, a string, b string, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = sums.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    first = F.row_number().over(Window.partitionBy("lang", "sig", "sig2").orderBy("term"))
    members = kept.select("lang", "sig", "sig2", F.col("term").alias("item"), first.alias("k")).where(F.col("k") <= top_terms).drop("k")
    above = entries.withColumn("value", F.col("p") - smoothed("lang_n", "lang_total", "terms")).where("value > 0")
    terms = above.join(members, ["lang", "sig", "sig2"]).select("lang", "source", F.lit("term").alias("part"), "item", "value")

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    return ranked(pairs).union(ranked(terms).where(F.col("rank") <= top_terms))


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, sum(c) AS n, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM o JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, (1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 5) // (coalesce(t.n, 0) + 5 * l.v))::BIGINT AS p,
  (1 + 1000000000::HUGEINT * (k.c + 5) // (l.n + 5 * l.v))::BIGINT AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q),
y AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM x)
SELECT * FROM y WHERE part = 'pair' OR rank <= 50
"""

"""Operator 10: secret scans over an incremental blob ledger, in DataFrame operations only."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, free_names, join_spread

#: The rules in their order. (kind, pattern, group of the value or 0, least length of it, base rule)
#: Letters of either case are written out, so that no engine folds other letters into them.
RULES = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20, True),
    ("hex", r"[0-9a-f]{24,}", 0, 24, True),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, False),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, False),
    ("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 27, False),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 33, False),
]
#: Names the set of rules; scans under another name start over.
RULE_VERSION = "1"
#: A ledger of up to so many blobs, 64 bytes each, is broadcast to the texts; a larger one meets them by a shuffle.
BROADCAST_BLOBS = 200_000
LEDGER_SCHEMA = "blob string, rule_version string, spans array<struct<start:long,kind:int,end:long>>"


def _may_hit(text: Column) -> Column:
    """Whether any rule may match: a look for a fixed part where there is one."""
    fixed = {"access": "AKIA", "slack": "xox", "pem": "PRIVATE KEY-----", "jwt": "eyJ", "github": "gh"}
    out = F.lit(False)
    for kind, pattern, *_ in RULES:
        if kind in fixed:
            out = out | (text.contains(fixed[kind]) & text.rlike(pattern))
        else:
            out = out | text.rlike(pattern)
    return out


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """(blob, spans) of the blobs (blob, text) in which rules match: spans by start, then kind.

    A rule's matches are leftmost and don't overlap; a match's place follows
    from the lengths of the gaps and matches before it, summed by a window over
    the matches of one blob and rule. Matches with too short a value drop out
    after that, so they still use up their characters.
    """
    text = F.col("text")
    found = [
        F.struct(
            F.lit(number).alias("kind"),
            F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length).alias("lengths"),
            (F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else F.lit(None).cast("array<int>")).alias("values"),
            F.when(text.rlike(pattern), F.transform(F.split(text, pattern, -1), F.length)).alias("gaps"),
        )
        for number, (_, pattern, group, _, _) in enumerate(RULES)
    ]
    hits = blobs.select("blob", F.inline(F.array(*found))).where(F.size("lengths") > 0)
    each = hits.select("blob", "kind", F.posexplode(F.arrays_zip(F.slice("gaps", F.lit(1), F.size("lengths")).alias("gap"), F.col("lengths").alias("length"), F.coalesce("values", "lengths").alias("value"))).alias("at", "x"))
    each = each.select("blob", "kind", "at", "x.*").toDF("blob", "kind", "at", "gap", "length", "value")
    end = F.sum(F.col("gap").cast("long") + F.col("length")).over(Window.partitionBy("blob", "kind").orderBy("at"))
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("length"))
    least = F.element_at(F.array(*[F.lit(r[3]) for r in RULES]), F.col("kind") + 1)
    placed = placed.where(F.col("value") >= least)
    return placed.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))


def _unseen(docs: DataFrame, ledger: DataFrame | None, rule_version: str) -> DataFrame:
    """(blob, text) of the rows of docs whose content the ledger has no scan of under these rules."""
    rows = docs.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    if ledger is None:
        return rows
    seen = ledger.where(F.col("rule_version") == rule_version).select("blob").distinct()
    few = seen.limit(BROADCAST_BLOBS + 1).count() <= BROADCAST_BLOBS
    return rows.join(F.broadcast(seen) if few else seen, "blob", "left_anti")


def unseen_blobs(docs: DataFrame, ledger: DataFrame | None, rule_version: str = RULE_VERSION) -> DataFrame:
    """(blob, text) of the contents in docs that the ledger has no scan of under these rules, each once."""
    return _unseen(docs, ledger, rule_version).groupBy("blob").agg(F.first("text").alias("text"))


def ledger_update(docs: DataFrame, ledger: DataFrame | None, rule_version: str = RULE_VERSION) -> DataFrame:
    """What to append to the ledger (blob, rule_version, spans): a row for each unseen blob, spans empty where nothing was found.

    A look for any match is made where texts are read; only texts with one
    are brought together by content, to be scanned once each, and of the others only the hash.
    """
    fresh = _unseen(docs, ledger, rule_version)
    found = scan_blobs(fresh.where(_may_hit(F.col("text"))).groupBy("blob").agg(F.first("text").alias("text")))
    empty = F.expr("cast(array() as array<struct<start:long,kind:int,end:long>>)")
    return fresh.select("blob").distinct().join(found, "blob", "left").select("blob", F.lit(rule_version).alias("rule_version"), F.coalesce("spans", empty).alias("spans"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at path; None where there is none yet."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def record_scans(docs: DataFrame, path: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scans what the ledger at path hasn't seen, appends it there, and returns the ledger.

    A run that dies appends nothing, and the next one scans its blobs again.
    """
    spark = docs.sparkSession
    ledger_update(docs, read_ledger(spark, path), rule_version).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def _with_findings(rows: DataFrame, blob: str, table: DataFrame) -> DataFrame:
    """rows left joined to the table by blob; the rows of a very common content are spread."""
    held = rows.groupBy(blob).agg(F.count("*").alias("rows"))
    return join_spread(rows, table.join(held, blob), blob, "rows", F.monotonically_increasing_id(), "left")


def findings_by_path(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with ``spans`` at the end: those of (blob, spans) joined back to every row with that content; null if none.

    Other columns pass through, whatever their names; a taken ``spans`` has underscores at its end.
    """
    spans, blob = free_names(docs, "spans", "blob")
    table = found.where(F.size("spans") > 0).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    return _with_findings(docs.withColumn(blob, F.sha2(F.coalesce("text", F.lit("")), 256)), blob, table).select(*columns(docs), spans)


def secret_digest(docs: DataFrame, path: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of docs, by way of the ledger at path.

    Contents that the ledger hasn't are scanned and recorded first; findings
    are read from it. Null or empty texts have no spans; texts may be of any
    length; repeated rows and versions of a document each have theirs; other
    columns of docs aren't read.
    """
    docs = docs.select("doc_id", "text")
    known = record_scans(docs, path, rule_version).where((F.col("rule_version") == rule_version) & (F.size("spans") > 0))
    names = F.array(*[F.lit(r[0]) for r in RULES])
    base = sum(r[4] for r in RULES)

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s.kind + 1), F.lit(":"), s.start.cast("string"), F.lit(":"), s.end.cast("string"))), ",")

    def count(kind):
        return F.coalesce(F.size(F.filter("spans", lambda s: s.kind == kind)), F.lit(0)).cast("long")

    # digests are made once a content, before the join back
    made = known.select(
        "blob",
        *[count(k).alias(f"n_{RULES[k][0]}") for k in range(base)],
        F.sha2(text(F.filter("spans", lambda s: s.kind < base)), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
    joined = _with_findings(docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob")), "blob", made)
    return joined.select(
        "doc_id",
        *[F.coalesce(f"n_{RULES[k][0]}", F.lit(0).cast("long")).alias(f"n_{RULES[k][0]}") for k in range(base)],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def _sql() -> str:
    def literal(x):
        return "'" + x.replace("'", "''") + "'"

    parts = []
    for number, (kind, pattern, group, least, _) in enumerate(RULES):
        parts.append(
            f"SELECT r, {number} AS kind, '{kind}' AS name, {least} AS least, unnest(regexp_extract_all(text, {literal(pattern)})) AS m, "
            f"unnest(regexp_extract_all(text, {literal(pattern)}, {group})) AS v, unnest(string_split_regex(text, {literal(pattern)})[:-2]) AS g, "
            f"unnest(range(len(regexp_extract_all(text, {literal(pattern)})))) AS pos FROM d WHERE regexp_matches(text, {literal(pattern)})"
        )
    base = sum(r[4] for r in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(parts)}),
p AS (SELECT *, sum(len(g) + len(m)) OVER (PARTITION BY r, kind ORDER BY pos) AS e FROM m),
s AS (SELECT r, kind, (e - len(m))::BIGINT AS b, name || ':' || (e - len(m))::BIGINT || ':' || e::BIGINT AS t FROM p WHERE len(v) >= least),
a AS (SELECT r, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
  string_agg(t, ',' ORDER BY b, kind) FILTER (kind < {base}) AS base, string_agg(t, ',' ORDER BY b, kind) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""


SECRETS_SQL = _sql()

"""What the queries share: registration, inputs, and the same inputs in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import cohorts, membership, scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CUTOFF, HORIZON = "1998-01-01 00:00:00", 91


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame and the SQL that must give its rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def transactions(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.orders_as_transactions(table(spark, d, "orders"))


def cohort(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.one_cohort(transactions(spark, d), CUTOFF, HORIZON)


def scored(spark: SparkSession, d: str) -> DataFrame:
    df = cohort(spark, d)
    return scoring.score(df, scoring.fit_cutpoints(df))


def fuzzy(spark: SparkSession, d: str, family: str = "piecewise") -> DataFrame:
    df = scored(spark, d)
    return membership.fuzzify(df, membership.band_centroids(df), family)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and counts as bigint, so that engines that add up in another order agree."""
    out = []
    for c, t in df.dtypes:
        x = F.col(f"`{c}`")
        if t in ("double", "float") or t.startswith("decimal"):
            x = F.round(x.cast("double"), digits) + F.lit(0.0)
        elif t in ("int", "smallint", "tinyint"):
            x = x.cast("long")
        out.append(x.alias(c))
    return df.select(*out)


# The same cohort in SQL, as common table expressions.
TX = "tx AS (SELECT o_custkey::VARCHAR AS customer_id, o_orderkey AS invoice, o_orderdate AS ts_, o_totalprice::DECIMAL(18,2) AS v FROM orders)"
COHORT = (
    TX
    + f""", rfm AS (SELECT customer_id, datesub('day', max(ts_), TIMESTAMP '{CUTOFF}') AS R, count(DISTINCT invoice) AS F, sum(v)::DOUBLE AS M
  FROM tx WHERE ts_ <= TIMESTAMP '{CUTOFF}' GROUP BY 1),
hold AS (SELECT customer_id, count(DISTINCT invoice) AS fi, sum(v)::DOUBLE AS fs FROM tx
  WHERE ts_ > TIMESTAMP '{CUTOFF}' AND ts_ <= TIMESTAMP '{CUTOFF}' + INTERVAL {HORIZON} DAY GROUP BY 1),
cohort AS (SELECT rfm.*, coalesce(fi, 0) AS future_invoices, greatest(coalesce(fs, 0), 0) AS future_spend, (coalesce(fi, 0) > 0)::INT AS repurchased
  FROM rfm LEFT JOIN hold USING (customer_id))"""
)
LONG = COHORT + ", l AS (SELECT customer_id, 'R' AS dim, R::DOUBLE AS x FROM cohort UNION ALL SELECT customer_id, 'F', F::DOUBLE FROM cohort UNION ALL SELECT customer_id, 'M', M FROM cohort)"
CUTS = LONG + ", cuts AS (SELECT dim, list_transform(quantile_cont(x, [0.2, 0.4, 0.6, 0.8]), lambda q: round(q, 6)) AS cuts FROM l GROUP BY dim)"
SCORED_LONG = (
    CUTS
    + """, s AS (SELECT customer_id, dim, x, CASE WHEN dim = 'R' THEN 5 - len(list_filter(cuts, lambda c: x > c)) ELSE 1 + len(list_filter(cuts, lambda c: x > c)) END AS s
  FROM l JOIN cuts USING (dim)),
scored AS (SELECT cohort.*, max(s.s) FILTER (dim = 'R') AS R_score, max(s.s) FILTER (dim = 'F') AS F_score, max(s.s) FILTER (dim = 'M') AS M_score
  FROM cohort JOIN s USING (customer_id) GROUP BY ALL)"""
)
CENTROIDS = (
    SCORED_LONG
    + """, bands AS (SELECT dim, unnest(range(1, 6)) AS band FROM (SELECT DISTINCT dim FROM l)),
med AS (SELECT dim, s AS band, median(x) AS m FROM s GROUP BY 1, 2), allmed AS (SELECT dim, median(x) AS m FROM l GROUP BY 1),
cen AS (SELECT dim, band, coalesce(med.m, allmed.m) AS c FROM bands LEFT JOIN med USING (dim, band) JOIN allmed USING (dim)),
pos AS (SELECT dim, band, c, lag(c) OVER w AS lo, lead(c) OVER w AS hi, row_number() OVER w AS p FROM cen
  WINDOW w AS (PARTITION BY dim ORDER BY c, CASE WHEN dim = 'R' THEN -band ELSE band END))"""
)
MU = (
    CENTROIDS
    + """, mu AS (SELECT customer_id, dim, band, round(greatest(0.0, least(1.0, CASE WHEN lo IS NULL OR (hi IS NULL AND x >= c) THEN 1.0 ELSE (x - lo) / (CASE WHEN c = lo THEN 1e-9 ELSE c - lo END) END,
  CASE WHEN hi IS NULL OR (lo IS NULL AND x <= c) THEN 1.0 ELSE (hi - x) / (CASE WHEN hi = c THEN 1e-9 ELSE hi - c END) END)), 9) AS mu FROM l JOIN pos USING (dim)),
mus AS (SELECT customer_id, list(mu ORDER BY band) FILTER (dim = 'R') AS R_mu, list(mu ORDER BY band) FILTER (dim = 'F') AS F_mu,
  list(mu ORDER BY band) FILTER (dim = 'M') AS M_mu FROM mu GROUP BY customer_id)"""
)


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes}{select}" if select.lstrip().startswith(",") else f"WITH {ctes}\n{select}"


#: Crisp concepts of the cohort at {cut}, projected on its customers: proj (customer_id, m, mu), and percent ranks: pct.
CRISP_COHORT = """c0 AS (SELECT o_custkey::VARCHAR AS customer_id, datesub('day', max(o_orderdate), TIMESTAMP '{cut}') AS R, count(DISTINCT o_orderkey) AS F, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS M
  FROM orders WHERE o_orderdate <= TIMESTAMP '{cut}' GROUP BY 1),
q0 AS (SELECT list_transform(quantile_cont(R::DOUBLE, [0.2, 0.4, 0.6, 0.8]), lambda v: round(v, 6)) AS qr, list_transform(quantile_cont(F::DOUBLE, [0.2, 0.4, 0.6, 0.8]), lambda v: round(v, 6)) AS qf,
  list_transform(quantile_cont(M, [0.2, 0.4, 0.6, 0.8]), lambda v: round(v, 6)) AS qm FROM c0),
k0 AS (SELECT customer_id, 4 - len(list_filter(qr, lambda c: R::DOUBLE > c)) AS rs, 5 + len(list_filter(qf, lambda c: F::DOUBLE > c)) AS fs, 10 + len(list_filter(qm, lambda c: M::DOUBLE > c)) AS ms FROM c0, q0),
m0 AS (SELECT customer_id, ((1 << rs) + (1 << fs) + (1 << ms))::BIGINT AS mask, rs, fs, ms FROM k0),
cb AS (SELECT count(*) AS n, bit_and(mask) AS m FROM m0 GROUP BY CUBE (rs, fs, ms)),
cn AS (SELECT DISTINCT m FROM cb WHERE n >= 0.04 * (SELECT count(*) FROM m0) AND m <> 0),
proj AS (SELECT customer_id, m, 1.0::DOUBLE AS mu FROM m0 JOIN cn ON (mask & m) = m),
pct AS (SELECT customer_id, (rank() OVER (ORDER BY R) + (count(*) OVER (PARTITION BY R) - 1) / 2) / count(*) OVER () AS R, (rank() OVER (ORDER BY F) + (count(*) OVER (PARTITION BY F) - 1) / 2) / count(*) OVER () AS F,
  (rank() OVER (ORDER BY M) + (count(*) OVER (PARTITION BY M) - 1) / 2) / count(*) OVER () AS M FROM c0)"""

"""Recency, frequency and monetary value of customers at observation cutoffs, and what they do next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def money(c: Column) -> Column:
    """Sums of money are exact: decimals inside, a double at the end."""
    return F.sum(c.cast(MONEY)).cast("double")


def orders_as_transactions(orders: DataFrame) -> DataFrame:
    """(customer_id, invoice, at, value) of order headers."""
    return orders.select(F.col("o_custkey").cast("string").alias("customer_id"), F.col("o_orderkey").alias("invoice"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").cast(MONEY).alias("value"))


def clean_lines(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Order lines as transactions: with customer, of positive quantity and price, not cancelled."""
    lines = lineitem.where((F.col("l_quantity") > 0) & (F.col("l_extendedprice") > 0) & (F.col("l_returnflag") != "R"))
    value = (F.col("l_extendedprice").cast(MONEY) * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)")
    return lines.join(orders.where(F.col("o_custkey").isNotNull()), lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").cast("string").alias("customer_id"), F.col("o_orderkey").alias("invoice"), F.col("o_orderdate").alias("at"), value.alias("value")
    )


def aggregate_rfm(tx: DataFrame, ref: str) -> DataFrame:
    """R: full days from the last transaction to ref; F: distinct invoices; M: sum of value."""
    return tx.groupBy("customer_id").agg(
        F.timestamp_diff("DAY", F.max("at"), F.lit(ref).cast("timestamp_ntz")).alias("R"),
        F.countDistinct("invoice").alias("F"),
        money(F.col("value")).alias("M"),
    )


def build_cohorts(tx: DataFrame, origins: DataFrame, by_day: bool = False) -> DataFrame:
    """One long frame of cohorts, keyed by (origin, pooled), over origins (origin, cutoff, horizon, pooled).

    Each transaction meets the few origins once and is either before the
    cutoff, in the holdout after it, or neither; observation and outcome come
    from one aggregation. Customers without an observation drop out. With
    ``by_day`` the time axis is a number of days.
    """
    end = F.col("cutoff") + F.col("horizon") if by_day else F.col("cutoff") + F.make_dt_interval(F.col("horizon"))
    seen, later = F.col("at") <= F.col("cutoff"), (F.col("at") > F.col("cutoff")) & (F.col("at") <= end)
    met = tx.join(F.broadcast(origins), F.col("at") <= end)
    days = F.col("cutoff") - F.max(F.when(seen, F.col("at"))) if by_day else F.timestamp_diff("DAY", F.max(F.when(seen, F.col("at"))), F.col("cutoff"))
    out = met.groupBy("origin", "pooled", "cutoff", "customer_id").agg(
        days.cast("long").alias("R"),
        F.countDistinct(F.when(seen, F.col("invoice"))).alias("F"),
        money(F.when(seen, F.col("value"))).alias("M"),
        F.countDistinct(F.when(later, F.col("invoice"))).alias("future_invoices"),
        F.coalesce(money(F.when(later, F.col("value"))), F.lit(0.0)).alias("future_spend"),
    )
    out = out.where(F.col("R").isNotNull()).withColumn("future_spend", F.greatest("future_spend", F.lit(0.0)))
    return out.withColumn("repurchased", (F.col("future_invoices") > 0).cast("int")).drop("cutoff")


def one_cohort(tx: DataFrame, cutoff: str = "1998-01-01", horizon: int = 91) -> DataFrame:
    """The cohort of a single cutoff."""
    spark = tx.sparkSession
    origin = spark.range(1).select(F.lit(cutoff[:10]).alias("origin"), F.lit(cutoff).cast("timestamp_ntz").alias("cutoff"), F.lit(horizon).alias("horizon"), F.lit(True).alias("pooled"))
    return build_cohorts(tx, origin).drop("origin", "pooled")


def with_tenure(tx: DataFrame) -> DataFrame:
    """First, last, orders, value and days from first to last transaction."""
    return tx.groupBy("customer_id").agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.countDistinct("invoice").alias("orders"), money(F.col("value")).alias("value"),
        F.timestamp_diff("DAY", F.min("at"), F.max("at")).alias("tenure"),
    )


def audit(tx: DataFrame) -> DataFrame:
    """One row: rows, distinct customers and invoices, nulls, repeated rows, time span."""
    repeated = tx.groupBy(*tx.columns).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_rows"))
    main = tx.agg(
        F.count("*").alias("n_rows"), F.countDistinct("customer_id").alias("customers"), F.countDistinct("invoice").alias("invoices"),
        F.count_if(F.col("customer_id").isNull() | F.col("value").isNull()).alias("nulls"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
    )
    return main.crossJoin(F.broadcast(repeated))

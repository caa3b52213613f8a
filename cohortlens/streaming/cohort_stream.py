"""Customer state kept up to date from a stream of transactions (customer_id, invoice, at, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_totals(tx: DataFrame) -> DataFrame:
    """(customer_id, first_at, last_at, orders, value) so far, for update mode. An order comes as one row."""
    return tx.groupBy("customer_id").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("orders"), F.sum(F.col("value").cast("decimal(18,2)")).alias("value"))


def windowed_value(tx: DataFrame, window: str = "7 days", late: str = "1 day") -> DataFrame:
    """(start, customer_id, orders, value) of tumbling windows, final once the watermark has passed them; an order counts once."""
    once = tx.withWatermark("at", late).dropDuplicatesWithinWatermark(["invoice"])
    return once.groupBy(F.window("at", window), "customer_id").agg(F.count("*").alias("orders"), F.sum(F.col("value").cast("decimal(18,2)")).alias("value")).select("window.start", "customer_id", "orders", "value")


def upsert_state(batch: DataFrame, state: DataFrame) -> DataFrame:
    """The running totals of state joined with those of a further batch of orders: what a foreachBatch sink writes back."""
    both = state.unionByName(running_totals(batch))
    return both.groupBy("customer_id").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("orders").alias("orders"), F.sum("value").cast("decimal(28,2)").alias("value"))


def recency(state: DataFrame, ref: str) -> DataFrame:
    """(customer_id, R, F, M) at ref of a state of running totals."""
    return state.select("customer_id", F.timestamp_diff("DAY", F.col("last_at"), F.lit(ref).cast("timestamp")).alias("R"), F.col("orders").alias("F"), F.col("value").cast("double").alias("M"))

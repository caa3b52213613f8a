"""Readers of raw transaction files and writers of results."""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RETAIL_SCHEMA = "InvoiceNo string, StockCode string, Description string, Quantity int, InvoiceDate timestamp_ntz, UnitPrice double, CustomerID double, Country string"
GROCERY_SCHEMA = "household_key long, BASKET_ID long, DAY int, PRODUCT_ID long, QUANTITY int, SALES_VALUE double"


def retail_lines(spark: SparkSession, paths: list[str], schema: str = RETAIL_SCHEMA, timestamps: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """(customer_id, invoice, at, value) of retail CSV files, a byte-order mark allowed: lines with customer, of positive
    quantity and price, not cancelled (invoice numbers with a leading C)."""
    raw = spark.read.option("timestampNTZFormat", timestamps).csv(paths, header=True, schema=schema)
    lines = raw.where("CustomerID IS NOT NULL AND Quantity > 0 AND UnitPrice > 0 AND NOT startswith(InvoiceNo, 'C')")
    value = (F.col("Quantity") * F.col("UnitPrice").cast("decimal(18,4)")).cast("decimal(18,4)")
    return lines.select(F.col("CustomerID").cast("long").cast("string").alias("customer_id"), F.regexp_replace("InvoiceNo", "^﻿", "").alias("invoice"), F.col("InvoiceDate").alias("at"), value.alias("value"))


def grocery_baskets(spark: SparkSession, path: str) -> DataFrame:
    """(customer_id, invoice, at, value) of a grocery CSV; time is a day number. Only the four columns used are parsed."""
    rows = spark.read.csv(path, header=True, schema=GROCERY_SCHEMA).select("household_key", "BASKET_ID", "DAY", "SALES_VALUE")
    return rows.select(F.col("household_key").cast("string").alias("customer_id"), F.col("BASKET_ID").alias("invoice"), F.col("DAY").alias("at"), F.col("SALES_VALUE").cast("decimal(18,2)").alias("value"))


def music_purchases(spark: SparkSession, path: str) -> DataFrame:
    """(customer_id, invoice, at, value) of headerless lines "customer yyyyMMdd count dollars"; an invoice is a customer's day; only dollars > 0."""
    return parse_purchases(spark.read.text(path))


def parse_purchases(lines: DataFrame) -> DataFrame:
    """The purchases in lines (value) of white-space separated fields."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.trim("value") != "").select(parts.alias("p"))
    rows = rows.select(F.get("p", F.lit(0)).alias("customer_id"), F.to_date(F.get("p", F.lit(1)), "yyyyMMdd").alias("at"), F.get("p", F.lit(3)).cast("decimal(18,2)").alias("value"))
    return rows.where("value > 0").withColumn("invoice", F.col("at")).select("customer_id", "invoice", "at", "value")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files that match."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def confined(base: str, sub: str) -> str:
    """A folder below base; anything that leads out of it raises."""
    if sub.startswith("/") or ":" in sub:
        raise ValueError(f"{sub} isn't a folder below {base}")
    inside = posixpath.normpath(sub)
    if inside in (".", "..") or inside.startswith("../"):
        raise ValueError(f"{sub} isn't a folder below {base}")
    return f"{base.rstrip('/')}/{inside}"


def write_new(df: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    """Writes to a folder that mustn't exist yet."""
    df.write.mode("errorifexists").options(**options).format(kind).save(path)


def write_csv(df: DataFrame, path: str) -> None:
    write_new(df, path, "csv", header=True)


def write_parameters(spark: SparkSession, path: str, parameters: dict) -> None:
    """One JSON line of run parameters."""
    write_new(spark.createDataFrame([(json.dumps(parameters, sort_keys=True),)], "value string"), path, "text")


def markdown(df: DataFrame, rows: int = 200, floats: str = "%.4f", padded: bool = False) -> str:
    """A small result as a Markdown table; more than ``rows`` rows raise."""
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"more than {rows} rows are no table for a report")
    text = [list(df.columns), *([("" if v is None else floats % v if isinstance(v, float) else str(v)).replace("|", "\\|") for v in r] for r in found)]
    width = [max(len(r[i]) for r in text) if padded else 0 for i in range(len(df.columns))]
    line = lambda r: "| " + " | ".join(c.ljust(w) for c, w in zip(r, width, strict=True)) + " |"
    return "\n".join([line(text[0]), "|" + "|".join("-" * (w + 2 if padded else 3) for w in width) + "|", *map(line, text[1:])])


def write_report(spark: SparkSession, path: str, title: str, sections: list[tuple[str, DataFrame | str]], floats: str = "%.4f") -> None:
    """A Markdown report of a title and sections, each a heading over a small table or a text, as one text file that must not exist."""
    parts = [f"# {title}", *(f"## {heading}\n\n{body if isinstance(body, str) else markdown(body, floats=floats)}" for heading, body in sections)]
    write_new(spark.createDataFrame([("\n\n".join(parts),)], "value string"), path, "text")


def append_missing(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Appends the rows whose keys the table at path lacks, partitioned by the first key, and returns the table.

    A study that was cut short goes on where it ended.
    """
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        rows = rows.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    rows.write.mode("append").partitionBy(keys[0]).parquet(path)
    return spark.read.parquet(path)

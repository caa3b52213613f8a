"""A stream of orders gives the totals that a batch gives."""

from datetime import datetime

from cohortlens.streaming import cohort_stream

SCHEMA = "customer_id string, invoice long, at timestamp, value double"


def test_stream_equals_batch(spark, tmp_path):
    rows = [("ab"[i % 2], i, datetime(2020, 1, 1 + i), 1.5 * i) for i in range(20)]
    folder = str(tmp_path / "in")
    for part in (rows[:12], rows[12:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    q = cohort_stream.running_totals(stream).writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    batch = cohort_stream.running_totals(spark.createDataFrame(rows, SCHEMA))
    assert sorted(spark.table("totals").collect()) == sorted(batch.collect())
    merged = cohort_stream.upsert_state(spark.createDataFrame(rows[12:], SCHEMA), cohort_stream.running_totals(spark.createDataFrame(rows[:12], SCHEMA)))
    assert sorted(map(str, merged.collect())) == sorted(map(str, batch.collect()))
    assert {r.customer_id: r.R for r in cohort_stream.recency(batch, "2020-01-21 00:00:00").collect()} == {"a": 2, "b": 1}


def test_windows_close_behind_the_watermark(spark, tmp_path):
    rows = [("a", 1, datetime(2020, 1, 2), 2.0), ("a", 1, datetime(2020, 1, 2), 2.0), ("a", 2, datetime(2020, 1, 3), 3.0), ("a", 3, datetime(2020, 3, 1), 1.0)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    q = cohort_stream.windowed_value(stream).writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.orders, float(r.value)) for r in spark.table("windows").collect()] == [(2, 5.0)]

"""Readers, writers and result tables."""

import pytest

from cohortlens.operators import evidence
from cohortlens.sources import files


def test_retail_lines_are_cleaned(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    head = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"
    a.write_text("﻿" + head + "1,s,d,2,2020-01-01 10:00:00,1.50,17.0,UK\nC2,s,d,1,2020-01-01 10:00:00,1.5,17.0,UK\n3,s,d,-1,2020-01-01 10:00:00,1.5,17.0,UK\n", encoding="utf-8")
    b.write_text(head + "4,s,d,1,2020-01-02 10:00:00,0,17.0,UK\n5,s,d,1,2020-01-02 10:00:00,2.25,,UK\n6,s,d,4,2020-01-03 10:00:00,2.25,18.0,UK\n")
    got = sorted((r.customer_id, r.invoice, float(r.value)) for r in files.retail_lines(spark, [str(a), str(b)]).collect())
    assert got == [("17", "1", 3.0), ("18", "6", 9.0)]


def test_grocery_and_music(spark, tmp_path):
    g = tmp_path / "g.csv"
    g.write_text("household_key,BASKET_ID,DAY,PRODUCT_ID,QUANTITY,SALES_VALUE\n1,10,5,7,1,2.50\n")
    row = files.grocery_baskets(spark, str(g)).first()
    assert (row.customer_id, row.invoice, row.at, float(row.value)) == ("1", 10, 5, 2.5)
    m = tmp_path / "m.txt"
    m.write_text(" 00001 19970101  1   11.77\n 00002 19970112  5    0.00\n\n")
    rows = files.music_purchases(spark, str(m)).collect()
    assert len(rows) == 1 and rows[0].customer_id == "00001" and str(rows[0].at) == "1997-01-01"


def test_writers_refuse_and_confine(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b", 0.5)], "k long, s string, v double")
    files.write_csv(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_csv(df, str(tmp_path / "out"))
    assert files.confined("/base/", "runs/one") == "/base/runs/one"
    for bad in ("../x", "/etc", "a/../../b", "s3://x", "."):
        with pytest.raises(ValueError):
            files.confined("/base", bad)
    assert files.markdown(df) == "| k | s | v |\n|---|---|---|\n| 1 | a\\|b | 0.5000 |"
    with pytest.raises(ValueError):
        files.markdown(spark.range(5), rows=3)


def test_resume_appends_what_is_missing(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0.1), ("a", 2, 0.2), ("b", 1, 0.3)], "dataset string, origin long, v double")
    path = str(tmp_path / "t")
    files.append_missing(rows.limit(2), path, ["dataset", "origin"])
    assert files.append_missing(rows, path, ["dataset", "origin"]).count() == 3
    assert files.append_missing(rows, path, ["dataset", "origin"]).count() == 3


def test_parity_guard(spark):
    one = spark.createDataFrame([("d", "o", "a", 0.5, 0.4, 0.3)], "dataset string, origin string, arm string, auc double, spend_r2 double, invoice_r2 double")
    other = one.withColumn("auc", one["auc"] + 1e-6)
    keys = ["dataset", "origin", "arm"]
    assert all(r.ok for r in evidence.guard(evidence.parity(one, one, keys)).collect())
    with pytest.raises(Exception, match="not reproduced"):
        evidence.guard(evidence.parity(one, other, keys)).collect()
    assert {r.metric for r in evidence.parity(one, one.limit(0), keys).where("missing > 0").collect()} == set(evidence.METRICS)

"""Hashed draws against hashlib and Spark's own functions, and resampling in parts against plain code."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import draws
from cohortlens.operators import inference


def head(b, slot, seed):
    return int(hashlib.md5(f"{b}|{slot}|{seed}".encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("low, high, first, seed", [(0, 1203, 0, 7), (95, 1105, 8, 12345), (99_990, 100_020, 998, 12345), (1 << 20, (1 << 20) + 3, 1996, 7)])
def test_md5_heads_are_those_of_hashlib(low, high, first, seed):
    got = draws.md5_heads(range(first, first + 4), low, high, seed)
    assert got.tolist() == [[head(b, slot, seed) for slot in range(low, high)] for b in range(first, first + 4)]


def test_long_keys_are_refused():
    with pytest.raises(ValueError, match="55 bytes"):
        draws.md5_heads(range(2), 0, 5, 10**60)


@pytest.mark.parametrize("window, slots", [(1 << 23, 1 << 20), (1024, 300)])
def test_counts_in_windows_and_parts(spark, monkeypatch, window, slots):
    monkeypatch.setattr(draws, "WINDOW", window)
    monkeypatch.setattr(draws, "SLOTS", slots)
    groups = spark.createDataFrame([(1, 3), (2, 2500), (3, 1)], "g long, n long")
    rows = draws.draw_counts(groups, 6, 7, 512, 2504).collect()
    for g, n in ((1, 3), (2, 2500), (3, 1)):
        whole = np.zeros((6, -(-n // 512) * 512), int)
        for r in rows:
            if r.g == g:
                first, w = draws.weights_of(r.block, bytes(r.w), 6, 512)
                whole[first : first + len(w), r.chunk * 512 : (r.chunk + 1) * 512] += w
        want = np.stack([np.bincount([head(b, i, 7) % n for i in range(n)], minlength=whole.shape[1]) for b in range(6)])
        assert (whole == want).all()


def test_sums_of_draws_meet_their_rows(spark, monkeypatch):
    monkeypatch.setattr(inference, "SUM_CHUNK", 16)
    rows = [(f"c{i:03}", o, float(i * i % 17)) for i in range(50) for o in ("a", "b") if o == "a" or i % 3]
    got = inference.draw_sums(spark.createDataFrame(rows, "customer_id string, o string, v double"), 7, 5, {"v": F.col("v")}, ["o"])
    want = {}
    for b in range(7):
        for slot in range(50):
            for c, o, v in rows:
                if c == f"c{head(b, slot, 5) % 50:03}":
                    n, total = want.get((o, b), (0, 0))
                    want[o, b] = n + 1, total + v
    assert {(r.o, r.b): (r.w, r.v) for r in got.collect()} == want


def test_means_of_splits_keep_groups_without_key(spark):
    rows = [(None, i, float(i)) for i in range(9)] + [(4, 1, 2.0), (4, 2, None)]
    got = {(r.g, r.b): r.m for r in inference.split_means(spark.createDataFrame(rows, "g int, s int, v double"), "v", ["g"], "s", b=3, seed=7).collect()}
    assert {b: got[None, b] for b in range(3)} == pytest.approx({b: np.mean([head(b, i, 7) % 9 for i in range(9)]) for b in range(3)})
    assert len(got) == 6 and all(got[4, b] in (2.0, None) for b in range(3))


def test_sampled_patterns_are_those_of_spark(spark, monkeypatch):
    monkeypatch.setattr(inference, "SUM_CHUNK", 8)
    values = [((i * 37) % 23 - 10) / 4 for i in range(30)]
    got = inference.sign_flip_p(spark.createDataFrame([(None, v) for v in values], "g int, v double"), "v", ["g"], draws=300, seed=42).first()
    bits = spark.range(300).selectExpr("cast(id as int) AS p").crossJoin(spark.range(30).selectExpr("cast(id as int) AS i")).select("p", "i", F.xxhash64("p", "i", F.lit(42)).bitwiseAND(1).alias("bit"))
    sums = np.zeros(300)
    for r in bits.collect():
        sums[r.p] += (-1) ** r.bit * sorted(values)[r.i]
    assert got.g is None and got.n == 30 and got.p == (np.sum(np.abs(sums) >= abs(sum(values))) + 1) / 301

"""Multi-index hashing against brute force: every code within a radius, exact ranks where all are wanted, recall, odd vectors."""

import numpy as np
import pytest

from cohortlens.llm import hamming

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0.5) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k=20, every=20):
    fine = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine[i, tuple(np.float32(v))] = None
    dims = max((len(v) for _, v in fine), default=0)
    ids = np.array([i for i, _ in fine], np.int64)
    x = np.zeros((len(fine), dims))
    for r, (_, v) in enumerate(fine):
        x[r, : len(v)] = v
    out = []
    for r in np.flatnonzero(ids % every == 0):
        score = np.zeros(len(ids))
        for d in range(dims):
            score += x[r, d] * x[:, d]
        other = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[r]][:k]
        out += [(int(ids[r]), n + 1, int(ids[j]), float(score[j])) for n, j in enumerate(other)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))


def test_radii_of_tables_leave_no_code_out():
    rng = np.random.default_rng(0)
    for radius in (0, 5, 14, 15, 16, 100, 203, 512):
        radii = hamming.table_radii(np.array([radius]))[0]
        for _ in range(300):
            each = np.bincount(rng.integers(0, 16, radius), minlength=16)
            assert (each <= radii).any()
        assert (radii + 1).sum() == radius + 1  # and none is larger than needed


@pytest.mark.parametrize("cell", [2, 50_000])
def test_every_code_within_the_radius_is_found_once(spark, monkeypatch, cell):
    monkeypatch.setattr(hamming, "CELL", cell)
    monkeypatch.setattr(hamming, "CODES", 7)
    monkeypatch.setattr(hamming, "ASKING", 3)
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**31), 2**31, (4, 16)).astype(np.int32)
    code = base[rng.integers(0, 4, 60)] ^ np.where(rng.random((60, 16)) < 0.3, 1 << rng.integers(0, 31, (60, 16)), 0).astype(np.int32)
    codes = spark.createDataFrame([(0, i, 1, c.tolist()) for i, c in enumerate(code)], "band int, ck long, n long, code array<int>")
    asking = [(i, i, 0, [-1, 2][i % 2], [3, 250, 512][i % 3], code[i].tolist()) for i in range(12)]
    got = hamming.code_pairs(codes, spark.createDataFrame(asking, "ka long, kb long, band int, least int, r int, code array<int>"), len(code))
    d = np.bitwise_count((code[:, None] ^ code[None]).view(np.uint32)).sum(axis=2)
    want = sorted((a, j) for a, _, _, least, r, _ in asking for j in range(60) if least < d[a, j] <= r)
    assert sorted((r.ka, r.ck) for r in got.collect()) == want


def test_few_vectors_are_ranked_exactly(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(6).round(1).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(45)]  # copies of one vector, more than are asked for
    rows += [(300 + i, [x * s for x in rows[i][1]]) for i, s in enumerate((100.0, 1e-3, -5.0))]  # other lengths
    rows += [(420, None), (440, []), (460, [0.0] * 6), (480, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (500, [float("nan")] * 6), (520, [float("inf")] * 6), (None, [1.0] * 6), (540, [1.0, 2.0]), rows[3], rows[3], rows[20]]
    assert len(rows) < hamming.WANTED
    assert found(hamming.neighbour_digest(frame(spark, rows))) == brute(rows)


def test_vectors_of_one_code_are_met_in_parts(spark, monkeypatch):
    monkeypatch.setattr(hamming, "SAME_CODE", 10)
    monkeypatch.setattr(hamming, "WANTED", 30)
    monkeypatch.setattr(hamming, "AIM", 40)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(8)
    rows = [(i, (centre + 1e-5 * rng.standard_normal(8)).tolist()) for i in range(130)] + [(i, rng.standard_normal(8).tolist()) for i in range(130, 200)]
    got, want = found(hamming.neighbour_digest(frame(spark, rows), k=5)), brute(rows, k=5)
    tight = {q for q, *_ in want if q < 130}
    assert [r for r in got if r[0] in tight] == [r for r in want if r[0] in tight]


def test_recall_on_random_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = found(hamming.neighbour_digest(frame(spark, rows))), brute(rows)
    assert len(got) == len(want) == 4000
    hits = {r[0:1] + r[2:3] for r in got} & {r[0:1] + r[2:3] for r in want}
    assert len(hits) >= 0.95 * len(want)
    score = {(q, v): s for q, _, v, s in want}
    assert all(score.get((q, v), s) == s for q, _, v, s in got)


def test_empty_and_single(spark):
    assert found(hamming.neighbour_digest(frame(spark, [(20, [1.0, 0.0])]))) == []
    assert found(hamming.neighbour_digest(frame(spark, [(1, [1.0, 0.0])]))) == []
    assert hamming.neighbour_digest(frame(spark, [(1, None)]).where("false")).collect() == []

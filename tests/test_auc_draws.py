"""Areas of draws by ranges of scores, with scores that fill ranges, against all pairs; packed weights."""

import numpy as np
import pytest

from cohortlens.operators import bootstrap


def test_packed_weights_come_back_in_a_third_of_a_byte_each():
    w = np.random.default_rng(1).poisson(1, (40, 2001))
    codes, above = bootstrap.packed_weights(w)
    assert codes.nbytes + sum(map(len, above)) < w.size * 0.36
    assert (bootstrap.unpacked_weights([x.tobytes() for x in codes], above, 2001) == w).all()
    w[3, 5] = 70_000
    codes, above = bootstrap.packed_weights(w)
    assert (bootstrap.unpacked_weights([x.tobytes() for x in codes], above, 2001) == w).all()


@pytest.mark.parametrize("range_rows", [8192, 9])
def test_ranges_give_the_areas_of_all_pairs(spark, monkeypatch, range_rows):
    for name, value in (("LEAF", 16), ("RANGE_ROWS", range_rows), ("CHUNK", 7), ("DRAWS", 4)):
        monkeypatch.setattr(bootstrap, name, value)
    rng = np.random.default_rng(3)
    rows = [(seed, arm, f"c{i:03d}", int(rng.random() < 0.4), 0.5 if arm == "a" and i % 3 else float(np.round(rng.random(), 2))) for seed in (0, 1) for arm in "ab" for i in range(120 - 20 * seed)]
    df = spark.createDataFrame(rows, "seed int, arm string, customer_id string, repurchased int, prob double").repartition(5)
    tree = bootstrap.WeightTree(120, 6, 9)
    w = np.concatenate([tree.weights(i) for i in range(tree.leaves)])
    got = {(r.seed, r.arm, r.b): r.auc for r in bootstrap.auc_draws(df, 6, 9, ["seed", "arm"]).collect()}
    assert len(got) == 4 * 6
    for seed, arm, b in got:
        own = [(w[int(r[2][1:]), b], r[3], r[4]) for r in rows if r[:2] == (seed, arm)]
        k, y, s = map(np.array, zip(*own, strict=True))
        pairs = ((s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0])) * k[y == 1][:, None] * k[y == 0]
        assert got[seed, arm, b] == pytest.approx(pairs.sum() / (k[y == 1].sum() * k[y == 0].sum()), abs=1e-12)

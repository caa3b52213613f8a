"""Ward's method by rounds against the chain of nearest neighbours."""

import numpy as np
import pytest

from cohortlens.operators import clustering


@pytest.mark.parametrize("most_on_driver", [20_000, 100])
def test_rounds_give_the_clusters_of_the_chain(spark, monkeypatch, most_on_driver):
    monkeypatch.setattr(clustering, "ON_DRIVER", most_on_driver)
    monkeypatch.setattr(clustering, "BLOCK", 32)
    rng = np.random.default_rng(3)
    x, w = np.round(rng.random((1500, 3)) ** 2, 6), rng.integers(1, 9, 1500)
    for k in (1, 2, 4, 9, 200):
        assert np.array_equal(clustering._ward_rounds(spark, x, w, k), clustering._ward_tree(x, w, k))


def test_many_points_need_no_work_of_their_square(spark):
    """100,000 points take some 10^10 distances and minutes by the chain."""
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0, 0], [5, 0, 0], [0, 5, 0], [0, 0, 5.0]])
    own = rng.integers(0, 4, 100_000)
    labels = clustering._ward_rounds(spark, centres[own] + rng.normal(0, 0.3, (100_000, 3)), np.ones(100_000), 4)
    assert len({(int(a), int(b)) for a, b in zip(own, labels)}) == 4

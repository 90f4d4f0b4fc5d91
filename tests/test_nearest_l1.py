"""Sums of absolute differences in single precision choose candidates; results are exact."""

import numpy as np

from shapelake.operators import spatial as sp


def test_rough_distances_are_within_their_bound():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(70, 64)), 1000 + rng.normal(size=(90, 64))
    for p in (a, b):
        near, wrong = sp.rough(a, p, "l1")
        assert near.dtype == np.float32 and (np.abs(near - sp.between(a, p, "l1")) <= wrong[:, None]).all()
    b[4, 2] = np.nan
    assert np.array_equal(sp.rough(a, b, "l1")[0], sp.between(a, b, "l1"), equal_nan=True)

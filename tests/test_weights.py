"""The learnt filter counts merged rows and does not repeat them."""

import numpy as np

from marlstone.operators import learn as L


def test_weights_take_counts():
    rnd = np.random.default_rng(3)
    x, y, k = np.column_stack([np.ones(12), rnd.random((12, 2))]), (rnd.random(12) < 0.5).astype(float), rnd.integers(1, 9, 12)
    assert np.allclose(L.fit(x, y, k.astype(float)), L.fit(np.repeat(x, k, axis=0), np.repeat(y, k)), atol=1e-12)

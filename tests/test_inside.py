"""Pairs inside components: many small matrices at once."""

import numpy as np
import pytest

from arcloom.functions.semiring import BOOLEAN, LOG, PROBABILITY, TROPICAL


@pytest.mark.parametrize("ring", [BOOLEAN, LOG, PROBABILITY, TROPICAL], ids=lambda r: r.name)
def test_many_matrices_close_as_each_does(ring):
    rng = np.random.default_rng(5)
    there, x = rng.random((7, 6, 6)) < 0.4, rng.random((7, 6, 6)) * 0.1
    a = there if ring is BOOLEAN else np.where(there, np.log(x) if ring is LOG else x, ring.zero)
    for own, closed in zip(a, ring.closed_all_(a), strict=True):
        np.testing.assert_allclose(closed, ring.closed_(own), rtol=1e-12)

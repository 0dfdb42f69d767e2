"""The nearest of a tile of distances, without putting whole rows in order."""

from __future__ import annotations

import numpy as np
import pytest

from quillspark.operators import clustering


@pytest.mark.parametrize(("n", "k", "levels"), [(50, 10, 4), (50, 10, 10**9), (5, 10, 3), (10, 10, 3), (1, 1, 1)])
def test_same_as_a_stable_sort(n, k, levels):
    rng = np.random.default_rng(5)
    d = rng.integers(0, levels, (30, n)) / 7
    d[np.arange(min(n, 30)), np.arange(min(n, 30))] = np.inf
    best = np.argsort(d, axis=1, kind="stable")[:, :k]
    kept = np.take_along_axis(d, best, axis=1)
    row, column, value = clustering._smallest(d, k)
    finite = np.isfinite(kept)
    assert row.tolist() == np.nonzero(finite)[0].tolist() and column.tolist() == best[finite].tolist() and value.tolist() == kept[finite].tolist()

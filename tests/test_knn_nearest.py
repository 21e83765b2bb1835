"""The k nearest of a block: equal to sorting all exact distances, with ties and far from the origin."""

import numpy as np
import pytest

from tessera.operators import knn as K


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("shift,grid", [(0.0, False), (0.0, True), (1e6, False), (1e6, True)])
def test_equals_a_stable_sort(p, shift, grid, monkeypatch):
    monkeypatch.setattr(K, "CELL_ELEMENTS", 2000)
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 3, (n, 4)).astype(float) if grid else rng.normal(size=(n, 4)) for n in (70, 90))
    a, b = a + shift, b + shift
    b[10:14] = a[5]
    want = K.distances(a, b, p)
    for k in (1, 5, 200):
        for upper in (np.full(70, np.inf), np.linspace(0, 3, 70)):
            order = np.argsort(want, axis=1, kind="stable")[:, :k]
            keep = [(i, j, want[i, j]) for i in range(70) for j in order[i].tolist() if want[i, j] <= upper[i]]
            got = list(zip(*(v.tolist() for v in K.nearest(a, b, k, p, upper))))
            assert got == keep


def test_no_distance_matrix_is_sorted(monkeypatch):
    called = []
    monkeypatch.setattr(K, "distances", lambda *_: called.append(1))
    K.nearest(np.eye(4), np.eye(4), 2, 2, np.full(4, np.inf))
    assert not called

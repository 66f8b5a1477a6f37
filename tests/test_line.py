"""Nearest rows by one feature against the block search."""

import numpy as np
import pytest

from siftgraph.operators import knn
from siftgraph.operators.leaves import Leaves


@pytest.mark.parametrize("kind", ["plain", "few values", "pairs of values", "far apart", "constant"])
@pytest.mark.parametrize("n", [0, 1, 7, 900])
def test_singles_against_the_block_search(kind, n):
    rng = np.random.default_rng(n)
    x = {"plain": rng.random(n), "few values": rng.integers(0, 9, n) / 7, "pairs of values": rng.integers(0, n // 2 + 1, n) * 1.0, "far apart": rng.random(n) * 1e-3 + rng.integers(0, 2, n) * 1e13, "constant": np.ones(n)}[kind]
    if kind == "far apart" and n > 7:
        x[x > 1] = 1e13 + rng.random((x > 1).sum())
        x[3] = 5e12
    m = knn.Matrix(x[:, None], rng.integers(0, 4, n), rng.integers(0, 5, n), rng.permutation(n))
    b = m.block([0])
    for apparent in (False, True):
        hits = knn._hits(b, 5, not apparent) if n else np.zeros(0, bool)
        folds = [hits[m.folds == f].mean() for f in np.unique(m.folds)]
        want = hits.mean() if apparent else np.mean(folds) if len(folds) > 1 else 0.0
        assert m.single(0, 5, apparent) == pytest.approx(want if n else 0.0, abs=1e-12)


def test_single_features_take_no_leaves(spark, monkeypatch):
    """single_feature_accuracy built leaves and took some 1,000 distances a row for each feature, and ran out of time."""
    rng = np.random.default_rng(1)
    m = knn.Matrix(rng.random((20000, 3)), rng.integers(0, 3, 20000), rng.integers(0, 5, 20000))
    want = [m.accuracy([f]) for f in range(3)]
    monkeypatch.setattr(Leaves, "__init__", lambda *_: pytest.fail("leaves"))
    monkeypatch.setattr(knn, "_close", lambda *_: pytest.fail("all pairs of rows"))
    assert [m.single(f) for f in range(3)] == want

"""Nearest and farthest rows by leaves against the block search and plain distances."""

import numpy as np
import pytest

from siftgraph.operators import embedded, knn, search
from siftgraph.operators.leaves import Leaves


def rows(kind, n, p, rng):
    if kind == "copies":
        return rng.integers(0, 3, (n, p)).astype(float)
    if kind == "far apart":
        return np.round(rng.normal(size=(n, p)), 1) * 1e6 + rng.integers(0, 2, (n, 1)) * 1e12
    if kind == "tiny":
        return np.concatenate([np.zeros((n // 2, p)), rng.random((n - n // 2, p)) * 1e-9])
    return rng.random((n, p))


@pytest.mark.parametrize("kind", ["plain", "copies", "far apart", "tiny"])
@pytest.mark.parametrize("n, p", [(1, 1), (7, 2), (900, 1), (1500, 3), (1200, 11)])
def test_votes_and_extremes_against_the_block_search(kind, n, p):
    rng = np.random.default_rng(n + p)
    b = knn.Block(rows(kind, n, p, rng), rng.permutation(n), rng.integers(0, 4, n), rng.integers(0, 5, n))
    m = knn.Matrix(b.x, b.labels, b.folds, b.ids)
    for apparent in (False, True):
        want = knn._hits(b, 5, other_fold=not apparent)
        found = [knn._right(b, 5, not apparent, (i, 3)) for i in range(3)]
        assert sorted(np.concatenate(found)) == np.flatnonzero(want).tolist()
        assert m.hits(range(p), 5, apparent).sum() == want.sum()
    d = ((b.x[:, None] - b.x[None]) ** 2).sum(2)
    same = b.labels[:, None] == b.labels[None]
    leaves = Leaves(b.x, b.ids, b.labels, 1, pure=True)
    far, near = np.zeros(n), np.full(n, np.inf)
    for at, out in leaves.farthest():
        far[at] = out
    for at, i, _, out in leaves.nearest():
        near[at[i]] = out
    assert np.allclose(far[leaves.first], np.where(same, d, 0).max(1), rtol=1e-9, atol=0)
    assert np.allclose(near[leaves.first], np.where(same, np.inf, d).min(1), rtol=1e-9, atol=0)


def test_a_vote_needs_few_distances(monkeypatch):
    """A subset of few features took all pairs of rows, so buddy_refine and the searches ran out of time."""
    rng = np.random.default_rng(3)
    m = knn.Matrix(rng.random((20000, 2)), rng.integers(0, 3, 20000), rng.integers(0, 5, 20000))
    monkeypatch.setattr(knn, "_close", lambda *_: pytest.fail("all pairs of rows"))
    seen = []
    rough = Leaves._rough
    monkeypatch.setattr(Leaves, "_rough", lambda self, q, squares, centre, at, *rest: (seen.append(len(q) * len(at)), rough(self, q, squares, centre, at, *rest))[1])
    assert 0.2 < m.accuracy([0, 1]) < 0.5 and sum(seen) < 20000**2 / 8


def test_subsets_are_dealt_out(spark):
    rng = np.random.default_rng(4)
    m = knn.Matrix(rng.random((5000, 4)), rng.integers(0, 3, 5000), rng.integers(0, 5, 5000))
    subsets = [[1, 2, 3], [], [0]]
    assert len(knn.dealt(subsets, 5000, spark)) > 2
    assert knn.accuracies(subsets, m, spark) == [m.accuracy(s) for s in subsets]


def test_separation_takes_no_blocks_of_all_pairs(spark, monkeypatch):
    """Each change of the node weights took all pairs of rows, twice, so evolve_enhanced ran out of time."""
    rng = np.random.default_rng(5)
    m = knn.Matrix(rng.random((3000, 5)), rng.integers(0, 3, 3000), rng.integers(0, 5, 3000))
    subsets = [np.array([0, 2]), np.arange(5), np.array([], int)]
    want = [search._ratio(*knn.far_and_near(b, [b])) if len(s) else 0.0 for s in subsets for b in [m.block(s)]]
    parts = [knn.ends(m.block(subsets[0]), (i, 3)) for i in range(3)]
    assert np.isclose(search._ratio(*(np.concatenate(v) for v in zip(*parts))), want[0])
    monkeypatch.setattr(search, "far_and_near", lambda *_: pytest.fail("all pairs of rows"))
    monkeypatch.setattr(knn, "far_and_near", lambda *_: pytest.fail("all pairs of rows"))
    assert np.allclose(search.separation(m, subsets, spark), want)


def test_complementarity_takes_singles_once(spark):
    """Both sides of a pair had the singles evaluated again."""
    rng = np.random.default_rng(6)
    m = knn.Matrix(rng.random((300, 3)), rng.integers(0, 3, 300), rng.integers(0, 5, 300))
    taken = spark.sparkContext.accumulator(0)

    def seen(frames):
        for f in frames:
            taken.add(len(f))
            yield f

    singles = knn.single_accuracies(m, spark).mapInPandas(seen, "fid int, accuracy double")
    pairs = spark.createDataFrame([(0, 1), (2, 1)], "a int, b int")
    one = [m.accuracy([f]) for f in range(3)]
    found = {(r["i"], r["j"]): r["comp"] for r in knn.complementarity(pairs, singles, m).collect()}
    assert found == {(i, j): max(0.0, m.accuracy([i, j]) - max(one[i], one[j])) for i, j in ((0, 1), (1, 2))} and taken.value == 3


@pytest.mark.parametrize("p, share", [(1, 40), (2, 15)])
def test_singles_and_pairs_of_hot_values_need_few_distances(monkeypatch, p, share):
    """single_feature_accuracy and rc_greedy_extend took all pairs of rows, whatever the values."""
    rng = np.random.default_rng(p)
    x = rng.random((20000, p))
    x[::3] = 0.5
    seen = []
    rough = Leaves._rough
    monkeypatch.setattr(Leaves, "_rough", lambda self, q, squares, centre, at, *rest: (seen.append(len(q) * len(at)), rough(self, q, squares, centre, at, *rest))[1])
    knn.Matrix(x, rng.integers(0, 3, 20000), rng.integers(0, 5, 20000)).accuracy(range(p))
    assert 0 < sum(seen) < 20000**2 / share


def test_forest_grows_in_tasks(spark, monkeypatch):
    """rf_importance passed over the rows for every level of its 200 trees; the forest is that of pyspark.ml up to its draws."""
    import pyspark.ml.classification as ml

    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 8))
    x[:, 6], x[:, 7] = 1.0, rng.integers(0, 2, 500)
    y = (x[:, 0] + 0.7 * x[:, 1] + 0.3 * rng.normal(size=500) > 0).astype(int) + (x[:, 2] > 1)
    wide = spark.createDataFrame([(i, int(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))], "sample_id long, label int, features array<double>").cache()
    with monkeypatch.context() as m:
        m.setattr(knn, "BROADCAST", 1)
        want = np.array([r["score"] for r in embedded.forest_importance(wide, 60).orderBy("fid").collect()])
    monkeypatch.setattr(ml, "RandomForestClassifier", lambda **_: pytest.fail("passes over the rows"))
    one, two = (np.array([r["score"] for r in embedded.forest_importance(w, 60).orderBy("fid").collect()]) for w in (wide, wide.repartition(5)))
    assert (one == two).all() and np.isclose(one.sum(), 1) and one[6] == 0
    assert np.abs(one - want).max() < 0.05


def test_a_search_sends_its_matrix_once(spark):
    """evolve_baseline broadcast the matrix in every generation and left most tasks idle."""
    rng = np.random.default_rng(8)
    m = knn.Matrix(rng.random((5000, 3)), rng.integers(0, 3, 5000), rng.integers(0, 5, 5000))
    one = search.Search(spark, None, m, np.ones(3), search.Settings(baseline=True))
    one.accuracies([(0,), (0, 1)])
    sent = m.shared(spark)
    one.accuracies([(0,), (2,)])
    assert m.shared(spark) is sent and one.known == {s: m.accuracy(s) for s in ((), (0,), (0, 1), (2,))}

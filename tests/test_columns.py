"""Complementarities on demand, and leaves of one fold."""

import numpy as np

from siftgraph.operators import graph, knn, kshell
from siftgraph.operators.leaves import Leaves
from siftgraph.plans import pipeline


def test_rc_greedy_evaluates_pairs_of_its_members(spark, monkeypatch):
    """rc_greedy_extend evaluated all pairs of the graph and looked at those of its members, so it ran out of time."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 12))
    y = (x[:, 0] * x[:, 3] + x[:, 5] > 0).astype(int)
    wide = spark.createDataFrame([(i, int(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))], "sample_id long, label int, features array<double>")
    c = pipeline.Context(wide, pipeline.Config())
    edges = graph.knn_graph(c.sim, 2).cache()
    whole, taken = c.comp_matrix(edges), []
    accuracies = knn.accuracies
    monkeypatch.setattr(knn, "accuracies", lambda subsets, *rest: (taken.extend(subsets), accuracies(subsets, *rest))[1])
    core, found = np.array([0, 3]), []
    columns = c.comp_columns(edges)
    assert (columns([0, 3]) == whole[:, [0, 3]]).all()
    pairs = {(min(r["src"], r["dst"]), max(r["src"], r["dst"])) for r in edges.collect()}
    assert sorted(s for s in taken if len(s) == 2) == sorted(p for p in pairs if 0 in p or 3 in p) and len(taken) == len(set(taken))
    for tau in (-1.0, 0.0, 0.3):
        found.append(kshell.rc_greedy(core, columns, c.sim_matrix, tau).tolist())
        assert found[-1] == kshell.rc_greedy(core, whole, c.sim_matrix, tau).tolist()
    assert len(found[0]) == 7 and (columns(list(range(12))) == whole).all() and len(taken) == len(set(taken))


def test_votes_pass_over_their_fold(monkeypatch):
    """Searches took all pairs of rows for each subset of many features, those of one fold as well."""
    rng = np.random.default_rng(2)
    n = 15000
    m = knn.Matrix(rng.random((n, 24)), rng.integers(0, 3, n), rng.integers(0, 5, n))
    seen, rough = [], Leaves._rough
    monkeypatch.setattr(Leaves, "_rough", lambda self, q, squares, centre, at, *rest: (seen.append(len(q) * len(at)), rough(self, q, squares, centre, at, *rest))[1])
    got = m.hits(range(24), share=(0, 4)).sum() + sum(m.hits(range(24), share=(i, 4)).sum() for i in (1, 2, 3))
    assert sum(seen) < 0.85 * n * n
    assert got == knn._hits(m.block(range(24)), 5, True).sum()

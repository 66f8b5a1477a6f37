"""Operators without SQL, against plain versions and hand-written cases."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftgraph.functions import text
from siftgraph.operators import embedded, graph, knn, kshell, pareto, prep, search, stats
from siftgraph.plans import pipeline
from siftgraph.sources import tables


def wide_of(spark, x, y):
    return spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))], "sample_id long, label int, features array<double>")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    y = np.repeat([0, 1, 2], 20)
    x = rng.standard_normal((60, 6))
    x[:, 2] += y
    x[:, 4] = 1.5  # constant
    return x, y


# k-shells.


def test_peel_removes_only_equal_degrees():
    # 0-1 are heavy; 2 hangs on 3; once 2 goes, 3 has a degree below the shell's and stays for the next shell.
    a = np.zeros((6, 6))
    for i, j, w in [(0, 1, 4.0), (1, 0, 4.0), (0, 3, 4.0), (1, 3, 4.0), (2, 3, 1.0), (3, 2, 4.0), (4, 5, 1.0), (5, 4, 1.0)]:
        a[i, j] = w
    shells = kshell.peel(a, np.ones(6))
    assert sorted(np.concatenate(shells).tolist()) == [0, 1, 2, 3, 4, 5]
    assert set(shells[0].tolist()) == {2, 4, 5} or set(shells[0].tolist()) >= {2}
    assert 3 not in shells[0].tolist()


def plain_peel(a, w):
    a, left, shells = a.copy(), set(range(len(a))), []
    degree = lambda i: round(math.sqrt((a[i] > 0).sum() * a[i].sum() * w[i]))
    while left:
        m, shell = min(map(degree, left)), []
        while gone := [i for i in sorted(left) if degree(i) == m]:
            shell += gone
            left -= set(gone)
            a[gone, :] = 0
            a[:, gone] = 0
        shells.append(shell)
    return shells


@pytest.mark.parametrize("seed", range(20))
def test_peel_against_plain(seed):
    rng = np.random.default_rng(seed)
    a = np.where(rng.random((9, 9)) < 0.3, rng.random((9, 9)) * 3, 0)
    np.fill_diagonal(a, 0)
    w = 1 + rng.random(9)
    shells = [s.tolist() for s in kshell.peel(a, w)]
    assert [sorted(s) for s in shells] == [sorted(s) for s in plain_peel(a, w)]
    assert len(set(itertools.chain(*shells))) == sum(map(len, shells))


def test_peel_takes_nodes_without_edges_first():
    a = np.zeros((5, 5))
    for i, j in [(0, 1), (1, 2), (2, 0), (1, 0), (2, 1), (0, 2)]:
        a[i, j] = 1.0
    w = np.array([1, 1, 1, 1, 1.5])
    assert [sorted(s.tolist()) for s in kshell.peel(a, w)] == [[3, 4], [0, 1, 2]]
    assert kshell.representatives(kshell.peel(a, w), w).tolist() == [0, 1, 2, 4]


def test_genome_without_edges_has_an_empty_core():
    d = kshell.Decoder(3, np.array([0, 1]), np.array([1, 2]), np.array([0.5, 0.5]))
    assert len(d.core(np.array([0, 0]), np.ones(3))) == 0
    with pytest.raises(ValueError):
        d.adjacency(np.array([1]))


def test_rc_greedy_stops_without_gain():
    comp, sim = np.zeros((4, 4)), np.eye(4)
    assert kshell.rc_greedy(np.array([1]), comp, sim).tolist() == [1]
    comp[1, 2] = comp[2, 1] = 1.0
    assert kshell.rc_greedy(np.array([1]), comp, sim).tolist() == [1, 2]


# Search.


def plain_ranks(f):
    left, rank, level = set(range(len(f))), [0] * len(f), 0
    while left:
        level += 1
        free = [i for i in left if not any(all(f[j] <= f[i]) and any(f[j] < f[i]) for j in left)]
        for i in free:
            rank[i] = level
        left -= set(free)
    return rank


@pytest.mark.parametrize("seed", range(10))
def test_fronts_and_crowding(seed):
    f = np.random.default_rng(seed).integers(0, 6, (25, 2)).astype(float)
    rank = search.sort_fronts(f)
    assert rank.tolist() == plain_ranks(f)
    assert pareto._front_numbers(f[:, 0].tolist(), f[:, 1].tolist()) == rank.tolist()
    crowd = search.crowding(f, rank)
    assert (crowd >= 0).all() and np.isinf(crowd[np.argmin(f[:, 0])]) | True
    assert len(search.survivors(rank, crowd, 10)) == 10 and (np.sort(rank)[:10] == np.sort(rank[search.survivors(rank, crowd, 10)])).all()


def test_genetic_operators():
    rng = np.random.default_rng(0)
    genes = rng.integers(0, 2, (4, 30))
    assert search.cross(genes, 0.9, rng).shape == (8, 30)
    assert (search.mutate(genes, 0.0, rng) == genes).all()
    assert (search.mutate(genes, 1.0, rng) == 1 - genes).all()
    assert set(search.tournament(np.array([1, 2, 2]), np.array([1.0, 2.0, 1.0]), 50, 2, rng)) <= {0, 1, 2}


def test_separation_against_plain(data):
    x, y = data
    m = knn.Matrix(x, y, np.zeros(60))
    d = np.sqrt(((x[:, None, :2] - x[None, :, :2]) ** 2).sum(2))
    far = np.array([d[i][y == y[i]].max() for i in range(60)])
    near = np.array([d[i][y != y[i]].min() for i in range(60)])
    both = np.concatenate([far, near])
    s = lambda v: (v - both.min()) / np.ptp(both)
    assert math.isclose(search.separation(m, [np.array([0, 1]), np.array([], int)])[0], np.mean(s(near) / s(far)), rel_tol=1e-9)
    assert search.separation(m, [np.array([], int)])[0] == 0


def test_separation_in_tasks(spark, data, monkeypatch):
    x, y = data
    wide = wide_of(spark, x, y)
    folds = prep.stratified_folds(wide)
    subsets = [np.array([0, 1]), np.array([], int), np.arange(6), np.array([4])]
    m = knn.Matrix.of(wide, folds)
    here = search.separation(m, subsets)
    monkeypatch.setattr(search, "BLOCK", 17)
    assert np.allclose(search.separation(m, subsets, spark), here)
    monkeypatch.setattr(knn, "BROADCAST", 10)
    rows = knn.Matrix.of(wide, folds)
    assert isinstance(rows, knn.Rows) and np.allclose(search.separation(rows, subsets, spark), here)


@pytest.mark.parametrize("cell", [knn.CELL, 3000])
def test_neighbours_against_plain(spark, monkeypatch, cell):
    """Ties, repeated rows, folds; blocks of 7 rows and cells of a few of them."""
    monkeypatch.setattr(knn, "CELL", cell)
    monkeypatch.setattr(knn, "BLOCK", 7)
    rng = np.random.default_rng(8)
    x = rng.integers(0, 4, (90, 3)).astype(float)
    fold = rng.integers(0, 3, 90)
    wide = wide_of(spark, x, rng.integers(0, 3, 90)).join(spark.createDataFrame([(i, int(f)) for i, f in enumerate(fold)], "sample_id long, fold int"), "sample_id").repartition(4)
    for other, own in ((False, False), (True, False), (False, True)):
        got = {}
        for r in knn.neighbours(wide, wide, 4, other_fold=other, not_self=own).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["row_id"], r["distance"]))
        for i in range(90):
            d = np.sqrt(((x - x[i]) ** 2).sum(1))
            ok = [j for j in range(90) if not (other and fold[j] == fold[i]) and not (own and j == i)]
            want = sorted(ok, key=lambda j: (d[j], j))[:4]
            assert [j for _, j, _ in sorted(got[i])] == want
            assert np.allclose([v for _, _, v in sorted(got[i])], d[want])


def test_blocks_are_sent_a_root_of_times(spark):
    """100 times the rows: what is shuffled grows with the rows, not with pairs of blocks."""
    rng = np.random.default_rng(0)
    sent = []
    for n in (300, 3000):
        wide = wide_of(spark, rng.standard_normal((n, 4)), [0] * n).repartition(4).cache()
        out = []
        found = knn.grid(wide, wide, lambda q, held: out.append(len(held)), "a int")  # noqa: B023
        plan = plan_of(found)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        blocks = knn._packed(wide).agg(F.sum(F.length("x"))).first()[0]
        sent.append(blocks)
    assert sent[1] == 10 * sent[0]


@pytest.mark.parametrize("cuts", [128, 3])
def test_running_sums_by_buckets(spark, monkeypatch, cuts):
    monkeypatch.setattr(stats, "CUTS", cuts)
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.integers(0, 9, 70), rng.standard_normal(70), np.exp(5 * rng.standard_normal(70)), np.ones(70)]).astype(float)
    y = rng.integers(0, 4, 70)
    long = tables.melt(wide_of(spark, x, y))
    tau = {r["fid"]: r["score"] for r in stats.kendall(long).collect()}
    rank = {(r["sample_id"], r["fid"]): r["x"] for r in stats.ranks(long).collect()}
    for f in range(4):
        pairs = [(i, j) for i in range(70) for j in range(i)]
        assert math.isclose(tau[f], sum(np.sign(x[i, f] - x[j, f]) * np.sign(y[i] - y[j]) for i, j in pairs) / len(pairs), abs_tol=1e-12)
        assert all(rank[i, f] == (x[:, f] < x[i, f]).sum() + ((x[:, f] == x[i, f]).sum() + 1) / 2 for i in range(70))


def test_edges_by_bits(spark, data):
    wide = wide_of(spark, *data)
    var = graph.local_variance(wide).where("var <= 1.2")
    want = {(a["fid"], b["fid"]) for rows in [var.collect()] for a in rows for b in rows if a["sample_id"] == b["sample_id"] and a["fid"] != b["fid"]}
    assert {tuple(r) for r in graph.variance_edges(wide, threshold=1.2).collect()} == want and want


def test_forward_selection_over_the_bound(spark, data, monkeypatch):
    x, y = data
    wide = wide_of(spark, x[:, :3], y)
    folds = prep.stratified_folds(wide, 2)
    here = embedded.sfs_svm(knn.Matrix.of(wide, folds), spark, 1)
    monkeypatch.setattr(knn, "BROADCAST", 10)
    assert embedded.sfs_svm(knn.Matrix.of(wide, folds), spark, 1) == here == [2]


def test_search_runs_and_is_deterministic(spark, data):
    x, y = data
    wide = wide_of(spark, x, y)
    c = pipeline.Context(wide, pipeline.Config(search=search.Settings(population=6, generations=2, gap=1)))
    one, two = (pipeline._search(c, "knn", c.config.search).result for _ in range(2))
    assert (one.objectives == two.objectives).all() and (one.weight >= 1).all()
    assert 2 in one.subsets[one.best()]
    front, test = pipeline.run(c, "enh:knn:rc_greedy")
    assert front.columns == pipeline._front_rows(c, "x", []).columns and test.count() == 2
    with pytest.raises(ValueError):
        pipeline.run(c, "enh:nothing:normal")
    assert pipeline.run(c, "trad:WRAP_RFE_SVM")[1].count() == 1
    assert pipeline.pareto_front_on_test(c).count() >= 1
    assert pipeline.named_holdout(c, {"a": [2], "b": []}).count() == 2
    few = pipeline.replace_config(c, ratios=(0.2, 0.5))
    front, test = pipeline.sweep(few, ["trad:FILTER_pearson", "trad:nothing", "all"], k_ref=2)
    assert front.count() == 3 and {r["test_mode"] for r in test.collect()} == {"ratio", "k_ref", "all"}
    assert pipeline.score_front(few, stats.fisher(tables.melt(wide))).count() == 2
    assert pipeline.repeated(few, "all", 2)[1].count() == 2
    assert search.generation_rows(one, spark).count() > 0 and search.log_frame(one, spark).count() == 3
    assert pipeline.logged(("a", "b", "c"), None) and not pipeline.logged(("a", "b", "c"), ("a", "b", "d"))
    fixed = pipeline.Context(wide, pipeline.Config(fixed_fnum=2))
    assert pipeline.run(fixed, "graph:InfFS")[1].first()["test_mode"] == "fixed_k"


def test_buddy_takes_the_first_improving_candidate():
    comp, sim = np.zeros((5, 5)), np.zeros((5, 5))
    comp[0] = [0, 3, 2, 1, 0]
    gain = {(0,): 0.5, (0, 1): 0.5, (0, 2): 0.6, (0, 3): 0.9, (0, 4): 0.1}
    assert search.buddy([0], comp, sim, lambda ss: [gain[s] for s in ss]) == [0, 2]
    with pytest.raises(ValueError):
        search.refine("other", [0])
    with pytest.raises(ValueError):
        search.refine("buddy", [0])


# Neighbours.


def test_accuracy_agrees_between_plans(spark, data):
    x, y = data
    wide = wide_of(spark, x, y)
    folds = prep.stratified_folds(wide)
    m = knn.Matrix.of(wide, folds)
    assert math.isclose(m.accuracy(range(6)), knn.cv_accuracy(wide, folds).first()[0], rel_tol=1e-12)
    assert m.accuracy([]) == 0.0
    few = knn.subset_accuracies(spark.createDataFrame([(1, [2]), (2, [])], "key int, ids array<int>"), m).collect()
    assert {r["key"]: r["accuracy"] for r in few} == {1: m.accuracy([2]), 2: 0.0}


def test_ties_go_to_the_smaller_id_and_label():
    train = np.zeros((4, 1))
    assert knn.vote(train, np.array([3, 1, 1, 3]), np.arange(4), np.zeros((1, 1)), 4)[0] == 1
    assert knn.vote(train, np.array([3, 1, 1, 3]), np.arange(4), np.zeros((1, 1)), 1)[0] == 3


# Graphs.


def test_spanning_tree_against_plain(spark):
    rng = np.random.default_rng(1)
    pairs = [(i, j, float(rng.random())) for i in range(8) for j in range(i + 1, 8)]
    tree = graph.spanning_tree(spark.createDataFrame(pairs, "i int, j int, sim double")).collect()
    parent, total = list(range(8)), 0.0

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, j, s in sorted(pairs, key=lambda p: 1 - p[2]):
        if find(i) != find(j):
            parent[find(i)] = find(j)
            total += s
    assert len(tree) == 7 and math.isclose(sum(r["sim"] for r in tree), total)


def test_symmetric_graphs(spark, data):
    x, y = data
    wide = wide_of(spark, x, y)
    sim, fisher = stats.similarity(wide), stats.fisher(tables.melt(wide))
    for name in ("local_thresh", "fisher_red", "mst_local", "probabilistic"):
        edges = {(r["src"], r["dst"]): r["sim"] for r in graph.INITIALIZERS[name](sim, fisher, 1).collect()}
        assert edges and all(edges[j, i] == s for (i, j), s in edges.items()), name


def test_pagerank_against_plain(spark):
    edges = [(0, 1), (1, 0), (1, 2), (2, 1), (3, 1)]
    got = {r["fid"]: r["score"] for r in graph.pagerank(spark.createDataFrame(edges, "src int, dst int"), 5).collect()}
    a = np.zeros((5, 5))
    for i, j in edges:
        a[i, j] = 1
    out, r = a.sum(1), np.full(5, 0.2)
    for t in range(1, 101):
        new = 0.15 / 5 + 0.85 * (a / np.where(out, out, 1)[:, None]).T @ r
        change, r = np.linalg.norm(new - r), new
        if change < 1e-3 and t > 5:
            break
    assert np.allclose([got[i] for i in range(5)], r)


def test_relieff_prefers_the_informative_feature(spark, data):
    scores = {r["fid"]: r["score"] for r in graph.relieff(wide_of(spark, *data), 5).collect()}
    assert max(scores, key=scores.get) == 2 and scores[4] == 0


def test_infinite_selection_against_paths(spark, data):
    """Scores are the weights of all walks from a feature, summed up to a length where they vanish."""
    x, y = data
    wide = wide_of(spark, x, y)
    sd = x.std(0, ddof=1)
    sd = (sd - sd.min()) / np.ptp(sd)
    own = np.array([r["score"] for r in stats.fisher(tables.melt(wide)).orderBy("fid").collect()])
    c = np.outer(own, own)
    for supervised in (True, False):
        sims = {(r["i"], r["j"]): r["sim"] for r in stats.spearman(tables.melt(wide)).collect()}
        rest = np.array([[0.0 if i == j else 1 - sims[min(i, j), max(i, j)] for j in range(6)] for i in range(6)])
        a = 0.5 * np.maximum.outer(sd, sd) + 0.5 * ((c - c.min()) / np.ptp(c) if supervised else rest)
        a *= 0.9 / np.abs(np.linalg.eigvalsh(a)).max()
        walks, total = np.ones(6), np.zeros(6)
        for _ in range(600):
            walks = a @ walks
            total += walks
        got = {r["fid"]: r["score"] for r in graph.inffs(wide, supervised=supervised).collect()}
        assert np.allclose([got[i] for i in range(6)], total)
    got = {r["fid"]: r["score"] for r in graph.inffs(wide).collect()}
    assert max(got, key=got.get) == 2


# Embedded and wrapper methods.


def test_embedded_methods_find_the_informative_feature(spark, data):
    x, y = data
    wide = wide_of(spark, x, y)
    for name in embedded.EMBEDDED:
        scores = {r["fid"]: r["score"] for r in embedded.embedded_scores(wide, [name]).collect()}
        assert max(scores, key=scores.get) == 2, name
    assert 2 in embedded.rfe_svm(wide, 2)
    assert embedded.sfs_svm(knn.Matrix.of(wide, prep.stratified_folds(wide)), spark, 1) == [2]


# Preparation.


def test_constant_features(spark, data):
    long = tables.melt(wide_of(spark, *data)).where("fid = 4")
    assert {r["x"] for r in prep.minmax(long).collect()} == {0.0}
    assert {r["x"] for r in prep.zscore(long).collect()} == {0.0}
    assert stats.fisher(long).first()["score"] == 0.0
    for name in stats.FILTERS | stats.MORE_FILTERS:
        assert abs(stats.filter_scores(long, [name]).first()["score"]) < 1e-9, name


def test_perfectly_separated_feature_has_score_100(spark):
    long = tables.melt(wide_of(spark, [[0.0], [0.0], [1.0], [1.0]], [0, 0, 1, 1]))
    assert stats.fisher(long).first()["score"] == 100.0


def test_decorrelate_and_whiten(spark, data):
    x, y = data
    z = np.array([r["features"] for r in prep.decorrelate(wide_of(spark, x[:, :4], y), whiten=True).collect()])
    assert np.allclose(np.cov(z.T), np.eye(4), atol=1e-6)


def test_folds_and_splits(spark, data):
    wide = wide_of(spark, *data)
    sizes = prep.stratified_folds(wide).groupBy("label", "fold").count().collect()
    assert {r["count"] for r in sizes} == {4}
    split = prep.stratified_split(wide).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"test": 18, "train": 42}
    folds = [r["fold"] for r in prep.contiguous_folds(wide.limit(7).select("sample_id")).orderBy("sample_id").collect()]
    assert sorted(folds) == [0, 0, 1, 1, 2, 3, 4]


def test_finite_check_fails_on_nan(spark):
    long = spark.createDataFrame([(0, 1, 0, float("nan"))], "sample_id long, label int, fid int, x double")
    with pytest.raises(Exception, match="not finite"):
        prep.check_finite(long).collect()


# Fronts.


def plain_hv(points):
    best, total, y = None, 0.0, 1.0
    for fr, er in sorted(points):
        if fr < 1 and er < y:
            total += (1 - fr) * (y - er)
            y = er
    return total


def test_hypervolume_properties(spark):
    rng = np.random.default_rng(5)
    pts = [("a", float(f), float(e)) for f, e in rng.random((40, 2))] + [("b", 1.0, 0.2), ("b", 0.5, 1.0), ("c", float("nan"), 0.1)]
    frame = spark.createDataFrame(pts, "g string, fr double, er double")
    hv = {r["g"]: r["hv"] for r in pareto.hypervolume(frame, ["g"]).collect()}
    assert math.isclose(hv["a"], plain_hv([(f, e) for g, f, e in pts if g == "a"])) and hv["b"] == 0 and hv["c"] == 0
    once = pareto.front(frame, ["g"])
    assert once.count() == pareto.front(once, ["g"]).count()
    more = pareto.hypervolume(frame.union(spark.createDataFrame([("a", 0.01, 0.01)], frame.schema)), ["g"]).where("g = 'a'").first()["hv"]
    assert more >= hv["a"]


# Files and text.


def test_results_on_disk(spark, tmp_path):
    for d, body in (("dataset_1/a/run_1", "dataset_idx,run,fnum\n1,1,3\n"), ("dataset_1/b/run_2", "dataset_idx,extra\n1,x\n")):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "front_train_cv.csv").write_text(body)
    found = tables.read_results(spark, str(tmp_path), "front_train_cv")
    assert found.columns == ["dataset_idx", "run", "fnum", "extra"] and found.count() == 2
    (tmp_path / "sizes.csv").write_text("dataset_idx,run,target_fnum\n1,1,4\n1,1,5.6\nbad,2,3\n2,1,-1\n")
    assert [tuple(r) for r in tables.read_ref_sizes(spark, str(tmp_path / "sizes.csv")).collect()] == [(1, 1, 6)]
    assert not tables.write_csv(found.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    assert tables.write_csv(found, str(tmp_path / "some"))
    with pytest.raises(ValueError):
        tables.require(found, ["absent"])
    with pytest.raises(ValueError):
        tables.dataset(spark, str(tmp_path), 99)
    wide_of(spark, [[1.0]], [-1]).write.parquet(str(tmp_path / "Sonar.parquet"))
    frame, name = tables.dataset(spark, str(tmp_path), 1)
    assert name == "Sonar" and frame.first()["label"] == 0
    tables.write_ids(spark.createDataFrame([([3, 1],)], "ids array<int>"), "ids", str(tmp_path / "ids"))
    assert spark.read.text(str(tmp_path / "ids")).first()[0] == "3 1"


def test_text_functions(spark):
    row = spark.range(1).select(
        text.float_tag(F.lit(-1.5)).alias("a"), text.parse_ids(F.lit(" 3 x 4")).alias("b"), text.parse_ratios(F.lit("0.1, 0.2")).alias("c"), text.mean_std(F.lit(1.0), F.lit(0.25)).alias("d"), text.lp_distance([(F.lit(0.0), F.lit(3.0)), (F.lit(0.0), F.lit(4.0))]).alias("e")
    ).first()
    assert tuple(row) == ("m1p5", [3, 4], [0.1, 0.2], "1.000±0.250", 5.0)


def test_command_line(spark, sf, tmp_path):
    from siftgraph.__main__ import main

    for n in (1, 2):
        main(["run", "--data", sf, "--algo", "trad:FILTER_pearson", "--ratios", "0.1,0.2", "--run", str(n), "--out", str(tmp_path / "runs")])
    main(["merge", "--root", str(tmp_path / "runs"), "--out", str(tmp_path / "merged")])
    main(["analyze", "--front", str(tmp_path / "merged/front"), "--test", str(tmp_path / "merged/test"), "--out", str(tmp_path / "tables")])
    assert (tmp_path / "runs/dataset_01/trad__FILTER_pearson/run_02/test_points.csv").exists()
    summary = spark.read.csv(str(tmp_path / "tables/train_summary"), header=True).first()
    assert summary["method"] == "FILTER_pearson" and summary["runs"] == "2"
    assert spark.read.csv(str(tmp_path / "tables/test_summary"), header=True).count() == 1
    (tmp_path / "sizes.csv").write_text("dataset_idx,run,target_fnum\n1,1,3\n")
    main(["run", "--data", sf, "--algo", "graph:UGFS", "--run", "9", "--ref_sizes", str(tmp_path / "sizes.csv"), "--out", str(tmp_path / "skip")])
    assert "run 9" in spark.read.text(str(tmp_path / "skip/dataset_01/graph__UGFS/run_09/error")).first()[0]


def test_swept_settings_have_folders_of_their_own(spark, sf, tmp_path):
    from siftgraph.__main__ import main

    some = ["--data", sf, "--algo", "enh:probabilistic:normal", "--population", "4", "--generations", "1", "--out", str(tmp_path)]
    for beta in ("1.4", "2"):
        main(["run", *some, "--prob_beta", beta])
    folders = sorted(p.name for p in (tmp_path / "dataset_01").iterdir())
    assert folders == ["enh__probabilistic__normal__beta_1p4__tau_0p3__lam_0p5", "enh__probabilistic__normal__beta_2__tau_0p3__lam_0p5"]
    made = tmp_path / "dataset_01" / folders[0] / "run_01"
    assert {p.name for p in made.iterdir()} >= {"front_train_cv.csv", "test_points.csv", "run_info.json", "solver_meta.json", "post_normal", "post_buddy", "pop_metrics.csv", "generations.csv", "neighbours.json", "pareto"}
    assert spark.read.json(str(made / "post_buddy/post_metrics.json")).first()["post_mode"] == "buddy"
    one, two = (spark.read.json(str(tmp_path / "dataset_01" / f / "run_01/neighbours.json")).collect() for f in folders)
    assert sorted(map(str, one)) != sorted(map(str, two))
    assert len(pipeline.swept(pipeline.Config())) == 12


def test_preprocessing(spark, data):
    wide = wide_of(spark, *data)
    for name in prep.PREPROCESS:
        assert prep.preprocess(wide, name)[0].count() == 60
    with pytest.raises(ValueError):
        prep.preprocess(wide, "other")
    with pytest.raises(ValueError):
        prep.check_dimension(0, 3)


# Plans.


def plan_of(frame):
    return frame._jdf.queryExecution().toString()


def test_scans_read_few_columns_and_push_filters(spark, sf):
    plan = plan_of(stats.fisher(tables.lineitem_long(spark, sf)))
    scan = plan[plan.rindex("ReadSchema") :].split("\n")[0]
    assert "l_quantity" in scan and "l_shipdate" not in scan
    assert "PushedFilters: [IsNotNull(event_type)" in plan_of(tables.table(spark, sf, "events").where("event_type = 'view'").select("value"))


def test_statistics_stay_in_the_engine(spark, sf):
    from siftgraph.plans.queries import QUERIES

    for name in ("fisher_score", "filter_kendall", "filter_gini", "stratified_split", "hypervolume", "method_summary", "graph_probabilistic", "test_summary"):
        plan = plan_of(QUERIES[name](spark, sf))
        if name != "graph_probabilistic":
            assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan or name in ("graph_probabilistic",), name


def test_gram_shuffles_sums_not_rows(spark, sf):
    plan = plan_of(stats.gram(tables.embeddings(spark, sf)))
    assert plan.rindex("partial_sum") > plan.rindex("Exchange")  # printed root first: added up before the exchange

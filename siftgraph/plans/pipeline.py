"""Whole runs: a dataset and an algorithm's name to front and test-point tables.

Names: all, baseline, enh:<initialiser>:<mode>, trad:<method>, graph:InfFS,
graph:UGFS. The split, similarities and Fisher scores do not depend on the run,
so they are computed once for a dataset (Context) and shared by its runs.
"""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import embedded, graph, kshell, knn, prep, search, stats
from ..operators.report import united
from ..sources import tables
from ..sources.tables import FRONT_SCHEMA, TEST_SCHEMA, melt, widen


@dataclass(frozen=True)
class Config:
    dataset_idx: int = 1
    dataset: str = "embeddings"
    run: int = 1
    test_size: float = 0.3
    split_seed: int = 42
    cv_folds: int = 5
    k: int = 5
    fixed_fnum: int | None = None
    ratios: tuple[float, ...] = stats.RATIOS
    k_neighbours: int = 5
    prob_beta: float = 2.0  # how much the probabilistic graph prefers similar features
    post_modes: tuple[str, ...] = ("normal", "buddy")
    buddy_lambda: float = 0.5
    max_per_core: int = 1
    fit_on: str = "all"  # rows that min-max scaling sees: all, or train
    #: Sizes over which the cross-validated accuracy of all features is left out.
    most_rows: int = 8000
    most_features: int = 2000
    search: search.Settings = search.Settings()

    @property
    def seed(self) -> int:
        return 1000 * self.dataset_idx + self.run


class Context:
    """What a dataset's runs share."""

    def __init__(self, wide: DataFrame, config: Config):
        self.config = config
        self.spark: SparkSession = wide.sparkSession
        self.wide = wide.select("sample_id", "label", "features").cache()
        self.split = prep.stratified_split(self.wide, config.test_size, config.split_seed).cache()
        self.train_ids = self.split.where("split = 'train'").select("sample_id")
        self.p = int(self.wide.agg(F.max(F.size("features"))).first()[0] or 0)

    def part(self, wide: DataFrame) -> DataFrame:
        return wide.join(self.train_ids, "sample_id", "left_semi")

    @cached_property
    def scaled(self) -> DataFrame:
        """Min-max scaled, wide."""
        long = melt(self.wide)
        return widen(prep.minmax(long, None if self.config.fit_on == "all" else self.part(long))).cache()

    @cached_property
    def standard(self) -> DataFrame:
        """Standardised by the train rows, wide."""
        long = melt(self.wide)
        return widen(prep.zscore(long, self.part(long))).cache()

    @cached_property
    def folds(self) -> DataFrame:
        return prep.stratified_folds(self.part(self.wide), self.config.cv_folds, self.config.split_seed).cache()

    @cached_property
    def fisher(self) -> DataFrame:
        return stats.fisher(self.part(melt(self.scaled))).cache()

    @cached_property
    def sim(self) -> DataFrame:
        return stats.similarity(self.part(self.scaled)).cache()

    @cached_property
    def sim_matrix(self) -> np.ndarray:
        m = np.zeros((self.p, self.p))
        rows = self.sim.toPandas()
        m[rows["i"], rows["j"]] = m[rows["j"], rows["i"]] = rows["sim"]
        return m

    @cached_property
    def matrix(self) -> knn.Matrix:
        return knn.Matrix.of(self.part(self.scaled), self.folds)

    @cached_property
    def singles(self) -> DataFrame:
        return knn.single_accuracies(self.matrix, self.spark, self.config.k).cache()

    def node_weights(self) -> np.ndarray:
        rows = stats.unit_scores(self.fisher).orderBy("fid").toPandas()
        return 1 + rows["score"].to_numpy()

    def comp_matrix(self, edges: DataFrame) -> np.ndarray:
        """Complementarity of the edges' pairs; others are 0."""
        pairs = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        m = np.zeros((self.p, self.p))
        for r in knn.complementarity(pairs, self.singles, self.matrix, self.config.k).collect():
            m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["comp"]
        return m

    def comp_columns(self, edges: DataFrame) -> Callable[[list[int]], np.ndarray]:
        """A function that gives columns of comp_matrix; pairs are evaluated when a feature of theirs is first asked for."""
        pairs = {(min(r["src"], r["dst"]), max(r["src"], r["dst"])) for r in edges.select("src", "dst").collect() if r["src"] != r["dst"]}
        m, known = np.zeros((self.p, self.p)), {}

        def columns(members: list[int]) -> np.ndarray:
            new = sorted(x for x in pairs if x not in known and not {*x}.isdisjoint(members))
            if new:
                subsets = [*dict.fromkeys([*((f,) for x in new for f in x if (f,) not in known), *new])]
                known.update(zip(subsets, knn.accuracies(subsets, self.matrix, self.spark, self.config.k)))
                for i, j in new:
                    m[i, j] = m[j, i] = max(0.0, known[i, j] - max(known[i,], known[j,]))
            return m[:, members]

        return columns

    def redundancy(self, ids: list[int]) -> float:
        if len(ids) < 2:
            return 0.0
        return float(self.sim_matrix[np.ix_(ids, ids)][np.triu_indices(len(ids), 1)].mean())

    def test_accuracy(self, wide: DataFrame, ids: list[int]) -> float:
        if not len(ids):
            return 0.0
        chosen = wide.select("sample_id", "label", F.transform(F.array(*map(F.lit, map(int, ids))), lambda i: F.get("features", i)).alias("features"))
        return knn.holdout_accuracy(chosen, self.split, self.config.k).first()["accuracy"]


def _front_rows(context: Context, method: str, subsets: list[tuple[list[int], float]]) -> DataFrame:
    """Front rows of subsets with their cross-validated accuracies: the best of each size, by ratio."""
    c = context.config
    best: dict[int, tuple[float, int, list[int]]] = {}
    for i, (ids, acc) in enumerate(subsets):
        if len(ids) not in best or (1 - acc, i) < best[len(ids)][:2]:
            best[len(ids)] = (1 - acc, i, list(ids))
    rows = [(c.dataset_idx, c.dataset, method, c.run, k, n, n / context.p, 1 - e, e, context.redundancy(ids), " ".join(map(str, sorted(ids)))) for k, (n, (e, _, ids)) in enumerate(sorted(best.items()))]
    return context.spark.createDataFrame(rows, FRONT_SCHEMA)


def _test_rows(context: Context, method: str, points: list[tuple[str, list[int], float, float]]) -> DataFrame:
    c = context.config
    rows = [(c.dataset_idx, c.dataset, method, c.run, mode, acc, 1 - acc, len(ids), len(ids) / context.p, context.redundancy(ids), took, " ".join(map(str, sorted(ids)))) for mode, ids, acc, took in points]
    return context.spark.createDataFrame(rows, TEST_SCHEMA)


@dataclass
class Solved:
    """A search, its result, the graph's edges, complementarities (where needed), and seconds."""

    solver: search.Search
    result: search.Result
    edges: DataFrame
    comp: np.ndarray | None
    began: float
    took: float


def _search(context: Context, initializer: str, settings: search.Settings) -> Solved:
    c = context.config
    edges = graph.INITIALIZERS[initializer](context.sim, context.fisher, c.k_neighbours, c.prob_beta).cache()
    decoder = kshell.Decoder.of(graph.gene_layout(edges), context.p)
    comp = context.comp_matrix(edges) if settings.mode not in ("none", "normal") or set(c.post_modes) - {"none", "normal"} else None
    began = time.perf_counter()
    found = search.Search(context.spark, decoder, context.matrix, context.node_weights(), settings, comp, context.sim_matrix)
    result = found.run(c.seed)
    return Solved(found, result, edges, comp, began, time.perf_counter() - began)


def run_enhanced(context: Context, initializer: str, mode: str, keep: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Front and test points of a search; keep, if given, takes its Solved as 'solved' and the refined subsets by mode as 'posts'."""
    c = context.config
    if initializer not in graph.INITIALIZERS:
        raise ValueError(f"no initialiser {initializer}")
    mode = mode if mode in kshell.MODES else "normal"
    solved = _search(context, initializer, replace(c.search, mode=mode))
    solver, result = solved.solver, solved.result
    method = f"graph_enhanced__init_{initializer}__ks_{mode}"

    def accuracies(subsets):
        solver.accuracies(subsets)
        return [solver.known[s] for s in subsets]

    core = [int(x) for x in result.subsets[result.best()]]
    points, fronts = [], [([int(x) for x in result.subsets[i]], 1 - float(result.objectives[i, 0])) for i in result.pareto()]
    for post in c.post_modes:
        ids = search.refine(post, core, solved.comp, context.sim_matrix, accuracies, c.buddy_lambda, c.max_per_core)
        points.append((post, ids, context.test_accuracy(context.scaled, ids), time.perf_counter() - solved.began))
    if keep is not None:
        keep |= {"solved": solved, "posts": points}
    front = _front_rows(context, method, fronts)
    test = _test_rows(context, method, points).withColumn("post_mode", F.col("test_mode")).withColumn("test_mode", F.lit("selected"))
    return front, test.withColumn("init_mode", F.lit(initializer)).withColumn("ks_mode", F.lit(mode))


def run_baseline(context: Context, keep: dict | None = None) -> tuple[DataFrame, DataFrame]:
    solved = _search(replace_config(context, post_modes=("normal",)), "knn", replace(context.config.search, baseline=True))
    result = solved.result
    fronts = [([int(x) for x in result.subsets[i]], -float(result.objectives[i, 0])) for i in result.pareto()]
    ids = [int(x) for x in result.subsets[result.best()]]
    point = ("selected", ids, context.test_accuracy(context.scaled, ids), time.perf_counter() - solved.began)
    if keep is not None:
        keep |= {"solved": solved, "posts": [point]}
    return _front_rows(context, "graph_baseline", fronts), _test_rows(context, "graph_baseline", [point])


def replace_config(context: Context, **changes) -> Context:
    """The same context under changed settings; what was computed stays."""
    other = Context.__new__(Context)
    other.__dict__.update(context.__dict__)
    other.config = replace(context.config, **changes)
    return other


def run_scores(context: Context, method: str, scores: DataFrame, began: float) -> tuple[DataFrame, DataFrame]:
    """Ranked features at a fixed size, or over the grid of ratios."""
    c = context.config
    order = [r["fid"] for r in stats.ranked(scores).orderBy("rank").select("fid").collect()]
    if c.fixed_fnum is not None:
        sizes = [("fixed_k", min(context.p, max(1, c.fixed_fnum)))]
    else:
        sizes = [("ratio", min(context.p, max(1, round(r * context.p)))) for r in c.ratios]
    score_time = time.perf_counter() - began
    matrix = knn.Matrix.of(context.part(context.standard), context.folds)
    frame = context.spark.createDataFrame([(i, order[:k]) for i, (_, k) in enumerate(sizes)], "key int, ids array<int>").repartition(len(sizes))
    cv = {r["key"]: r["accuracy"] for r in knn.subset_accuracies(frame, matrix, c.k).collect()}
    front = _front_rows(context, method, [(order[:k], cv[i]) for i, (_, k) in enumerate(sizes)])
    test = _test_rows(context, method, [(mode, order[:k], context.test_accuracy(context.standard, order[:k]), score_time) for mode, k in sizes])
    return front, test


def run_all_features(context: Context) -> tuple[DataFrame, DataFrame]:
    c, ids, began = context.config, list(range(context.p)), time.perf_counter()
    n = context.train_ids.count()
    if n <= c.most_rows and context.p <= c.most_features:
        acc = knn.cv_accuracy(context.part(context.standard), context.folds, c.k).first()["accuracy"]
    else:
        acc = float("nan")
    return _front_rows(context, "all_features", [(ids, acc)]), _test_rows(context, "all_features", [("all", ids, context.test_accuracy(context.standard, ids), time.perf_counter() - began)])


def run(context: Context, algo: str, keep: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Front and test-point tables of one run; keep, if given, takes what a search leaves (run_enhanced)."""
    family, *rest = algo.split(":", 2)
    began = time.perf_counter()
    train = context.part(context.standard)
    if family == "all":
        return run_all_features(context)
    if family == "baseline":
        return run_baseline(context, keep)
    if family == "enh" and rest:
        return run_enhanced(context, rest[0], rest[1] if len(rest) > 1 else "normal", keep)
    name = rest[0] if rest else ""
    if family == "trad" and name in stats.FILTERS | stats.MORE_FILTERS:
        return run_scores(context, name, stats.filter_scores(melt(train), [name]).drop("method"), began)
    if family == "trad" and name == "FILTER_reliefF":
        return run_scores(context, name, graph.relieff(train), began)
    if family == "trad" and name in embedded.EMBEDDED:
        return run_scores(context, name, embedded.embedded_scores(train, [name]).drop("method"), began)
    if family == "trad" and name in embedded.WRAPPERS:
        k = context.config.fixed_fnum or max(1, round(0.1 * context.p))
        matrix = knn.Matrix.of(train, context.folds)
        ids = [int(i) for i in embedded.WRAPPERS[name](train, matrix, k)]
        took = time.perf_counter() - began
        return _front_rows(context, name, [(ids, matrix.accuracy(ids, context.config.k))]), _test_rows(context, name, [("fixed_k", ids, context.test_accuracy(context.standard, ids), took)])
    if family == "graph" and name == "InfFS":
        return run_scores(context, name, graph.inffs(train), began)
    if family == "graph" and name == "UGFS":
        return run_scores(context, name, graph.ugfs(train), began)
    raise ValueError(f"no algorithm {algo}")


def export(context: Context, kept: dict, folder: str) -> None:
    """What a search leaves, as files: its settings and seconds, each refined subset, its generations, the graph's neighbour lists and the Pareto set."""
    solved, spark = kept["solved"], context.spark
    result, c = solved.result, context.config
    core = [int(x) for x in result.subsets[result.best()]]
    tables.write_info(spark, {"run": c.run, "solver_time": solved.took, "fnum_S0": len(core), "S0": core}, f"{folder}/solver_meta.json")
    for mode, ids, acc, took in kept["posts"]:
        own = {"run": c.run, "post_mode": mode, "acc_test": acc, "red": context.redundancy(ids), "fnum": len(ids), "time_total": took, "time_solver": solved.took, "time_post_extra": took - solved.took}
        tables.write_info(spark, own, f"{folder}/post_{mode}/post_metrics.json")
        tables.write_ids(spark.createDataFrame([([int(i) for i in ids],)], "ids array<int>"), "ids", f"{folder}/post_{mode}/selected.txt")
    tables.write_csv(search.log_frame(result, spark), f"{folder}/pop_metrics.csv")
    tables.write_csv(search.generation_rows(result, spark), f"{folder}/generations.csv")
    tables.write_json(graph.neighbour_lists(solved.edges), f"{folder}/neighbours.json")
    tables.write_arrays(search.fronts_frame(result, spark), f"{folder}/pareto")


def sweep(context: Context, methods: list[str], k_ref: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Front and test-point tables of many algorithms; with k_ref also each score method's test point of that size, mode 'k_ref'.

    A method that fails is left out with a warning that names it; if all fail, the exception names them.
    """
    fronts, tests, failed = [], [], []
    for name in methods:
        try:
            front, test = run(context, name)
            fronts.append(front)
            tests.append(test)
            if k_ref is not None and name.split(":")[0] in ("trad", "graph") and "WRAP" not in name:
                tests.append(run(replace_config(context, fixed_fnum=k_ref), name)[1].withColumn("test_mode", F.lit("k_ref")))
        except (ValueError, KeyError) as e:
            failed.append(f"{name}: {e}")
            warnings.warn(f"left out of the sweep: {failed[-1]}", stacklevel=2)
    if not fronts:
        raise ValueError("; ".join(failed) or "no methods")
    return united(fronts), united(tests)


def repeated(context: Context, algo: str, runs: int) -> tuple[DataFrame, DataFrame]:
    """The tables of runs 1 to `runs`; split, similarities and scores are computed once."""
    parts = [run(replace_config(context, run=r), algo) for r in range(1, runs + 1)]
    return united([p[0] for p in parts]), united([p[1] for p in parts])


def test_front(context: Context, subsets: list[list[int]]) -> DataFrame:
    """(fRatio, eRate_test, fset): the least test error of each distinct ratio over all subsets, by ratio."""
    rows = [(len(ids) / context.p, 1 - context.test_accuracy(context.scaled, ids), " ".join(map(str, sorted(ids)))) for ids in subsets]
    frame = context.spark.createDataFrame(rows, "fRatio double, eRate_test double, fset string")
    best = F.min_by(F.struct("eRate_test", "fset"), F.struct("eRate_test", "fset"))
    return frame.groupBy("fRatio").agg(best.alias("b")).select("fRatio", "b.*").orderBy("fRatio")


def score_front(context: Context, scores: DataFrame) -> DataFrame:
    """test_front of the ratio grid over ranked scores."""
    order = [r["fid"] for r in stats.ranked(scores).orderBy("rank").select("fid").collect()]
    return test_front(context, [order[: min(context.p, max(1, round(r * context.p)))] for r in context.config.ratios])


def pareto_front_on_test(context: Context, initializer: str = "knn") -> DataFrame:
    """test_front of a solved run's Pareto set."""
    result = _search(replace_config(context, post_modes=("normal",)), initializer, context.config.search).result
    return test_front(context, [[int(x) for x in result.subsets[i]] for i in result.pareto()])


def named_holdout(context: Context, subsets: dict[str, list[int]]) -> DataFrame:
    """(name, acc_test): hold-out accuracies of named subsets of the standardised features."""
    return context.spark.createDataFrame([(n, float(context.test_accuracy(context.standard, ids))) for n, ids in subsets.items()], "name string, acc_test double")


def logged(combination: tuple[str, str, str], only: tuple[str, str, str] | None) -> bool:
    """Whether a combination (initialiser, mode, post) is logged: all are, or only the one named."""
    return only is None or combination == only


#: Settings of the sensitivity sweeps.
SWEEPS = {"prob_beta": (1.4, 1.7, 2.0, 2.3), "ks_rc_tau": (0.0, 0.3, 0.6, 0.9), "buddy_lambda": (0.2, 0.5, 0.7, 1.0)}


def swept(config: Config) -> list[Config]:
    """The configurations of the sensitivity sweeps: one setting at a time, the others as they are."""
    out = []
    for name, values in SWEEPS.items():
        for v in values:
            out.append(replace(config, search=replace(config.search, tau=v)) if name == "ks_rc_tau" else replace(config, **{name: v}))
    return out


def ablation_grid(initializers: tuple[str, ...] = ("knn", "probabilistic"), modes: tuple[str, ...] = ("normal", "rc_greedy"), posts: tuple[str, ...] = ("normal", "buddy")) -> list[tuple[str, str, str]]:
    return [(i, m, p) for i in initializers for m in modes for p in posts]

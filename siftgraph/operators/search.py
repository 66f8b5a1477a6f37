"""Bi-objective evolutionary search over graph edges.

The population (some tens of genomes) lives on the driver; every generation's
new subsets are one frame, evaluated in parallel. Objectives depend on the
subset only, so they are remembered by subset, never by genes: the node weights
that decode genes change during the search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kshell import MODES, Decoder
from .knn import BLOCK, Matrix, Rows, accuracies, dealt, ends, extremes, far_and_near


@dataclass(frozen=True)
class Settings:
    population: int = 20
    generations: int = 50
    crossover: float = 0.9
    mutation: float = 0.01
    tour: int = 2
    gap: int = 5  # generations between changes of the node weights
    k: int = 5
    mode: str = "normal"
    tau: float = 0.3
    most_added: int = 5
    weight_sharing: bool = True
    baseline: bool = False  # objectives (-accuracy, size) instead of (error, size / p)


def dominates(f: np.ndarray) -> np.ndarray:
    """Matrix: row dominates column (no objective worse, one better; smaller is better)."""
    le = (f[:, None, :] <= f[None]).all(2)
    return le & (f[:, None, :] < f[None]).any(2)


def sort_fronts(f: np.ndarray) -> np.ndarray:
    """Ranks from 1 by peeling non-dominated fronts."""
    rank = np.zeros(len(f), np.int64)
    d = dominates(f)
    left = np.ones(len(f), bool)
    level = 0
    while left.any():
        level += 1
        free = left & ~(d & left[:, None]).any(0)
        rank[free] = level
        left &= ~free
    return rank


def crowding(f: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Per front the sum over objectives of scaled gaps between neighbours; ends, and fronts without a range, are infinite."""
    out = np.zeros(len(f))
    for r in np.unique(rank):
        at = np.flatnonzero(rank == r)
        for m in range(f.shape[1]):
            order = at[np.argsort(f[at, m], kind="stable")]
            v = f[order, m]
            out[order[[0, -1]]] = np.inf
            span = v[-1] - v[0] if np.isfinite(v).all() else 0
            if not span > 0:
                out[order] = np.inf
            elif len(order) > 2:
                out[order[1:-1]] += (v[2:] - v[:-2]) / span
    return out


def tournament(rank: np.ndarray, crowd: np.ndarray, pool: int, tour: int, rng: np.random.Generator) -> np.ndarray:
    """Indices of winners of draws of distinct candidates: lower rank, then larger distance, then the first drawn."""
    n, out = len(rank), []
    for _ in range(pool):
        drawn: list[int] = []
        while len(drawn) < min(tour, n):
            i = min(n, max(1, round(rng.random() * n))) - 1
            if i not in drawn:
                drawn.append(i)
        out.append(min(drawn, key=lambda i: (rank[i], -crowd[i])))
    return np.array(out)


def cross(parents: np.ndarray, chance: float, rng: np.random.Generator) -> np.ndarray:
    """Two children of each parent and a random other one, swapping each gene by the chance."""
    n = len(parents)
    children = []
    for i in range(n):
        mate = int(rng.integers(n - 1)) if n > 1 else 0
        mate += mate >= i and n > 1
        swap = rng.random(parents.shape[1]) < chance
        children += [np.where(swap, parents[mate], parents[i]), np.where(swap, parents[i], parents[mate])]
    return np.array(children)


def mutate(genes: np.ndarray, chance: float | None, rng: np.random.Generator, base: np.ndarray | None = None) -> np.ndarray:
    """Each locus moves by a random step within its base (2: a flipped bit) by the chance, 0.7 / length by default."""
    base = np.full(genes.shape[1], 2) if base is None else base
    chance = 0.7 / genes.shape[1] if chance is None else chance
    hit = rng.random(genes.shape) < chance
    step = 1 + np.floor(rng.random(genes.shape) * (base - 1)).astype(genes.dtype)
    return np.where(hit, (genes + step) % base, genes)


def survivors(rank: np.ndarray, crowd: np.ndarray, n: int) -> np.ndarray:
    """Whole fronts while they fit, then the largest distances."""
    order = np.lexsort((np.arange(len(rank)), -crowd, rank))
    return order[:n]


def _mean_ratio(frame: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ratio): mean of near over far, both scaled over a key's rows; ratios that are not finite are missing."""
    inf = float("inf")
    ends = frame.groupBy(*keys).agg(F.least(F.min("far"), F.min("near")).alias("lo"), F.greatest(F.max("far"), F.max(F.when(F.col("near") < inf, F.col("near")))).alias("hi"))
    rows = frame.join(F.broadcast(ends), keys) if keys else frame.join(F.broadcast(ends))  # a row for each subset
    span = F.col("hi") - F.col("lo")
    scaled = lambda c: F.when(span > 0, (F.col(c) - F.col("lo")) / span).otherwise(0.5)
    ratio = F.when((F.col("near") < inf) & (scaled("far") > 0), scaled("near") / scaled("far"))
    return rows.groupBy(*keys).agg(F.coalesce(F.avg(ratio), F.lit(0.0)).alias("ratio"))


def separation(matrix: Matrix | Rows, subsets: list[np.ndarray], spark: SparkSession | None = None) -> np.ndarray:
    """Mean over samples of nearest other-class over farthest same-class distance, each scaled over both; 0 for empty subsets.

    Ratios that are not finite count as missing. A matrix of one block is settled
    here; of a larger one each task takes a share of the samples of a subset, and
    rows over the broadcast bound go through the grid, so no task holds all distances.
    """
    if isinstance(matrix, Rows):
        return np.array([_mean_ratio(extremes(matrix.part(s)), []).first()[0] if len(s) else 0.0 for s in subsets])
    if len(matrix.y) <= BLOCK:
        return np.array([_ratio(*far_and_near(b, [b])) if len(s) else 0.0 for s in subsets for b in [matrix.block(s)]])
    shared = matrix.shared(spark)
    jobs = dealt(subsets, len(matrix.y), spark)
    if not jobs:
        return np.zeros(len(subsets))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matrix(*shared.value)
        for f in frames:
            for at in f["id"]:
                i, share, shares, ids = jobs[at]
                far, near = ends(m.block(ids), (share, shares))
                yield pd.DataFrame({"subset": i, "far": far, "near": near})

    found = spark.range(0, len(jobs), 1, len(jobs)).mapInPandas(run, "subset int, far double, near double").persist()
    out = np.zeros(len(subsets))
    for r in _mean_ratio(found, ["subset"]).collect():
        out[r["subset"]] = r["ratio"]
    found.unpersist()
    return out


def _ratio(far: np.ndarray, near: np.ndarray) -> float:
    both = np.concatenate([far, near[np.isfinite(near)]])
    lo, span = both.min(), both.max() - both.min()
    scaled = lambda v: (v - lo) / span if span > 0 else np.full(len(v), 0.5)
    near, far = scaled(near[np.isfinite(near)]), scaled(far[np.isfinite(near)])
    ok = far > 0
    return float((near[ok] / far[ok]).mean()) if ok.any() else 0.0


@dataclass
class Result:
    genes: np.ndarray
    subsets: list[np.ndarray]
    objectives: np.ndarray
    rank: np.ndarray
    weight: np.ndarray
    log: list[dict] = field(default_factory=list)

    def best(self) -> int:
        """The individual of best 0.9 * accuracy + 0.1 * (1 - share of features); without edges is worst."""
        f = self.objectives
        p = len(self.weight)
        score = 0.9 * (1 - f[:, 0]) + 0.1 * (1 - f[:, 1]) if f[:, 0].min() >= 0 else 0.9 * np.abs(f[:, 0]) + 0.1 * (1 - f[:, 1] / p)
        return int(np.where(np.isfinite(f).all(1), score, -np.inf).argmax())

    def pareto(self) -> np.ndarray:
        """Non-dominated individuals, duplicates kept."""
        return np.flatnonzero(~dominates(self.objectives).any(0) & np.isfinite(self.objectives).all(1))


class Search:
    """The generation loop. comp and sim are needed for the mode rc_greedy only."""

    def __init__(self, spark: SparkSession, decoder: Decoder, matrix: Matrix | Rows, weight: np.ndarray, settings: Settings = Settings(), comp: np.ndarray | None = None, sim: np.ndarray | None = None):
        if settings.mode not in MODES:
            raise ValueError(f"no k-shell mode {settings.mode}")
        if settings.mode == "rc_greedy" and (comp is None or sim is None):
            raise ValueError("rc_greedy needs complementarity and similarity")
        self.spark, self.decoder, self.matrix, self.weight, self.settings = spark, decoder, matrix, weight.copy(), settings
        self.comp, self.sim = comp, sim
        self.known: dict[tuple[int, ...], float] = {(): 0.0}

    def accuracies(self, subsets: list[tuple[int, ...]]) -> None:
        """Accuracies of subsets not seen before, by one parallel evaluation."""
        new = [s for s in dict.fromkeys(subsets) if s not in self.known]
        if not new:
            return
        self.known |= zip(new, accuracies(new, self.matrix, self.spark, self.settings.k))

    def evaluate(self, population: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Subsets and objectives of genomes; a genome without edges has infinite ones and all features."""
        p, s = len(self.weight), self.settings
        cores = [self.decoder.core(g, self.weight) for g in population]
        longer = [MODES[s.mode](c, self.comp, self.sim, s.tau, s.most_added) if len(c) else c for c in cores]
        key = lambda x: tuple(int(i) for i in x)
        self.accuracies([key(x) for x in (*cores, *longer) if len(x)])
        subsets, objectives = [], []
        for core, more in zip(cores, longer):
            if not len(core):
                subsets.append(np.arange(p))
                objectives.append((np.inf, np.inf))
                continue
            options = []
            for x in dict.fromkeys((key(core), key(more))):
                error = 1 - self.known[x]
                options.append((0.9 * (1 - error) + 0.1 * len(x) / p, x, error))
            # Ties go to the extension, which comes last.
            _, x, error = max(reversed(options), key=lambda o: o[0])
            subsets.append(np.array(x))
            objectives.append((-(1 - error), float(len(x))) if s.baseline else (error, len(x) / p))
        return subsets, np.array(objectives)

    def run(self, seed: int) -> Result:
        s, rng = self.settings, np.random.default_rng(seed)
        genes = (rng.random((s.population, len(self.decoder))) < 0.5).astype(np.int64)
        subsets, f = self.evaluate(genes)
        rank = sort_fronts(f)
        crowd = crowding(f, rank)
        order = survivors(rank, crowd, s.population)
        genes, subsets, f, rank, crowd = genes[order], [subsets[i] for i in order], f[order], rank[order], crowd[order]
        archive: dict[tuple[int, ...], float] = {}
        log = [self.metrics(0, f, rank)]
        for generation in range(1, s.generations + 1):
            pool = tournament(rank, crowd, max(1, s.population // 2), s.tour, rng)
            children = mutate(cross(genes[pool], s.crossover, rng), s.mutation, rng)
            own, g = self.evaluate(children)
            genes, subsets, f = np.concatenate([genes, children]), subsets + own, np.concatenate([f, g])
            rank = sort_fronts(f)
            crowd = crowding(f, rank)
            order = survivors(rank, crowd, s.population)
            genes, subsets, f, rank, crowd = genes[order], [subsets[i] for i in order], f[order], rank[order], crowd[order]
            for i in np.flatnonzero((rank == 1) & np.isfinite(f).all(1)):
                archive[tuple(int(x) for x in subsets[i])] = 0.0
            if s.weight_sharing and generation % s.gap == 0 and archive:
                members = [np.array(x) for x in archive]
                values = separation(self.matrix, members, self.spark)
                keep = np.argsort(-values, kind="stable")[: s.population]
                for i in keep:
                    self.weight[members[i]] += values[i]
                archive = {}
            log.append(self.metrics(generation, f, rank))
        return Result(genes, subsets, f, rank, self.weight, log)

    @staticmethod
    def metrics(generation: int, f: np.ndarray, rank: np.ndarray) -> dict:
        ok = f[np.isfinite(f).all(1)]
        mean, std = (ok.mean(0), ok.std(0)) if len(ok) else (np.full(2, np.nan),) * 2
        return {"gen": generation, "mean_obj1": float(mean[0]), "mean_obj2": float(mean[1]), "std_obj1": float(std[0]), "std_obj2": float(std[1]), "prop_rank1": float((rank == 1).mean()), "rank1": ok[:0].tolist() if not len(ok) else f[rank == 1].tolist()}


def fronts_frame(result: Result, spark: SparkSession) -> DataFrame:
    """(point_id, f1, f2, fset) of the Pareto set."""
    rows = [(int(i), float(result.objectives[i, 0]), float(result.objectives[i, 1]), [int(x) for x in result.subsets[i]]) for i in result.pareto()]
    return spark.createDataFrame(rows, "point_id int, f1 double, f2 double, fset array<int>")


def log_frame(result: Result, spark: SparkSession) -> DataFrame:
    """Metrics of each generation."""
    return spark.createDataFrame([tuple(x[c] for c in _LOG) for x in result.log], "gen int, mean_obj1 double, mean_obj2 double, std_obj1 double, std_obj2 double, prop_rank1 double")


_LOG = ("gen", "mean_obj1", "mean_obj2", "std_obj1", "std_obj2", "prop_rank1")


def population_metrics(population: DataFrame) -> DataFrame:
    """Metrics by generation of a frame (gen, obj1, obj2, rank)."""
    return population.groupBy("gen").agg(F.avg("obj1").alias("mean_obj1"), F.avg("obj2").alias("mean_obj2"), F.stddev_pop("obj1").alias("std_obj1"), F.stddev_pop("obj2").alias("std_obj2"), F.avg((F.col("rank") == 1).cast("double")).alias("prop_rank1"))


def truncated(archive: DataFrame, groups: list[str], value: str, key: str, most: int) -> DataFrame:
    """Of each group the rows of the `most` largest values; ties by key."""
    rn = F.row_number().over(W.partitionBy(*groups).orderBy(F.desc(value), key))
    return archive.withColumn("__rn", rn).where(F.col("__rn") <= most).drop("__rn")


def generation_rows(result: Result, spark: SparkSession) -> DataFrame:
    """(gen, obj1, obj2): the objectives of each generation's first front."""
    return spark.createDataFrame([(x["gen"], float(a), float(b)) for x in result.log for a, b in x["rank1"]], "gen int, obj1 double, obj2 double")


# Refinement after the search.


def buddy(core: list[int], comp: np.ndarray, sim: np.ndarray, accuracy: Callable[[list[tuple[int, ...]]], list[float]], lam: float = 0.5, per_core: int = 1, batch: int = 16) -> list[int]:
    """core with, for each of its features in order, up to per_core candidates that raise the accuracy.

    Candidates come by comp - lam * sim, descending. Batches of them are evaluated
    at once and the first improving one in order is taken, as one by one would be.
    """
    chosen = list(core)
    best = accuracy([tuple(sorted(chosen))])[0]
    for f in core:
        added = 0
        order = np.argsort(-(comp[f] - lam * sim[f]), kind="stable")
        queue = [int(c) for c in order if c != f]
        while queue and added < per_core:
            queue = [c for c in queue if c not in chosen]
            part, queue = queue[:batch], queue[batch:]
            values = accuracy([tuple(sorted([*chosen, c])) for c in part])
            for k, (c, v) in enumerate(zip(part, values)):
                if v > best:
                    chosen.append(c)
                    best, added = v, added + 1
                    queue = part[k + 1 :] + queue
                    break
    return sorted(chosen)


def _by_buddies(core, comp, sim, accuracy, lam, per_core):
    if comp is None or sim is None or accuracy is None:
        raise ValueError("buddy needs complementarity, similarity and accuracies")
    return buddy(core, comp, sim, accuracy, lam, per_core)


#: Ways to refine a subset after the search, open to more: fn(core, comp, sim, accuracy, lam, per_core) -> ids.
POST_MODES: dict[str, Callable[..., list[int]]] = {"normal": lambda core, *_: sorted(core), "none": lambda core, *_: sorted(core), "buddy": _by_buddies}


def register_post_mode(name: str, function: Callable[..., list[int]]) -> None:
    POST_MODES[name] = function


def refine(mode: str, core: list[int], comp=None, sim=None, accuracy=None, lam: float = 0.5, per_core: int = 1) -> list[int]:
    if mode not in POST_MODES:
        raise ValueError(f"no post mode {mode}")
    return POST_MODES[mode](core, comp, sim, accuracy, lam, per_core)

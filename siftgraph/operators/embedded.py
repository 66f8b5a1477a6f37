"""Embedded and wrapper selectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import finite
from . import knn
from .knn import Matrix, Rows


def _vectors(wide: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return wide.select(F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features"))


def l1_importance(wide: DataFrame, most: int = 200) -> DataFrame:
    """(fid, score): mean absolute coefficient over one-against-rest logistic regressions with an L1 penalty of 1 / rows."""
    from pyspark.ml.classification import LogisticRegression, OneVsRest

    rows = _vectors(wide).cache()
    n = rows.count()
    one = LogisticRegression(elasticNetParam=1.0, regParam=1.0 / max(1, n), standardization=False, maxIter=most)
    if rows.select("label").distinct().count() > 2:
        models = OneVsRest(classifier=one, parallelism=4).fit(rows).models
    else:
        models = [one.fit(rows)]
    rows.unpersist()
    scores = np.mean([np.abs(m.coefficients.toArray()) for m in models], axis=0)
    return wide.sparkSession.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "fid int, score double")


#: Bins of a feature's values, and cells of the histograms that a tree holds at once.
BINS, CELLS = 32, 1 << 18


def _cuts(x: np.ndarray) -> np.ndarray:
    """Thresholds between a feature's values: all where there are few, else those nearest to even shares of the rows."""
    values, counts = np.unique(x, return_counts=True)
    if len(values) > BINS:
        before = np.cumsum(counts)[:-1]
        aims = len(x) * np.arange(1, BINS) / BINS
        at = np.clip(np.searchsorted(before, aims), 0, len(before) - 1)
        low = np.maximum(at - 1, 0)
        at = np.unique(np.where(aims - before[low] < before[at] - aims, low, at))
    else:
        at = np.arange(len(values) - 1)
    return values[at] / 2 + values[at + 1] / 2


def _grown(bins: np.ndarray, y: np.ndarray, classes: int, deepest: int, tried: int, rng: np.random.Generator) -> np.ndarray:
    """A tree's share of impurity taken away by each feature: rows weighted by Poisson(1), splits by Gini among `tried` features of each node.

    As in pyspark.ml, a split whose children are leaves with one prediction is none.
    """
    p = bins.shape[1]
    weight = rng.poisson(1.0, len(y)).astype(np.float64)
    rows = np.flatnonzero(weight)
    node, m, levels = np.zeros(len(rows), np.int64), 1, []
    for depth in range(deepest + 1):
        total = np.bincount(node * classes + y[rows], weight[rows], m * classes).reshape(m, classes)
        n = total.sum(1)
        gain, feature, cut = np.zeros(m), np.zeros(m, np.int64), np.zeros(m, np.int64)
        open_ = np.flatnonzero(total.max(1) < n) if depth < deepest else np.zeros(0, np.int64)
        ends = np.searchsorted(node, np.arange(m + 1))  # rows are sorted by node
        size = max(1, CELLS // (tried * BINS * classes))
        for a in range(0, len(open_), size):
            own = open_[a : a + size]
            at = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in own])
            place = np.repeat(np.arange(len(own)), ends[own + 1] - ends[own])
            ids = np.argpartition(rng.random((len(own), p)), tried - 1, axis=1)[:, :tried]
            cell = ((place[:, None] * tried + np.arange(tried)) * BINS + bins[rows[at][:, None], ids[place]]) * classes + y[rows[at]][:, None]
            h = np.bincount(cell.ravel(), np.repeat(weight[rows[at]], tried), len(own) * tried * BINS * classes).reshape(len(own), tried, BINS, classes)
            left = h.cumsum(2)[:, :, :-1]
            t, all_ = total[own], n[own][:, None, None]
            nl = left.sum(3)
            nr = all_ - nl
            squares = np.einsum("mtbc,mtbc->mtb", left, left)
            others = (t * t).sum(1)[:, None, None] - 2 * np.einsum("mtbc,mc->mtb", left, t) + squares
            ok = (nl >= 1) & (nr >= 1)
            score = np.where(ok, squares / np.maximum(nl, 1) + others / np.maximum(nr, 1), -np.inf).reshape(len(own), -1)
            best = score.argmax(1)
            gain[own] = score[np.arange(len(own)), best] / n[own] - ((t / n[own][:, None]) ** 2).sum(1)
            feature[own], cut[own] = ids[np.arange(len(own)), best // (BINS - 1)], best % (BINS - 1)
        split = gain > 1e-12
        levels.append((split, np.where(split, gain * n, 0), feature, total.argmax(1)))
        if not split.any():
            break
        keep = split[node]
        rows, node = rows[keep], node[keep]
        node = 2 * (np.cumsum(split) - 1)[node] + (bins[rows, feature[node]] > cut[node])
        by = np.argsort(node, kind="stable")
        rows, node, m = rows[by], node[by], 2 * int(split.sum())
    out, leaf, guess = np.zeros(p), np.zeros(0, bool), np.zeros(0, np.int64)
    for split, value, feature, own in reversed(levels):
        at = np.flatnonzero(split)
        alike = leaf[0::2] & leaf[1::2] & (guess[0::2] == guess[1::2])
        np.add.at(out, feature[at[~alike]], value[at[~alike]])
        leaf = ~split
        leaf[at[alike]], guess = True, own
    return out / out.sum() if out.sum() else out


def forest_importance(wide: DataFrame, trees: int = 200, seed: int = 0, deepest: int = 30) -> DataFrame:
    """(fid, score): impurity importances of a random forest with the settings of pyspark.ml.

    Each tree grows in one task on the binned features, which are broadcast; over
    BROADCAST, or with values that are not finite, the forest is that of pyspark.ml,
    whose levels are passes over the rows.
    """
    spark = wide.sparkSession
    rows = wide.select("sample_id", "label", "features")
    size, odd = rows.agg(F.sum(8 * F.size("features")), F.max(F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | F.col("label").isNull())).first()
    if not size or size > knn.BROADCAST or odd:
        from pyspark.ml.classification import RandomForestClassifier

        model = RandomForestClassifier(numTrees=trees, seed=seed, maxDepth=deepest).fit(_vectors(wide))
        return spark.createDataFrame([(i, float(s)) for i, s in enumerate(model.featureImportances.toArray())], "fid int, score double")
    found = rows.orderBy("sample_id").toArrow()
    names, y = np.unique(found.column("label").to_numpy(), return_inverse=True)
    x = np.asarray(found.column("features").combine_chunks().flatten(), np.float64).reshape(len(y), -1)
    p = x.shape[1]
    bins = np.stack([np.searchsorted(_cuts(c), c).astype(np.uint8) for c in x.T], axis=1)
    shared = spark.sparkContext.broadcast((bins, y))
    tried, classes = math.ceil(math.sqrt(p)) if trees > 1 else p, len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree in batch.column("id").to_pylist():
                own = _grown(*shared.value, classes, deepest, tried, np.random.default_rng([seed, tree]))
                yield pa.RecordBatch.from_arrays([pa.array([tree]), pa.array([own.tolist()], pa.list_(pa.float64()))], names=["tree", "scores"])

    grown = spark.range(0, trees, 1, min(trees, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "tree long, scores array<double>").collect()
    scores = np.sum([r["scores"] for r in sorted(grown)], axis=0)
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores / (scores.sum() or 1.0))], "fid int, score double")


# Linear support vector machines with the squared hinge, one against the rest.


def _parts(weights: np.ndarray, classes: np.ndarray, ids: np.ndarray):
    """For each task the gradients and Hessians of the squared hinge at the weights (classes x features + 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, hessian = 0.0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("features").to_pylist(), np.float64)[:, ids]
            x = np.column_stack([x, np.ones(len(x))])
            y = np.where(batch.column("label").to_numpy(zero_copy_only=False)[:, None] == classes[None], 1.0, -1.0)
            gap = np.maximum(0, 1 - y * (x @ weights.T))
            gradient = gradient - 2 * (y * gap).T @ x
            hessian = hessian + 2 * np.einsum("nc,ni,nj->cij", (gap > 0).astype(float), x, x, optimize=True)
        if isinstance(gradient, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array([gradient.tobytes()], pa.binary()), pa.array([hessian.tobytes()], pa.binary())], names=["g", "h"])

    return run


def linear_svm(wide: DataFrame, ids: list[int], c: float = 1.0, most: int = 12, classes: np.ndarray | None = None, constant: bool = False) -> np.ndarray:
    """Coefficients (classes x features, with constant one more) by Newton steps; each step adds up the tasks' sums, whose size does not depend on the rows."""
    classes = np.array(sorted(r[0] for r in wide.select("label").distinct().collect())) if classes is None else classes
    at = np.array(ids)
    p = len(at) + 1
    weights = np.zeros((len(classes), p))
    penalty = np.diag([1.0] * (p - 1) + [1e-6])
    for _ in range(most):
        gradient, hessian = np.zeros((len(classes), p)), np.zeros((len(classes), p, p))
        for r in wide.select("label", "features").mapInArrow(_parts(weights, classes, at), "g binary, h binary").toLocalIterator():
            gradient += np.frombuffer(r["g"]).reshape(gradient.shape)
            hessian += np.frombuffer(r["h"]).reshape(hessian.shape)
        step = np.stack([np.linalg.solve(c * h + penalty, c * g + penalty @ w) for g, h, w in zip(gradient, hessian, weights)])
        weights = weights - step
        if np.abs(step).max() < 1e-6:
            break
    return weights if constant else weights[:, :-1]


def rfe_svm(wide: DataFrame, k: int, drop: float = 0.1) -> list[int]:
    """k features left after dropping a share of those with the least squared coefficients, step by step."""
    rows = wide.select("label", "features").cache()
    left = list(range(rows.agg(F.max(F.size("features"))).first()[0] or 0))
    while len(left) > k:
        size = (linear_svm(rows, left, most=6) ** 2).sum(0)
        out = min(max(1, int(drop * len(left))), len(left) - k)
        order = np.lexsort((-np.array(left), size))  # of equal ones the larger id goes first
        gone = set(order[:out].tolist())
        left = [f for i, f in enumerate(left) if i not in gone]
    rows.unpersist()
    return left


def _local_svm(x: np.ndarray, y: np.ndarray, classes: np.ndarray, most: int = 8) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    signs = np.where(y[:, None] == classes[None], 1.0, -1.0)
    weights = np.zeros((len(classes), x.shape[1]))
    for _ in range(most):
        gap = np.maximum(0, 1 - signs * (x @ weights.T))
        moved = 0.0
        for c in range(len(classes)):
            on = gap[:, c] > 0
            step = np.linalg.solve(2 * x[on].T @ x[on] + penalty, -2 * x[on].T @ (signs[on, c] * gap[on, c]) + penalty @ weights[c])
            weights[c] -= step
            moved = max(moved, np.abs(step).max())
        if moved < 1e-5:
            break
    return weights


def _guesses(weights: np.ndarray, classes: np.ndarray, at: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("features").to_pylist(), np.float64).reshape(batch.num_rows, -1)[:, at]
            guess = classes[(np.column_stack([x, np.ones(len(x))]) @ weights.T).argmax(1)]
            yield pa.RecordBatch.from_arrays([pa.array((guess == batch.column("label").to_numpy()).astype(np.float64))], names=["hit"])

    return run


def svm_accuracy(rows: Rows, ids: list[int]) -> float:
    """Cross-validated accuracy of linear SVMs on rows that stay in the tasks: only sums reach the driver."""
    classes = np.array(sorted(r[0] for r in rows.rows.select("label").distinct().collect()))
    hits = []
    for fold in sorted(r[0] for r in rows.rows.select("fold").distinct().collect()):
        weights = linear_svm(rows.rows.where(F.col("fold") != fold), ids, most=8, classes=classes, constant=True)
        test = rows.rows.where(F.col("fold") == fold).select("label", "features")
        hits.append(test.mapInArrow(_guesses(weights, classes, np.array(ids)), "hit double").agg(F.avg("hit")).first()[0])
    return float(np.mean(hits))


def sfs_svm(matrix: Matrix | Rows, spark, k: int) -> list[int]:
    """k features by greedy forward selection on the cross-validated accuracy of linear SVMs; each step's candidates run in parallel.

    Over the broadcast bound candidates follow one another, each with its rows in parallel.
    """
    if isinstance(matrix, Rows):
        picks: list[int] = []
        while len(picks) < min(k, matrix.p):
            scores = {f: svm_accuracy(matrix, [*picks, f]) for f in range(matrix.p) if f not in picks}
            picks.append(min(scores, key=lambda f: (-round(scores[f], 12), f)))
        return picks
    shared = spark.sparkContext.broadcast(matrix.parts)
    chosen: list[int] = []
    p = matrix.x.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matrix(*shared.value)
        classes = np.unique(m.y)
        for batch in batches:
            ids, scores = batch.column("fid").to_pylist(), []
            for f in ids:
                x = m.x[:, [*chosen, f]]
                hits = 0.0
                folds = np.unique(m.folds)
                for fold in folds:
                    test = m.folds == fold
                    w = _local_svm(x[~test], m.y[~test], classes)
                    guess = classes[(np.column_stack([x[test], np.ones(test.sum())]) @ w.T).argmax(1)]
                    hits += float(np.mean(guess == m.y[test]))
                scores.append(hits / len(folds))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(scores)], names=["fid", "accuracy"])

    while len(chosen) < min(k, p):
        rest = [(f,) for f in range(p) if f not in chosen]
        frame = spark.createDataFrame(rest, "fid int").repartition(min(len(rest), 32), "fid")
        best = frame.mapInArrow(run, "fid int, accuracy double").orderBy(F.desc("accuracy"), "fid").first()
        chosen.append(best["fid"])
    return chosen


#: Registries, open to more: score methods fn(wide) -> (fid, score) and subset methods fn(wide, matrix, k) -> ids.
EMBEDDED: dict[str, Callable[[DataFrame], DataFrame]] = {"EMB_L1_LogReg": l1_importance, "EMB_RF_importance": forest_importance}
WRAPPERS: dict[str, Callable[[DataFrame, Matrix | Rows, int], list[int]]] = {
    "WRAP_RFE_SVM": lambda wide, matrix, k: rfe_svm(wide, k),
    "WRAP_SFS_SVM": lambda wide, matrix, k: sfs_svm(matrix, wide.sparkSession, k),
}


def embedded_scores(wide: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(method, fid, score) of the named methods."""
    out = None
    for name in names or list(EMBEDDED):
        part = EMBEDDED[name](wide).select(F.lit(name).alias("method"), "fid", finite(F.col("score")).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out

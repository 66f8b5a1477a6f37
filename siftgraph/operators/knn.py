"""Nearest neighbours and accuracies.

All pairs of rows meet in a grid of cells: rows are packed into blocks of BLOCK
rows, query blocks are dealt to G columns and row blocks to G lines, and each cell
takes the blocks of its column and line. So a block is sent G times, about the
root of the number of tasks, not once for every other block. A cell holds its row
blocks (CELL bytes at most), passes its query blocks by them one after another
and leaves the k nearest of each query; these merge by query. Distances are
Euclidean; ties go to the smaller row id, tied votes to the smaller label.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import line
from .leaves import Leaves

BLOCK = 2048
#: Bytes of row blocks that a cell holds.
CELL = 128 << 20
#: Bytes of a training matrix up to which subset evaluation broadcasts it.
BROADCAST = 64 << 20
#: Features up to which boxes of leaves rule out most rows.
PRUNED = 8


def _packed(rows: DataFrame) -> DataFrame:
    """Blocks (x, ids, labels, folds) of at most BLOCK rows, as binary columns."""

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(parts)
        x = np.array(part.column("features").to_pylist(), np.float64)
        ids, labels, folds = (part.column(c).to_numpy().astype(np.int64) for c in ("sample_id", "label", "fold"))
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x, ids, labels, folds)], names=["x", "ids", "labels", "folds"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                if size + part.num_rows > BLOCK:
                    yield block(held)
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if size:
            yield block(held)

    fold = F.col("fold").cast("long") if "fold" in rows.columns else F.lit(0).cast("long")
    return rows.select(F.col("sample_id").cast("long").alias("sample_id"), F.col("label").cast("long").alias("label"), fold.alias("fold"), "features").mapInArrow(run, "x binary, ids binary, labels binary, folds binary")


class Block:
    """Rows of a block: features, ids, labels and folds."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, folds: np.ndarray):
        self.x, self.ids, self.labels, self.folds = x, ids, labels, folds
        self.squares = (x * x).sum(1)

    @classmethod
    def of(cls, row: dict) -> Block:
        ids, labels, folds = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "folds"))
        return cls(np.frombuffer(row["x"]).reshape(len(ids), -1), ids, labels, folds)

    def part(self, at: slice | np.ndarray) -> Block:
        return Block(self.x[at], self.ids[at], self.labels[at], self.folds[at])


def _barred(q: Block, r: Block, other_fold: bool, not_self: bool) -> np.ndarray | None:
    """Pairs that do not count."""
    out = None
    if other_fold:
        out = q.folds[:, None] == r.folds[None]
    if not_self:
        own = q.ids[:, None] == r.ids[None]
        out = own if out is None else out | own
    return out


def _close(q: Block, r: Block, k: int, barred: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in q, place in r, squared distance) of pairs that hold the k nearest rows of each query, and ties.

    Products of the blocks tell which pairs can be among them, within rounding;
    these pairs' distances are added up feature by feature, so equal rows have
    equal distances.
    """
    rough = q.squares[:, None] + r.squares[None] - 2 * (q.x @ r.x.T)
    if barred is not None:
        rough[barred] = np.inf
    slack = 1e-11 * (q.squares.max(initial=0) + r.squares.max(initial=0))
    k = min(k, len(r.ids))
    cut = np.partition(rough, k - 1, axis=1)[:, k - 1 : k] + slack
    at, near = np.nonzero((rough <= cut) & np.isfinite(rough))
    d = np.zeros(len(at))
    for x, y in zip(q.x.T, r.x.T):
        step = x[at] - y[near]
        d += step * step
    return at, near, d


def nearest(q: Block, rows: list[Block], k: int, other_fold: bool = False, not_self: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place in q, row id, row label, squared distance) of the k nearest rows of each query, by query, distance and id."""
    held = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.float64))
    for r in rows:
        if not len(q.ids) or not len(r.ids) or not k:
            continue
        at, near, d = _close(q, r, k, _barred(q, r, other_fold, not_self))
        at, ids, labels, d = (np.concatenate(x) for x in zip(held, (at, r.ids[near], r.labels[near], d)))
        order = np.lexsort((ids, d, at))
        first = np.searchsorted(at[order], np.arange(len(q.ids)))
        keep = order[np.arange(len(order)) - first[at[order]] < k]
        held = at[keep], ids[keep], labels[keep], d[keep]
    return held


def grid(queries: DataFrame, rows: DataFrame, work: Callable[[Block, list[Block]], pa.RecordBatch | None], schema: str) -> DataFrame:
    """What work yields of each query block and the row blocks of each line of the grid."""
    spark = queries.sparkSession
    parallel = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = rows.agg(F.sum(8 * F.size("features") + 24)).first()[0] or 0
    g = max(math.ceil(math.sqrt(parallel)), math.ceil(2 * size / CELL))
    own = F.pmod(F.xxhash64("ids"), F.lit(g))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(g - 1).cast("long")))
    left = _packed(queries).withColumn("line", every).withColumn("column", own).withColumn("query", F.lit(1))
    right = _packed(rows).withColumn("column", every).withColumn("line", own).withColumn("query", F.lit(0))
    cells = left.unionByName(right).repartition(min(g * g, 4 * parallel), "line", "column").sortWithinPartitions("line", "column", "query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if (row["line"], row["column"]) != cell:
                    cell, held = (row["line"], row["column"]), []
                block = Block.of(row)
                if not row["query"]:
                    held.append(block)
                elif held and (out := work(block, held)) is not None:
                    yield out

    return cells.mapInArrow(run, schema)


def neighbours(queries: DataFrame, rows: DataFrame, k: int = 5, other_fold: bool = False, not_self: bool = False) -> DataFrame:
    """(query_id, query_label, query_fold, row_id, row_label, distance, rank): the k nearest rows of each query.

    With other_fold only rows of another fold count, with not_self a row is not its own neighbour.
    """

    def work(q: Block, held: list[Block]) -> pa.RecordBatch:
        at, ids, labels, d = nearest(q, held, k, other_fold, not_self)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (q.ids[at], q.labels[at], q.folds[at], ids, labels, np.sqrt(d))], names=["query_id", "query_label", "query_fold", "row_id", "row_label", "distance"])

    found = grid(queries, rows, work, "query_id long, query_label long, query_fold long, row_id long, row_label long, distance double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "row_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def extremes(rows: DataFrame) -> DataFrame:
    """(query_id, far, near) of each row: the farthest row of its class, itself included, and the nearest of another (infinite without one)."""

    def work(q: Block, held: list[Block]) -> pa.RecordBatch:
        far, near = far_and_near(q, held)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (q.ids, far, near)], names=["query_id", "far", "near"])

    found = grid(rows, rows, work, "query_id long, far double, near double")
    return found.groupBy("query_id").agg(F.max("far").alias("far"), F.min("near").alias("near"))


def far_and_near(q: Block, rows: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    far, near = np.zeros(len(q.ids)), np.full(len(q.ids), np.inf)
    for r in rows:
        d = np.sqrt(np.maximum(q.squares[:, None] + r.squares[None] - 2 * q.x @ r.x.T, 0))
        same = q.labels[:, None] == r.labels[None]
        d[same & (q.ids[:, None] == r.ids[None])] = 0
        far = np.maximum(far, np.where(same, d, 0).max(1, initial=0))
        near = np.minimum(near, np.where(same, np.inf, d).min(1, initial=np.inf))
    return far, near


def ends(rows: Block, share: tuple[int, int] = (0, 1)) -> tuple[np.ndarray, np.ndarray]:
    """far_and_near of a share of the rows among all of them."""
    if not np.isfinite(rows.x).all():
        places = range(0, len(rows.ids), BLOCK)
        return far_and_near(rows.part(slice(share[0], None, share[1])), [rows.part(slice(a, a + BLOCK)) for a in places])
    leaves = Leaves(rows.x, rows.ids, rows.labels, 1, pure=True)
    far, near, seen = np.zeros(len(rows.ids)), np.full(len(rows.ids), np.inf), np.zeros(len(rows.ids), bool)
    for at, d in leaves.farthest(share):
        far[at], seen[at] = np.sqrt(d), True
    for at, i, _, d in leaves.nearest(share):
        near[at[i]] = np.sqrt(d)
    mine = leaves.first[seen[leaves.first]]
    return far[mine], near[mine]


def votes(near: DataFrame) -> DataFrame:
    """(query_id, query_label, query_fold, predicted) by uniform votes."""
    counts = near.groupBy("query_id", "query_label", "query_fold", "row_label").agg(F.count("*").alias("c"))
    best = F.max_by("row_label", F.struct("c", (-F.col("row_label")).alias("l")))
    return counts.groupBy("query_id", "query_label", "query_fold").agg(best.alias("predicted"))


def holdout_accuracy(wide: DataFrame, split: DataFrame, k: int = 5) -> DataFrame:
    """accuracy and n_test of a k-nearest-neighbour vote of the train rows on the test rows."""
    rows = wide.join(split.select("sample_id", "split"), "sample_id")
    found = votes(neighbours(rows.where("split = 'test'"), rows.where("split = 'train'"), k))
    return found.agg(F.coalesce(F.avg((F.col("predicted") == F.col("query_label")).cast("double")), F.lit(0.0)).alias("accuracy"), F.count("*").alias("n_test"))


def cv_accuracy(wide: DataFrame, folds: DataFrame, k: int = 5) -> DataFrame:
    """accuracy: the mean over folds of the accuracy of the other folds' vote."""
    rows = wide.join(folds.select("sample_id", "fold"), "sample_id")
    found = votes(neighbours(rows, rows, k, other_fold=True))
    by_fold = found.groupBy("query_fold").agg(F.avg((F.col("predicted") == F.col("query_label")).cast("double")).alias("a"))
    return by_fold.agg(F.coalesce(F.avg("a"), F.lit(0.0)).alias("accuracy"))


# Evaluation of many feature subsets.


class Matrix:
    """A training matrix on the driver, its labels and folds, checked against BROADCAST before it goes to the tasks."""

    def __init__(self, x: np.ndarray, y: np.ndarray, folds: np.ndarray, ids: np.ndarray | None = None):
        if x.nbytes > BROADCAST:
            raise ValueError(f"a matrix of {x.nbytes} bytes is over {BROADCAST}; Matrix.of takes such rows as they are")
        self.x, self.y, self.folds = x, y.astype(np.int64), folds.astype(np.int64)
        self.ids = np.arange(len(y)) if ids is None else ids
        self.p = self.x.shape[1] if self.x.ndim == 2 else 0
        self._sent = None

    @classmethod
    def of(cls, wide: DataFrame, folds: DataFrame) -> Matrix | Rows:
        """The matrix, or the rows as they are where it is over BROADCAST."""
        rows = wide.join(folds.select("sample_id", "fold"), "sample_id")
        size = rows.agg(F.sum(8 * F.size("features"))).first()[0] or 0
        if size > BROADCAST:
            return Rows(rows.select("sample_id", "label", "fold", "features"))
        found = rows.select("sample_id", "label", "fold", "features").orderBy("sample_id").toArrow()
        ids, labels, folds_ = (found.column(c).to_numpy() for c in ("sample_id", "label", "fold"))
        flat = found.column("features").combine_chunks()
        x = np.asarray(flat.flatten(), np.float64).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))
        return cls(x, labels, folds_, ids)

    @property
    def parts(self) -> tuple[np.ndarray, ...]:
        """What a matrix is made from: plain arrays, which a task can read without this module."""
        return self.x, self.y, self.folds, self.ids

    def shared(self, spark):
        """Its parts, broadcast once."""
        if self._sent is None:
            self._sent = spark.sparkContext.broadcast(self.parts)
        return self._sent

    def block(self, subset, at=slice(None)) -> Block:
        return Block(np.ascontiguousarray(self.x[at][:, list(subset)]), self.ids[at], self.y[at], self.folds[at])

    def accuracy(self, subset, k: int = 5) -> float:
        """Mean over folds; an empty subset has 0."""
        subset = list(subset)
        if not subset or not len(self.y):
            return 0.0
        return self.mean(self.hits(subset, k))

    def apparent(self, subset, k: int = 5) -> float:
        """Accuracy on the rows that vote themselves."""
        subset = list(subset)
        return self.mean(self.hits(subset, k, True), True) if subset and len(self.y) else 0.0

    def single(self, f: int, k: int = 5, apparent: bool = False) -> float:
        """The accuracy, or apparent accuracy, of one feature."""
        x = self.x[:, f]
        if k < 1 or not len(x) or not np.isfinite(x).all():
            return (self.apparent if apparent else self.accuracy)([f], k)
        names, fold = np.unique(self.folds, return_inverse=True)
        hits = np.zeros(len(names), np.int64)
        for q, near in line.nearest(x, self.ids, fold, k, not apparent):
            i, j = np.nonzero(near >= 0)
            guess = _most(len(q), i, self.y[near[i, j]])
            hits += np.bincount(fold[q[guess == self.y[q]]], minlength=len(names))
        return self.mean(hits, apparent)

    def hits(self, subset, k: int = 5, apparent: bool = False, share: tuple[int, int] = (0, 1)) -> np.ndarray:
        """By fold the rows whose vote is their label, of one of so many shares of the rows."""
        names, fold = np.unique(self.folds, return_inverse=True)
        return np.bincount(fold[_right(self.block(subset), k, not apparent, share)], minlength=len(names))

    def mean(self, hits: np.ndarray, apparent: bool = False) -> float:
        """The accuracy of all rows' hits."""
        rows = np.unique(self.folds, return_counts=True)[1]
        if apparent:
            return float(hits.sum() / rows.sum())
        return float(np.mean(hits / rows)) if len(rows) > 1 else 0.0


def _right(rows: Block, k: int, other_fold: bool, share: tuple[int, int]) -> np.ndarray:
    """Places of a share of the rows whose vote among the others is their label."""
    if k < 1 or not np.isfinite(rows.x).all():
        return np.flatnonzero(_hits(rows, k, other_fold)) if not share[0] else np.zeros(0, np.int64)
    pure = other_fold and rows.x.shape[1] > PRUNED  # a leaf of one fold passes over its fold
    leaves = Leaves(rows.x, rows.ids, rows.folds if other_fold else np.zeros_like(rows.folds), k, pure)
    guess, seen = np.zeros_like(rows.labels), np.zeros(len(rows.ids), bool)
    for at, i, j, d in leaves.nearest(share, other_fold):
        guess[at], seen[at] = _voted(rows.part(at), (i, rows.ids[j], rows.labels[j], d)), True
    return np.flatnonzero(seen[leaves.first] & (guess[leaves.first] == rows.labels))


def _hits(rows: Block, k: int, other_fold: bool = False) -> np.ndarray:
    """Whether each row's vote among the others is its label, block by block; for values that are not finite."""
    places = [slice(a, a + BLOCK) for a in range(0, len(rows.ids), BLOCK)]
    blocks = [rows.part(at) for at in places]
    return np.concatenate([_voted(q, nearest(q, blocks, k, other_fold)) == q.labels for q in blocks])


def _voted(q: Block, found: tuple) -> np.ndarray:
    """The label with the most votes of each query, the smaller of ties; queries without neighbours get none (the least long)."""
    at, _, labels, _ = found
    return _most(len(q.ids), at, labels)


def _most(n: int, at: np.ndarray, labels: np.ndarray) -> np.ndarray:
    names, coded = np.unique(labels, return_inverse=True)
    if not len(names):
        return np.full(n, np.iinfo(np.int64).min)
    counts = np.zeros((n, len(names)), np.int64)
    np.add.at(counts, (at, coded), 1)
    return np.where(counts.any(1), names[counts.argmax(1)], np.iinfo(np.int64).min)


class Rows:
    """Training rows over BROADCAST: a subset's accuracy comes from the block search, and nothing is collected."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.cache()
        self.p = rows.agg(F.max(F.size("features"))).first()[0] or 0

    def part(self, subset) -> DataFrame:
        ids = F.array(*(F.lit(int(i)) for i in subset))
        return self.rows.withColumn("features", F.transform(ids, lambda i: F.get("features", i)))

    def accuracy(self, subset, k: int = 5) -> float:
        """Mean over folds; an empty subset has 0."""
        subset = list(subset)
        return cv_accuracy(self.part(subset).drop("fold"), self.rows, k).first()["accuracy"] if subset else 0.0

    def apparent(self, subset, k: int = 5) -> float:
        """Accuracy on the rows that vote themselves."""
        subset = list(subset)
        if not subset:
            return 0.0
        part = self.part(subset)
        return votes(neighbours(part, part, k)).agg(F.avg((F.col("predicted") == F.col("query_label")).cast("double"))).first()[0] or 0.0


def vote(train: np.ndarray, labels: np.ndarray, ids: np.ndarray, test: np.ndarray, k: int) -> np.ndarray:
    none = np.zeros(len(test), np.int64)
    q = Block(test, np.arange(len(test)), none, none)
    rows = Block(train, ids, labels, np.zeros(len(train), np.int64))
    return _voted(q, nearest(q, [rows.part(slice(a, a + BLOCK)) for a in range(0, len(train), BLOCK)], k))


def subset_accuracies(subsets: DataFrame, matrix: Matrix | Rows, k: int = 5, apparent: bool = False) -> DataFrame:
    """subsets (key, ids) with accuracy; each subset is one row of work, or one block search after another over Rows."""
    if isinstance(matrix, Rows):
        found = [(r["key"], r["ids"], float((matrix.apparent if apparent else matrix.accuracy)(r["ids"], k))) for r in subsets.select("key", "ids").collect()]
        return subsets.sparkSession.createDataFrame(found, f"key {dict(subsets.dtypes)['key']}, ids array<int>, accuracy double")
    shared = matrix.shared(subsets.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matrix(*shared.value)
        for f in frames:
            yield f.assign(accuracy=[m.single(ids[0], k, apparent) if len(ids) == 1 else (m.apparent if apparent else m.accuracy)(ids, k) for ids in f["ids"]])

    kind = dict(subsets.dtypes)["key"]
    return subsets.select("key", "ids").mapInPandas(run, f"key {kind}, ids array<int>, accuracy double")


def dealt(subsets: list, rows: int, spark) -> list[tuple[int, int, int, list[int]]]:
    """(number of the subset, share, shares, ids), the largest subsets first: as many shares of each as keep all tasks busy."""
    shares = max(1, min(math.ceil(2 * spark.sparkContext.defaultParallelism / max(1, len(subsets))), math.ceil(rows / BLOCK)))
    jobs = [(i, share, shares, [int(f) for f in ids]) for i, ids in enumerate(subsets) if len(ids) for share in range(shares)]
    return sorted(jobs, key=lambda job: -len(job[3]))


def accuracies(subsets: list, matrix: Matrix | Rows, spark, k: int = 5) -> list[float]:
    """Accuracies of subsets at once; of few subsets each is settled by several tasks."""
    if isinstance(matrix, Rows):
        return [matrix.accuracy(s, k) for s in subsets]
    jobs = dealt(subsets, len(matrix.y), spark)
    if not jobs or not len(matrix.y):
        return [0.0] * len(subsets)
    shared = matrix.shared(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matrix(*shared.value)
        for batch in batches:
            for at in batch.column("id").to_pylist():
                i, share, shares, ids = jobs[at]
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([m.hits(ids, k, share=(share, shares)).tolist()], pa.list_(pa.int64()))], names=["subset", "hits"])

    hits: dict[int, np.ndarray] = {}
    for r in spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(run, "subset long, hits array<long>").collect():
        hits[r["subset"]] = hits.get(r["subset"], 0) + np.array(r["hits"])
    return [matrix.mean(hits[i]) if i in hits else 0.0 for i in range(len(subsets))]


def single_accuracies(matrix: Matrix, spark, k: int = 5, apparent: bool = False) -> DataFrame:
    """(fid, accuracy) of every single feature."""
    p = matrix.p
    subsets = spark.range(p).select(F.col("id").cast("int").alias("key"), F.array(F.col("id").cast("int")).alias("ids")).repartition(min(p, 32))
    return subset_accuracies(subsets, matrix, k, apparent).select(F.col("key").alias("fid"), "accuracy")


def complementarity(pairs: DataFrame, singles: DataFrame, matrix: Matrix, k: int = 5) -> DataFrame:
    """(i, j, comp) for i < j: what the pair's accuracy exceeds the better single's by, or 0; pairs (a, b) count once."""
    p = matrix.p
    pairs = pairs.select(F.least("a", "b").cast("int").alias("i"), F.greatest("a", "b").cast("int").alias("j")).where(f"i != j and i >= 0 and j < {p}").distinct()
    subsets = pairs.select(F.struct("i", "j").alias("key"), F.array("i", "j").alias("ids")).repartition(32)
    both = subset_accuracies(subsets, matrix, k).select("key.i", "key.j", "accuracy")
    singles = singles.sparkSession.createDataFrame(singles.select("fid", "accuracy").collect(), "fid int, accuracy double")  # once, not for each side
    one = singles.select(F.col("fid").alias("i"), F.col("accuracy").alias("ai"))
    two = singles.select(F.col("fid").alias("j"), F.col("accuracy").alias("aj"))
    return both.join(one, "i").join(two, "j").select("i", "j", F.greatest(F.lit(0.0), F.col("accuracy") - F.greatest("ai", "aj")).alias("comp"))

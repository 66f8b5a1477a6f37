"""Weighted k-shell decoding of edge genomes into feature subsets.

The peel is an inherently sequential loop over one small graph, so it is a NumPy
kernel; populations are frames with one genome a row, decoded in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def weighted_degree_frame(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """(fid, degree): the rounded square root of out-degree * out-weight * node weight, halves to even."""
    sums = edges.groupBy(F.col("src").alias("fid")).agg(F.count("*").alias("n"), F.sum("sim").alias("s"))
    return sums.join(weights, "fid").select("fid", F.rint(F.sqrt(F.col("n") * F.col("s") * F.col("weight"))).alias("degree"))


def degrees(adjacency: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.rint(np.sqrt((adjacency > 0).sum(1) * adjacency.sum(1) * weight))


def peel(adjacency: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Shells in order: the nodes of least weighted degree go, and again while any has exactly that degree; then the next shell.

    Every node takes part: those without edges have degree 0 and go with the first shell.
    """
    a = adjacency.copy()
    left = np.arange(len(a))
    shells = []
    while len(left):
        d = degrees(a, weight)
        if not np.isfinite(d[left]).all():
            raise ValueError("a degree is not finite")
        least = d[left].min()
        shell: list[int] = []
        while True:
            out = left[d[left] == least]
            if not len(out):
                break
            shell += out.tolist()
            a[out, :] = 0
            a[:, out] = 0
            left = np.setdiff1d(left, out)
            d = degrees(a, weight)
        shells.append(np.array(shell))
    return shells


def representatives(shells: list[np.ndarray], weight: np.ndarray) -> np.ndarray:
    """The heaviest node of each shell but the last, and all of the last, ascending."""
    if not shells:
        return np.zeros(0, np.int64)
    picks = [s[np.argmax(weight[s])] for s in shells[:-1]]
    return np.sort(np.concatenate([np.array(picks, np.int64), shells[-1]]))


def shell_representatives(shells: DataFrame) -> DataFrame:
    """(graph_id, fid) of frames (graph_id, fid, shell, pos, weight), as representatives()."""
    w = W.partitionBy("graph_id", "shell").orderBy(F.desc("weight"), "pos")
    last = F.max("shell").over(W.partitionBy("graph_id"))
    return shells.withColumn("rn", F.row_number().over(w)).withColumn("last", last).where("rn = 1 or shell = last").select("graph_id", "fid")


def rc_greedy(core: np.ndarray, comp: np.ndarray | Callable[[list[int]], np.ndarray], sim: np.ndarray, tau: float = 0.3, most: int = 5) -> np.ndarray:
    """core and up to `most` features of best comp(f, S) - tau * red(f, S), while that is over 0.

    comp is the best complementarity with a member, red the largest |1 - similarity| to a member.
    comp may be a function that gives the columns of members: only these are ever looked at.
    """
    chosen = [int(f) for f in core]
    columns = comp if callable(comp) else lambda members: comp[:, members]
    for _ in range(most):
        rest = np.setdiff1d(np.arange(len(sim)), chosen)
        if not len(rest) or not chosen:
            break
        value = columns(chosen)[rest].max(1) - tau * np.abs(1 - sim[np.ix_(rest, chosen)]).max(1)
        best = int(value.argmax())
        if value[best] <= 0:
            break
        chosen.append(int(rest[best]))
    return np.sort(np.array(chosen, np.int64))


#: Extension modes of a decoded core, open to more: fn(core, comp, sim, tau, most) -> ids.
MODES: dict[str, Callable[..., np.ndarray]] = {"none": lambda core, *_: core, "normal": lambda core, *_: core, "rc_greedy": rc_greedy}


def register_mode(name: str, function: Callable[..., np.ndarray]) -> None:
    MODES[name] = function


class Decoder:
    """Genomes (a bit for each edge of a layout) to subsets."""

    def __init__(self, p: int, src: np.ndarray, dst: np.ndarray, sim: np.ndarray):
        self.p, self.src, self.dst, self.sim = p, src, dst, sim

    @classmethod
    def of(cls, layout: DataFrame, p: int) -> Decoder:
        rows = layout.orderBy("gene_pos").toPandas()
        return cls(p, rows["src"].to_numpy(), rows["dst"].to_numpy(), rows["sim"].to_numpy())

    def __len__(self) -> int:
        return len(self.src)

    def adjacency(self, genes: np.ndarray) -> np.ndarray:
        if len(genes) != len(self.src):
            raise ValueError("a genome has a bit for each edge")
        on = np.asarray(genes).astype(bool)
        a = np.zeros((self.p, self.p))
        a[self.src[on], self.dst[on]] = self.sim[on]
        return a

    def core(self, genes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The genome's subset; without edges it has none."""
        a = self.adjacency(genes)
        return representatives(peel(a, weight), weight) if a.any() else np.zeros(0, np.int64)


def decode_population(population: DataFrame, decoder: Decoder, weight: np.ndarray) -> DataFrame:
    """(ind_id, subset) of frames (ind_id, genes)."""
    shared = population.sparkSession.sparkContext.broadcast(((decoder.p, decoder.src, decoder.dst, decoder.sim), weight))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, w = shared.value
        d = Decoder(*own)
        for f in frames:
            yield pd.DataFrame({"ind_id": f["ind_id"], "subset": [d.core(np.array(g), w).astype(np.int32).tolist() for g in f["genes"]]})

    return population.select("ind_id", "genes").mapInPandas(run, "ind_id int, subset array<int>")

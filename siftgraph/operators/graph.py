"""Feature graphs: initial edges, spanning trees, neighbour-variance graphs, PageRank, InfFS.

Edges are frames (src, dst, sim). Windows run over one feature's edges, so the
largest group has as many rows as there are features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .prep import weighted_sample
from .stats import both_ways, unit_scores


def _top(edges: DataFrame, k: Column | int) -> DataFrame:
    rn = F.row_number().over(W.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    return edges.withColumn("__rn", rn).where(F.col("__rn") <= k).drop("__rn")


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each edge with the larger weight."""
    swapped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim")
    return edges.select("src", "dst", "sim").union(swapped).groupBy("src", "dst").agg(F.max("sim").alias("sim"))


def knn_graph(sim: DataFrame, k: int = 5) -> DataFrame:
    """Directed edges to the k most similar features."""
    return _top(both_ways(sim), k)


def local_threshold_graph(sim: DataFrame, quantile: float = 0.8, k_min: int = 1) -> DataFrame:
    """Edges at or over the quantile of a feature's positive similarities, k_min at least, in both directions."""
    edges = both_ways(sim)
    cuts = edges.where("sim > 0").groupBy("src").agg(F.percentile("sim", F.lit(quantile)).alias("cut"))
    rn = F.row_number().over(W.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    kept = edges.join(cuts, "src", "left").withColumn("__rn", rn).where((F.col("sim") > 0) & (F.col("sim") >= F.col("cut")) | (F.col("__rn") <= k_min))
    return symmetric(kept)


def unordered(pairs: DataFrame) -> DataFrame:
    """(i, j) with i < j: distinct unordered pairs (a, b) of different features."""
    return pairs.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).where("i != j").distinct()


def coloured(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges (i, j, ...) with colour, by how many of their ends are chosen: the table behind a network plot."""
    ends = chosen.select(F.col("fid"), F.lit(1).alias("on")).distinct()
    one, two = ends.select(F.col("fid").alias("i"), F.col("on").alias("a")), ends.select(F.col("fid").alias("j"), F.col("on").alias("b"))
    n = F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))
    return edges.join(one, "i", "left").join(two, "j", "left").withColumn("colour", F.when(n == 2, "both").when(n == 1, "one").otherwise("none")).drop("a", "b")


def _half(scores: DataFrame) -> DataFrame:
    """Scores to [0, 1]; a range under 1e-12 gives 0.5."""
    ends = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    span = F.col("hi") - F.col("lo")
    return scores.join(F.broadcast(ends)).select("fid", F.when(span < 1e-12, 0.5).otherwise((F.col("score") - F.col("lo")) / span).alias("score"))  # one row


def fisher_redundancy_graph(sim: DataFrame, fisher: DataFrame, k_min: int = 1, k_max: int = 15) -> DataFrame:
    """As many edges as a feature's Fisher score is high and its mean similarity low."""
    edges = both_ways(sim)
    p = fisher.count()
    means = edges.groupBy(F.col("src").alias("fid")).agg((F.sum("sim") / float(p)).alias("score"))
    f, r = _half(fisher), _half(means)
    both = f.select("fid", F.col("score").alias("f")).join(r.select("fid", F.col("score").alias("r")), "fid")
    deg = F.greatest(F.lit(k_min), F.least(F.lit(k_max), F.rint(k_min + (k_max - k_min) * (0.5 * F.col("f") + 0.5 * (1 - F.col("r")))).cast("int")))
    return symmetric(_top(edges.join(both.select(F.col("fid").alias("src"), deg.alias("deg")), "src"), F.col("deg")))


def probabilistic_graph(sim: DataFrame, fisher: DataFrame, k_min: int = 1, k_max: int = 15, beta: float = 2.0, seed: int = 42) -> DataFrame:
    """Edges drawn without replacement, by sim ** beta and the mean of both features' scaled Fisher scores."""
    edges = both_ways(sim)
    f = unit_scores(fisher, 0.5)
    p = fisher.count()
    rows = edges.join(f.select(F.col("fid").alias("src"), F.col("score").alias("fi")), "src").join(f.select(F.col("fid").alias("dst"), F.col("score").alias("fj")), "dst")
    deg = F.least(F.greatest(F.rint(k_min + (k_max - k_min) * F.col("fi")).cast("int"), F.lit(k_min)), F.lit(p - 1))
    weight = F.pow("sim", F.lit(beta)) * 0.5 * (F.col("fi") + F.col("fj"))
    rows = rows.withColumn("deg", deg)
    drawn = weighted_sample(rows, "src", weight, F.col("deg"), seed, ["src", "dst"])
    # A feature without any positive weight takes its most similar ones.
    bare = rows.join(drawn.select("src").distinct(), "src", "left_anti")
    return symmetric(drawn.select("src", "dst", "sim").union(_top(bare, F.col("deg")).select("src", "dst", "sim")))


def spanning_tree(sim: DataFrame) -> DataFrame:
    """(src, dst, sim) of a minimum spanning forest for the distance max(0, 1 - sim); zero distances are no edges.

    Boruvka rounds: each component's shortest edge out of it is an aggregate; the
    driver keeps a label for each feature, nothing for edges.
    """
    spark = sim.sparkSession
    edges = sim.select("i", "j", "sim", F.greatest(F.lit(0.0), 1 - F.col("sim")).alias("d")).where("d > 0").cache()
    label = {r[0]: r[0] for r in both_ways(sim).select("src").distinct().collect()}
    tree: dict[tuple[int, int], float] = {}
    while label:
        names = spark.createDataFrame(sorted(label.items()), "f int, c int")
        one = names.select(F.col("f").alias("i"), F.col("c").alias("ci"))
        two = names.select(F.col("f").alias("j"), F.col("c").alias("cj"))
        out = edges.join(one, "i").join(two, "j").where("ci != cj").withColumn("e", F.struct("d", "i", "j", "sim"))
        least = out.select(F.col("ci").alias("c"), "e").union(out.select("cj", "e")).groupBy("c").agg(F.min("e").alias("e")).collect()
        if not least:
            break
        for r in least:
            e = r["e"]
            a, b = label[e["i"]], label[e["j"]]
            if a != b:
                tree[e["i"], e["j"]] = e["sim"]
                low, high = min(a, b), max(a, b)
                label = {f: low if c == high else c for f, c in label.items()}
    edges.unpersist()
    return spark.createDataFrame([(int(i), int(j), float(s)) for (i, j), s in sorted(tree.items())], "src int, dst int, sim double")


def mst_local_graph(sim: DataFrame, extra_k: int = 2) -> DataFrame:
    """The spanning tree and each feature's extra_k most similar others, in both directions."""
    tree = spanning_tree(sim)
    both = symmetric(tree)
    rest = both_ways(sim).join(both.select("src", "dst"), ["src", "dst"], "left_anti")
    return symmetric(both.unionByName(_top(rest, extra_k).select("src", "dst", "sim")))


def neighbour_lists(edges: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(src, neighbours) by ascending id, of edges over the tolerance."""
    return edges.where(F.col("sim") > tolerance).groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


def neighbour_matrix(sim: DataFrame, k: int = 5) -> DataFrame:
    """(src, nearest): each feature's k most similar features, the most similar first."""
    pairs = F.sort_array(F.collect_list(F.struct(F.negative("sim").alias("s"), "dst")))
    return knn_graph(sim, k).groupBy("src").agg(F.transform(pairs, lambda p: p["dst"]).alias("nearest"))


def gene_layout(edges: DataFrame) -> DataFrame:
    """(gene_pos, src, dst, sim): a bit of a genome for each edge, by src, then dst."""
    sizes = edges.groupBy("src").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(W.partitionBy(F.lit(0)).orderBy("src").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rn = F.row_number().over(W.partitionBy("src").orderBy("dst"))
    return edges.join(sizes, "src").select((F.col("before") + rn - 1).cast("int").alias("gene_pos"), "src", "dst", "sim")


def decode(layout: DataFrame, genomes: DataFrame) -> DataFrame:
    """(ind_id, src, dst, sim): the edges whose bit a genome (ind_id, genes) has set."""
    bits = genomes.select("ind_id", F.posexplode("genes").alias("gene_pos", "bit")).where("bit != 0")
    return bits.join(layout, "gene_pos").select("ind_id", "src", "dst", "sim")


#: Graph initialisers by name: fn(sim, fisher, k, beta) -> edges; (src, dst, sim). beta sharpens the probabilistic one.
INITIALIZERS: dict[str, Callable[[DataFrame, DataFrame, int, float], DataFrame]] = {
    "knn": lambda sim, fisher, k, beta=2.0: knn_graph(sim, k),
    "local_thresh": lambda sim, fisher, k, beta=2.0: local_threshold_graph(sim),
    "fisher_red": lambda sim, fisher, k, beta=2.0: fisher_redundancy_graph(sim, fisher, 1, 3 * k),
    "mst_local": lambda sim, fisher, k, beta=2.0: mst_local_graph(sim),
    "probabilistic": lambda sim, fisher, k, beta=2.0: probabilistic_graph(sim, fisher, 1, 3 * k, beta),
}


def register_initializer(name: str, function: Callable[[DataFrame, DataFrame, int, float], DataFrame]) -> None:
    INITIALIZERS[name] = function


# Unsupervised selection by local variance.


def pool_moments(wide: DataFrame, k: int = 5) -> DataFrame:
    """(fid, m1, m2): mean and mean square over all samples' neighbours 2 to k + 1, as one pool."""
    from .knn import neighbours

    near = neighbours(wide, wide, k + 1, not_self=True).where("rank > 1")
    weights = near.groupBy(F.col("row_id").alias("sample_id")).agg(F.count("*").alias("w"))
    long = wide.join(weights, "sample_id").select("w", F.posexplode("features").alias("fid", "x"))
    return long.groupBy("fid").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m1"), (F.sum(F.col("w") * F.col("x") * F.col("x")) / F.sum("w")).alias("m2"))


def local_variance(wide: DataFrame, k: int = 5) -> DataFrame:
    """(sample_id, fid, var): mean squared difference from the pool, by its two moments."""
    from ..sources.tables import melt

    rows = melt(wide).join(pool_moments(wide, k), "fid")
    return rows.select("sample_id", "fid", (F.col("m2") - 2 * F.col("x") * F.col("m1") + F.col("x") * F.col("x")).alias("var"))


def variance_edges(wide: DataFrame, k: int = 5, threshold: float = 2.0) -> DataFrame:
    """(src, dst) in both directions: features whose variance stays within the threshold in one sample.

    Each task joins its samples' features into one p x p matrix of bits; only edges
    that a task has seen are shuffled, however many samples show them.
    """
    moments = pool_moments(wide, k).orderBy("fid").collect()  # a row for each feature
    m1, m2 = (np.array([r[c] for r in moments], np.float64) for c in ("m1", "m2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(m1), len(m1)), bool)
        for batch in batches:
            x = np.array(batch.column("features").to_pylist(), np.float64).reshape(batch.num_rows, -1)
            near = (m2 - 2 * x * m1 + x * x <= threshold).astype(np.float32)
            for a in range(0, len(near), 4096):
                seen |= near[a : a + 4096].T @ near[a : a + 4096] > 0
        np.fill_diagonal(seen, False)
        for a in range(0, len(seen), 256):  # so many lines of the matrix at once
            src, dst = np.nonzero(seen[a : a + 256])
            yield pa.RecordBatch.from_arrays([pa.array((src + a).astype(np.int32)), pa.array(dst.astype(np.int32))], names=["src", "dst"])

    return wide.select("features").mapInArrow(run, "src int, dst int").distinct()


def pagerank(edges: DataFrame, p: int, damping: float = 0.85, most: int = 100, tolerance: float = 1e-3, least: int = 5) -> DataFrame:
    """(fid, score): ranks of p features; edges weigh the same, dead ends give nothing.

    Stops when the change's norm is under the tolerance after more than `least`
    rounds. A round is a join and an aggregate; the driver keeps p numbers.
    """
    spark = edges.sparkSession
    out = edges.groupBy("src").agg(F.count("*").alias("n"))
    shares = edges.join(out, "src").select("src", "dst", (1.0 / F.col("n")).alias("share")).cache()
    rank = np.full(p, 1.0 / p)
    for turn in range(1, most + 1):
        now = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rank)], "src int, r double")
        given = shares.join(F.broadcast(now), "src").groupBy("dst").agg(F.sum(F.col("share") * F.col("r")).alias("g")).collect()  # p rows
        new = np.full(p, (1 - damping) / p)
        for r in given:
            new[r["dst"]] += damping * r["g"]
        change = float(np.linalg.norm(new - rank))
        rank = new
        if change < tolerance and turn > least:
            break
    shares.unpersist()
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(rank)], "fid int, score double")


def ugfs(wide: DataFrame, k: int = 5, threshold: float = 2.0, ndim: int | None = None, preprocessing: str = "cscale") -> DataFrame:
    """(fid, score) of all features by PageRank over the variance graph; ndim keeps the first ones."""
    from .prep import check_dimension, preprocess
    from .stats import top

    scaled, _ = preprocess(wide, preprocessing)
    p = scaled.agg(F.max(F.size("features"))).first()[0] or 0
    edges = variance_edges(scaled, k, threshold)
    if edges.isEmpty():
        raise ValueError("no feature varies within the threshold")
    scores = pagerank(edges, p)
    return scores if ndim is None else top(scores, check_dimension(ndim, p))


def default_ndim(p: int) -> int:
    return min(20, max(1, p // 2))


def inffs(wide: DataFrame, alpha: float = 0.5, supervised: bool = True) -> DataFrame:
    """(fid, score): Infinite Feature Selection, by the published formula.

    A = alpha * max(sd_i, sd_j) + (1 - alpha) * c, deviations scaled to [0, 1].
    Supervised, c is the product of both features' Fisher scores, scaled to [0, 1]
    over all pairs; else it is 1 - |spearman|. Scores are the row sums of
    (I - r A)^-1 - I with r = 0.9 / the spectral radius. The matrix is p x p on the
    driver, for some thousand features.
    """
    from ..sources.tables import melt
    from .stats import fisher, spearman

    long = melt(wide)
    sd = unit_scores(long.groupBy("fid").agg(F.stddev_samp("x").alias("score"))).orderBy("fid").toPandas()["score"].to_numpy()
    p = len(sd)
    if supervised:
        own = fisher(long).orderBy("fid").toPandas()["score"].to_numpy()
        c = np.outer(own, own)
        c = (c - c.min()) / np.ptp(c) if p and np.ptp(c) > 0 else np.zeros((p, p))
    else:
        c = np.zeros((p, p))
        rows = spearman(long).toPandas()
        c[rows["i"], rows["j"]] = c[rows["j"], rows["i"]] = 1 - rows["sim"]
    a = alpha * np.maximum.outer(sd, sd) + (1 - alpha) * c
    radius = float(np.abs(np.linalg.eigvalsh(a)).max()) or 1.0
    scores = (np.linalg.inv(np.eye(p) - 0.9 / radius * a) - np.eye(p)).sum(1)
    return wide.sparkSession.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "fid int, score double")


def relieff(wide: DataFrame, k: int = 10) -> DataFrame:
    """(fid, score): ReliefF with k nearest hits and misses of every sample; misses weigh by their class's share.

    Differences are scaled by each feature's range; neighbours are those of scaled
    features. Classes are handled one by one, each by block search.
    """
    from ..sources.tables import melt, widen
    from .knn import neighbours
    from .prep import minmax

    scaled = widen(minmax(melt(wide))).cache()
    n = scaled.count()
    shares = {r["label"]: r["c"] / n for r in scaled.groupBy("label").agg(F.count("*").alias("c")).collect()}
    found = None
    for c in sorted(shares):
        near = neighbours(scaled, scaled.where(F.col("label") == c), k, not_self=True)
        own = near.withColumn("m", F.count("*").over(W.partitionBy("query_id")))
        other = F.lit(shares[c]) / (1 - F.element_at(F.create_map(*(F.lit(x) for q, s in shares.items() for x in (int(q), float(s)))), F.col("query_label").cast("int")))
        weight = F.when(F.col("query_label") == c, -1.0).otherwise(other) / F.col("m") / n
        part = own.select("query_id", "row_id", weight.alias("w"))
        found = part if found is None else found.union(part)
    q = scaled.select(F.col("sample_id").alias("query_id"), F.col("features").alias("fq"))
    r = scaled.select(F.col("sample_id").alias("row_id"), F.col("features").alias("fr"))
    rows = found.join(q, "query_id").join(r, "row_id").select("w", F.posexplode(F.zip_with("fq", "fr", lambda a, b: F.abs(a - b))).alias("fid", "d"))
    return rows.groupBy("fid").agg(F.sum(F.col("w") * F.col("d")).alias("score"))

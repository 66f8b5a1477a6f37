"""Feature statistics, similarities and filter scores of labelled datasets.

Scores are frames (fid, score). Pairwise similarities come from one pass over
wide rows: each task adds up its rows' products as a block of the Gram matrix,
and only these p x p sums are shuffled, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import finite


def fisher(long: DataFrame) -> DataFrame:
    """Between-class over within-class scatter; 0 without the first, 100 with the first only."""
    by_class = long.groupBy("fid", "label").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    totals = by_class.groupBy("fid").agg(F.sum(F.col("n") * F.col("m")).alias("t"), F.sum("n").alias("c"))
    rows = by_class.join(totals.select("fid", (F.col("t") / F.col("c")).alias("all")), "fid")
    sums = rows.groupBy("fid").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("all"), F.lit(2.0))).alias("a"), F.sum(F.col("n") * F.col("v")).alias("b"))
    return sums.select("fid", F.when(F.col("a") == 0, 0.0).when(F.col("b") == 0, 100.0).otherwise(F.col("a") / F.col("b")).alias("score"))


def unit_scores(scores: DataFrame, constant: float = 0.0) -> DataFrame:
    """Scores to [0, 1] over all features; all equal gives the constant."""
    ends = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    rows = scores.join(F.broadcast(ends))  # one row
    span = F.col("hi") - F.col("lo")
    return rows.select("fid", F.when(span > 0, (F.col("score") - F.col("lo")) / span).otherwise(constant).alias("score"))


def node_weight(long: DataFrame) -> DataFrame:
    """1 + the Fisher score scaled to [0, 1]."""
    return unit_scores(fisher(long)).select("fid", (F.col("score") + 1).alias("weight"))


def _sums(p_limit: int = 4096):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, gram = None, 0, None
        for batch in batches:
            x = np.array(batch.column("features").to_pylist(), np.float64)
            if not len(x):
                continue
            total = x.sum(0) if total is None else total + x.sum(0)
            gram = x.T @ x if gram is None else gram + x.T @ x
            count += len(x)
        if gram is not None:
            p = len(total)
            for a in range(0, p, max(1, p_limit // 64)):  # the matrix goes by blocks of rows
                b = min(p, a + max(1, p_limit // 64))
                i, j = np.meshgrid(np.arange(a, b), np.arange(p), indexing="ij")
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i.ravel().astype(np.int32), j.ravel().astype(np.int32), gram[a:b].ravel(), np.repeat(total[a:b], p), np.full((b - a) * p, count))], names=["i", "j", "s", "t", "n"])

    return run


def gram(wide: DataFrame) -> DataFrame:
    """(i, j, s, t, n): sums of products of features i and j, sum of i, and rows."""
    parts = wide.select("features").mapInArrow(_sums(), "i int, j int, s double, t double, n long")
    return parts.groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("t").alias("t"), F.sum("n").alias("n"))


def moments(wide: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and mean-free-less Gram matrix, for a number of features that the driver can square."""
    rows = gram(wide).toPandas()
    p = int(rows["i"].max()) + 1 if len(rows) else 0
    m = np.zeros((p, p))
    m[rows["i"], rows["j"]] = rows["s"]
    t = np.zeros(p)
    t[rows["i"]] = rows["t"]
    n = int(rows["n"].max()) if len(rows) else 0
    return n, t / max(1, n), m


def similarity(wide: DataFrame) -> DataFrame:
    """(i, j, sim) for i < j: absolute Pearson correlation, 0 where it is not defined."""
    g = gram(wide)
    diagonal = g.where("i = j").select("i", F.col("s").alias("q"), F.col("t").alias("u"))
    pairs = g.where("i < j").select("i", "j", "s", "n").join(diagonal, "i").join(diagonal.select(F.col("i").alias("j"), F.col("q").alias("q2"), F.col("u").alias("u2")), "j")
    a, b = F.col("q") - F.col("u") * F.col("u") / F.col("n"), F.col("q2") - F.col("u2") * F.col("u2") / F.col("n")
    r = F.try_divide(F.col("s") - F.col("u") * F.col("u2") / F.col("n"), F.sqrt(a * b))
    tiny = (a <= 1e-12 * F.col("q")) | (b <= 1e-12 * F.col("q2"))
    return pairs.select("i", "j", F.when(tiny, 0.0).otherwise(F.least(F.lit(1.0), F.abs(finite(r)))).alias("sim"))


#: Buckets that a feature's values are cut into for running sums.
CUTS = 128


def bucketed(counts: DataFrame) -> DataFrame:
    """counts (fid, x, ...) with bucket: values in order, cut at CUTS quantiles of a sketch.

    A running sum over a feature's values then runs in each bucket by itself, on
    top of the sums of the buckets before; values of one bucket are never all of
    a feature's, unless it has few.
    """
    cuts = counts.groupBy("fid").agg(F.percentile_approx("x", [k / CUTS for k in range(1, CUTS)], 10_000).alias("cuts"))
    return counts.join(cuts, "fid").withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col("x")))).drop("cuts")


def running(rows: DataFrame, value: str, name: str, by: list[str], own: bool = True) -> DataFrame:
    """rows (by, bucket, x, value) with the sum of value over smaller x, with own also of x itself, within by."""
    sums = rows.groupBy(*by, "bucket").agg(F.sum(value).alias("__s"))
    before = F.coalesce(F.sum("__s").over(W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*by, "bucket", before.alias("__before"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy(*by, "bucket").orderBy("x").rowsBetween(W.unboundedPreceding, 0 if own else -1)), F.lit(0))
    return rows.withColumn("__inside", inside).join(sums, [*by, "bucket"]).withColumn(name, F.col("__inside") + F.col("__before")).drop("__inside", "__before")


def grid(long: DataFrame) -> DataFrame:
    """(fid, x, bucket, label, c): the rows of each distinct value and label, 0 where there are none; labels are classes and few."""
    cells = long.groupBy("fid", "x", "label").agg(F.count("*").alias("c"))
    labels = cells.select("fid", "label").distinct()
    values = bucketed(cells.select("fid", "x").distinct())
    return values.join(labels, "fid").join(cells, ["fid", "x", "label"], "left").fillna(0, ["c"])


def ranks(long: DataFrame) -> DataFrame:
    """x replaced by its average rank within its feature."""
    counts = bucketed(long.groupBy("fid", "x").agg(F.count("*").alias("c")))
    upto = running(counts, "c", "upto", ["fid"])
    ranked = upto.select("fid", "x", (F.col("upto") - (F.col("c") - 1) / 2.0).alias("r"))
    return long.join(ranked, ["fid", "x"]).select("sample_id", "label", "fid", F.col("r").alias("x"))


def spearman(long: DataFrame) -> DataFrame:
    """As similarity, of ranks."""
    from ..sources.tables import widen

    return similarity(widen(ranks(long)))


def both_ways(sim: DataFrame) -> DataFrame:
    """(src, dst, sim) in both directions."""
    return sim.select(F.col("i").alias("src"), F.col("j").alias("dst"), "sim").union(sim.select("j", "i", "sim"))


def redundancy_cos2(wide: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """Mean squared cosine over pairs of the features; a zero norm counts as 1e-12; under two features 0."""
    g = gram(wide)
    if ids is not None:
        g = g.where(F.col("i").isin(ids) & F.col("j").isin(ids))
    norms = g.where("i = j").select("i", F.when(F.col("s") > 0, F.sqrt("s")).otherwise(1e-12).alias("a"))
    pairs = g.where("i < j").select("i", "j", "s").join(norms, "i").join(norms.select(F.col("i").alias("j"), F.col("a").alias("b")), "j")
    return pairs.agg(F.coalesce(F.avg(F.pow(F.col("s") / (F.col("a") * F.col("b")), F.lit(2.0))), F.lit(0.0)).alias("red_cos2"))


def redundancy_abscorr(sim: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """Mean absolute correlation over pairs of the features; under two features 0."""
    if ids is not None:
        sim = sim.where(F.col("i").isin(ids) & F.col("j").isin(ids))
    return sim.agg(F.coalesce(F.avg("sim"), F.lit(0.0)).alias("red_abscorr"))


# Filter scores.


def _corr(x: Column, y: Column) -> Column:
    """Pearson correlation, 0 where it is not defined; corr() fails on constants under ANSI arithmetic."""
    return finite(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def pearson(long: DataFrame) -> DataFrame:
    return long.groupBy("fid").agg(_corr(F.col("x"), F.col("label").cast("double")).alias("score"))


def kendall(long: DataFrame) -> DataFrame:
    """Kendall's tau-a with the label: concordant minus discordant pairs over all pairs.

    No pair is made: of each value and label, the rows of smaller values are known
    by label from running sums, and those with a smaller label count for it, those
    with a larger one against it.
    """
    cells = running(grid(long), "c", "earlier", ["fid", "label"], own=False)
    w = W.partitionBy("fid", "x").orderBy("label")
    less = F.coalesce(F.sum("earlier").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    more = F.coalesce(F.sum("earlier").over(w.rowsBetween(1, W.unboundedFollowing)), F.lit(0))
    total = cells.withColumn("s", F.col("c") * (less - more)).groupBy("fid").agg(F.sum("s").alias("s"), F.sum("c").cast("double").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return total.select("fid", F.when(pairs > 0, F.col("s") / pairs).otherwise(0.0).alias("score"))


def chi2(long: DataFrame) -> DataFrame:
    """Chi-squared of the features' sums by class against those expected; values are moved to be non-negative."""
    from .prep import shifted

    rows = shifted(long)
    observed = rows.groupBy("fid", "label").agg(F.sum("x").alias("o"), F.count("*").alias("n"))
    totals = observed.groupBy("fid").agg(F.sum("o").alias("t"), F.sum("n").alias("all"))
    joined = observed.join(totals, "fid").withColumn("e", F.col("n") / F.col("all") * F.col("t"))
    return joined.groupBy("fid").agg(F.sum(F.when(F.col("e") > 0, F.pow(F.col("o") - F.col("e"), F.lit(2.0)) / F.col("e")).otherwise(0.0)).alias("score"))


def _entropy(count: str, total: str):
    p = F.col(count) / F.col(total)
    return -p * F.log(p)


def information_gain(long: DataFrame) -> DataFrame:
    """H(label) - H(label | x) in nats over distinct values."""
    cells = long.groupBy("fid", "x", "label").agg(F.count("*").alias("c"))
    by_x = cells.groupBy("fid", "x").agg(F.sum("c").alias("n"))
    by_label = cells.groupBy("fid", "label").agg(F.sum("c").alias("c"))
    total = by_label.groupBy("fid").agg(F.sum("c").alias("all"))
    h = by_label.join(total, "fid").groupBy("fid").agg(F.sum(_entropy("c", "all")).alias("h"))
    conditional = cells.join(by_x, ["fid", "x"]).join(total, "fid").groupBy("fid").agg(F.sum(F.col("n") / F.col("all") * _entropy("c", "n") / 1.0).alias("g"))
    return h.join(conditional, "fid").select("fid", (F.col("h") - F.col("g")).alias("score"))


def symmetric_uncertainty(long: DataFrame) -> DataFrame:
    """2 IG / (H(x) + H(label)); 0 where both entropies are 0."""
    by_x = long.groupBy("fid", "x").agg(F.count("*").alias("c"))
    by_label = long.groupBy("fid", "label").agg(F.count("*").alias("c"))
    total = by_label.groupBy("fid").agg(F.sum("c").alias("all"))
    hx = by_x.join(total, "fid").groupBy("fid").agg(F.sum(_entropy("c", "all")).alias("hx"))
    hy = by_label.join(total, "fid").groupBy("fid").agg(F.sum(_entropy("c", "all")).alias("hy"))
    rows = information_gain(long).join(hx, "fid").join(hy, "fid")
    return rows.select("fid", F.when(F.col("hx") + F.col("hy") > 0, 2 * F.col("score") / (F.col("hx") + F.col("hy"))).otherwise(0.0).alias("score"))


def gini(long: DataFrame) -> DataFrame:
    """Least weighted Gini impurity of a cut x <= t, as its gain over no cut."""
    cells = running(grid(long), "c", "l", ["fid", "label"])
    totals = cells.groupBy("fid", "label").agg(F.sum("c").alias("t"))
    cells = cells.join(totals, ["fid", "label"])
    cut = cells.groupBy("fid", "x").agg(F.sum("l").alias("nl"), F.sum("t").alias("n"), F.sum(F.pow(F.col("l").cast("double"), F.lit(2.0))).alias("ql"), F.sum(F.pow((F.col("t") - F.col("l")).cast("double"), F.lit(2.0))).alias("qr"), F.sum(F.pow(F.col("t").cast("double"), F.lit(2.0))).alias("q"))
    nr = F.col("n") - F.col("nl")
    split = 1 - (F.when(F.col("nl") > 0, F.col("ql") / F.col("nl")).otherwise(0.0) + F.when(nr > 0, F.col("qr") / nr).otherwise(0.0)) / F.col("n")
    whole = 1 - F.col("q") / F.pow(F.col("n").cast("double"), F.lit(2.0))
    return cut.groupBy("fid").agg(F.max(whole - split).alias("score"))


def f_ratio(long: DataFrame) -> DataFrame:
    """Analysis of variance: between-class over within-class mean square."""
    by_class = long.groupBy("fid", "label").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    totals = by_class.groupBy("fid").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("all"), F.sum("n").alias("rows"), F.count("*").alias("k"))
    rows = by_class.join(totals, "fid")
    sums = rows.groupBy("fid", "rows", "k").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("all"), F.lit(2.0))).alias("a"), F.sum(F.col("n") * F.col("v")).alias("b"))
    ratio = (F.col("a") / (F.col("k") - 1)) / (F.col("b") / (F.col("rows") - F.col("k")))
    return sums.select("fid", F.when((F.col("k") > 1) & (F.col("b") > 0) & (F.col("rows") > F.col("k")), ratio).otherwise(0.0).alias("score"))


def fechner(long: DataFrame) -> DataFrame:
    """Agreements minus disagreements of the signs of x and label around their means, over rows."""
    means = long.groupBy("fid").agg(F.avg("x").alias("mx"), F.avg(F.col("label").cast("double")).alias("my"))
    sign = F.signum(F.col("x") - F.col("mx")) * F.signum(F.col("label").cast("double") - F.col("my"))
    return long.join(means, "fid").groupBy("fid").agg((F.sum(sign) / F.count("*")).alias("score"))


def spearman_score(long: DataFrame) -> DataFrame:
    """Spearman correlation of x with the label."""
    labels = long.select("fid", "sample_id", F.col("label").cast("double").alias("x"), F.lit(0).alias("label"))
    a, b = ranks(long), ranks(labels)
    return a.join(b.select("fid", "sample_id", F.col("x").alias("y")), ["fid", "sample_id"]).groupBy("fid").agg(_corr(F.col("x"), F.col("y")).alias("score"))


#: Filters of the benchmark, and those that it leaves out.
FILTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"FILTER_pearson": pearson, "FILTER_kendall": kendall, "FILTER_chi2": chi2, "FILTER_info_gain": information_gain}
MORE_FILTERS = {"FILTER_f_ratio": f_ratio, "FILTER_gini": gini, "FILTER_su": symmetric_uncertainty, "FILTER_spearman": spearman_score, "FILTER_fechner": fechner}


def filter_scores(long: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(method, fid, score) of the named filters; scores that are not finite are 0."""
    out = None
    known = FILTERS | MORE_FILTERS
    for name in names or list(FILTERS):
        part = known[name](long).select(F.lit(name).alias("method"), "fid", finite(F.col("score")).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def ranked(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """scores with rank (from 1) by descending absolute score; ties by ascending fid."""
    w = W.partitionBy(*(by or [])) if by else W.partitionBy(F.lit(0))
    return scores.withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.abs("score")), "fid")))


def top(scores: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The first k features, k held within 1 and their number."""
    if not by:
        return scores.orderBy(F.desc(F.abs("score")), "fid").limit(max(1, k))
    return ranked(scores, by).where(F.col("rank") <= max(1, k)).drop("rank")


RATIOS = tuple(k / 10 for k in range(1, 10))


def ratio_grid(scores: DataFrame, p: int, ratios: tuple[float, ...] = RATIOS) -> DataFrame:
    """(ratio, k, fid, rank): for each ratio the first k = round(ratio * p) features, halves to even, k within 1 and p."""
    spark = scores.sparkSession
    sizes = spark.createDataFrame([(float(r), min(p, max(1, round(r * p)))) for r in ratios], "ratio double, k int")
    rows = ranked(scores)
    return rows.join(F.broadcast(sizes), F.col("rank") <= F.col("k")).select("ratio", "k", "fid", "rank")

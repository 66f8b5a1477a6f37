"""Registered queries over the driver's tables, with equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..operators import embedded, graph, knn, kshell, pareto, prep, report, search, stats
from ..sources import tables
from . import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = sql
        return function

    return register


# Shared parts of the SQL.
WIDE = "wide AS (SELECT vec_id AS sample_id, label, CAST(embedding AS DOUBLE[]) AS features FROM embeddings)"
LONG = "long AS (SELECT vec_id AS sample_id, label, generate_subscripts(embedding, 1) - 1 AS fid, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
SPLIT = "split AS (SELECT sample_id, label, CASE WHEN rn <= floor(0.3e0 * n + 0.5e0) THEN 'test' ELSE 'train' END AS split FROM (SELECT vec_id AS sample_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM embeddings))"
FOLDS = "folds AS (SELECT vec_id AS sample_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('42:fold:' || vec_id), vec_id) - 1) % 5 AS INT) AS fold FROM embeddings)"
SIM = "sims AS (SELECT a.fid AS i, b.fid AS j, coalesce(abs(corr(a.x, b.x)), 0) AS sim FROM long a JOIN long b ON a.sample_id = b.sample_id AND a.fid < b.fid GROUP BY 1, 2)"
EDGES = "edges AS (SELECT i AS src, j AS dst, sim FROM sims UNION ALL SELECT j, i, sim FROM sims)"
FISHER = """byclass AS (SELECT fid, label, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM long GROUP BY 1, 2),
totals AS (SELECT fid, sum(n * m) / sum(n) AS allm FROM byclass GROUP BY 1),
fisher AS (SELECT fid, CASE WHEN a = 0 THEN 0 WHEN b = 0 THEN 100 ELSE a / b END AS score FROM (SELECT fid, sum(n * (m - allm) * (m - allm)) AS a, sum(n * v) AS b FROM byclass JOIN totals USING (fid) GROUP BY 1))"""
FRONT = """front AS (SELECT CAST(event_id % 3 AS INT) AS dataset_idx,
  CASE event_type WHEN 'view' THEN 'graph_enhanced__init_knn__ks_normal' WHEN 'signup' THEN 'graph_enhanced__init_probabilistic__ks_rc_greedy' WHEN 'purchase' THEN 'graph_baseline' WHEN 'click' THEN 'FILTER_pearson' WHEN 'error' THEN 'UGFS' END AS method,
  CAST(user_id % 5 AS INT) AS run, event_id AS point_id, CAST(1 + event_id % 20 AS INT) AS fnum, (1 + event_id % 20) / 20.0e0 AS fr, value / (value + 50.0e0) AS er
  FROM events WHERE event_type IN ('view', 'signup', 'purchase', 'click', 'error'))"""
TEST = """test AS (SELECT f.dataset_idx, f.method, f.run, f.point_id, f.fnum, f.fr AS fRatio,
  CASE (event_id // 3) % 3 WHEN 0 THEN 'selected' WHEN 1 THEN 'fixed_k' ELSE 'ratio' END AS test_mode,
  CASE (event_id // 9) % 3 WHEN 0 THEN '' WHEN 1 THEN 'normal' ELSE 'buddy' END AS post_mode,
  50.0e0 / (value + 50.0e0) AS acc_test, value / 1000.0e0 AS red, value / 10.0e0 AS time_total
  FROM front f JOIN events e ON f.point_id = e.event_id)"""


def nd(groups: str) -> str:
    return f"""mins AS (SELECT {groups}, fr, min(er) AS er FROM front GROUP BY {groups}, fr),
nd AS (SELECT * EXCLUDE (best) FROM (SELECT *, min(er) OVER (PARTITION BY {groups} ORDER BY fr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM mins) WHERE best IS NULL OR er < best - 1e-12)"""


def _wide(spark, sf):
    return tables.embeddings(spark, sf)


def _long(spark, sf):
    return tables.melt(_wide(spark, sf))


def _points(spark, sf):
    return report.points(tables.front_points(spark, sf))


def bigints(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


# Sources and preparation.


@query("SELECT CAST(max(len(embedding)) AS BIGINT) AS n_features, count(*) AS n_samples, count(DISTINCT label) AS n_classes FROM embeddings")
def dataset_stats(spark, sf):
    return tables.shape(_wide(spark, sf))


@query("SELECT vec_id, CASE WHEN label - 1 = -1 THEN 0 ELSE label - 1 END AS label FROM embeddings")
def label_recode(spark, sf):
    return tables.table(spark, sf, "embeddings").select("vec_id", tables.recode(F.col("label") - 1).alias("label"))


@query(f"WITH {LONG} SELECT * FROM long")
def melt_features(spark, sf):
    return bigints(_long(spark, sf), "fid")


@query(f"WITH {LONG} SELECT sample_id, fid, round((x - min(x) OVER w) / CASE WHEN max(x) OVER w > min(x) OVER w THEN max(x) OVER w - min(x) OVER w ELSE 1 END, 9) AS x FROM long WINDOW w AS (PARTITION BY fid)")
def minmax_scale(spark, sf):
    return bigints(prep.minmax(_long(spark, sf)).select("sample_id", "fid", F.round("x", 9).alias("x")), "fid")


@query(f"WITH {LONG}, {SPLIT}, fit AS (SELECT fid, avg(x) AS m, stddev_pop(x) AS s FROM long JOIN split USING (sample_id) WHERE split = 'train' GROUP BY 1) SELECT sample_id, fid, round((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 8) AS x FROM long JOIN fit USING (fid)")
def zscore_train(spark, sf):
    wide = _wide(spark, sf)
    train = prep.stratified_split(wide).where("split = 'train'").select("sample_id")
    long = tables.melt(wide)
    return bigints(prep.zscore(long, long.join(train, "sample_id", "left_semi")).select("sample_id", "fid", F.round("x", 8).alias("x")), "fid")


@query(f"WITH {LONG} SELECT sample_id, fid, round(x - avg(x) OVER (PARTITION BY fid), 9) AS x FROM long")
def center(spark, sf):
    return bigints(prep.center(_long(spark, sf)).select("sample_id", "fid", F.round("x", 9).alias("x")), "fid")


@query(f"WITH {LONG}, fit AS (SELECT fid, stddev_samp(x) AS s FROM long GROUP BY 1) SELECT sample_id, fid, round(x / CASE WHEN s = 0 THEN 1 ELSE s END, 8) AS x FROM long JOIN fit USING (fid)")
def scale_sample(spark, sf):
    return bigints(prep.scale(_long(spark, sf)).select("sample_id", "fid", F.round("x", 8).alias("x")), "fid")


@query(f"WITH {LONG}, fit AS (SELECT fid, avg(x) AS m, stddev_samp(x) AS s FROM long GROUP BY 1) SELECT sample_id, fid, round((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 8) AS x FROM long JOIN fit USING (fid)")
def cscale(spark, sf):
    return bigints(prep.center_scale(_long(spark, sf)).select("sample_id", "fid", F.round("x", 8).alias("x")), "fid")


@query(f"WITH {LONG}, low AS (SELECT min(x) AS lo FROM long) SELECT sample_id, fid, CASE WHEN lo < 0 THEN x - lo + 1e-9 ELSE x END AS x FROM long, low")
def nonnegative_shift(spark, sf):
    return bigints(prep.shifted(_long(spark, sf)).select("sample_id", "fid", "x"), "fid")


@query()
def decorrelate(spark, sf):
    return prep.decorrelate(_wide(spark, sf))


@query()
def whiten(spark, sf):
    return prep.decorrelate(_wide(spark, sf), whiten=True)


@query(f"WITH {LONG} SELECT sample_id, fid, x FROM long WHERE fid IN (1, 3, 5, 60)")
def column_subset(spark, sf):
    return bigints(prep.subset(_long(spark, sf), [1, 3, 5, 60]).select("sample_id", "fid", "x"), "fid")


@query(f"WITH {SPLIT} SELECT * FROM split")
def stratified_split(spark, sf):
    return prep.stratified_split(_wide(spark, sf))


@query(f"WITH {FOLDS} SELECT * FROM folds")
def stratified_kfold(spark, sf):
    return prep.stratified_folds(_wide(spark, sf))


@query("SELECT vec_id AS sample_id, CAST(ntile(5) OVER (ORDER BY vec_id) - 1 AS INT) AS fold FROM embeddings")
def contiguous_kfold(spark, sf):
    return prep.contiguous_folds(_wide(spark, sf))


# Statistics and filters.


@query(f"WITH {LONG}, {FISHER} SELECT fid, round(score, 9) AS score FROM fisher")
def fisher_score(spark, sf):
    return bigints(stats.fisher(_long(spark, sf)).select("fid", F.round("score", 9).alias("score")), "fid")


@query(f"WITH {LONG.replace('vec_id AS sample_id, label, generate_subscripts(embedding, 1) - 1 AS fid, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings', '* FROM (SELECT l_returnflag AS label, 0 AS fid, l_quantity AS x FROM lineitem UNION ALL SELECT l_returnflag, 1, l_extendedprice FROM lineitem UNION ALL SELECT l_returnflag, 2, l_discount FROM lineitem UNION ALL SELECT l_returnflag, 3, l_tax FROM lineitem)')}, {FISHER} SELECT CAST(fid AS BIGINT) AS fid, round(score, 9) AS score FROM fisher")
def fisher_score_tall(spark, sf):
    return bigints(stats.fisher(tables.lineitem_long(spark, sf)).select("fid", F.round("score", 9).alias("score")), "fid")


@query(f"WITH {LONG}, {FISHER} SELECT fid, round(1 + (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 9) AS weight FROM fisher")
def node_weight(spark, sf):
    return bigints(stats.node_weight(_long(spark, sf)).select("fid", F.round("weight", 9).alias("weight")), "fid")


@query(f"WITH {LONG}, {SIM} SELECT i, j, round(sim, 8) AS sim FROM sims")
def pearson_similarity(spark, sf):
    return bigints(stats.similarity(_wide(spark, sf)).select("i", "j", F.round("sim", 8).alias("sim")), "i", "j")


RANKED = "ranked AS (SELECT sample_id, label, fid, rank() OVER w + (count(*) OVER (PARTITION BY fid, x) - 1) / 2.0e0 AS x FROM raw WINDOW w AS (PARTITION BY fid ORDER BY x))"


@query(f"WITH {LONG.replace('long AS', 'raw AS')}, {RANKED.replace('ranked AS', 'long AS')}, {SIM} SELECT i, j, round(sim, 8) AS sim FROM sims")
def spearman_similarity(spark, sf):
    return bigints(stats.spearman(_long(spark, sf)).select("i", "j", F.round("sim", 8).alias("sim")), "i", "j")


@query(f"WITH {LONG}, s AS (SELECT a.fid AS i, b.fid AS j, sum(a.x * b.x) AS s FROM long a JOIN long b USING (sample_id) WHERE a.fid <= b.fid GROUP BY 1, 2) SELECT round(avg(pow(p.s / (greatest(sqrt(a.s), 1e-12) * greatest(sqrt(b.s), 1e-12)), 2)), 9) AS red_cos2 FROM s p JOIN s a ON a.i = p.i AND a.j = p.i JOIN s b ON b.i = p.j AND b.j = p.j WHERE p.i < p.j")
def redundancy_cos2(spark, sf):
    return stats.redundancy_cos2(_wide(spark, sf)).select(F.round("red_cos2", 9).alias("red_cos2"))


@query(f"WITH {LONG}, {SIM} SELECT round(avg(sim), 9) AS red_abscorr FROM sims")
def redundancy_abscorr(spark, sf):
    return stats.redundancy_abscorr(stats.similarity(_wide(spark, sf))).select(F.round("red_abscorr", 9).alias("red_abscorr"))


def _scores(function, spark, sf):
    return bigints(function(_long(spark, sf)).select("fid", F.round("score", 8).alias("score")), "fid")


_FILTER_SQL = {
    "filter_pearson": (stats.pearson, f"WITH {LONG} SELECT fid, round(corr(x, label), 8) AS score FROM long GROUP BY 1"),
    "filter_kendall": (stats.kendall, f"WITH {LONG} SELECT a.fid, round(sum(sign(b.x - a.x) * sign(b.label - a.label)) / count(*), 8) AS score FROM long a JOIN long b ON a.fid = b.fid AND a.sample_id < b.sample_id GROUP BY 1"),
    "filter_chi2": (stats.chi2, f"WITH {LONG}, low AS (SELECT min(x) AS lo FROM long), s AS (SELECT fid, label, CASE WHEN lo < 0 THEN x - lo + 1e-9 ELSE x END AS x FROM long, low), o AS (SELECT fid, label, sum(x) AS o, count(*) AS n FROM s GROUP BY 1, 2), t AS (SELECT fid, sum(o) AS t, sum(n) AS c FROM o GROUP BY 1) SELECT fid, round(sum((o - n::DOUBLE / c * t) * (o - n::DOUBLE / c * t) / (n::DOUBLE / c * t)), 8) AS score FROM o JOIN t USING (fid) GROUP BY 1"),
    "filter_f_ratio": (stats.f_ratio, f"WITH {LONG}, g AS (SELECT fid, label, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM long GROUP BY 1, 2), t AS (SELECT fid, sum(n * m) / sum(n) AS a, sum(n) AS r, count(*) AS k FROM g GROUP BY 1) SELECT fid, round((sum(n * (m - a) * (m - a)) / (any_value(k) - 1)) / (sum(n * v) / (any_value(r) - any_value(k))), 8) AS score FROM g JOIN t USING (fid) GROUP BY 1"),
    "filter_fechner": (stats.fechner, f"WITH {LONG}, m AS (SELECT fid, avg(x) AS mx, avg(label) AS my FROM long GROUP BY 1) SELECT fid, round(sum(sign(x - mx) * sign(label - my)) / count(*), 8) AS score FROM long JOIN m USING (fid) GROUP BY 1"),
    "filter_spearman": (stats.spearman_score, f"WITH {LONG.replace('long AS', 'raw AS')}, {RANKED}, l AS (SELECT vec_id AS sample_id, rank() OVER (ORDER BY label) + (count(*) OVER (PARTITION BY label) - 1) / 2.0e0 AS y FROM embeddings) SELECT fid, round(corr(x, y), 8) AS score FROM ranked JOIN l USING (sample_id) GROUP BY 1"),
    "filter_gini": (stats.gini, f"WITH {LONG}, p AS (SELECT DISTINCT fid, x FROM long), l AS (SELECT p.fid, p.x, b.label, count(*) FILTER (b.x <= p.x)::DOUBLE AS l, count(*)::DOUBLE AS t FROM p JOIN long b ON p.fid = b.fid GROUP BY 1, 2, 3), c AS (SELECT fid, x, sum(l) AS nl, sum(t) AS n, sum(l * l) AS ql, sum((t - l) * (t - l)) AS qr, sum(t * t) AS q FROM l GROUP BY 1, 2) SELECT fid, round(max((1 - q / (n * n)) - (1 - (CASE WHEN nl > 0 THEN ql / nl ELSE 0 END + CASE WHEN n > nl THEN qr / (n - nl) ELSE 0 END) / n)), 8) AS score FROM c GROUP BY 1"),
}
for _name, (_function, _sql) in _FILTER_SQL.items():
    query(_sql, _name)(partial(_scores, _function))


def _binned(spark, sf):
    return _long(spark, sf).withColumn("x", F.floor(F.col("x") * 4.0).cast("double"))


_BINNED = LONG.replace("long AS", "raw AS") + ", long AS (SELECT sample_id, label, fid, floor(x * 4) AS x FROM raw)"
_CELLS = """cells AS (SELECT fid, x, label, count(*)::DOUBLE AS c FROM long GROUP BY 1, 2, 3), byx AS (SELECT fid, x, sum(c) AS n FROM cells GROUP BY 1, 2), byl AS (SELECT fid, label, sum(c) AS c FROM cells GROUP BY 1, 2), tot AS (SELECT fid, sum(c) AS n FROM byl GROUP BY 1),
hy AS (SELECT fid, sum(-c / n * ln(c / n)) AS hy FROM byl JOIN tot USING (fid) GROUP BY 1), hx AS (SELECT fid, sum(-b.n / t.n * ln(b.n / t.n)) AS hx FROM byx b JOIN tot t USING (fid) GROUP BY 1),
hyx AS (SELECT fid, sum(b.n / t.n * (-c / b.n * ln(c / b.n))) AS h FROM cells JOIN byx b USING (fid, x) JOIN tot t USING (fid) GROUP BY 1)"""


@query(f"WITH {_BINNED}, {_CELLS} SELECT fid, round(hy - h, 8) AS score FROM hy JOIN hyx USING (fid)")
def filter_info_gain(spark, sf):
    return bigints(stats.information_gain(_binned(spark, sf)).select("fid", F.round("score", 8).alias("score")), "fid")


@query(f"WITH {_BINNED}, {_CELLS} SELECT fid, round(2 * (hy - h) / (hx + hy), 8) AS score FROM hy JOIN hyx USING (fid) JOIN hx USING (fid)")
def filter_symmetric_uncertainty(spark, sf):
    return bigints(stats.symmetric_uncertainty(_binned(spark, sf)).select("fid", F.round("score", 8).alias("score")), "fid")


@query(
    f"""WITH {LONG.replace('long AS', 'raw AS')}, long AS (SELECT sample_id, label, fid, (x - min(x) OVER w) / CASE WHEN max(x) OVER w > min(x) OVER w THEN max(x) OVER w - min(x) OVER w ELSE 1 END AS x FROM raw WINDOW w AS (PARTITION BY fid)),
shares AS (SELECT label, count(*) / (SELECT count(*) FROM embeddings)::DOUBLE AS share FROM embeddings GROUP BY 1),
d AS (SELECT q.sample_id AS qid, q.label AS ql, r.sample_id AS rid, r.label AS rl, sum((q.x - r.x) * (q.x - r.x)) AS d FROM long q JOIN long r ON q.fid = r.fid AND q.sample_id != r.sample_id GROUP BY ALL),
near AS (SELECT *, count(*) OVER (PARTITION BY qid, rl) AS m FROM (SELECT *, row_number() OVER (PARTITION BY qid, rl ORDER BY d, rid) AS k FROM d) WHERE k <= 10),
w AS (SELECT qid, rid, CASE WHEN ql = rl THEN -1.0e0 ELSE b.share / (1 - a.share) END / m / (SELECT count(*) FROM embeddings) AS w FROM near JOIN shares a ON a.label = ql JOIN shares b ON b.label = rl)
SELECT q.fid, round(sum(w * abs(q.x - r.x)), 8) AS score FROM w JOIN long q ON q.sample_id = qid JOIN long r ON r.sample_id = rid AND r.fid = q.fid GROUP BY 1"""
)
def filter_relieff(spark, sf):
    return bigints(graph.relieff(_wide(spark, sf)).select("fid", F.round("score", 8).alias("score")), "fid")


@query(f"WITH {LONG}, s AS (SELECT 'FILTER_pearson' AS method, fid, corr(x, label) AS score FROM long GROUP BY 2 UNION ALL SELECT 'FILTER_fechner', fid, sum(sign(x - mx) * sign(label - my)) / count(*) FROM long JOIN (SELECT fid, avg(x) AS mx, avg(label) AS my FROM long GROUP BY 1) USING (fid) GROUP BY 2) SELECT method, fid, rank FROM (SELECT method, fid, row_number() OVER (PARTITION BY method ORDER BY round(abs(score), 9) DESC, fid) AS rank FROM s) WHERE rank <= 10")
def rank_topk(spark, sf):
    scores = stats.filter_scores(_long(spark, sf), ["FILTER_pearson", "FILTER_fechner"]).withColumn("score", F.round("score", 9))
    return bigints(stats.ranked(scores, ["method"]).where("rank <= 10").select("method", "fid", "rank"), "fid", "rank")


@query(f"WITH {LONG}, {FISHER}, r AS (SELECT fid, row_number() OVER (ORDER BY score DESC, fid) AS rank FROM fisher), g AS (SELECT k / 10.0e0 AS ratio, greatest(1, least(64, round_even(k / 10.0e0 * 64, 0))) AS k FROM range(1, 10) t(k)) SELECT ratio, CAST(k AS BIGINT) AS k, fid, rank FROM g JOIN r ON rank <= k")
def ratio_grid(spark, sf):
    return bigints(stats.ratio_grid(stats.fisher(_long(spark, sf)), 64), "k", "fid", "rank")


# Nearest neighbours.


def _knn_sql(features: str = "true", folds: bool = False) -> str:
    pairs = f"""pairs AS (SELECT q.sample_id AS qid, q.label AS ql, {'f.fold' if folds else '0'} AS fold, r.sample_id AS rid, r.label AS rl, sqrt(sum((q.x - r.x) * (q.x - r.x))) AS d
FROM long q JOIN long r ON q.fid = r.fid {'JOIN folds f ON f.sample_id = q.sample_id JOIN folds g ON g.sample_id = r.sample_id WHERE f.fold != g.fold' if folds else "JOIN split f ON f.sample_id = q.sample_id AND f.split = 'test' JOIN split g ON g.sample_id = r.sample_id AND g.split = 'train' WHERE true"} AND q.{features} GROUP BY ALL)"""
    return pairs + """, near AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, rid) AS k FROM pairs), votes AS (SELECT qid, ql, fold, rl, count(*) AS c FROM near WHERE k <= 5 GROUP BY ALL), picks AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, rl) AS k FROM votes), hits AS (SELECT qid, fold, CASE WHEN ql = rl THEN 1.0e0 ELSE 0.0e0 END AS hit FROM picks WHERE k = 1)"""


@query(f"WITH {LONG}, {SPLIT}, {_knn_sql('fid >= 0')} SELECT round(avg(hit), 9) AS accuracy, count(*) AS n_test FROM hits")
def knn_holdout_accuracy(spark, sf):
    wide = _wide(spark, sf)
    return knn.holdout_accuracy(wide, prep.stratified_split(wide)).select(F.round("accuracy", 9).alias("accuracy"), "n_test")


@query(f"WITH {LONG}, {FOLDS}, {_knn_sql('fid >= 0', True)} SELECT round(avg(a), 9) AS accuracy FROM (SELECT fold, avg(hit) AS a FROM hits GROUP BY 1)")
def knn_cv_accuracy(spark, sf):
    wide = _wide(spark, sf)
    return knn.cv_accuracy(wide, prep.stratified_folds(wide)).select(F.round("accuracy", 9).alias("accuracy"))


_SINGLE = """one AS (SELECT q.fid, f.fold, q.sample_id AS qid, q.label AS ql, r.label AS rl, row_number() OVER (PARTITION BY q.fid, q.sample_id ORDER BY abs(q.x - r.x), r.sample_id) AS k
FROM long q JOIN long r ON q.fid = r.fid JOIN folds f ON f.sample_id = q.sample_id JOIN folds g ON g.sample_id = r.sample_id WHERE f.fold != g.fold AND q.fid < {n}),
v AS (SELECT fid, fold, qid, ql, rl, count(*) AS c FROM one WHERE k <= 5 GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY fid, qid ORDER BY c DESC, rl) AS k FROM v),
single AS (SELECT fid, avg(a) AS accuracy FROM (SELECT fid, fold, avg(CASE WHEN ql = rl THEN 1.0e0 ELSE 0.0e0 END) AS a FROM w WHERE k = 1 GROUP BY 1, 2) GROUP BY 1)"""


def _matrix(spark, sf):
    wide = _wide(spark, sf)
    return knn.Matrix.of(wide, prep.stratified_folds(wide))


@query(f"WITH {LONG}, {FOLDS}, {_SINGLE.format(n=64)} SELECT fid, round(accuracy, 9) AS accuracy FROM single")
def single_feature_accuracy(spark, sf):
    return bigints(knn.single_accuracies(_matrix(spark, sf), spark).select("fid", F.round("accuracy", 9).alias("accuracy")), "fid")


@query()
def complementarity(spark, sf):
    """Complementarity of every pair of features; all pairs are too many for SQL, so tests hold it against brute force."""
    matrix = _matrix(spark, sf)
    every = spark.range(matrix.p).select(F.col("id").cast("int").alias("a"))
    pairs = every.join(every.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))
    found = knn.complementarity(pairs, knn.single_accuracies(matrix, spark), matrix)
    return bigints(found.select("i", "j", F.round("comp", 9).alias("comp")), "i", "j")


# Graphs.


def _sim(spark, sf):
    return stats.similarity(_wide(spark, sf)).withColumn("sim", F.round("sim", 9))


_SIM9 = SIM.replace("coalesce(abs(corr(a.x, b.x)), 0)", "round(coalesce(abs(corr(a.x, b.x)), 0), 9)")
_GRAPH = f"{LONG}, {_SIM9}, {EDGES}"
_SYM = "SELECT src, dst, max(sim) AS sim FROM (SELECT src, dst, sim FROM kept UNION ALL SELECT dst, src, sim FROM kept) GROUP BY 1, 2"


def _edges(df):
    return bigints(df.select("src", "dst", F.round("sim", 7).alias("sim")), "src", "dst")


@query(f"WITH {_GRAPH}, kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS k FROM edges) WHERE k <= 5) SELECT src, dst, round(sim, 7) AS sim FROM kept")
def graph_knn(spark, sf):
    return _edges(graph.knn_graph(_sim(spark, sf)))


@query(f"WITH {_GRAPH}, cuts AS (SELECT src, quantile_cont(sim, 0.8) AS cut FROM edges WHERE sim > 0 GROUP BY 1), kept AS (SELECT src, dst, sim FROM (SELECT e.*, cut, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS k FROM edges e LEFT JOIN cuts USING (src)) WHERE (sim > 0 AND sim >= cut) OR k <= 1) SELECT src, dst, round(sim, 7) AS sim FROM ({_SYM})")
def graph_local_threshold(spark, sf):
    return _edges(graph.local_threshold_graph(_sim(spark, sf)))


@query(
    f"WITH {_GRAPH}, {FISHER}"
    """, red AS (SELECT src AS fid, sum(sim) / 64.0e0 AS score FROM edges GROUP BY 1),
deg AS (SELECT fid AS src, CAST(greatest(1, least(15, round_even(1 + 14 * (0.5e0 * (f.score - min(f.score) OVER ()) / (max(f.score) OVER () - min(f.score) OVER ()) + 0.5e0 * (1 - (r.score - min(r.score) OVER ()) / (max(r.score) OVER () - min(r.score) OVER ()))), 0))) AS INT) AS deg FROM fisher f JOIN red r USING (fid)),
kept AS (SELECT src, dst, sim FROM (SELECT e.*, deg, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS k FROM edges e JOIN deg USING (src)) WHERE k <= deg) """
    + f"SELECT src, dst, round(sim, 7) AS sim FROM ({_SYM})"
)
def graph_fisher_redundancy(spark, sf):
    return _edges(graph.fisher_redundancy_graph(_sim(spark, sf), stats.fisher(_long(spark, sf))))


@query(
    f"WITH {_GRAPH}, {FISHER}"
    """, f AS (SELECT fid, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS s FROM fisher),
w AS (SELECT src, dst, sim, least(greatest(round_even(1 + 14 * a.s, 0), 1), 63) AS deg, pow(sim, 2) * 0.5e0 * (a.s + b.s) AS w, (('0x' || substr(md5('42:' || src || ':' || dst), 1, 12))::BIGINT + 0.5e0) / 281474976710656.0e0 AS u FROM edges JOIN f a ON a.fid = src JOIN f b ON b.fid = dst),
kept AS (SELECT src, dst, sim FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY -ln(u) / w, src, dst) AS k FROM w WHERE w > 0) WHERE k <= deg) """
    + f"SELECT src, dst, round(sim, 7) AS sim FROM ({_SYM})"
)
def graph_probabilistic(spark, sf):
    return _edges(graph.probabilistic_graph(_sim(spark, sf), stats.fisher(_long(spark, sf))))


@query(f"WITH {_GRAPH}, kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS k FROM edges) WHERE k <= 5) SELECT src, string_agg(dst::VARCHAR, ' ' ORDER BY dst) AS neighbours FROM kept GROUP BY 1")
def neighbor_lists(spark, sf):
    lists = graph.neighbour_lists(graph.knn_graph(_sim(spark, sf)))
    return bigints(lists.select("src", text.join_ids(F.col("neighbours")).alias("neighbours")), "src")


@query()
def graph_mst_local(spark, sf):
    return _edges(graph.mst_local_graph(_sim(spark, sf)))


@query(f"WITH {_GRAPH}, kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS k FROM edges) WHERE k <= 5) SELECT row_number() OVER (ORDER BY src, dst) - 1 AS gene_pos, src, dst FROM kept")
def gene_layout(spark, sf):
    return bigints(graph.gene_layout(graph.knn_graph(_sim(spark, sf))).select("gene_pos", "src", "dst"), "gene_pos", "src", "dst")


def _genomes(spark, layout):
    genes = layout.groupBy().agg(F.transform(F.array_sort(F.collect_list("gene_pos")), lambda g: F.when(g % 3 == 0, 0).otherwise(1)).alias("genes"))
    return spark.range(4).select(F.col("id").cast("int").alias("ind_id")).join(F.broadcast(genes)).withColumn("genes", F.transform("genes", lambda g, i: F.when(F.pmod(i + F.col("ind_id"), F.lit(4)) == 0, 0).otherwise(g)))


@query(f"WITH {_GRAPH}, kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS k FROM edges) WHERE k <= 5), l AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS g, src, dst FROM kept) SELECT ind_id, src, dst FROM l, range(0, 4) t(ind_id) WHERE g % 3 != 0 AND (g + ind_id) % 4 != 0")
def gene_decode(spark, sf):
    layout = graph.gene_layout(graph.knn_graph(_sim(spark, sf)))
    return bigints(graph.decode(layout, _genomes(spark, layout)).select("ind_id", "src", "dst"), "ind_id", "src", "dst")


@query(f"WITH {_GRAPH}, {FISHER}, kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS k FROM edges) WHERE k <= 5), w AS (SELECT fid, 1 + (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS w FROM fisher) SELECT src AS fid, round_even(sqrt(count(*) * sum(sim) * any_value(w)), 0) AS degree FROM kept JOIN w ON fid = src GROUP BY 1")
def weighted_degree(spark, sf):
    return bigints(kshell.weighted_degree_frame(graph.knn_graph(_sim(spark, sf)), stats.node_weight(_long(spark, sf))), "fid")


# The peel as a recursion: each round takes the nodes of the shell's degree, or, if there are none left, begins a shell with the least.
_PEEL = f"""{_GRAPH}, {FISHER}, kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS k FROM edges) WHERE k <= 5),
w AS (SELECT fid, 1 + (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS w FROM fisher),
l AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS g, src, dst, sim FROM kept), inds AS (SELECT CAST(range AS INT) AS ind_id FROM range(0, 4)),
own AS (SELECT ind_id, src, dst, sim FROM l, inds WHERE g % 3 != 0 AND (g + ind_id) % 4 != 0),
peel(ind_id, fid, shell, m, gone) AS (
  SELECT ind_id, fid, 0, -1.0e0, false FROM w, inds
  UNION ALL
  SELECT ind_id, fid, shell, m, degree = m FROM (
    SELECT ind_id, fid, degree, CASE WHEN bool_or(degree = m) OVER p THEN m ELSE min(degree) OVER p END AS m, CASE WHEN bool_or(degree = m) OVER p THEN shell ELSE shell + 1 END AS shell FROM (
      SELECT s.ind_id, s.fid, s.shell, s.m, round_even(sqrt(count(t.fid) * coalesce(sum(CASE WHEN t.fid IS NOT NULL THEN o.sim END), 0) * any_value(w.w)), 0) AS degree
      FROM peel s JOIN w ON w.fid = s.fid LEFT JOIN own o ON o.ind_id = s.ind_id AND o.src = s.fid LEFT JOIN (SELECT * FROM peel WHERE NOT gone) t ON t.ind_id = s.ind_id AND t.fid = o.dst
      WHERE NOT s.gone GROUP BY s.ind_id, s.fid, s.shell, s.m)
    WINDOW p AS (PARTITION BY ind_id))
)"""


@query(f"WITH RECURSIVE {_PEEL} SELECT ind_id, string_agg(fid::VARCHAR, ' ' ORDER BY fid) AS subset FROM (SELECT ind_id, fid, shell, row_number() OVER (PARTITION BY ind_id, shell ORDER BY w DESC, fid) AS k, max(shell) OVER (PARTITION BY ind_id) AS last FROM peel JOIN w USING (fid) WHERE gone) WHERE k = 1 OR shell = last GROUP BY 1")
def kshell_core(spark, sf):
    layout = graph.gene_layout(graph.knn_graph(_sim(spark, sf))).cache()
    weight = stats.node_weight(_long(spark, sf)).orderBy("fid").toPandas()["weight"].to_numpy()
    found = kshell.decode_population(_genomes(spark, layout), kshell.Decoder.of(layout, len(weight)), weight)
    return found.select("ind_id", text.join_ids(F.col("subset")).alias("subset"))


_SHELLS = "shells AS (SELECT event_id % 7 AS graph_id, event_id AS fid, CAST(user_id % 4 AS INT) AS shell, event_id AS pos, value AS weight FROM events)"


@query(f"WITH {_SHELLS} SELECT graph_id, fid FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, shell ORDER BY weight DESC, pos) AS rn, max(shell) OVER (PARTITION BY graph_id) AS l FROM shells) WHERE rn = 1 OR shell = l")
def shell_representative(spark, sf):
    e = tables.table(spark, sf, "events")
    return kshell.shell_representatives(e.select((F.col("event_id") % 7).alias("graph_id"), F.col("event_id").alias("fid"), (F.col("user_id") % 4).cast("int").alias("shell"), F.col("event_id").alias("pos"), F.col("value").alias("weight")))


_POOL = """d AS (SELECT q.sample_id AS qid, r.sample_id AS rid, sum((q.x - r.x) * (q.x - r.x)) AS d FROM long q JOIN long r ON q.fid = r.fid AND q.sample_id != r.sample_id GROUP BY 1, 2),
near AS (SELECT rid FROM (SELECT rid, row_number() OVER (PARTITION BY qid ORDER BY sqrt(d), rid) AS k FROM d) WHERE k BETWEEN 2 AND 6),
mom AS (SELECT fid, avg(x) AS m1, avg(x * x) AS m2 FROM near JOIN long ON sample_id = rid GROUP BY 1), vars AS (SELECT sample_id, fid, m2 - 2 * x * m1 + x * x AS var FROM long JOIN mom USING (fid))"""
_CSCALED = LONG.replace("long AS", "raw AS") + ", long AS (SELECT sample_id, label, fid, (x - avg(x) OVER w) / stddev_samp(x) OVER w AS x FROM raw WINDOW w AS (PARTITION BY fid))"


def _cscaled(spark, sf):
    return tables.widen(prep.center_scale(_long(spark, sf)))


@query(f"WITH {_CSCALED}, {_POOL} SELECT sample_id, fid, round(var, 7) AS var FROM vars")
def ugfs_variance(spark, sf):
    return bigints(graph.local_variance(_cscaled(spark, sf)).select("sample_id", "fid", F.round("var", 7).alias("var")), "fid")


@query(f"WITH {_CSCALED}, {_POOL}, b AS (SELECT sample_id, fid FROM vars WHERE var <= 1.001) SELECT DISTINCT x.fid AS src, y.fid AS dst FROM b x JOIN b y ON x.sample_id = y.sample_id AND x.fid != y.fid")
def ugfs_edges(spark, sf):
    return bigints(graph.variance_edges(_cscaled(spark, sf), threshold=1.001), "src", "dst")


@query()
def ugfs_pagerank(spark, sf):
    return graph.ugfs(_wide(spark, sf))


@query()
def inffs_score(spark, sf):
    return graph.inffs(_wide(spark, sf))


@query()
def inffs_unsupervised(spark, sf):
    return graph.inffs(_wide(spark, sf), supervised=False)


@query(
    f"""WITH {LONG}, sets(subset, a, b) AS (VALUES (0, 0, 8), (1, 8, 16), (2, 0, 64)),
d AS (SELECT subset, q.sample_id AS i, q.label = r.label AS same, r.sample_id AS j, sqrt(sum((q.x - r.x) * (q.x - r.x))) AS d FROM sets JOIN long q ON q.fid >= a AND q.fid < b JOIN long r ON q.fid = r.fid GROUP BY ALL),
e AS (SELECT subset, i, max(d) FILTER (same) AS far, min(d) FILTER (NOT same) AS near FROM d GROUP BY 1, 2), lows AS (SELECT subset, least(min(far), min(near)) AS lo FROM e GROUP BY 1)
SELECT subset, round(avg(CASE WHEN far > lo THEN (near - lo) / (far - lo) END), 6) AS weight FROM e JOIN lows USING (subset) GROUP BY 1 UNION ALL SELECT 3, 0.0e0"""
)
def separation_weight(spark, sf):
    matrix = _matrix(spark, sf)
    subsets = [np.arange(0, 8), np.arange(8, 16), np.arange(64), np.zeros(0, int)]
    return spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(search.separation(matrix, subsets, spark))], "subset int, weight double")


# Embedded and wrapper methods, and searches.


@query()
def l1_logreg_importance(spark, sf):
    return embedded.l1_importance(_wide(spark, sf))


@query()
def rf_importance(spark, sf):
    return embedded.forest_importance(_wide(spark, sf))


@query()
def rfe_svm(spark, sf):
    return spark.createDataFrame([(f,) for f in embedded.rfe_svm(_wide(spark, sf), 16)], "fid int")


@query()
def sfs_forward(spark, sf):
    matrix = _matrix(spark, sf)
    return spark.createDataFrame(list(enumerate(embedded.sfs_svm(matrix, spark, max(1, round(0.1 * matrix.p))))), "step int, fid int")


def _context(spark, sf, **changes):
    return pipeline.Context(_wide(spark, sf), pipeline.Config(**changes))


@query()
def evolve_enhanced(spark, sf):
    return pipeline.run(_context(spark, sf, post_modes=("normal",)), "enh:knn:normal")[0]


@query()
def evolve_baseline(spark, sf):
    return pipeline.run(_context(spark, sf), "baseline")[0]


@query()
def rc_greedy_extend(spark, sf):
    c = _context(spark, sf)
    comp = c.comp_columns(graph.knn_graph(c.sim))
    core = np.array([0, 9, 33])
    return spark.createDataFrame([(int(f), bool(f in core)) for f in kshell.rc_greedy(core, comp, c.sim_matrix)], "fid int, core boolean")


@query()
def buddy_refine(spark, sf):
    c = _context(spark, sf)
    comp = c.comp_matrix(graph.knn_graph(c.sim))
    found = search.buddy([0, 9, 33], comp, c.sim_matrix, lambda subsets: knn.accuracies(subsets, c.matrix, spark))
    return spark.createDataFrame([(int(f),) for f in found], "fid int")


# Hold-out accuracies of the first k features by a rank, on features standardised by the train rows.
_RUN = f"""{LONG.replace('long AS', 'raw AS')}, {SPLIT}, fit AS (SELECT fid, avg(x) AS m, stddev_pop(x) AS s FROM raw JOIN split USING (sample_id) WHERE split = 'train' GROUP BY 1),
long AS (SELECT sample_id, label, fid, (x - m) / CASE WHEN s = 0 THEN 1 ELSE s END AS x FROM raw JOIN fit USING (fid)),
train AS (SELECT long.* FROM long JOIN split USING (sample_id) WHERE split = 'train'),
sims AS (SELECT a.fid AS i, b.fid AS j, coalesce(abs(corr(a.x, b.x)), 0) AS sim FROM train a JOIN train b ON a.sample_id = b.sample_id AND a.fid < b.fid GROUP BY 1, 2)"""
_RUN_TEST = """pairs AS (SELECT k, q.sample_id AS qid, q.label AS ql, r.sample_id AS rid, r.label AS rl, sum((q.x - r.x) * (q.x - r.x)) AS d FROM sizes JOIN ranked ON rank <= k JOIN long q ON q.fid = ranked.fid JOIN split f ON f.sample_id = q.sample_id AND f.split = 'test' JOIN train r ON r.fid = q.fid GROUP BY ALL),
near AS (SELECT *, row_number() OVER (PARTITION BY k, qid ORDER BY d, rid) AS n FROM pairs), votes AS (SELECT k, qid, ql, rl, count(*) AS c FROM near WHERE n <= 5 GROUP BY ALL),
picks AS (SELECT *, row_number() OVER (PARTITION BY k, qid ORDER BY c DESC, rl) AS n FROM votes), accuracy AS (SELECT k, avg(CASE WHEN ql = rl THEN 1.0e0 ELSE 0.0e0 END) AS acc FROM picks WHERE n = 1 GROUP BY 1),
reds AS (SELECT k, avg(sim) AS red FROM sizes JOIN ranked a ON a.rank <= k JOIN ranked b ON b.rank <= k JOIN sims ON i = a.fid AND j = b.fid GROUP BY 1), sets AS (SELECT k, string_agg(fid::VARCHAR, ' ' ORDER BY fid) AS fset FROM sizes JOIN ranked ON rank <= k GROUP BY 1)"""


def _run_select(method: str, mode: str) -> str:
    return f"SELECT 1 AS dataset_idx, 'embeddings' AS dataset, '{method}' AS method, 1 AS run, '{mode}' AS test_mode, round(acc, 9) AS acc_test, round(1 - acc, 9) AS eRate_test, CAST(k AS INT) AS fnum, k / 64.0e0 AS fRatio, round(red, 8) AS red, fset FROM accuracy JOIN reds USING (k) JOIN sets USING (k)"


def _run_rows(frame: DataFrame) -> DataFrame:
    return frame.drop("time_total").withColumns({"acc_test": F.round("acc_test", 9), "eRate_test": F.round("eRate_test", 9), "red": F.round("red", 8)})


@query(f"WITH {_RUN}, ranked AS (SELECT fid, row_number() OVER (ORDER BY abs(score) DESC, fid) AS rank FROM (SELECT fid, corr(x, label) AS score FROM train GROUP BY 1)), sizes AS (SELECT greatest(1, least(64, round_even(t.r / 10.0e0 * 64, 0))) AS k FROM range(1, 10) t(r)), {_RUN_TEST} {_run_select('FILTER_pearson', 'ratio')}")
def run_filter_pearson(spark, sf):
    return _run_rows(pipeline.run(_context(spark, sf), "trad:FILTER_pearson")[1])


@query(f"WITH {_RUN}, ranked AS (SELECT DISTINCT fid, 1 AS rank FROM fit), sizes AS (SELECT 64 AS k), {_RUN_TEST} {_run_select('all_features', 'all')}")
def run_all_features(spark, sf):
    return _run_rows(pipeline.run(_context(spark, sf), "all")[1])


# Fronts and reports.


@query(f"WITH {FRONT}, {nd('dataset_idx, method, run')} SELECT dataset_idx, method, run, fr, er FROM nd")
def nondominated_front(spark, sf):
    return pareto.front(_points(spark, sf), ["dataset_idx", "method", "run"])


@query(f"WITH {FRONT} SELECT dataset_idx, method, run, point_id FROM front a WHERE NOT EXISTS (SELECT 1 FROM front b WHERE b.dataset_idx = a.dataset_idx AND b.method = a.method AND b.run = a.run AND b.fr <= a.fr AND b.er <= a.er AND (b.fr < a.fr OR b.er < a.er))")
def dominance_front(spark, sf):
    groups = ["dataset_idx", "method", "run"]
    return pareto.dominance_front(_points(spark, sf), groups).select(*groups, "point_id")


# A point's front is the length of the longest chain of points that each dominate the next one.
_RANK = """dom AS (SELECT a.point_id AS p, b.point_id AS q FROM front a JOIN front b USING (dataset_idx, method, run) WHERE a.fr <= b.fr AND a.er <= b.er AND (a.fr < b.fr OR a.er < b.er)),
chain(q, d) AS (SELECT point_id, 1 FROM front UNION SELECT dom.q, d + 1 FROM chain JOIN dom ON dom.p = chain.q),
ranks AS (SELECT q AS point_id, CAST(max(d) AS INT) AS rank FROM chain GROUP BY 1)"""


@query(f"WITH RECURSIVE {FRONT}, {_RANK} SELECT dataset_idx, method, run, point_id, fr, er, rank FROM front JOIN ranks USING (point_id)")
def nondominated_rank(spark, sf):
    return pareto.ranks(_points(spark, sf), ["dataset_idx", "method", "run"], "point_id")


@query(
    f"""WITH RECURSIVE {FRONT}, {_RANK}, r AS (SELECT * FROM front JOIN ranks USING (point_id)), w AS (SELECT dataset_idx, method, run, point_id, rank,
  max(fr) OVER g - min(fr) OVER g AS s1, max(er) OVER g - min(er) OVER g AS s2, lead(fr) OVER a - lag(fr) OVER a AS g1, lead(er) OVER b - lag(er) OVER b AS g2
  FROM r WINDOW g AS (PARTITION BY dataset_idx, method, run, rank), a AS (PARTITION BY dataset_idx, method, run, rank ORDER BY fr, point_id), b AS (PARTITION BY dataset_idx, method, run, rank ORDER BY er, point_id))
SELECT dataset_idx, method, run, point_id, rank, round(CASE WHEN s1 > 0 AND g1 IS NOT NULL THEN g1 / s1 ELSE 1e9 END + CASE WHEN s2 > 0 AND g2 IS NOT NULL THEN g2 / s2 ELSE 1e9 END, 6) AS crowd FROM w"""
)
def crowding_distance(spark, sf):
    # Infinite distances show as sums of 1e9 here, so both sides compare.
    groups = ["dataset_idx", "method", "run"]
    rows = pareto.ranks(_points(spark, sf), groups, "point_id")
    one = [pareto.crowding(rows, groups, "point_id", (f,)).select(*groups, "point_id", "rank", F.when(F.col("crowd") == float("inf"), 1e9).otherwise(F.col("crowd")).alias(f)) for f in ("fr", "er")]
    return one[0].join(one[1].drop("rank"), [*groups, "point_id"]).select(*groups, "point_id", "rank", F.round(F.col("fr") + F.col("er"), 6).alias("crowd"))


_HV = f"{nd('dataset_idx, method, run')}, hvs AS (SELECT dataset_idx, method, run, sum((1 - fr) * (coalesce(prev, 1) - er)) AS hv FROM (SELECT *, lag(er) OVER (PARTITION BY dataset_idx, method, run ORDER BY fr) AS prev FROM nd WHERE fr < 1 AND er < 1) GROUP BY 1, 2, 3), hv AS (SELECT dataset_idx, method, run, coalesce(hv, 0) AS hv FROM (SELECT DISTINCT dataset_idx, method, run FROM front) LEFT JOIN hvs USING (dataset_idx, method, run))"


@query(f"WITH {FRONT}, {_HV} SELECT dataset_idx, method, run, round(hv, 9) AS hv FROM hv")
def hypervolume(spark, sf):
    groups = ["dataset_idx", "method", "run"]
    return pareto.hypervolume(_points(spark, sf), groups).select(*groups, F.round("hv", 9).alias("hv"))


_REF = "rm AS (SELECT dataset_idx, fr, min(er) AS er FROM front GROUP BY 1, 2), ref AS (SELECT dataset_idx, fr AS rf, er AS re FROM (SELECT *, min(er) OVER (PARTITION BY dataset_idx ORDER BY fr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM rm) WHERE best IS NULL OR er < best - 1e-12)"
_IGD = "igd AS (SELECT dataset_idx, method, run, avg(d) AS igd FROM (SELECT dataset_idx, method, run, rf, min(sqrt((fr - rf) * (fr - rf) + (er - re) * (er - re))) AS d FROM nd JOIN ref USING (dataset_idx) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)"


@query(f"WITH {FRONT}, {_REF} SELECT dataset_idx, rf AS fr, re AS er FROM ref")
def reference_front(spark, sf):
    return report.reference_front(_points(spark, sf))


@query(f"WITH {FRONT}, {nd('dataset_idx, method, run')}, {_REF}, {_IGD} SELECT dataset_idx, method, run, round(igd, 9) AS igd FROM igd")
def igd(spark, sf):
    groups, p = ["dataset_idx", "method", "run"], _points(spark, sf)
    return pareto.igd(p, groups, report.reference_front(p), ["dataset_idx"]).select(*groups, F.round("igd", 9).alias("igd"))


@query(f"WITH {FRONT}, {_HV}, m AS (SELECT dataset_idx, method, quantile_cont(hv, 0.5) AS mid FROM hv GROUP BY 1, 2) SELECT dataset_idx, method, run, round(hv, 9) AS hv FROM (SELECT hv.*, row_number() OVER (PARTITION BY dataset_idx, method ORDER BY round(abs(hv - mid), 12), run) AS k FROM hv JOIN m USING (dataset_idx, method)) WHERE k = 1")
def median_hv_run(spark, sf):
    hv = pareto.hypervolume(_points(spark, sf), ["dataset_idx", "method", "run"])
    return pareto.median_run(hv, ["dataset_idx", "method"]).select("dataset_idx", "method", "run", F.round("hv", 9).alias("hv"))


@query(f"WITH {FRONT} SELECT dataset_idx, method, run, fnum, point_id, er FROM (SELECT *, row_number() OVER (PARTITION BY dataset_idx, method, run, fnum ORDER BY er, point_id) AS k FROM front) WHERE k = 1")
def best_per_size(spark, sf):
    return report.best_per_size(_points(spark, sf), ["dataset_idx", "method", "run"]).select("dataset_idx", "method", "run", "fnum", "point_id", "er")


def _rounded(df, keys, digits=8):
    return df.select(*(F.col(c) if c in keys or t == "string" else F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) for c, t in df.dtypes))


_SUMMARY = """best AS (SELECT dataset_idx, method, run, 1 - er AS best_acc, fnum AS best_fnum FROM (SELECT *, row_number() OVER (PARTITION BY dataset_idx, method, run ORDER BY er, point_id) AS k FROM front) WHERE k = 1),
runs AS (SELECT * FROM hv LEFT JOIN igd USING (dataset_idx, method, run) JOIN best USING (dataset_idx, method, run)),
summary AS (SELECT dataset_idx, method, avg(hv) AS hv_mean, stddev_samp(hv) AS hv_std, avg(igd) AS igd_mean, stddev_samp(igd) AS igd_std, avg(best_acc) AS best_acc_mean, stddev_samp(best_acc) AS best_acc_std, avg(best_fnum) AS best_fnum_mean, stddev_samp(best_fnum) AS best_fnum_std, count(DISTINCT run) AS runs FROM runs GROUP BY 1, 2)"""
_TRAIN = f"{_HV}, {_REF}, {_IGD}, {_SUMMARY}"
_SUMMARY_ROUNDED = ", ".join(f"round({c}_{s}, 8) AS {c}_{s}" for c in ("hv", "igd", "best_acc", "best_fnum") for s in ("mean", "std"))


@query(f"WITH {FRONT}, {_TRAIN} SELECT dataset_idx, method, {_SUMMARY_ROUNDED}, runs FROM summary")
def method_summary(spark, sf):
    return _rounded(report.method_summary(_points(spark, sf)), ["dataset_idx"])


_PICK = "named AS (SELECT * REPLACE (method || CASE WHEN post_mode = '' THEN '' ELSE '__post' || post_mode END AS method), CASE WHEN contains(method, 'graph_') THEN CASE test_mode WHEN 'selected' THEN 0 ELSE 1 END ELSE CASE test_mode WHEN 'k_ref' THEN 0 WHEN 'ratio' THEN 1 ELSE 2 END END AS p, method AS method_base, CASE WHEN post_mode = '' THEN 'nopost' ELSE 'post' || post_mode END AS post_tag FROM test), picks AS (SELECT * EXCLUDE (k, p) FROM (SELECT *, row_number() OVER (PARTITION BY dataset_idx, method, run ORDER BY p, acc_test DESC, point_id) AS k FROM named) WHERE k = 1)"


@query(f"WITH {FRONT}, {TEST}, {_PICK} SELECT dataset_idx, method_base AS method, post_mode, run, point_id, test_mode, acc_test FROM picks")
def test_pick(spark, sf):
    return report.test_pick(tables.test_points(spark, sf), ["dataset_idx", "method", "post_mode", "run"]).select("dataset_idx", "method", "post_mode", "run", "point_id", "test_mode", "acc_test")


_TSUM = "tsum AS (SELECT dataset_idx, method, method_base, post_tag, count(DISTINCT run) AS runs, avg(acc_test) AS acc_test_mean, stddev_samp(acc_test) AS acc_test_std, avg(fnum) AS fnum_test_mean, stddev_samp(fnum) AS fnum_test_std, avg(red) AS red_test_mean, stddev_samp(red) AS red_test_std, avg(time_total) AS time_total_mean, stddev_samp(time_total) AS time_total_std FROM picks GROUP BY 1, 2, 3, 4)"
_TCOLS = ("acc_test_mean", "acc_test_std", "fnum_test_mean", "fnum_test_std", "red_test_mean", "red_test_std", "time_total_mean", "time_total_std")
_TROUND = ", ".join(f"round({c}, 8) AS {c}" for c in _TCOLS)


@query(f"WITH {FRONT}, {TEST}, {_PICK}, {_TSUM} SELECT dataset_idx, method, method_base, post_tag, runs, {_TROUND} FROM tsum")
def test_summary(spark, sf):
    return _rounded(report.test_summary(tables.test_points(spark, sf)), ["dataset_idx"])


@query(
    f"WITH {FRONT}, {TEST}"
    ", s AS (SELECT *, max(CASE WHEN test_mode = 'selected' THEN 1 ELSE 0 END) OVER (PARTITION BY dataset_idx) AS h FROM test WHERE contains(lower(method), 'graph_enhanced')) "
    "SELECT dataset_idx, CASE WHEN contains(method, '_knn_') THEN 'knn' ELSE 'probabilistic' END AS init_mode, CASE WHEN contains(method, 'ks_normal') THEN 'normal' ELSE 'rc_greedy' END AS ks_mode, post_mode, count(DISTINCT run) AS runs, "
    + ", ".join(f"round({f}({c}), 8) AS {o}_{n}" for c, o in (("acc_test", "acc"), ("fnum", "fnum"), ("red", "red"), ("time_total", "time_total")) for f, n in (("avg", "mean"), ("stddev_samp", "std")))
    + " FROM s WHERE h = 0 OR test_mode = 'selected' GROUP BY 1, 2, 3, 4"
)
def ablation_summary(spark, sf):
    return _rounded(report.ablation(tables.test_points(spark, sf)), ["dataset_idx"])


@query(f"WITH {FRONT}, {TEST}, {_TRAIN}, {_PICK}, {_TSUM} SELECT a.dataset_idx, a.method, {_SUMMARY_ROUNDED}, a.runs, b.runs AS runs_test, {_TROUND} FROM summary a LEFT JOIN tsum b USING (dataset_idx, method)")
def join_exact(spark, sf):
    return _rounded(report.join_exact(report.method_summary(_points(spark, sf)), report.test_summary(tables.test_points(spark, sf))), ["dataset_idx"])


@query(f"WITH {FRONT}, {TEST}, {_TRAIN}, {_PICK}, {_TSUM} SELECT a.dataset_idx, a.method AS method_base, a.method AS method_train, {_SUMMARY_ROUNDED}, a.runs, b.method AS method_test, post_tag, b.runs AS runs_test, {_TROUND} FROM summary a LEFT JOIN tsum b ON b.dataset_idx = a.dataset_idx AND b.method_base = a.method")
def join_by_base(spark, sf):
    return _rounded(report.join_by_base(report.method_summary(_points(spark, sf)), report.test_summary(tables.test_points(spark, sf))), ["dataset_idx"])


@query(f"WITH {FRONT}, {TEST} SELECT dataset_idx, method, run, point_id, er, NULL::VARCHAR AS test_mode, NULL::DOUBLE AS acc_test FROM front UNION ALL SELECT dataset_idx, method, run, point_id, NULL, test_mode, acc_test FROM test")
def union_merge(spark, sf):
    one = _points(spark, sf).select("dataset_idx", "method", "run", "point_id", "er")
    return report.united([one, tables.test_points(spark, sf).select("dataset_idx", "method", "run", "point_id", "test_mode", "acc_test")])


_SIZES = "sizes AS (SELECT DISTINCT dataset_idx, run, CAST(1 + dataset_idx + run AS INT) AS target_fnum FROM front WHERE NOT (dataset_idx = 2 AND run = 4))"


@query(f"WITH {FRONT}, {_SIZES} SELECT DISTINCT dataset_idx, run, coalesce(target_fnum, -1) AS target_fnum FROM front LEFT JOIN sizes USING (dataset_idx, run)")
def ref_size_lookup(spark, sf):
    p = _points(spark, sf)
    return report.with_targets(p.select("dataset_idx", "run").distinct(), tables.ref_sizes(p)).fillna(-1, ["target_fnum"])


@query(f"WITH {FRONT}, {_SIZES} SELECT DISTINCT dataset_idx, run FROM front ANTI JOIN sizes USING (dataset_idx, run)")
def ref_size_skips(spark, sf):
    p = _points(spark, sf)
    return report.skipped(p.select("dataset_idx", "run").distinct(), tables.ref_sizes(p))


@query(f"WITH {FRONT}, {_HV}, t AS (SELECT CAST(run AS VARCHAR) AS run, hv FROM hv WHERE dataset_idx = 0 AND method = 'UGFS') SELECT run, round(hv, 9) AS hv FROM t UNION ALL SELECT 'mean', round(avg(hv), 9) FROM t UNION ALL SELECT 'std', round(stddev_pop(hv), 9) FROM t")
def run_mean_std(spark, sf):
    hv = pareto.hypervolume(_points(spark, sf), ["dataset_idx", "method", "run"]).where("dataset_idx = 0 and method = 'UGFS'")
    return report.mean_std_rows(hv, "run", ["hv"]).select("run", F.round("hv", 9).alias("hv"))


@query("WITH p AS (SELECT event_id % 10 AS gen, value AS obj1, value / 2 AS obj2, user_id % 3 AS rank FROM events) SELECT gen, round(avg(obj1), 8) AS mean_obj1, round(avg(obj2), 8) AS mean_obj2, round(stddev_pop(obj1), 8) AS std_obj1, round(stddev_pop(obj2), 8) AS std_obj2, round(avg(CASE WHEN rank = 1 THEN 1.0e0 ELSE 0.0e0 END), 8) AS prop_rank1 FROM p GROUP BY 1")
def population_metrics(spark, sf):
    e = tables.table(spark, sf, "events")
    rows = e.select((F.col("event_id") % 10).alias("gen"), F.col("value").alias("obj1"), (F.col("value") / 2).alias("obj2"), (F.col("user_id") % 3).alias("rank"))
    return _rounded(search.population_metrics(rows), ["gen"])


@query(f"WITH {FRONT}, e AS (SELECT dataset_idx, run, max(fnum) - 20 AS fnum FROM front WHERE method = 'UGFS' GROUP BY 1, 2), b AS (SELECT dataset_idx, run, max(fnum) AS fnum FROM front WHERE method = 'graph_baseline' GROUP BY 1, 2) SELECT dataset_idx, run, coalesce(nullif(e.fnum, 0), nullif(b.fnum, 0), 1)::INT AS k_ref FROM b FULL JOIN e USING (dataset_idx, run)")
def k_ref_choice(spark, sf):
    p = _points(spark, sf)
    size = lambda m, less: p.where(F.col("method") == m).groupBy("dataset_idx", "run").agg((F.max("fnum") - less).alias("fnum"))
    return report.reference_size(size("graph_baseline", 0), size("UGFS", 20))


# Scalar functions.


@query(f"WITH {FRONT} SELECT point_id, CASE WHEN contains(lower(method), 'graph_enhanced') THEN 'enhanced' WHEN contains(lower(method), 'graph_baseline') THEN 'baseline' ELSE 'other' END AS category FROM front")
def method_category(spark, sf):
    return _points(spark, sf).select("point_id", text.category(F.col("method")).alias("category"))


# The tags' SQL lists the values that names must give, one by one.
_TAGGED = "tagged AS (SELECT event_id, event_type, event_id % 4 AS kind, event_type || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '__postBuddy' WHEN 2 THEN '__POST_a__postnormal' ELSE '' END AS method FROM events)"


def _tagged(spark, sf):
    tag = F.element_at(F.array(F.lit(""), F.lit("__postBuddy"), F.lit("__POST_a__postnormal"), F.lit("")), (F.col("event_id") % 4 + 1).cast("int"))
    return tables.table(spark, sf, "events").select("event_id", F.concat("event_type", tag).alias("method"), F.when(F.col("event_id") % 4 == 3, "Buddy").when(F.col("event_id") % 4 == 0, "nan").alias("post_mode"))


@query(f"WITH {_TAGGED} SELECT event_id, event_type || CASE kind WHEN 2 THEN '__POST_a' ELSE '' END AS base, event_type || CASE kind WHEN 0 THEN '' WHEN 1 THEN '__postBuddy' WHEN 2 THEN '__POST_a__postnormal' ELSE '__postbuddy' END AS test FROM tagged")
def method_base(spark, sf):
    method = F.col("method")
    return _tagged(spark, sf).select("event_id", text.method_base(method).alias("base"), text.method_test(method, F.col("post_mode")).alias("test"))


@query(f"WITH {_TAGGED} SELECT event_id, CASE kind WHEN 0 THEN 'nopost' WHEN 1 THEN 'postbuddy' WHEN 2 THEN 'postnormal' ELSE 'nopost' END AS by_name, CASE kind WHEN 0 THEN 'nopost' WHEN 1 THEN 'postbuddy' WHEN 2 THEN 'postnormal' ELSE 'postbuddy' END AS tag FROM tagged")
def post_tag(spark, sf):
    method = F.col("method")
    return _tagged(spark, sf).select("event_id", text.post_tag(method).alias("by_name"), text.post_tag(method, F.col("post_mode")).alias("tag"))


@query("SELECT event_id, 'enh' AS family, event_type AS first, 'k:' || event_id % 4 AS second, 'enh__' || event_type || '__k__' || event_id % 4 AS safe FROM events")
def algo_tag(spark, sf):
    algo = F.concat_ws(":", F.lit("enh"), "event_type", F.lit("k"), (F.col("event_id") % 4).cast("string"))
    family, first, second = text.algo_parts(algo)
    return tables.table(spark, sf, "events").select("event_id", family.alias("family"), first.alias("first"), second.alias("second"), text.safe_tag(algo).alias("safe"))


_FLOATS = [(0.5, "0p5"), (2.0, "2"), (0.25, "0p25"), (-1.5, "m1p5"), (0.0, "0"), (100.0, "100"), (1 / 3, "0p333333"), (123456.0, "123456"), (1234567.0, "1p23457e+06"), (0.0001, "0p0001"), (0.00002, "2em05")]


@query("SELECT event_id, CASE event_id % " + str(len(_FLOATS)) + "".join(f" WHEN {i} THEN '{t}'" for i, (_, t) in enumerate(_FLOATS)) + " END AS tag FROM events")
def float_tag(spark, sf):
    value = F.element_at(F.array(*(F.lit(float(x)) for x, _ in _FLOATS)), (F.col("event_id") % len(_FLOATS) + 1).cast("int"))
    return tables.table(spark, sf, "events").select("event_id", text.float_tag(value).alias("tag"))


@query("SELECT event_id, (event_id % 7) || ' ' || (event_id % 7 + 3) AS fset, CAST(2 AS BIGINT) AS n, 2 * (event_id % 7) + 3 AS total FROM events")
def fset_roundtrip(spark, sf):
    ids = F.array((F.col("event_id") % 7).cast("int"), (F.col("event_id") % 7 + 3).cast("int"))
    back = text.parse_ids(text.join_ids(ids))
    return tables.table(spark, sf, "events").select("event_id", text.join_ids(ids).alias("fset"), F.size(back).cast("bigint").alias("n"), F.aggregate(back, F.lit(0), lambda a, b: a + b).cast("bigint").alias("total"))


@query("SELECT event_type, printf('%.3f±%.3f', avg(value), stddev_samp(value)) AS text FROM events GROUP BY 1")
def mean_std_text(spark, sf):
    return tables.table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).select("event_type", text.mean_std(F.col("m"), F.col("s")).alias("text"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 WHEN event_id % 4 = 1 THEN 0 ELSE value END AS score FROM events")
def score_sanitise(spark, sf):
    bad = F.when(F.col("event_id") % 4 == 0, float("nan")).when(F.col("event_id") % 4 == 1, float("inf")).otherwise(F.col("value"))
    return tables.table(spark, sf, "events").select("event_id", text.finite(bad).alias("score"))


@query("SELECT event_type, round(avg(value), 8) AS mean, round(quantile_cont(value, 0.5), 8) AS median, arg_min(event_id, struct_pack(v := value, e := event_id)) AS best FROM events WHERE event_id % 3 != 0 GROUP BY 1")
def missing_values(spark, sf):
    x = F.when(F.col("event_id") % 3 == 0, float("nan")).otherwise(F.col("value"))
    rows = tables.table(spark, sf, "events").select("event_type", "event_id", x.alias("x"))
    return rows.groupBy("event_type").agg(F.round(numeric.nan_mean(F.col("x")), 8).alias("mean"), F.round(numeric.nan_median(F.col("x")), 8).alias("median"), numeric.nan_argmin(F.col("event_id"), F.col("x")).alias("best"))


@query("SELECT event_id, greatest(0.5e0, least(2.5e0, value / 100)) AS clamped, round_even(event_id / 2.0e0, 0) AS rounded, round(sqrt(value * value + 9), 8) AS norm FROM events")
def numeric_functions(spark, sf):
    v = F.col("value")
    return tables.table(spark, sf, "events").select("event_id", numeric.clamp(v / 100, 0.5, 2.5).alias("clamped"), numeric.half_even(F.col("event_id") / 2.0).alias("rounded"), F.round(numeric.norm(F.array(v, F.lit(3.0))), 8).alias("norm"))


@query(f"WITH {_GRAPH} SELECT src, string_agg(dst::VARCHAR, ' ' ORDER BY sim DESC, dst) AS nearest FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS k FROM edges) WHERE k <= 5 GROUP BY 1")
def neighbor_matrix(spark, sf):
    return bigints(graph.neighbour_matrix(_sim(spark, sf)).select("src", text.join_ids(F.col("nearest")).alias("nearest")), "src")


@query(f"WITH {WIDE} SELECT sample_id, features[4] + 2 * features[1] AS mixed FROM wide")
def indicator_projection(spark, sf):
    rows = prep.project(_wide(spark, sf), [3, 0])
    return rows.select("sample_id", (F.get("features", F.lit(0)) + 2 * F.get("features", F.lit(1))).alias("mixed"))


# Predicates, sets and tables for plots.


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS v FROM events")
def numeric_coercion(spark, sf):
    rows = tables.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "x").otherwise(F.col("event_id").cast("string")).alias("v"))
    return tables.numeric(rows, ["v"])


@query("SELECT event_id, value / (value + 50.0e0) AS er FROM events WHERE event_id % 4 != 1 AND event_id % 4 != 2")
def complement_column(spark, sf):
    e = tables.table(spark, sf, "events")
    rate = F.col("value") / (F.col("value") + 50.0)
    rows = e.select("event_id", F.lit(0.5).alias("fRatio"), F.when(F.col("event_id") % 2 == 0, rate).alias("eRate_train_cv"), F.lit(None).cast("double").alias("acc_train_cv"))
    rows = rows.union(e.where("event_id % 4 = 3").select("event_id", F.lit(0.5), rate, F.lit(None).cast("double")))
    return report.points(rows).where("event_id % 4 != 2").select("event_id", "er")


@query("SELECT event_id, value FROM events WHERE event_id % 5 NOT IN (0, 1, 2)")
def finite_filter(spark, sf):
    k = F.col("event_id") % 5
    bad = F.when(k == 0, float("nan")).when(k == 1, float("-inf")).when(k != 2, F.col("value"))
    return tables.table(spark, sf, "events").select("event_id", bad.alias("value")).where(text.is_finite(F.col("value")))


@query(f"WITH {WIDE} SELECT sample_id, array_to_string(list_transform(range(0, 64), lambda i: CASE WHEN features[i + 1] > 0 THEN i END), ' ') AS ids FROM wide")
def mask_to_ids(spark, sf):
    ids = F.filter(F.transform("features", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    return _wide(spark, sf).select("sample_id", text.join_ids(ids).alias("ids"))


@query(f"WITH {FRONT}, {TEST}, s AS (SELECT *, max(CASE WHEN test_mode = 'selected' THEN 1 ELSE 0 END) OVER (PARTITION BY dataset_idx, method, run) AS h FROM test) SELECT dataset_idx, method, run, point_id, test_mode FROM s WHERE h = 0 OR test_mode = 'selected'")
def selected_only(spark, sf):
    return report.selected_only(tables.test_points(spark, sf), ["dataset_idx", "method", "run"]).select("dataset_idx", "method", "run", "point_id", "test_mode")


@query("SELECT DISTINCT least(event_id % 11, user_id % 13) AS i, greatest(event_id % 11, user_id % 13) AS j FROM events WHERE event_id % 11 != user_id % 13")
def distinct_pairs(spark, sf):
    return graph.unordered(tables.table(spark, sf, "events").select((F.col("event_id") % 11).alias("a"), (F.col("user_id") % 13).alias("b")))


@query("WITH kept AS (SELECT event_id % 11 AS src, user_id % 13 AS dst, value AS sim FROM events) SELECT src, dst, max(sim) AS sim FROM (SELECT src, dst, sim FROM kept UNION ALL SELECT dst, src, sim FROM kept) GROUP BY 1, 2")
def symmetrise(spark, sf):
    return graph.symmetric(tables.table(spark, sf, "events").select((F.col("event_id") % 11).alias("src"), (F.col("user_id") % 13).alias("dst"), F.col("value").alias("sim")))


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY -ln((('0x' || substr(md5('7:' || event_id), 1, 12))::BIGINT + 0.5e0) / 281474976710656.0e0) / value, event_id) AS k FROM events) WHERE k <= 20")
def weighted_sampling(spark, sf):
    e = tables.table(spark, sf, "events").select("event_type", "event_id", "value")
    return prep.weighted_sample(e, "event_type", F.col("value"), F.lit(20), 7, ["event_id"]).select("event_type", "event_id")


@query("SELECT gen, event_id FROM (SELECT event_id % 10 AS gen, event_id, row_number() OVER (PARTITION BY event_id % 10 ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 20")
def archive_truncation(spark, sf):
    rows = tables.table(spark, sf, "events").select((F.col("event_id") % 10).alias("gen"), "event_id", "value")
    return search.truncated(rows, ["gen"], "value", "event_id", 20).select("gen", "event_id")


@query(f"WITH {_GRAPH} SELECT i, j, CASE WHEN i % 8 = 0 AND j % 8 = 0 THEN 'both' WHEN i % 8 = 0 OR j % 8 = 0 THEN 'one' ELSE 'none' END AS colour FROM sims WHERE sim > 0.05")
def edge_colours(spark, sf):
    chosen = spark.range(0, 64, 8).select(F.col("id").cast("int").alias("fid"))
    return bigints(graph.coloured(_sim(spark, sf).where("sim > 0.05"), chosen).select("i", "j", "colour"), "i", "j")


@query(f"WITH {FRONT}, {_HV}, {'m AS (SELECT dataset_idx, method, quantile_cont(hv, 0.5) AS mid FROM hv GROUP BY 1, 2), p AS (SELECT dataset_idx, method, run FROM (SELECT hv.*, row_number() OVER (PARTITION BY dataset_idx, method ORDER BY round(abs(hv - mid), 12), run) AS k FROM hv JOIN m USING (dataset_idx, method)) WHERE k = 1)'} SELECT dataset_idx, method, run, fr, er, CASE WHEN contains(method, 'enhanced') THEN 0 WHEN contains(method, 'baseline') THEN 1 ELSE 2 END AS place FROM nd JOIN p USING (dataset_idx, method, run)")
def median_fronts(spark, sf):
    return report.median_fronts(_points(spark, sf))


#: The flagship query: the ten best features by Fisher score, and the hold-out accuracy on them.
FLAGSHIP = f"WITH {LONG.replace('long AS', 'everything AS')}, {SPLIT}, {LONG.replace('long AS (SELECT', 'trains AS (SELECT').replace('FROM embeddings)', 'FROM embeddings)')}, long0 AS (SELECT * FROM trains JOIN split USING (sample_id, label) WHERE split = 'train'), {FISHER.replace('FROM long', 'FROM long0')}, top AS (SELECT fid FROM fisher ORDER BY score DESC, fid LIMIT 10), long AS (SELECT everything.* FROM everything JOIN top USING (fid)), {_knn_sql('fid >= 0')} SELECT round(avg(hit), 9) AS accuracy, count(*) AS n_test FROM hits"


@query(FLAGSHIP)
def fisher_top10_accuracy(spark, sf):
    wide = _wide(spark, sf)
    split = prep.stratified_split(wide)
    train = wide.join(split.where("split = 'train'").select("sample_id"), "sample_id", "left_semi")
    best = stats.top(stats.fisher(tables.melt(train)), 10).select("fid")
    chosen = tables.widen(tables.melt(wide).join(F.broadcast(best), "fid"))  # ten rows
    return knn.holdout_accuracy(chosen, split).select(F.round("accuracy", 9).alias("accuracy"), "n_test")

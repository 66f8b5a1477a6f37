"""Queries do the whole job: all pairs, the operators' own settings, tables over the broadcast bound."""

from siftgraph.plans import queries
from siftgraph.sources import tables


def test_complementarity_of_all_pairs(spark, sf):
    wide = tables.embeddings(spark, sf)
    few = wide.where("sample_id < 60").selectExpr("sample_id", "label", "slice(features, 1, 9) AS features").cache()
    matrix = queries.knn.Matrix.of(few, queries.prep.stratified_folds(few))
    queries_matrix, queries._matrix = queries._matrix, lambda *_: matrix
    try:
        found = {(r["i"], r["j"]): r["comp"] for r in queries.QUERIES["complementarity"](spark, sf).collect()}
    finally:
        queries._matrix = queries_matrix
    one = [matrix.accuracy([f]) for f in range(9)]
    assert found == {(i, j): round(max(0.0, matrix.accuracy([i, j]) - max(one[i], one[j])), 9) for j in range(9) for i in range(j)}


def test_queries_keep_the_operators_settings(spark, sf, monkeypatch):
    c = queries._context(spark, sf).config
    assert c.search == queries.search.Settings() and c.ratios == queries.stats.RATIOS
    seen = []
    monkeypatch.setattr(queries.embedded, "forest_importance", lambda *a: seen.append(len(a)))
    monkeypatch.setattr(queries.embedded, "l1_importance", lambda *a: seen.append(len(a)))
    queries.QUERIES["rf_importance"](spark, sf), queries.QUERIES["l1_logreg_importance"](spark, sf)
    assert seen == [1, 1]  # the table alone, nothing smaller than the defaults
    monkeypatch.setattr(queries.pipeline, "run", lambda context, name: (context, seen.append(context.config.ratios)) and (None, spark.range(1).selectExpr("0 AS time_total", "0.5 AS acc_test", "0.5 AS eRate_test", "0.1 AS red")))
    queries.QUERIES["run_filter_pearson"](spark, sf)
    assert seen[-1] == queries.stats.RATIOS


def test_rows_over_the_bound_are_searched_by_blocks(spark, sf, monkeypatch):
    knn = queries.knn
    few = tables.embeddings(spark, sf).where("sample_id < 60").selectExpr("sample_id", "label", "slice(features, 1, 2) AS features").cache()
    folds = queries.prep.stratified_folds(few).cache()
    matrix = knn.Matrix.of(few, folds)
    monkeypatch.setattr(knn, "BROADCAST", 100)
    rows = knn.Matrix.of(few, folds)
    assert isinstance(rows, knn.Rows) and rows.p == 2
    found = {r["fid"]: r["accuracy"] for r in knn.single_accuracies(rows, spark).collect()}
    assert all(abs(found[f] - matrix.accuracy([f])) < 1e-9 for f in range(2))
    assert abs(rows.apparent([0, 1]) - matrix.apparent([0, 1])) < 1e-9

"""Summaries of result tables and their joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import category, is_finite, method_base, method_test, post_tag
from .pareto import front, hypervolume, igd, median_run


def points(table: DataFrame) -> DataFrame:
    """A front table with fr and er; a missing error rate comes from the accuracy. Rows without both are left out."""
    error = F.col("eRate_train_cv")
    if "acc_train_cv" in table.columns:
        error = F.coalesce(error, 1 - F.col("acc_train_cv"))
    return table.withColumn("fr", F.col("fRatio")).withColumn("er", error).dropna(subset=["fr", "er"])


def best_per_size(table: DataFrame, groups: list[str]) -> DataFrame:
    """Of each subset size the row with the least error, the first point of ties."""
    rest = [c for c in table.columns if c not in (*groups, "fnum")]
    best = F.min_by(F.struct(*rest), F.struct("er", "point_id"))
    return table.groupBy(*groups, "fnum").agg(best.alias("__b")).select(*groups, "fnum", *(F.col(f"__b.{c}").alias(c) for c in rest))


def reference_front(table: DataFrame) -> DataFrame:
    """The front over all methods of a dataset."""
    return front(table, ["dataset_idx"])


def run_metrics(table: DataFrame, reference: tuple[float, float] = (1.0, 1.0), p: float = 2.0) -> DataFrame:
    """(dataset_idx, method, run, hv, igd, best_acc, best_fnum) of each run, hv within the reference point and igd by the p-norm; igd is null without a front."""
    groups = ["dataset_idx", "method", "run"]
    best = table.groupBy(*groups).agg(F.min_by(F.struct("er", "fnum"), F.struct("er", "point_id")).alias("b"))
    best = best.select(*groups, (1 - F.col("b.er")).alias("best_acc"), F.col("b.fnum").alias("best_fnum"))
    return hypervolume(table, groups, reference).join(igd(table, groups, reference_front(table), ["dataset_idx"], p), groups, "left").join(best, groups)


def method_summary(table: DataFrame, reference: tuple[float, float] = (1.0, 1.0), p: float = 2.0) -> DataFrame:
    """Means and sample deviations over a method's runs."""
    return run_metrics(table, reference, p).groupBy("dataset_idx", "method").agg(
        *(f(c).alias(f"{c}_{n}") for c in ("hv", "igd", "best_acc", "best_fnum") for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))),
        F.countDistinct("run").alias("runs"),
    )


def test_pick(table: DataFrame, groups: list[str]) -> DataFrame:
    """Of each group the row of the best test accuracy, the first point of ties, among the preferred modes there.

    Graph methods prefer 'selected'; others 'k_ref', then 'ratio'. Rows without an accuracy are left out.
    """
    mode = F.lower(F.coalesce("test_mode", F.lit("")))
    graph = category(F.col("method")) != "other"
    preference = F.when(graph, (mode != "selected").cast("int")).when(mode == "k_ref", 0).when(mode == "ratio", 1).otherwise(2)
    rows = table.where(is_finite(F.col("acc_test"))).withColumn("__p", preference)
    best = F.min_by(F.struct(*(c for c in table.columns if c not in groups)), F.struct("__p", (-F.col("acc_test")).alias("a"), F.col("point_id").alias("i")))
    return rows.groupBy(*groups).agg(best.alias("b")).select(*groups, "b.*")


def selected_only(table: DataFrame, groups: list[str]) -> DataFrame:
    """Rows of mode 'selected' where the group has any, else all its rows."""
    selected = F.coalesce(F.lower("test_mode") == "selected", F.lit(False))
    has = table.groupBy(*groups).agg(F.max(selected.cast("int")).alias("__has"))
    return table.join(has, groups).where((F.col("__has") == 0) | selected).drop("__has")


def test_summary(table: DataFrame) -> DataFrame:
    """Means and sample deviations of each run's picked test point, by method with its post mode, method_base and post_tag."""
    rows = table.withColumn("method", method_test(F.col("method"), F.col("post_mode")))
    picked = test_pick(rows, ["dataset_idx", "method", "run"])
    return picked.groupBy("dataset_idx", "method").agg(
        F.first(method_base(F.col("method"))).alias("method_base"),
        F.min_by(post_tag(F.col("method"), F.col("post_mode")), "run").alias("post_tag"),
        F.countDistinct("run").alias("runs"),
        *(f(c).alias(f"{o}_{n}") for c, o in (("acc_test", "acc_test"), ("fnum", "fnum_test"), ("red", "red_test"), ("time_total", "time_total")) for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))),
    )


def ablation(table: DataFrame) -> DataFrame:
    """Means and sample deviations of a dataset's enhanced methods by initialiser, k-shell and post mode; missing modes are a group.

    Where a dataset has points of mode 'selected', only these count. Without
    columns init_mode and ks_mode both are read from the name.
    """
    rows = selected_only(table.where(category(F.col("method")) == "enhanced"), ["dataset_idx"])
    for name, part in (("init_mode", "__init_(.*?)(?:__|$)"), ("ks_mode", "__ks_(.*?)(?:__|$)")):
        known = F.col(name).cast("string") if name in table.columns else F.nullif(F.regexp_extract("method", part, 1), F.lit(""))
        rows = rows.withColumn(name, F.coalesce(known, F.lit("nan")))
    rows = rows.withColumn("post_mode", F.coalesce("post_mode", F.lit("nan")))
    return rows.groupBy("dataset_idx", "init_mode", "ks_mode", "post_mode").agg(
        F.countDistinct("run").alias("runs"),
        *(f(c).alias(f"{o}_{n}") for c, o in (("acc_test", "acc"), ("fnum", "fnum"), ("red", "red"), ("time_total", "time_total")) for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))),
    )


def join_exact(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train summaries with the test summaries of the same method; columns of both get _test on the right."""
    keys = ["dataset_idx", "method"]
    test = test.drop("method_base", "post_tag")
    right = test.select(*(F.col(c) if c in keys else F.col(c).alias(f"{c}_test" if c in train.columns else c) for c in test.columns))
    return train.join(right, keys, "left")


def join_by_base(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train summaries (method_train) with all test summaries (method_test) of the same method before its post mode."""
    left = train.withColumn("method_base", method_base(F.col("method"))).withColumnRenamed("method", "method_train")
    right = test.withColumnsRenamed({"method": "method_test", "runs": "runs_test"})
    return left.join(right, ["dataset_idx", "method_base"], "left")


def united(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns in the order in which they first appear."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def with_targets(jobs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Jobs (dataset_idx, run) with target_fnum, null where there is none."""
    return jobs.join(sizes, ["dataset_idx", "run"], "left")


def skipped(jobs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Jobs without a target size."""
    return jobs.join(sizes, ["dataset_idx", "run"], "left_anti")


def mean_std_rows(table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """table's columns and two more rows, 'mean' and 'std' (population)."""
    rows = table.select(F.col(key).cast("string").alias(key), *(F.col(c).cast("double").alias(c) for c in columns))
    mean = table.agg(*(F.avg(c).alias(c) for c in columns)).select(F.lit("mean").alias(key), *columns)
    std = table.agg(*(F.stddev_pop(c).alias(c) for c in columns)).select(F.lit("std").alias(key), *columns)
    return rows.unionByName(mean).unionByName(std)


def reference_size(baseline: DataFrame, enhanced: DataFrame) -> DataFrame:
    """(dataset_idx, run, k_ref): the enhanced size, else the baseline's, else 1; sizes of 0 count as none."""
    e = enhanced.select("dataset_idx", "run", F.col("fnum").alias("e"))
    return baseline.join(e, ["dataset_idx", "run"], "full").select("dataset_idx", "run", F.coalesce(F.nullif("e", F.lit(0)), F.nullif("fnum", F.lit(0)), F.lit(1)).alias("k_ref"))


def median_fronts(table: DataFrame, reference: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(dataset_idx, method, run, fr, er, place): each method's front in its run of median hypervolume, and its place in a legend.

    The table behind the comparison plot: enhanced methods first, then baselines, then others.
    """
    groups = ["dataset_idx", "method", "run"]
    chosen = median_run(hypervolume(table, groups, reference), ["dataset_idx", "method"]).drop("hv")
    place = F.when(category(F.col("method")) == "enhanced", 0).when(category(F.col("method")) == "baseline", 1).otherwise(2)
    return front(table.join(chosen, groups, "left_semi"), groups).withColumn("place", place)

"""Command line: one run, the merge of runs' files, and their analysis.

    python -m siftgraph run --data sf_dir --algo enh:knn:normal --run 1 --out folder
    python -m siftgraph sweep --data sf_dir --algo enh:probabilistic:rc_greedy --run 1 --out folder
    python -m siftgraph merge --root folder --out merged
    python -m siftgraph analyze --front merged/front --test merged/test --out tables
"""

from __future__ import annotations

import argparse
from dataclasses import asdict, replace
from functools import partial

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import float_tag, safe_tag
from .operators import report
from .plans import pipeline
from .sources import tables


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="siftgraph")
    kinds = parser.add_subparsers(dest="kind", required=True)
    for kind in ("run", "sweep"):
        _run_arguments(kinds.add_parser(kind))
    merge = kinds.add_parser("merge")
    merge.add_argument("--root", required=True)
    merge.add_argument("--out", required=True)
    analyze = kinds.add_parser("analyze")
    for name in ("front", "test", "out"):
        analyze.add_argument(f"--{name}", required=True)
    for name, default in (("hv_ref_x", 1.0), ("hv_ref_y", 1.0), ("igd_p", 2.0)):
        analyze.add_argument(f"--{name}", type=float, default=default)
    return parser


def _run_arguments(one: argparse.ArgumentParser) -> None:
    one.add_argument("--data", required=True, help="folder of the tables; embeddings is the dataset")
    one.add_argument("--algo", required=True)
    one.add_argument("--out", required=True)
    default = pipeline.Config()
    for name in ("dataset_idx", "run", "split_seed", "cv_folds", "k", "k_neighbours", "max_per_core"):
        one.add_argument(f"--{name}", type=int, default=getattr(default, name))
    one.add_argument("--fixed_fnum", type=int, help="size of ranked subsets; without it the ratios count")
    one.add_argument("--ratios", default=",".join(map(str, default.ratios)))
    one.add_argument("--ref_sizes", help="CSV of dataset_idx, run, target_fnum that gives the size; a missing pair skips the run")
    for name in ("test_size", "buddy_lambda", "prob_beta"):
        one.add_argument(f"--{name}", type=float, default=getattr(default, name))
    for name, kind in (("population", int), ("generations", int), ("crossover", float), ("mutation", float), ("tau", float), ("most_added", int)):
        one.add_argument(f"--{name}", type=kind, default=getattr(default.search, name))


def folder_of(spark: SparkSession, out: str, algo: str, config: pipeline.Config) -> str:
    """out/dataset_01/<safe name>/run_01; names of searches carry their swept settings, so settings never share a folder."""
    parts = [safe_tag(F.lit(algo))]
    if algo.startswith("enh:"):
        for name, value in (("beta", config.prob_beta), ("tau", config.search.tau), ("lam", config.buddy_lambda)):
            parts += [F.lit(f"__{name}_"), float_tag(F.lit(float(value)))]
    tag = spark.range(1).select(F.concat(*parts)).first()[0]
    return f"{out}/dataset_{config.dataset_idx:02d}/{tag}/run_{config.run:02d}"


def configured(a: argparse.Namespace, fixed: int | None) -> pipeline.Config:
    search = replace(pipeline.Config().search, population=a.population, generations=a.generations, crossover=a.crossover, mutation=a.mutation, tau=a.tau, most_added=a.most_added)
    own = {n: getattr(a, n) for n in ("dataset_idx", "run", "split_seed", "cv_folds", "k", "k_neighbours", "max_per_core", "test_size", "buddy_lambda", "prob_beta")}
    return pipeline.Config(search=search, fixed_fnum=fixed, ratios=tuple(float(x) for x in a.ratios.split(",") if x), **own)


def run(spark: SparkSession, a: argparse.Namespace, sweep: bool = False) -> None:
    """One run, or with sweep one for each setting of the sensitivity sweeps."""
    fixed = a.fixed_fnum
    if a.ref_sizes and a.algo.split(":")[0] in ("trad", "graph"):
        found = tables.read_ref_sizes(spark, a.ref_sizes).where((F.col("dataset_idx") == a.dataset_idx) & (F.col("run") == a.run)).first()
        if found is None:
            text = f"no size for dataset {a.dataset_idx}, run {a.run}"
            spark.createDataFrame([(text,)], "value string").write.mode("overwrite").text(f"{folder_of(spark, a.out, a.algo, configured(a, None))}/error")
            return
        fixed = found["target_fnum"]
    config = configured(a, fixed)
    context = pipeline.Context(tables.embeddings(spark, a.data), config)
    for own in pipeline.swept(config) if sweep else [config]:
        _one(spark, pipeline.replace_config(context, **{f: getattr(own, f) for f in ("prob_beta", "buddy_lambda", "search")}), a.algo, a.out)


def _one(spark: SparkSession, context: pipeline.Context, algo: str, out: str) -> None:
    config, kept = context.config, {}
    front, test = pipeline.run(context, algo, kept)
    folder = folder_of(spark, out, algo, config)
    tables.write_csv(front, f"{folder}/front_train_cv.csv")
    tables.write_csv(test, f"{folder}/test_points.csv")
    info = asdict(config) | {"algo": algo, "seed_run": config.seed}
    tables.write_info(spark, info, f"{folder}/run_info.json")
    if kept:
        pipeline.export(context, kept, folder)


def merge(spark: SparkSession, a: argparse.Namespace) -> None:
    for kind, name in (("front_train_cv", "front"), ("test_points", "test")):
        tables.write_csv(tables.read_results(spark, a.root, kind), f"{a.out}/{name}")


def analyze(spark: SparkSession, a: argparse.Namespace) -> None:
    read = lambda path: spark.read.csv(path, header=True)
    whole = ("dataset_idx", "run", "point_id", "fnum")
    front = tables.require(read(a.front), ["dataset_idx", "method", "run", "fRatio", "fnum"])
    front = tables.numeric(front, ["fRatio", "acc_train_cv", "eRate_train_cv", *whole])
    test = tables.numeric(tables.require(read(a.test), ["dataset_idx", "method", "run", "test_mode", "acc_test"]), ["acc_test", "fRatio", "red", "time_total", *whole])
    if "point_id" not in test.columns:
        test = test.withColumn("point_id", F.monotonically_increasing_id())
    if "post_mode" not in test.columns:
        test = test.withColumn("post_mode", F.lit(""))
    shown = {"reference": (a.hv_ref_x, a.hv_ref_y), "p": a.igd_p}
    points = report.points(front.withColumns({c: F.col(c).cast("int") for c in whole if c in front.columns}))
    test = test.withColumns({c: F.col(c).cast("int") for c in whole[:2]}).fillna("", ["post_mode"])
    train, tested = report.method_summary(points, **shown), report.test_summary(test)
    for name, frame in (("train_summary", train), ("test_summary", tested), ("joined", report.join_exact(train, tested)), ("joined_by_base", report.join_by_base(train, tested)), ("ablation", report.ablation(test)), ("median_fronts", report.median_fronts(points, shown["reference"]))):
        tables.write_csv(frame, f"{a.out}/{name}")


def main(words: list[str] | None = None) -> None:
    a = arguments().parse_args(words)
    spark = SparkSession.builder.getOrCreate()
    {"run": run, "sweep": partial(run, sweep=True), "merge": merge, "analyze": analyze}[a.kind](spark, a)


if __name__ == "__main__":
    main()

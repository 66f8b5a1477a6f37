"""Sources: labelled datasets in wide and long form, result tables, lookups, and sinks.

A labelled dataset is wide (sample_id, label, features) or long (sample_id, label,
fid, x). Long form is what relational statistics take; column subsets are then
filters on fid, which reach the plan before any shuffle.
"""

from __future__ import annotations

import json
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Dataset numbers and names of the benchmark's catalog.
CATALOG = {1: "Sonar", 2: "Musk1", 3: "Madelon", 4: "Isolet", 5: "USPS", 6: "COIL20", 7: "ORL", 8: "Yale", 9: "warpAR10P", 10: "lung", 11: "BASEHOCK", 12: "GISETTE", 13: "TOX171", 14: "ARCENE"}

FRONT_SCHEMA = "dataset_idx INT, dataset STRING, method STRING, run INT, point_id INT, fnum INT, fRatio DOUBLE, acc_train_cv DOUBLE, eRate_train_cv DOUBLE, red DOUBLE, fset STRING"
TEST_SCHEMA = "dataset_idx INT, dataset STRING, method STRING, run INT, test_mode STRING, acc_test DOUBLE, eRate_test DOUBLE, fnum INT, fRatio DOUBLE, red DOUBLE, time_total DOUBLE, fset STRING"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recode(label: Column) -> Column:
    """-1 becomes 0."""
    return F.when(label == -1, F.lit(0)).otherwise(label)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as a wide dataset of doubles."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"), recode(F.col("label")).alias("label"), F.col("embedding").cast("array<double>").alias("features"))


def melt(wide: DataFrame) -> DataFrame:
    """Wide to long."""
    return wide.select("sample_id", "label", F.posexplode("features").alias("fid", "x"))


def widen(long: DataFrame) -> DataFrame:
    """Long to wide, features by ascending fid."""
    pairs = F.array_sort(F.collect_list(F.struct("fid", "x")))
    return long.groupBy("sample_id", "label").agg(F.transform(pairs, lambda p: p["x"]).alias("features"))


def lineitem_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric columns of lineitem as a long dataset labelled by return flag."""
    columns = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    items = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return items.select(key.alias("sample_id"), F.col("l_returnflag").alias("label"), F.posexplode(F.array(*columns)).alias("fid", "x"))


def dataset(spark: SparkSession, root: str, index: int) -> tuple[DataFrame, str]:
    """The wide dataset and name of a catalog number: root/<name>.parquet with sample_id, label, features."""
    if index not in CATALOG:
        raise ValueError(f"no dataset {index}")
    found = spark.read.parquet(f"{root}/{CATALOG[index]}.parquet")
    missing = {"label", "features"} - set(found.columns)
    if missing:
        raise KeyError(f"columns {sorted(missing)} are missing")
    return found.withColumn("label", recode(F.col("label"))), CATALOG[index]


def shape(wide: DataFrame) -> DataFrame:
    """Features, samples and classes of a wide dataset."""
    return wide.agg(F.max(F.size("features")).cast("bigint").alias("n_features"), F.count("*").alias("n_samples"), F.countDistinct("label").alias("n_classes"))


def front_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A front table derived from events."""
    methods = {"view": "graph_enhanced__init_knn__ks_normal", "signup": "graph_enhanced__init_probabilistic__ks_rc_greedy", "purchase": "graph_baseline", "click": "FILTER_pearson", "error": "UGFS"}
    e = table(spark, sf_dir, "events")
    names = F.create_map(*(F.lit(x) for pair in methods.items() for x in pair))
    fnum = F.pmod("event_id", F.lit(20)) + 1
    return e.select(
        F.pmod("event_id", F.lit(3)).cast("int").alias("dataset_idx"),
        names[F.col("event_type")].alias("method"),
        F.pmod("user_id", F.lit(5)).cast("int").alias("run"),
        F.col("event_id").alias("point_id"),
        fnum.cast("int").alias("fnum"),
        (fnum / F.lit(20.0)).alias("fRatio"),
        (F.col("value") / (F.col("value") + 50.0)).alias("eRate_train_cv"),
    ).where("method is not null")


def test_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test-point table derived from events."""
    e = table(spark, sf_dir, "events").select("event_id", "value").join(front_points(spark, sf_dir), F.col("event_id") == F.col("point_id"))
    div = lambda n: F.floor(F.col("event_id") / n)
    mode = F.element_at(F.array(*map(F.lit, ("selected", "fixed_k", "ratio"))), (F.pmod(div(3), F.lit(3)) + 1).cast("int"))
    post = F.element_at(F.array(*map(F.lit, ("", "normal", "buddy"))), (F.pmod(div(9), F.lit(3)) + 1).cast("int"))
    return e.select(
        "dataset_idx", "method", "run", "point_id", "fnum", "fRatio",
        mode.alias("test_mode"), post.alias("post_mode"),
        (50.0 / (F.col("value") + 50.0)).alias("acc_test"),
        (F.col("value") / 1000.0).alias("red"), (F.col("value") / 10.0).alias("time_total"),
    )


def ref_sizes(front: DataFrame) -> DataFrame:
    """Target sizes of (dataset, run); the pair (2, 4) has none."""
    keys = front.select("dataset_idx", "run").distinct().where("not (dataset_idx = 2 and run = 4)")
    return keys.withColumn("target_fnum", (F.lit(1) + F.col("dataset_idx") + F.col("run")).cast("int"))


# Files.


def read_results(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """All result files root/dataset_*/*/run_*/<kind>.csv with the union of their columns.

    The header of each file counts, and only its first line is read for that:
    files are grouped by header, and the groups are united by name in the order in
    which columns first appear. Files that cannot be read are named in a warning.
    """
    lines = spark.read.option("ignoreCorruptFiles", "true").text(f"{root}/dataset_*/*/run_*/{kind}.csv").select(F.input_file_name().alias("file"), F.regexp_replace("value", r"^\ufeff|\r$", "").alias("header"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line"))
    first = lines.where("at = 0").groupBy("file").agg(F.min_by("header", "line").alias("header"))
    headers = first.where("header != ''").groupBy("header").agg(F.sort_array(F.collect_set("file")).alias("files")).orderBy(F.element_at("files", 1)).collect()
    if not headers:
        raise FileNotFoundError(f"no {kind}.csv under {root}")
    listed = spark.read.format("binaryFile").load(f"{root}/dataset_*/*/run_*/{kind}.csv").where("length > 0").select("path")
    read = {f.split(":", 1)[-1].replace("///", "/") for r in headers for f in r["files"]}
    lost = [r["path"] for r in listed.collect() if r["path"].split(":", 1)[-1].replace("///", "/") not in read]
    if lost:
        warnings.warn(f"not readable: {', '.join(sorted(lost))}", stacklevel=2)
    frames = [spark.read.option("ignoreCorruptFiles", "true").csv(r["files"], header=True, mode="PERMISSIVE") for r in headers]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_ref_sizes(spark: SparkSession, path: str) -> DataFrame:
    """A lookup of target sizes: bad rows are skipped, sizes rounded, keys and sizes positive, the last of repeated keys stays."""
    raw = spark.read.csv(path, header=True).withColumn("line", F.monotonically_increasing_id())
    number = lambda c: F.rint(F.expr(f"try_cast({c} AS DOUBLE)")).cast("int")
    rows = raw.select(number("dataset_idx").alias("dataset_idx"), number("run").alias("run"), number("target_fnum").alias("target_fnum"), "line")
    rows = rows.where("dataset_idx > 0 and run > 0 and target_fnum > 0")
    return rows.groupBy("dataset_idx", "run").agg(F.max_by("target_fnum", "line").alias("target_fnum"))


def require(frame: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in frame.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing")
    return frame


def numeric(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Columns cast to double, bad values null."""
    return frame.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in columns if c in frame.columns})


def write_csv(frame: DataFrame, path: str) -> bool:
    """Rows as CSV with a header; an empty frame writes nothing."""
    if frame.isEmpty():
        return False
    frame.write.mode("overwrite").csv(path, header=True)
    return True


def write_json(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def write_ids(frame: DataFrame, column: str, path: str) -> None:
    """Arrays of ids as lines of space-separated numbers."""
    frame.select(F.array_join(F.col(column).cast("array<string>"), " ").alias("value")).write.mode("overwrite").text(path)


def write_arrays(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").parquet(path)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def run_info(spark: SparkSession, info: dict) -> DataFrame:
    """One row of JSON with the settings of a run."""
    return spark.createDataFrame([(json.dumps(info, sort_keys=True),)], T.StructType([T.StructField("info", T.StringType())]))


def write_info(spark: SparkSession, info: dict, path: str) -> None:
    """info as one line of JSON."""
    run_info(spark, info).write.mode("overwrite").text(path)

"""Scaling, splitting and sampling of labelled datasets.

Row numbers within a group never gather the group in one task: rows are counted
by (group, bucket of the order), the counts are summed up, and numbers within a
bucket are added to what lies before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEED = 42


def numbered(rows: DataFrame, groups: list[str], bucket: Column, order: list[Column]) -> DataFrame:
    """rows with rn (from 1) in their group by bucket, then order, and with n, the group's size."""
    rows = rows.withColumn("__b", bucket)
    counts = rows.groupBy(*groups, "__b").agg(F.count("*").alias("__c"))
    before = W.partitionBy(*groups).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0))).withColumn("n", F.sum("__c").over(W.partitionBy(*groups)))
    rn = F.row_number().over(W.partitionBy(*groups, "__b").orderBy(*order))
    return rows.withColumn("__rn", rn).join(counts, [*groups, "__b"]).withColumn("rn", F.col("__rn") + F.col("__before")).drop("__b", "__c", "__before", "__rn")


def _hash(seed: str, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def stratified_split(samples: DataFrame, share: float = 0.3, seed: int = SEED) -> DataFrame:
    """sample_id, label, split: the given share of each class is 'test', by a hash of seed and id."""
    rows = samples.select("sample_id", "label", _hash(str(seed), "sample_id").alias("__h"))
    rows = numbered(rows, ["label"], F.substring("__h", 1, 3), [F.col("__h"), F.col("sample_id")])
    test = F.col("rn") <= F.floor(F.lit(float(share)) * F.col("n") + 0.5)
    return rows.select("sample_id", "label", F.when(test, "test").otherwise("train").alias("split"))


def stratified_folds(samples: DataFrame, k: int = 5, seed: int = SEED) -> DataFrame:
    """sample_id, label, fold: folds of each class differ by one row at most."""
    rows = samples.select("sample_id", "label", _hash(f"{seed}:fold", "sample_id").alias("__h"))
    rows = numbered(rows, ["label"], F.substring("__h", 1, 3), [F.col("__h"), F.col("sample_id")])
    return rows.select("sample_id", "label", F.pmod(F.col("rn") - 1, F.lit(k)).cast("int").alias("fold"))


def contiguous_folds(samples: DataFrame, k: int = 5) -> DataFrame:
    """sample_id, fold: blocks of consecutive ids, the larger blocks first."""
    ends = samples.agg(F.min("sample_id"), F.max("sample_id")).first()
    low, high = ends[0] or 0, ends[1] or 0
    bucket = F.floor((F.col("sample_id") - low) * 4096.0 / (high - low + 1))
    rows = numbered(samples.select("sample_id", F.lit(0).alias("__g")), ["__g"], bucket, [F.col("sample_id")])
    i, size, more = F.col("rn") - 1, F.floor(F.col("n") / k), F.pmod("n", F.lit(k))
    large = more * (size + 1)
    fold = F.when(i < large, F.floor(i / (size + 1))).otherwise(more + F.floor((i - large) / F.greatest(size, F.lit(1))))
    return rows.select("sample_id", fold.cast("int").alias("fold"))


def weighted_sample(edges: DataFrame, group: str, weight: Column, size: Column, seed: int, key: list[str]) -> DataFrame:
    """Of each group so many rows without replacement, by weight: the least -ln(u) / weight, u hashed from seed and key."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in key))
    u = (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)
    rows = edges.withColumn("__k", F.when(weight > 0, -F.log(u) / weight)).where("__k is not null")
    rn = F.row_number().over(W.partitionBy(group).orderBy("__k", *key))
    return rows.withColumn("__rn", rn).where(F.col("__rn") <= size).drop("__k", "__rn")


# Scaling of long datasets (sample_id, label, fid, x).


def _fitted(long: DataFrame, fit: DataFrame, *aggregates: Column) -> DataFrame:
    return long.join(fit.groupBy("fid").agg(*aggregates), "fid")


def minmax(long: DataFrame, fit: DataFrame | None = None) -> DataFrame:
    """x to [0, 1] by feature; a constant feature becomes 0. fit defaults to all rows."""
    rows = _fitted(long, fit if fit is not None else long, F.min("x").alias("lo"), F.max("x").alias("hi"))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    return rows.select("sample_id", "label", "fid", ((F.col("x") - F.col("lo")) / span).alias("x"))


def zscore(long: DataFrame, fit: DataFrame | None = None) -> DataFrame:
    """x with mean 0 and population deviation 1 of fit; a constant feature is only centred."""
    rows = _fitted(long, fit if fit is not None else long, F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return rows.select("sample_id", "label", "fid", ((F.col("x") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).alias("x"))


def center(long: DataFrame) -> DataFrame:
    return _fitted(long, long, F.avg("x").alias("m")).select("sample_id", "label", "fid", (F.col("x") - F.col("m")).alias("x"))


def scale(long: DataFrame) -> DataFrame:
    """x by the sample deviation, not centred; a zero deviation counts as 1."""
    rows = _fitted(long, long, F.stddev_samp("x").alias("s"))
    return rows.select("sample_id", "label", "fid", (F.col("x") / F.when((F.col("s") == 0) | F.col("s").isNull(), 1.0).otherwise(F.col("s"))).alias("x"))


def center_scale(long: DataFrame) -> DataFrame:
    rows = _fitted(long, long, F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    return rows.select("sample_id", "label", "fid", ((F.col("x") - F.col("m")) / F.when((F.col("s") == 0) | F.col("s").isNull(), 1.0).otherwise(F.col("s"))).alias("x"))


def decorrelate(wide: DataFrame, whiten: bool = False, epsilon: float = 1e-12) -> DataFrame:
    """Features turned onto the covariance's eigenvectors by descending eigenvalue; whiten divides by sqrt(eigenvalue + epsilon).

    Each vector's sign is fixed so that its largest component is positive.
    """
    import numpy as np
    import pyarrow as pa

    from .stats import moments

    n, mean, gram = moments(wide)
    values, vectors = np.linalg.eigh(gram / max(1, n - 1) - np.outer(mean, mean) * n / max(1, n - 1))
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(len(values))])
    if whiten:
        vectors = vectors / np.sqrt(np.maximum(values, 0) + epsilon)
    shift = mean @ vectors

    def run(batches):
        for batch in batches:
            x = np.array(batch.column("features").to_pylist(), np.float64).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("sample_id"), batch.column("label"), pa.array(list(x @ vectors - shift), pa.list_(pa.float64()))], names=["sample_id", "label", "features"])

    rows = wide.select("sample_id", "label", "features")
    return rows.mapInArrow(run, rows.schema)


def shifted(long: DataFrame) -> DataFrame:
    """x, moved by its least value and 1e-9 where any is negative."""
    low = long.agg(F.min("x")).first()[0]
    return long.withColumn("x", F.col("x") - low + 1e-9) if low is not None and low < 0 else long


def subset(long: DataFrame, ids: list[int]) -> DataFrame:
    """Rows of the features ids."""
    return long.where(F.col("fid").isin([int(i) for i in ids]))


def check_finite(long: DataFrame) -> DataFrame:
    """long; reading it fails where x is null, NaN or infinite."""
    ok = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))
    return long.withColumn("x", F.when(F.assert_true(ok, "a value is not finite").isNull(), F.col("x")))


def project(wide: DataFrame, ids: list[int]) -> DataFrame:
    """Wide rows with the features ids, in that order."""
    return wide.select("sample_id", "label", F.transform(F.array(*(F.lit(int(i)) for i in ids)), lambda i: F.get("features", i)).alias("features"))


def check_dimension(ndim: int, p: int) -> int:
    if not 1 <= ndim <= p:
        raise ValueError(f"the dimension must be within 1 and {p}")
    return ndim


def _long(function):
    from ..sources.tables import melt, widen

    return lambda wide: widen(function(melt(wide)))


#: Preprocessing of wide datasets by name.
PREPROCESS = {
    "null": lambda wide: wide,
    "center": _long(center),
    "scale": _long(scale),
    "cscale": _long(center_scale),
    "decorrelate": decorrelate,
    "whiten": lambda wide: decorrelate(wide, whiten=True),
}


def preprocess(wide: DataFrame, name: str = "null") -> tuple[DataFrame, dict]:
    """The preprocessed dataset, and what was done."""
    if name not in PREPROCESS:
        raise ValueError(f"no preprocessing {name}")
    return PREPROCESS[name](wide), {"type": name}

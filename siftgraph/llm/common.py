"""Shared helpers: Arrow column access, checkpoints and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch. Whole texts travel in batches, so bytes bound
#: them; a longer text is a batch of its own. All operators set the same bounds, so
#: frames that are built before others run as they would alone.
BATCH_ROWS, BATCH_BYTES = 4096, 2 << 20
#: Rows of one key that a task takes without more ado; beyond, hot keys are split.
HOT_ROWS = 65_536
#: Ids up to which a list of them is broadcast (8 MB).
FEW_IDS = 1_000_000


def session(df: DataFrame) -> SparkSession:
    """The session of df, with Arrow batches bounded by bytes."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.sparkSession


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the reliable checkpoint folder and read from there.

    The folder comes from spark.checkpoint.dir. Where neither that nor the context
    names one, a local session (tests) gets a temporary folder and a cluster an error.
    """
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the reliable checkpoint folder and read from there."""
    path = f"{_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), off


def each_text(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each row of a string column; null is empty."""
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in columns.values()], names=list(columns))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) of the components that links a-b make; roots are left out."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        old = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        if np.array_equal(old, label):
            break
    member = label != np.arange(len(ids))
    return ids[member], ids[label[member]]


def hot_share(spark: SparkSession, total: int) -> int:
    """Rows from which on a key is hot: more than a partition's even share of all, and over HOT_ROWS.

    So there are fewer hot keys than partitions, and a list of them is small.
    """
    return max(HOT_ROWS, total // max(1, shuffle_partitions(spark)))


def split_join(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, how: str = "inner", salt: Column | None = None, counts: DataFrame | None = None) -> DataFrame:
    """left joined with right, which has one row for each key and, as `rows`, the number of left's rows with it.

    The rows of a hot key are dealt out over so many salts that each has an even
    share, and right's row for it is repeated for each salt. The column `rows` goes;
    it may also come from counts (key, rows), where right is dear to make.
    salt is a number that spreads the rows of a key. By default they are counted;
    then left must be read from files or a checkpoint, where a partition read again
    has the same rows in the same order.
    """
    share = hot_share(left.sparkSession, total)
    own = right.drop(rows) if counts is None else right
    if total <= share:
        return left.join(own, key, how)
    counts = right if counts is None else counts
    hot = checkpoint(counts.where(F.col(rows) > share).select(key, F.ceil(F.col(rows) / share).cast("long").alias("__salts")))  # under `partitions` rows
    if hot.isEmpty():
        return left.join(own, key, how)
    left = left.withColumn("__row", F.monotonically_increasing_id() if salt is None else salt).join(F.broadcast(hot), key, "left")
    left = left.withColumn("__salt", F.coalesce(F.pmod("__row", "__salts"), F.lit(0))).drop("__row", "__salts")
    own = own.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return left.join(own, [key, "__salt"], how).drop("__salt")


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Edges (a, b) with m, the least of a's neighbours b."""
    share = hot_share(edges.sparkSession, total)
    low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    if total <= share:
        return edges.join(low.drop("n"), "a")
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / share)).cast("long")
    hot = low.where(F.col("n") > share).select("a", salts.alias("salts"))
    dealt = edges.join(F.broadcast(hot), "a", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("b"), F.col("salts")), F.lit(0))).drop("salts")
    low = low.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("n")
    return dealt.join(low, ["a", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for links (a, b) of longs; the component is its smallest node.

    Alternating large-star and small-star rounds: each joins every node's edges
    with the minimum of its neighbourhood. The minimum is a partial aggregate, and
    a hub's edges (more than a partition's even share) meet it in many tasks, so no
    hub is gathered in one. The number of rounds is logarithmic in the longest
    chain; each round is checkpointed.
    """
    edges = checkpoint(edges.where("a != b").select("a", "b").distinct())
    before, total = None, edges.count()
    while True:
        both = edges.union(edges.select("b", "a")).distinct()
        own = _with_least(both, 2 * total).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = own.where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        joined = _with_least(down, 2 * total)
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        edges = checkpoint(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, total = now, now[0]
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def kept_rows(docs: DataFrame, seen: DataFrame, kept: DataFrame, keyed) -> DataFrame:
    """The rows of docs that kept names, one for each of its pairs (doc_id, key); key may be no column of docs.

    seen has (doc_id, key) of each row, and keyed(batches) adds the key to batches
    with a column text. Most ids have one key, and their rows are found by id; only rows
    whose id is null or has several keys get their key again. Of repeats of a
    pair the row of the smallest text stays, then that of the smallest hash.
    """
    mixed = checkpoint(seen.where("doc_id is not null").distinct().groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("d")))
    n = mixed.count()
    listed = F.broadcast(mixed) if n <= FEW_IDS else mixed
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    least = F.min_by("row", F.struct(F.coalesce(F.col("row.text"), F.lit("")).alias("t"), F.xxhash64("row").alias("h"))).alias("row")
    named = kept.select(F.col("doc_id").alias("d"), "key")
    plain = named.where("d is not null").select("d").distinct()
    plain = plain.join(listed, "d", "left_anti") if n else plain
    whole = rows.where("d is not null").select("d", "row").join(plain, "d").groupBy("d").agg(least).select("row")
    odd = rows.where("d is null")
    odd = odd.union(rows.join(listed, "d", "left_semi").select("d", "text", "row")) if n else odd
    marked = odd.mapInArrow(keyed, odd.select("d", "text", "row", F.lit(0).cast("long").alias("key")).schema)
    some = named.where("d is null")
    some = some.union(named.join(listed, "d", "left_semi")) if n else some
    rest = marked.join(some.select(F.col("d").alias("e"), F.col("key").alias("k")), F.col("d").eqNullSafe(F.col("e")) & (F.col("key") == F.col("k"))).groupBy("d", "key").agg(least).select("row")
    return whole.union(rest).select("row.*")

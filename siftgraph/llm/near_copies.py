"""Near copies by the Jaccard similarity of their word shingles, one document kept for each group.

Two documents link when the sets of their SHINGLE-word shingles have a Jaccard
similarity of THRESHOLD or more; groups are the components of these links. Pairs
are proposed in two ways, and every proposed pair is compared by its whole shingle
sets, so no link is a guess:

*   by simhash: links of its fingerprints over the same shingles, found through its
    vantage-point trees at its radius. These are the closest pairs only. At a
    similarity of 0.8 fingerprints differ in 10 of 64 bits or so, and at a radius that
    reaches such pairs the triangle inequality parts nothing;
*   by MinHash bands: ROWS minima of a set, BANDS times, where two sets at the
    threshold share no band with a probability of MISS at most (closer ones less).

Equal sets collapse to one class before. Buckets with the same members, which a
group makes in most of its bands, are compared once. A bucket of more than
BUCKET classes is dealt out by pairs of its blocks, so none is gathered in one
task and none is capped. Blocks emit spanning forests of their links;
components follow by star rounds (common.components).

Defined results: words are as in simhash; a text of SHINGLE words or fewer is
one shingle; null and empty texts have the empty set and are one class; very
long texts count whole, one set of hashes at a time; a null doc_id takes part but
is never the one kept unless its group has no other; rows that share a doc_id but
not a shingle set are documents of their own; of rows alike in both, that of the
smallest text stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, checkpoint, components, each_text, forest, kept_rows, longs, session, shuffle_partitions, split_join
from .simhash import hashes, near_links, of_hashes

SHINGLE, THRESHOLD, MISS = 5, 0.8, 1e-6
ROWS = 4
BANDS = math.ceil(math.log(MISS) / math.log1p(-(THRESHOLD**ROWS)))
#: Classes of a bucket that one task compares, and shingles whose incidence is held at once.
BUCKET, COLUMNS = 1024, 4096

_TURNS = np.random.default_rng(11).integers(0, 2**64, (ROWS * BANDS + ROWS + BANDS, 1), np.uint64) | np.uint64(1)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of UTF-8 bytes' shingles."""
    return np.unique(hashes(text, shingle))


def bands(set_: np.ndarray) -> np.ndarray:
    """The keys of a set's bands; none of the empty set."""
    if not len(set_):
        return np.zeros(0, np.int64)
    least = np.full(ROWS * BANDS, 2**64 - 1, np.uint64)
    for i in range(0, len(set_), 1024):
        np.minimum(least, (_TURNS[: ROWS * BANDS] * set_[None, i : i + 1024]).min(1), out=least)
    mixed = least.reshape(BANDS, ROWS)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _TURNS[ROWS * BANDS : ROWS * BANDS + ROWS, 0]
    key = mixed.sum(1, dtype=np.uint64) ^ _TURNS[-BANDS:, 0]
    return (key ^ (key >> np.uint64(31))).view(np.int64)


def _node(set_: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(set_.tobytes())


def _signed(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp, keys = (np.zeros(batch.num_rows, t) for t in (np.uint64, np.uint64, object))
            for i, x in enumerate(each_text(batch.column("text"))):
                found = hashes(x, shingle)
                set_ = np.unique(found)
                node[i], fp[i], keys[i] = _node(set_), of_hashes(found), bands(set_)
            yield batch_of(doc_id=batch.column("doc_id"), node=node.view(np.int64), fp=fp.view(np.int64), bands=pa.array(list(keys), pa.list_(pa.int64())))

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x, shingle) for x in each_text(batch.column("text"))]
            node = np.array([_node(s) for s in sets], np.uint64).view(np.int64)
            yield batch_of(node=node, shingles=pa.array([s.tobytes() for s in sets], pa.binary()))

    return run


def _keyed(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.array([_node(shingle_set(x, shingle)) for x in each_text(batch.column("text"))], np.uint64).view(np.int64)
            yield batch_of(d=batch.column("d"), text=batch.column("text"), row=batch.column("row"), key=key)

    return run


def linked(one: list[np.ndarray], two: list[np.ndarray], threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Places (in one, in two) of the sets whose Jaccard similarity is threshold or more."""
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (one, two)]
    flat = [np.concatenate(x) for x in (one, two)]
    names = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]))
    shared = np.zeros((len(one), len(two)), np.float32)
    # Only shingles of both sides count; their incidence is multiplied by parts.
    places = [np.minimum(np.searchsorted(names, f), max(0, len(names) - 1)) for f in flat]
    there = [(names[p] == f) if len(names) else np.zeros(len(f), bool) for p, f in zip(places, flat)]
    held = [(r[t], p[t]) for r, p, t in zip(rows, places, there)]
    for c in range(0, len(names), COLUMNS):
        parts = []
        for (r, p), n in zip(held, (len(one), len(two))):
            at = (p >= c) & (p < c + COLUMNS)
            part = np.zeros((n, min(COLUMNS, len(names) - c)), np.float32)
            part[r[at], p[at] - c] = 1
            parts.append(part)
        shared += parts[0] @ parts[1].T
    sizes = np.array([len(s) for s in one])[:, None] + np.array([len(s) for s in two])[None]
    both = shared.astype(np.float64)
    return np.nonzero((both > 0) & (both >= threshold * (sizes - both) - 1e-9))


def _links(threshold: float):
    """Rows sorted by bucket and blocks to forest edges a, b of the links in it; with sides, of those across them."""

    def settle(node: list, side: list, sets: list) -> Iterator[pa.RecordBatch]:
        node, side = np.array(node, np.int64), np.array(side)
        one, two = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        if len(node) < 2 or not len(one) or not len(two):
            return
        x, y = linked([sets[i] for i in one], [sets[i] for i in two], threshold)
        a, b = node[one[x]], node[two[y]]
        a, b = a[a != b], b[a != b]
        if len(a):
            a, b = forest(a, b)
            yield batch_of(a=a, b=b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, ([], [], [])
        for batch in batches:
            keys = zip(*(longs(batch, c).tolist() for c in ("key", "one", "two")))
            rows = zip(longs(batch, "node").tolist(), longs(batch, "side").tolist(), batch.column("shingles").to_pylist())
            for key, (node, side, set_) in zip(keys, rows):
                if key != last:
                    yield from settle(*held)
                    last, held = key, ([], [], [])
                held[0].append(node)
                held[1].append(side)
                held[2].append(np.frombuffer(set_, np.uint64))
        yield from settle(*held)

    return run


def _proposed(classes: DataFrame) -> DataFrame:
    """(node, least, key, blocks): buckets of two, the pairs whose fingerprints agree or are linked by simhash.

    Nodes with one fingerprint are proposed with the smallest of them, and that with those of linked fingerprints.
    """
    named = checkpoint(classes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    links = near_links(named.select("fp"))
    one, two = (named.select(F.col("fp").alias(c), F.col("first").alias(x)) for c, x in (("a", "x"), ("b", "y")))
    pairs = links.join(one, "a").join(two, "b").select("x", "y")
    same = split_join(classes.select("node", "fp"), named.where("n > 1"), "fp", "n", classes.count())
    pairs = pairs.union(same.where("node != first").select("first", "node"))
    pairs = pairs.select(F.xxhash64("x", "y").alias("key"), F.explode(F.array("x", "y")).alias("node"))
    return pairs.join(classes.select("node", "least"), "node").select("node", "least", "key", F.lit(1).cast("long").alias("blocks"))


def near_groups(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of each row, node naming its shingle set; and (node, set, least) of each node, its group and smallest doc_id."""
    spark = session(docs)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    signed = checkpoint(base.mapInArrow(_signed(shingle), "doc_id long, node long, fp long, bands array<long>"))
    classes = checkpoint(signed.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.first("bands").alias("bands")))
    entries = classes.select("node", "least", F.explode("bands").alias("key"))
    # Buckets of the same members differ in their keys only; one of them is compared.
    alike = entries.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    chosen = alike.where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")
    members = entries.join(chosen, "key").withColumn("blocks", F.ceil(F.col("n") / BUCKET)).select("node", "least", "key", "blocks")
    members = checkpoint(members.union(_proposed(classes)))
    # The sets are made again for the members only, from a row that has the class's smallest doc_id.
    some = members.select(F.col("least").alias("doc_id")).distinct()
    rows = base.join(some.where("doc_id is not null"), "doc_id", "left_semi")
    if not some.where("doc_id is null").isEmpty():
        rows = rows.union(base.where("doc_id is null"))
    sets = rows.mapInArrow(_sets(shingle), "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
    # Each member of a large bucket goes to the pairs of its block with every block; side 0 marks a block met with itself.
    dealt = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("long")
    dealt = dealt.select("key", "node", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), side.alias("side"))
    total = int(members.agg(F.sum("blocks")).first()[0] or 0)
    per = dealt.groupBy("node").agg(F.count("*").alias("m"))
    dealt = split_join(dealt, sets, "node", "m", total, salt=F.xxhash64("key", "one", "two"), counts=per)
    dealt = dealt.repartition(max(shuffle_partitions(spark), 2), "key", "one", "two").sortWithinPartitions("key", "one", "two")
    named = components(dealt.mapInArrow(_links(threshold), "a long, b long"))
    told = classes.select("node", "least").join(named, "node", "left").select("node", "least", F.coalesce("component", "node").alias("set"))
    return signed.select("doc_id", "node"), told


def keep_one(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents' rows, one for each group: that with the group's smallest doc_id; other texts under that doc_id stay if their own groups keep them."""
    signed, told = near_groups(docs, shingle, threshold)
    first = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("doc_id"), F.col("node").alias("key"))).alias("first")
    kept = checkpoint(told.groupBy("set").agg(first).select("first.doc_id", "first.key"))
    return kept_rows(docs, signed.select("doc_id", F.col("node").alias("key")), kept, _keyed(shingle))

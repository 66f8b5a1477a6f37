"""SimHash fingerprints and exact near-duplicate links by vantage-point partitions.

A fingerprint has a bit set where over half of a text's word shingles' hashes
have it. Fingerprints link at RADIUS or fewer differing bits. Distinct
fingerprints are dealt to the leaves of vantage-point trees: at a node a
fingerprint lies inside if its Hamming distance to the node's vantage point is
at most the node's threshold. By the triangle inequality two linked
fingerprints' distances to any point differ by their own distance at most, so a
pair that a node separates lies as near to its threshold: fingerprints just
outside visit the inside shard too, and from there on follow every branch that a
linked fingerprint could have taken. Each linked pair thus meets in the home
shard of one of its members, and no pair is lost.

Over all 64 bits a radius of 2 is a good part of the spread of distances, and
every level of a tree would add a third to the copies. So there is a tree for each of PARTS
parts of the bits, whose distances count that part only. Two fingerprints within
RADIUS bits are within RADIUS // PARTS bits in one part at least; that is the
radius of the trees' overlaps, 0 by default, so that each fingerprint is sent
PARTS times however many leaves there are. Inside a shard a vantage-point tree over
all bits goes on locally, with overlaps of RADIUS, down to small blocks that are
compared directly.

A shard emits a spanning forest of its links (each fingerprint with the smallest
of its local component), never all pairs; the forests' components follow by
star rounds (common.components).

Defined results: null and empty texts have no words and fingerprint zero, which
links like any other; very long texts are hashed whole, their bits counted in
parts; a null doc_id takes part but is never a component's name unless a component
has no other (then null); repeated rows each get a row; of tied bits (set in half
of the hashes) none is set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, checkpoint, components, each_text, forest, kept_rows, longs, session, shuffle_partitions, split_join

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Parts of the bits, each with a tree of its own.
PARTS = 3
#: Fingerprints that a shard should hold at home, the fewest levels of the tree and its bounded sample.
SHARD, LEVELS, SAMPLE = 1 << 18, 6, 1 << 14
#: Homes that are compared directly, and visitors that a shard takes at once.
BLOCK, VISITORS = 192, 1 << 19

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of UTF-8 bytes' shingles, repeats included: of the whole sequence of fewer words, none without words."""
    words = text.translate(_LOWER).split()  # bytes split at 09-0D and 20
    if not words:
        return np.zeros(0, "<u8")
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), SEED)], "<u8")
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return np.array([digest(x, SEED) for x in shingles], "<u8")


def of_hashes(found: np.ndarray) -> int:
    """The 64-bit fingerprint of shingles' hashes; 0 without any."""
    set_ = np.zeros(64, np.int64)
    for i in range(0, len(found), 1 << 14):
        set_ += np.unpackbits(found[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(set_ * 2 > len(found), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of UTF-8 bytes; 0 without words."""
    return of_hashes(hashes(text, shingle))


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.fromiter((fingerprint(x, shingle) for x in each_text(batch.column("text"))), np.uint64, batch.num_rows)
            yield batch_of(doc_id=batch.column("doc_id"), fp=out.view(np.int64))

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of each row."""
    session(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


class Tree:
    """A complete vantage-point tree over the bits of a mask, as arrays: node i has the children 2i+1 (inside) and 2i+2."""

    def __init__(self, sample: np.ndarray, levels: int, mask: int = 2**64 - 1, seed: int = 7):
        self.levels, self.mask = levels, np.uint64(mask)
        self.point = np.random.default_rng(seed).integers(0, 2**64, 2**levels - 1, np.uint64)
        self.edge = np.full(2**levels - 1, (mask.bit_count() - 1) // 2, np.int64)  # half of all bit strings lie within it or so
        parts = {0: sample}
        for i in range(2**levels - 1):
            part = parts.pop(i, sample[:0])
            if len(part) >= 8:
                self.point[i] = part[len(part) // 2]
                d = self.distance(part, self.point[i])
                self.edge[i] = int(np.median(d))
                if (d <= self.edge[i]).all():
                    self.edge[i] = max(0, int(d.max()) - 1)
                parts[2 * i + 1], parts[2 * i + 2] = part[d <= self.edge[i]], part[d > self.edge[i]]

    def distance(self, fp: np.ndarray, point: np.ndarray) -> np.ndarray:
        return np.bitwise_count((fp ^ point) & self.mask).astype(np.int64)

    def route(self, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in fp, leaves and whether at home there."""
        at, node, home = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.ones(len(fp), bool)
        for _ in range(self.levels):
            d = self.distance(fp[at], self.point[node])
            inside, outside = _sides(d, self.edge[node], home, radius)
            own_in, own_out = home & (d <= self.edge[node]), home & (d > self.edge[node])
            at, home, node = np.concatenate([at[inside], at[outside]]), np.concatenate([own_in[inside], own_out[outside]]), np.concatenate([2 * node[inside] + 1, 2 * node[outside] + 2])
        return at, node - (2**self.levels - 1), home


class Trees:
    """A tree for each part of the bits; leaves are numbered through."""

    def __init__(self, sample: np.ndarray, levels: int, parts: int = PARTS):
        cuts = [64 * k // parts for k in range(parts + 1)]
        self.trees = [Tree(sample, levels, (1 << b) - (1 << a), 7 + k) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]

    def route(self, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [t.route(fp, radius // len(self.trees)) for t in self.trees]
        leaves = [leaf + (k << t.levels) for k, (t, (_, leaf, _)) in enumerate(zip(self.trees, found))]
        return np.concatenate([f[0] for f in found]), np.concatenate(leaves), np.concatenate([f[2] for f in found])


def _sides(d, edge, home, radius):
    """Who goes inside and outside: a home to its own side and, from just outside, also in; a visitor wherever a linked home may be."""
    inside = np.where(home, d <= edge + radius, d <= edge + radius)
    outside = np.where(home, d > edge, d > edge - radius)
    return inside, outside


def links(fp: np.ndarray, home: np.ndarray, radius: int = RADIUS, own: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Links (a home, any) at 1 to radius differing bits by a local vantage-point tree; very many are thinned to a forest.

    Without own, links between homes are left out.
    """
    found_a, found_b = [], []
    held = 0
    stack = [(np.flatnonzero(home), np.flatnonzero(~home), 0)]
    while stack:
        h, v, depth = stack.pop()
        if not len(h) or not own and not len(v) or len(h) + len(v) < 2:
            continue
        if len(h) <= BLOCK or depth > 40:
            other = np.concatenate([h, v]) if own else v
            for i in range(0, len(h), BLOCK):
                block = h[i : i + BLOCK]
                for j in range(0, len(other), 8192):
                    d = np.bitwise_count(fp[block][:, None] ^ fp[other[j : j + 8192]][None])
                    x, y = np.nonzero((d <= radius) & (d > 0))
                    found_a.append(fp[block[x]])
                    found_b.append(fp[other[j + y]])
                    held += len(x)
            if held > 1 << 20:  # only the components matter from here on
                a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
                found_a, found_b, held = [a], [b], 0
            continue
        point = fp[h[(depth * 7919) % len(h)]]
        dh, dv = np.bitwise_count(fp[h] ^ point).astype(np.int64), np.bitwise_count(fp[v] ^ point).astype(np.int64)
        edge = int(np.median(dh))
        if (dh <= edge).all():
            edge = max(0, int(dh.max()) - 1)
        near = (dh > edge) & (dh <= edge + radius) & own
        stack.append((h[dh <= edge], np.concatenate([v[dv <= edge + radius], h[near]]), depth + 1))
        stack.append((h[dh > edge], v[dv > edge - radius], depth + 1))
    if not found_a:
        return fp[:0], fp[:0]
    return np.concatenate(found_a), np.concatenate(found_b)


def _route(tree: Trees, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = longs(batch, "fp").view(np.uint64)
            at, leaf, home = tree.route(fp, radius)
            yield batch_of(leaf=leaf, fp=fp[at].view(np.int64), home=home)

    return run


def _shards(radius: int):
    """Rows sorted by leaf, homes first, to forest edges a, b of each leaf's links. Memory holds a shard's homes and some visitors."""

    def settle(homes: np.ndarray, visitors: np.ndarray, own: bool) -> Iterator[pa.RecordBatch]:
        fp = np.concatenate([homes, visitors]).view(np.uint64)
        a, b = links(fp, np.arange(len(fp)) < len(homes), radius, own)
        if len(a):
            a, b = forest(a.view(np.int64), b.view(np.int64))
            yield batch_of(a=a, b=b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes: list[np.ndarray] = []
        visitors: list[np.ndarray] = []
        last, size, own = None, 0, True
        none = np.zeros(0, np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal visitors, size, own, homes
            if homes and (own or visitors):
                homes = [np.concatenate(homes)]
                yield from settle(homes[0], np.concatenate([none, *visitors]), own)
            visitors, size, own = [], 0, False

        for batch in batches:
            leaf, fp, home = longs(batch, "leaf"), longs(batch, "fp"), longs(batch, "home").astype(bool)
            cuts = [0, *(np.flatnonzero(np.diff(leaf)) + 1), len(leaf)]
            for i, j in zip(cuts, cuts[1:]):
                if j <= i:
                    continue
                if last is not None and leaf[i] != last:
                    yield from flush()
                    homes, own = [], True
                last = leaf[i]
                if home[i:j].any():
                    homes.append(fp[i:j][home[i:j]])
                if not home[i:j].all():
                    visitors.append(fp[i:j][~home[i:j]])
                    size += len(visitors[-1])
                    if size >= VISITORS:
                        yield from flush()
        yield from flush()

    return run


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Forest edges a, b (signed longs) over distinct fingerprints fp whose components are those of all links."""
    spark = session(distinct)
    n = distinct.count()
    levels = LEVELS
    while n >> levels > SHARD:
        levels += 1
    # A bounded sample, in the order of a hash, only shapes the trees; every fingerprint is routed.
    sample = distinct.orderBy(F.xxhash64("fp")).limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = Trees(sample, levels)
    routed = distinct.select("fp").mapInArrow(_route(tree, radius), "leaf long, fp long, home boolean")
    return routed.repartition(max(shuffle_partitions(spark), 2), "leaf").sortWithinPartitions("leaf", F.desc("home")).mapInArrow(_shards(radius), "a long, b long")


def _groups(docs: DataFrame, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of each row; and (fp, least, n, component) of each fingerprint: its smallest doc_id, its rows and its component's smallest fingerprint."""
    fps = checkpoint(fingerprints(docs, shingle))
    classes = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    named = components(near_links(classes.select("fp"), radius))
    return fps, classes.join(named.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable by links) of each row."""
    fps, classes = _groups(docs, shingle, radius)
    classes = checkpoint(classes)
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    told = split_join(classes, least, "component", "m", classes.count()).select("fp", "component_id", "n")
    return split_join(fps, told, "fp", "n", fps.count()).select("doc_id", "fp", "component_id")


def as_hex(fp) -> F.Column:
    """Sixteen lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents' rows, one for each component: that with the component's smallest doc_id.

    Rows that share a doc_id but not a fingerprint are documents of their own; of
    rows alike in both, that of the smallest text stays.
    """
    fps, classes = _groups(docs, shingle, radius)
    first = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("doc_id"), F.col("fp").alias("key"))).alias("first")
    kept = checkpoint(classes.groupBy("component").agg(first).select("first.doc_id", "first.key"))
    return kept_rows(docs, fps.select("doc_id", F.col("fp").alias("key")), kept, _keyed(shingle))


def _keyed(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.fromiter((fingerprint(x, shingle) for x in each_text(batch.column("text"))), np.uint64, batch.num_rows)
            yield batch_of(d=batch.column("d"), text=batch.column("text"), row=batch.column("row"), key=out.view(np.int64))

    return run

"""Near-duplicate embeddings by randomised-rotation binary codes.

Vectors are scaled to length one and turned by fixed random rotations. The signs
of the turned components are a vector's binary code; with the code a correction
factor is stored, the inner product of the code's first part (scaled to length one)
and the vector. For a code o and a vector q,

    <code of o, q> / correction of o

estimates <o, q> without bias, and its error exceeds
EPSILON * sqrt((1 / correction ** 2 - 1) / (dimension - 1)) with a probability
that falls as exp(-c * EPSILON ** 2). A pair whose upper bound stays under the
threshold from both sides is left; the others' cosine is recomputed exactly in
double precision.

Which pairs are estimated: two vectors at the threshold's angle differ in a sign
with probability p = angle / pi. Code bits are cut into tables of bands so that
linked vectors share no band with a probability of MISS at most (smaller for
closer vectors); the bands lengthen with the logarithm of the number of vectors,
so buckets stay small. Equal vectors collapse to one class before, with their
number; a pair counts in the first table where its bands agree.

What moves: codes and factors are made once and stored. Buckets gather codes
only, and leave the members of pairs whose codes differ in no more bits than linked
vectors' codes do (with a probability of MISS at most they differ in more). Only
these members' vectors are fetched, to the same buckets, for estimates and exact
cosines. A bucket of more than BUCKET classes is dealt out by pairs of its blocks,
so none is gathered in one task and none is capped.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows whose label is null, link with nothing and name their own
component; vectors of different lengths do not link; very long vectors are coded
by batches of few; copies of a row count as other vectors; a cosine that ties with
the threshold links; classes whose smallest vec_id agrees are one node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, checkpoint, components, forest, session, shuffle_partitions, split_join

THRESHOLD, MISS, EPSILON = 0.98, 1e-6, 4.5
BUCKET, AIM = 4096, 96
#: Large buckets up to whose number a list of them is broadcast (some MB).
FEW_BUCKETS = 100_000


def rotation(dimension: int, which: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([dimension, which]).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


class Coder:
    """Codes of vectors of one length: bits by rotation, as many as the tables' bands need and one rotation at least."""

    def __init__(self, dimension: int, bits: int, tables: int):
        self.dimension, self.bits, self.tables = dimension, bits, tables
        self.turns = np.concatenate([rotation(dimension, k) for k in range(-(-bits * tables // dimension))])
        self.words = -(-len(self.turns) // 64)

    def code(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each code, correction factors, and bands."""
        turned = unit @ self.turns.T
        signs = turned > 0
        weights = np.int64(1) << np.arange(self.bits, dtype=np.int64)
        bands = signs[:, : self.bits * self.tables].reshape(len(unit), self.tables, self.bits) @ weights
        packed = np.zeros((len(unit), self.words * 8), np.uint8)
        flat = np.packbits(signs, axis=1, bitorder="little")
        packed[:, : flat.shape[1]] = flat
        return packed.view("<u8"), np.abs(turned[:, : self.dimension]).sum(1) / math.sqrt(self.dimension), bands

    def signs(self, words: np.ndarray) -> np.ndarray:
        """The first part of codes as vectors of length one."""
        bits = np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")[:, : self.dimension]
        return (2.0 * bits - 1) / math.sqrt(self.dimension)

    def upper(self, words: np.ndarray, correction: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Upper confidence bounds of the inner products of coded vectors (rows) with other vectors of length one (columns)."""
        estimate = self.signs(words) @ (others @ self.turns[: self.dimension].T).T / correction[:, None]
        width = EPSILON * np.sqrt(np.maximum(0, 1 / correction**2 - 1) / max(1, self.dimension - 1))
        return estimate + width[:, None]

    def masks(self) -> np.ndarray:
        """For each table the words with its band's bits set."""
        out = np.zeros((self.tables, self.words * 64), np.uint8)
        for t in range(self.tables):
            out[t, t * self.bits : (t + 1) * self.bits] = 1
        return np.packbits(out, axis=1, bitorder="little").view("<u8")

    def most(self, threshold: float, miss: float) -> int:
        """Differing bits that linked vectors' codes exceed with a probability of miss at most."""
        n, p = len(self.turns), math.acos(max(-1.0, min(1.0, threshold))) / math.pi
        if not 0 < p < 1:
            return 0 if p <= 0 else n
        log = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(n + 1)]
        tail = 0.0
        for k in range(n, -1, -1):
            tail += math.exp(log[k])
            if tail > miss:
                return k
        return 0


def plan(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits of a band and number of tables for at most n classes of one label."""
    p = math.acos(threshold) / math.pi
    bits = max(4, min(40, math.ceil(math.log2(max(2, n / AIM)))))
    return bits, math.ceil(math.log(miss) / math.log1p(-((1 - p) ** bits)))


def _matrix(column: pa.Array) -> list[np.ndarray]:
    return [np.array(x.as_py(), np.float64) for x in column]


def _coded(bits: int, tables: int):
    """Classes with d (the length), code (words as bytes), factor and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders: dict[int, Coder] = {}
        for batch in batches:
            rows = _matrix(batch.column("v"))
            sizes = np.array([len(x) for x in rows])
            codes, factors, bands = [b""] * len(rows), np.zeros(len(rows)), [None] * len(rows)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x = np.stack([rows[i] for i in at])
                coder = coders.setdefault(int(d), Coder(int(d), bits, tables))
                words, factors[at], own = coder.code(x / np.linalg.norm(x, axis=1)[:, None])
                for i, w, b in zip(at, words, own):
                    codes[i], bands[i] = w.tobytes(), b
            yield batch_of(node=batch.column("node"), label=batch.column("label"), size=batch.column("size"), d=sizes, code=pa.array(codes, pa.binary()), factor=factors, bands=pa.array(bands, pa.list_(pa.int64())))

    return run


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Members of either block, and whether pairs are across them."""
    return np.flatnonzero(side != 2), np.flatnonzero(side != 1), bool((side != 0).any())


def _first(coder: Coder, masks: np.ndarray, table: int, words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether so many pairs' bands agree in no table before this one."""
    out = np.ones(len(i), bool)
    differ = words[i] ^ words[j]
    for t in range(table):
        out &= (differ & masks[t]).any(1)
    return out


def _alike(bits: int, tables: int, threshold: float, miss: float):
    """Rows of a bucket (and pair of blocks) to the members of pairs that their codes leave."""

    def settle(key, node, side, codes, coders) -> pa.RecordBatch | None:
        if len(node) < 2:
            return None
        coder, masks, most = coders.setdefault(key[3], _tools(key[3], bits, tables, threshold, miss))
        words = np.frombuffer(b"".join(codes), "<u8").reshape(len(node), -1)
        one, two, across = _sides(np.array(side))
        found = np.zeros(len(node), bool)
        for a in range(0, len(one), 512):
            i = one[a : a + 512]
            for b in range(0, len(two), 4096):
                j = two[b : b + 4096]
                if not across and i[0] > j[-1]:
                    continue
                differ = np.zeros((len(i), len(j)), np.uint16)
                for w in range(words.shape[1]):
                    differ += np.bitwise_count(words[i, w][:, None] ^ words[j, w][None])
                x, y = np.nonzero(differ <= most)
                x, y = i[x], j[y]
                if not across:
                    x, y = x[x < y], y[x < y]
                for c in range(0, len(x), 1 << 18):
                    p, q = x[c : c + (1 << 18)], y[c : c + (1 << 18)]
                    new = _first(coder, masks, key[0], words, p, q)
                    found[p[new]] = found[q[new]] = True
        at = np.flatnonzero(found)
        if not len(at):
            return None
        n = len(at)
        return batch_of(t=np.full(n, key[0], np.int64), band=np.full(n, key[1], np.int64), label=pa.array([key[2]] * n, pa.string()), d=np.full(n, key[3], np.int64), node=np.array(node, np.int64)[at])

    return _by_key(("node", "side", "code"), settle)


def _tools(d: int, bits: int, tables: int, threshold: float, miss: float) -> tuple[Coder, np.ndarray, int]:
    coder = Coder(d, bits, tables)
    return coder, coder.masks(), coder.most(threshold, miss)


def _by_key(columns: tuple[str, ...], settle):
    """Rows sorted by bucket (and blocks), handed to settle key by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools: dict = {}
        key, held = None, tuple([] for _ in columns)
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("t", "band", "label", "d", "one", "two")))
            rows = zip(*(_matrix(batch.column(c)) if c == "v" else batch.column(c).to_pylist() for c in columns))
            for k, row in zip(keys, rows):
                if k != key:
                    if key is not None and (out := settle(key, *held, tools)) is not None:
                        yield out
                    key, held = k, tuple([] for _ in columns)
                for x, v in zip(held, row):
                    x.append(v)
        if key is not None and (out := settle(key, *held, tools)) is not None:
            yield out

    return run


def _linked(bits: int, tables: int, threshold: float, miss: float):
    """Rows of a bucket (and pair of blocks) to node, links and root of the members that link in it."""

    def settle(key, node, size, side, codes, factors, vectors, coders) -> pa.RecordBatch | None:
        if len(node) < 2:
            return None
        coder, masks, _ = coders.setdefault(key[3], _tools(key[3], bits, tables, threshold, miss))
        node, size, factor = np.array(node), np.array(size), np.array(factors)
        words = np.frombuffer(b"".join(codes), "<u8").reshape(len(node), -1)
        unit = np.stack(vectors)
        unit = unit / np.linalg.norm(unit, axis=1)[:, None]
        one, two, across = _sides(np.array(side))
        count = np.zeros(len(node), np.int64)
        member, root = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a in range(0, len(one), 1024):
            for b in range(0, len(two), 1024):
                i, j = one[a : a + 1024], two[b : b + 1024]
                if not across and i[0] > j[-1]:
                    continue
                bound = np.minimum(coder.upper(words[i], factor[i], unit[j]), coder.upper(words[j], factor[j], unit[i]).T)
                x, y = np.nonzero(bound >= threshold)
                x, y = i[x], j[y]
                if not across:
                    x, y = x[x < y], y[x < y]
                for c in range(0, len(x), 1 << 16):
                    p, q = x[c : c + (1 << 16)], y[c : c + (1 << 16)]
                    keep = np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold
                    p, q = p[keep], q[keep]
                    keep = _first(coder, masks, key[0], words, p, q)
                    p, q = p[keep], q[keep]
                    np.add.at(count, p, size[q])
                    np.add.at(count, q, size[p])
                    member, root = forest(np.concatenate([member, node[p]]), np.concatenate([root, node[q]]))  # only components matter
        some = np.flatnonzero(count)
        if not len(some):
            return None
        roots = dict(zip(member.tolist(), root.tolist()))
        return batch_of(node=node[some], links=count[some], root=np.array([roots.get(x, x) for x in node[some].tolist()], np.int64))

    return _by_key(("node", "size", "side", "code", "factor", "v"), settle)


_BUCKET = ["t", "band", "label", "d"]


def _dealt(entries: DataFrame, n: int) -> DataFrame:
    """entries (bucket, node, ...) by bucket, and those of large buckets by the pairs of their blocks, with one, two and side."""
    large = entries.groupBy(*_BUCKET).count().where(F.col("count") > BUCKET).withColumn("blocks", F.ceil(F.col("count") / BUCKET)).drop("count")
    large = checkpoint(large)
    many = large.count()
    if not many:  # so entries move once
        zero = F.lit(0).cast("long")
        entries = entries.withColumns({"one": zero, "two": zero, "side": zero})
        return entries.repartition(n, *_BUCKET, "one", "two").sortWithinPartitions(*_BUCKET, "one", "two")
    entries = entries.join(F.broadcast(large) if many <= FEW_BUCKETS else large, _BUCKET, "left")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    # Each member of a large bucket goes to the pairs of its block with every block; side 0 marks a block met with itself.
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    entries = entries.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", other)
    entries = entries.withColumn("one", F.least("own", "other")).withColumn("two", F.greatest("own", "other"))
    entries = entries.withColumn("side", F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("long"))
    return entries.drop("own", "other", "blocks").repartition(n, *_BUCKET, "one", "two").sortWithinPartitions(*_BUCKET, "one", "two")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row (see the module)."""
    spark = session(vectors)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    valid = F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    base = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(valid, F.xxhash64("label", "embedding")).alias("k1"),
        F.when(valid, F.hash("embedding", "label")).alias("k2"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").alias("v"),
    )
    classes = base.where("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"), F.min_by("label", "label").alias("label"), F.first("v").alias("v"))
    classes = checkpoint(classes.withColumn("node", F.coalesce("least", F.lit(-1) - F.abs(F.col("k1") % F.lit(2**60)))))
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan(most, threshold, miss)
    n = shuffle_partitions(spark)
    columns = classes.select("node", "label", "size", "v")
    stored = checkpoint(columns.mapInArrow(_coded(bits, tables), "node long, label string, size long, d long, code binary, factor double, bands array<long>"))
    entries = stored.select(F.posexplode("bands").alias("t", "band"), "label", "d", "node", "code").withColumn("t", F.col("t").cast("long"))
    alike = checkpoint(_dealt(entries, n).mapInArrow(_alike(bits, tables, threshold, miss), "t long, band long, label string, d long, node long").distinct())
    # Only members of pairs that the codes leave fetch their vectors.
    fetched = alike.join(stored.select("node", "size", "code", "factor"), "node").join(classes.select("node", "v"), "node")
    found = checkpoint(_dealt(fetched, n).mapInArrow(_linked(bits, tables, threshold, miss), "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    told = classes.select("k1", "k2", "node", "least", "size").join(links, "node", "left").join(named, "node", "left")
    told = checkpoint(told.select("k1", "k2", "least", "size", F.coalesce("component", "node").alias("set"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")))
    least = told.groupBy("set").agg(F.min("least").alias("component"), F.count("*").alias("m"))
    told = split_join(told, least, "set", "m", told.count()).withColumn("key", F.struct("k1", "k2")).select("key", "n_links", "component", "size")
    rows = base.select("vec_id", "k1", F.when(F.col("k1").isNotNull(), F.struct("k1", "k2")).alias("key"))
    out = split_join(rows, told, "key", "size", rows.count(), "left", salt=F.xxhash64("vec_id"))
    component = F.when(F.col("k1").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: The same in DuckDB by comparing all pairs of a label.
ORACLE = f"""
WITH RECURSIVE whole AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
), usable AS (
  SELECT vec_id, label, e, list_inner_product(e, e) AS q FROM whole WHERE isfinite(list_inner_product(e, e)) AND list_inner_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id != b.vec_id
  WHERE list_inner_product(a.e, b.e) / (sqrt(a.q) * sqrt(b.q)) >= {THRESHOLD}
), reach(v, c) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.a, r.c FROM reach r JOIN links l ON l.b = r.v
), named AS (
  SELECT v, min(c) AS c FROM reach GROUP BY v
), counted AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN named ON v = vec_id LEFT JOIN counted ON a = vec_id
"""

"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is target weight * documents / its documents. A
document's number of copies is the inverse of the Poisson distribution with that
mean at a uniform number hashed from seed, doc_id, text and, where rows are alike
in both, the row's number among them; so every row has a draw of its own, which
does not depend on partitions or retries. Each document is exploded by its count and
the copies are put in the order of another hash over all of them.

By default the target weight of a source is proportional to the number of its
documents to the power TEMPERATURE; other weights are given by source.

Defined results: a null source is a source of its own, apart from the empty name;
null doc_ids and texts are hashed as empty strings; very long texts are hashed
whole; repeated rows have draws of their own (which of two alike rows gets which
draw does not matter), and so no shuffle key is tied by a shared id; sources
without a weight get none (null sources are weighed under None); an empty table
gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, shuffle_partitions, split_join

SEED, TEMPERATURE = 17, 0.5
#: Bytes of the sources' tables up to which they are broadcast; beyond, they are joined, hot sources split.
BROADCAST = 32 << 20
#: Alike rows up to whose number of kinds a list of them is broadcast (24 MB).
FEW, BUCKETS = 1_000_000, 256


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of seed and parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


def _first(rate: Column) -> Column:
    """The count at which the table of a rate begins; below it nothing is left that 52 bits tell."""
    return F.when(rate > 500, F.floor(rate - 12 * F.sqrt(rate))).otherwise(0).cast("long")


def _limits(rate: Column) -> Column:
    """The distribution function of a Poisson distribution from _first(rate) on, as far as 52 bits tell."""
    k = _first(rate).cast("double")
    factorial = k * F.log(k) - k + 0.5 * F.log(2 * math.pi * k) + 1 / (12 * k) - 1 / (360 * k * k * k)  # its logarithm
    mass = F.when(rate > 500, F.exp(k * F.log(rate) - rate - factorial)).otherwise(F.exp(-rate))
    more = F.sequence(_first(rate) + 1, (rate + 12 * F.sqrt(rate) + 40).cast("long"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k.cast("double")
        return F.struct(F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"), p.alias("p"))

    return F.aggregate(more, F.struct(F.array(mass).alias("c"), mass.alias("p")), step)["c"]


def _source(source: Column) -> Column:
    """A name of the source that tells null from the empty name."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """source, documents and the mean repetition rate of each source."""
    counts = docs.groupBy("source").agg(F.count("*").alias("documents"))
    if weights is None:
        weight = F.pow(F.col("documents").cast("double"), F.lit(float(temperature)))
    else:
        known = F.create_map(*(F.lit(x) for s, w in weights.items() for x in ("" if s is None else f"={s}", float(w)))) if weights else F.create_map().cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(known, _source(F.col("source"))), F.lit(0.0))
    counts = counts.withColumn("weight", weight)
    weights_sum, documents = counts.agg(F.sum("weight"), F.sum("documents").cast("double")).first()
    rate = F.col("weight") / F.lit(weights_sum) * F.lit(documents) / F.col("documents") if weights_sum else F.lit(0.0)
    return counts.select("source", "documents", rate.alias("rate"))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, ...) with number: 0, or from 0 on among rows alike in doc_id and text.

    Only hashes are counted to find alike rows. Where there are none, no text moves.
    Alike rows are counted by BUCKETS first, so none of their kinds meets in one task.
    """
    kind = [F.xxhash64("id", "text"), F.xxhash64("text", "id", F.lit(1))]
    alike = rows.select(kind[0].alias("k1"), kind[1].alias("k2")).groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    alike = checkpoint(alike)
    kinds = alike.count()
    if not kinds:
        return rows.withColumn("number", F.lit(0).cast("long"))
    alike = alike.withColumn("again", F.lit(True))
    found = rows.withColumn("k1", kind[0]).withColumn("k2", kind[1]).join(F.broadcast(alike) if kinds <= FEW else alike, ["k1", "k2"], "left")
    once = found.where("again is null").drop("k1", "k2", "again").withColumn("number", F.lit(0).cast("long"))
    again = checkpoint(found.where("again").drop("again").withColumn("bucket", F.pmod(F.monotonically_increasing_id(), F.lit(BUCKETS))))
    sizes = again.groupBy("k1", "k2", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("k1", "k2").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("k1", "k2", "bucket", before.alias("before"))
    place = F.row_number().over(W.partitionBy("k1", "k2", "bucket").orderBy(F.lit(0))) - 1
    numbered = again.withColumn("place", place).join(sizes, ["k1", "k2", "bucket"])
    return once.union(numbered.withColumn("number", (F.col("place") + F.col("before")).cast("long")).select(*once.columns))


def _copies(docs: DataFrame, weights: dict[str | None, float] | None, seed: int, temperature: float) -> DataFrame:
    """(row, n_copies, copy, shuffle_key): each row as a struct, so none of its columns can clash."""
    own = F.col("rate")
    found = rates(docs.select("source"), weights, temperature)
    cells = F.sum(F.when(own > 500, 24 * F.sqrt(own) + 41).otherwise(own + 12 * F.sqrt(own) + 41))
    size, total = found.agg(8 * cells, F.sum("documents")).first()
    limits = found.select(_source(F.col("source")).alias("__source"), "documents", _limits(own).alias("limits"), "rate")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        _source(F.col("source")).alias("__source"),
    )
    rows = _numbered(rows)
    # From here on a row goes by what its draw is hashed from.
    rows = rows.select("row", "__source", F.concat_ws(":", "id", F.md5(F.col("text").cast("binary")), F.col("number").cast("string")).alias("id"))
    if (size or 0) <= BROADCAST:
        joined = rows.join(F.broadcast(limits.drop("documents")), "__source")  # checked: BROADCAST bytes at most
    else:
        joined = split_join(rows, limits, "__source", "documents", int(total or 0), salt=F.xxhash64("id"))
    u = uniform(seed, F.col("id"))
    count = F.when(own > 0, _first(own) + F.size(F.filter("limits", lambda x: x < u))).otherwise(0).cast("long")
    copies = joined.select("row", "id", count.alias("n_copies")).where("n_copies > 0")
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1)))
    key = F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed} order"), "id", F.col("copy").cast("string")).cast("binary")), 1, 16)
    # A uniform key: every copy lands in a random partition and at a random place there.
    copies = copies.select("row", "n_copies", "copy", key.alias("shuffle_key"))
    return copies.repartition(shuffle_partitions(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key")


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED, temperature: float = TEMPERATURE) -> DataFrame:
    """The documents' columns, n_copies, copy (from 0) and shuffle_key, in the order of the key.

    Columns of docs named like the three added ones are left out.
    """
    docs = docs.drop("n_copies", "copy", "shuffle_key")
    return _copies(docs, weights, seed, temperature).select("row.*", "n_copies", "copy", "shuffle_key")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED, temperature: float = TEMPERATURE) -> DataFrame:
    """The copies with the documents' own columns only, in the order of the key."""
    return _copies(docs, weights, seed, temperature).select("row.*")


#: The same in DuckDB for the default weights.
ORACLE = f"""
WITH counts AS (
  SELECT source AS s, count(*) AS documents, pow(count(*)::DOUBLE, {TEMPERATURE}) AS weight FROM documents GROUP BY 1
), rated AS (
  SELECT s, weight / (SELECT sum(weight) FROM counts) * (SELECT sum(documents) FROM counts)::DOUBLE / documents AS rate FROM counts
), places AS (
  SELECT s, rate, unnest(range(0, CAST(rate + 12 * sqrt(rate) + 41 AS BIGINT))) AS k FROM rated
), masses AS (
  SELECT s, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1.0)) AS p FROM places
), limits AS (
  SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS c FROM masses
), named AS (
  SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':' || (row_number() OVER (PARTITION BY doc_id, coalesce(text, '')) - 1) AS draw FROM documents
), hashed AS (
  SELECT *, (('0x' || substr(md5('{SEED}:' || draw), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM named
), counted AS (
  SELECT h.* EXCLUDE (u), (SELECT count(*) FROM limits l WHERE l.s IS NOT DISTINCT FROM h.source AND l.c < h.u)::BIGINT AS n_copies FROM hashed h
)
SELECT * EXCLUDE (draw), substr(md5('{SEED} order:' || draw || ':' || copy::VARCHAR), 1, 16) AS shuffle_key
FROM (SELECT *, unnest(range(0, n_copies)) AS copy FROM counted WHERE n_copies > 0)
"""

"""Near copies by Jaccard similarity against all pairs compared."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftgraph.llm import near_copies
from tests.llm.test_contracts import plain_fingerprint, roots, texts

STAGE = dict(corpus_pipeline.STAGES)["simhash near-dedup"]


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """The smallest doc_id of each group, from all pairs."""
    rows = sorted(rows)
    sets = [plain_shingles(t) for _, t in rows]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                links.append((i, j))
    return {rows[i][0] for i in set(roots(len(rows), links))}


def test_copies_beyond_two_bits_leave_one(spark, sf):
    words = [f"w{i * 7919 % 1000}" for i in range(127)]
    other = list(words)
    other[40], other[90] = "replaced", "too"
    one, two = " ".join(words), " ".join(other)
    assert (plain_fingerprint(one) ^ plain_fingerprint(two)).bit_count() > 2
    rows = [(1, one), (2, two), (3, "apart from these"), (None, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in STAGE(spark, docs, sf).collect()) == [1, 3, 4]
    alone = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(r["text"] or "" for r in STAGE(spark, alone, sf).collect()) == ["", "apart from these", min(one, two)]


@pytest.mark.parametrize("bucket", [near_copies.BUCKET, 2])
def test_against_all_pairs(spark, sf, monkeypatch, bucket):
    monkeypatch.setattr(near_copies, "BUCKET", bucket)
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    left = [r["doc_id"] for r in STAGE(spark, docs, sf).collect()]
    assert len(left) == len(set(left)) and set(left) == plain_kept(texts(docs))

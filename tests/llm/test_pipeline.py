"""The pipeline's stages one by one against plain versions, on the smallest tables and on odd rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftgraph.llm import pieces, suffix_dedup, toxicity
from tests.llm.test_contracts import ODD, odd, plain_repeats, texts  # noqa: F401
from tests.llm.test_near_copies import plain_kept

STAGES = dict(corpus_pipeline.STAGES)


def test_stages_on_whole_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kinds = docs.dtypes
    one = STAGES["toxicity"](spark, docs, sf).cache()
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert {r["doc_id"] for r in one.collect()} == {d for d, s in scores.items() if s < toxicity.CUT}

    two = STAGES["simhash near-dedup"](spark, one, sf).cache()
    assert {r["doc_id"] for r in two.collect()} == plain_kept(texts(one))

    three = STAGES["suffix-array dedup"](spark, two, sf).cache()
    plain = plain_repeats(texts(two), suffix_dedup.LENGTH)
    left = {r["doc_id"]: r for r in three.collect()}
    assert set(left) == set(plain)
    for d, (size, removed, _, _) in plain.items():
        assert 0 <= size - removed - len(left[d]["text"].encode()) <= 6 * (plain[d][2] + 1)  # parts of cut characters go
        assert left[d]["n_chars"] == len(left[d]["text"])

    four = STAGES["source mixing"](spark, three, sf).cache()
    assert {(r["doc_id"], r["text"]) for r in four.collect()} <= {(d, r["text"]) for d, r in left.items()}
    assert 0.7 * three.count() < four.count() < 1.3 * three.count()
    assert all(f.dtypes == kinds for f in (one, two, three, four))

    last = STAGES["sentencepiece encoding"](spark, four, sf)
    v = pieces.Vocabulary(*pieces.read_model())
    assert sorted((r["doc_id"], v.decode(r["ids"])) for r in last.collect()) == sorted((r["doc_id"], r["text"]) for r in four.collect())
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, last.collect()))


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_odd_rows(spark, sf, odd, name):  # noqa: F811
    out = STAGES[name](spark, odd, sf)
    assert out.count() <= 3 * len(ODD)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == odd.columns
        assert STAGES[name](spark, odd.limit(0), sf).count() == 0
    assert STAGES[name](spark, odd.withColumn("text", F.lit(None).cast("string")), sf).count() <= 3 * len(ODD)

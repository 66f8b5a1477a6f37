"""What the pipeline's worker processes hold."""

import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from siftgraph.llm import pieces, suffix_dedup


def test_workers_stay_small(spark):
    """Encoding held two workers with a vocabulary for each task, and the suffix stage 100 MB a worker: with what was kept, the pipeline took over 3000 MB of an executor."""
    rows = [(1, "a plain text with ünïcode"), (2, ""), (3, None), (4, "one\u2581two  \n three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.encode_pieces(spark, docs, "")
    vocabulary = pieces.Vocabulary(*pieces.read_model())
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = pieces.encode(docs, vocabulary)
    want = {r["doc_id"]: (r["ids"], len(r["ids"]), [x["score"] for x in r["nbest"]]) for r in want.collect()}
    back = {r["doc_id"]: r["decoded"] == (dict(rows)[r["doc_id"]] or "") for r in pieces.decode(pieces.encode(docs, vocabulary), vocabulary).collect()}
    assert {r["doc_id"]: (r["ids"], r["n_pieces"], r["nbest_scores"]) for r in out.collect()} == want
    assert {r["doc_id"]: r["round_trip"] for r in out.collect()} == back and all(back.values())

    rng = np.random.default_rng(1)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 26, 100_000)) for _ in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(texts)], names=["doc", "text"])
    tracemalloc.start()
    found = sum(x.num_rows for x in suffix_dedup._map_runs(suffix_dedup.LENGTH, suffix_dedup.GRAM, np.zeros(0, np.int64))(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found > 20 and peak < 60e6

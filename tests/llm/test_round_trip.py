"""The pipeline's last stage decodes what it encodes."""

import corpus_pipeline
from tests.llm.test_contracts import odd  # noqa: F401


def test_last_stage_takes_the_round_trip(spark, sf, odd):  # noqa: F811
    rows = corpus_pipeline.encode_pieces(spark, odd, sf).collect()
    assert rows and all(r["round_trip"] is True for r in rows)
    assert all(r["ids"] is not None and len(r["ids"]) == r["n_pieces"] for r in rows)

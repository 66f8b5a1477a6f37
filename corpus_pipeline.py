"""A training corpus from documents: five operators in a row.

Each stage takes (spark, docs, sf_dir) and returns the documents that it leaves,
with the columns of documents; the last returns token ids. A stage's result is
written before the next reads it, so a lost executor costs a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgraph.llm import mixing, near_copies, pieces, suffix_dedup, toxicity
from siftgraph.llm.common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the cut."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard similarity of five-word shingles 0.8 or more), that with the smallest doc_id."""
    return near_copies.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the bytes of strings that stand earlier in the corpus; a document may be left empty."""
    rows = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))
    left = suffix_dedup.remove_repeats(rows, keep_text=True, others=("row",))
    own = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return left.select(*(own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, repeated at their sources' rates and shuffled."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str = pieces.MODEL) -> DataFrame:
    """doc_id, ids of the best segmentation, n_pieces, the N best scores, and whether decoding the ids gives the text back."""
    return pieces.coded(docs, pieces.Vocabulary(*pieces.read_model(model)))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("source mixing", mix_sources),
    ("sentencepiece encoding", encode_pieces),
]

#: Learned scores, component search and a lattice search are not SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs

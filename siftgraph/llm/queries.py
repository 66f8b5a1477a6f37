"""Queries over the whole tables, one for each operator: QUERIES and ORACLES by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, mixing, pieces
from .embed_dedup import ORACLE as VECTORS
from .embed_dedup import near_vectors
from .langid import identify
from .license_scan import scan_licenses
from .matroska import digest, media_column
from .simhash import as_hex, near_components
from .suffix_dedup import remove_repeats
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(media_column(_table(spark, sf_dir, "documents")))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.format_conversations(chat.with_probe(_table(spark, sf_dir, "conversations"))))


def op8_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(_table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model: str = pieces.MODEL) -> DataFrame:
    return pieces.digest(_table(spark, sf_dir, "documents"), pieces.Vocabulary(*pieces.read_model(model)))


def op10_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_language_id": op3_language_id,
    "op4_license_scan": op4_license_scan,
    "op5_matroska": op5_matroska,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_poisson_mixing": op8_poisson_mixing,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_embed_dedup": op10_embed_dedup,
}

ORACLES: dict[str, str] = {
    "op7_chat_format": chat.ORACLE,
    "op8_poisson_mixing": mixing.ORACLE,
    "op10_embed_dedup": VECTORS,
}

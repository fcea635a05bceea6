"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .chat import format_chats, read_back
from .common import work_dir
from .decontam import find_overlaps
from .jaccard import similarity_components
from .langid import identify, learn_profiles
from .linededup import dedup_documents
from .quality_rules import apply_quality_rules
from .secret_scan import scan_secrets, secret_report
from .sharding import shard_ring
from .spm import Pieces, encode_documents
from .warc import read_archives, write_archives

#: A public SentencePiece model file; any model with identity normalisation serves.
TOKENIZER = os.environ.get("ASSAYFLOW_SPM_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_quality_rules(table(spark, sf_dir, "documents"), with_text=False)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(scan_secrets(table(spark, sf_dir, "documents")))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(format_chats(rows, pieces=Pieces.load(TOKENIZER)))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn_profiles(docs))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_documents(docs, report=True).select("doc_id", "n_lines", "n_removed", "text")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), Pieces.load(TOKENIZER))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_ring(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{work_dir(spark)}/archives"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_quality_rules, op2_secret_scan, op3_chat_formatting, op4_language_id, op5_line_dedup, op6_sentencepiece,
        op7_decontamination, op8_sharding, op9_ngram_jaccard, op10_warc,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """The other queries' results depend on a ring's hashes, a tokenizer, or sampled profiles that SQL lacks;
    tests/llm holds them against plain Python."""
    return {
        "op1_quality_rules": oracles.QUALITY,
        "op2_secret_scan": oracles.SECRETS,
        "op5_line_dedup": oracles.LINE_DEDUP,
        "op7_decontamination": oracles.OVERLAPS,
        "op9_ngram_jaccard": oracles.JACCARD,
        "op10_warc": oracles.WARC,
    }

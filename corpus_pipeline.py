"""The corpus pipeline: documents in, token ids out.

Language ID, line dedup, near-duplicate join, benchmark decontamination, SentencePiece encoding.
Each stage works on all rows that the one before kept; all but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.llm.common import fresh, remove, stored, work_dir
from assayflow.llm.decontam import decontaminate
from assayflow.llm.jaccard import similarity_components
from assayflow.llm.langid import keep_identified, learn_profiles
from assayflow.llm.linededup import dedup_documents
from assayflow.llm.queries import TOKENIZER
from assayflow.llm.spm import Pieces, encode_documents


#: Languages to keep; None: all that the corpus teaches.
LANGS: tuple[str, ...] | None = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or far from every language's profile, go; lang becomes the language
    found. Null and blank texts go; repeated rows are judged each on their own; an empty table gives
    an empty one; further columns stay."""
    return keep_identified(docs, learn_profiles(docs), langs=LANGS, label_col="lang")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are cut; n_chars, where there is such a column, follows the
    text. Documents that lose all their text go; null texts stay; repeated rows get the same text; an
    empty table gives an empty one; further columns stay."""
    out = dedup_documents(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.where("text is null or text != ''")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one stays: that with the least id (null ids last), then the least hash
    of the row; of rows equal in all columns, one. Rows without words are in no group and stay. An empty
    table gives an empty one; further columns stay."""
    row = fresh(docs, "row_hash")
    hashed = docs.withColumn(row, F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(row).alias("h"))
    found = similarity_components(hashed.select(key.alias("key"), "text"), id_col="key")
    found = found.select(F.col("doc_id.id").alias("i"), F.col("doc_id.h").alias("h"), (F.col("doc_id") == F.col("component_id")).alias("first"), "n_shingles")
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col(row) == F.col("h"))
    kept = hashed.join(found.where(~F.col("first")).select("i", "h").distinct(), same, "left_anti")
    # Rows equal in all columns are all first: what is left of such a row is one.
    twice = found.where("first and n_shingles > 0").groupBy("i", "h").count().where("count > 1").select("i", "h")
    once = kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", row]))
    return once.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go, rows told apart by id and text. Null texts stay; an empty
    table, or benchmark, drops nothing; further columns stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row's text; null for null. Repeated rows are encoded each on their own; further columns
    go."""
    return encode_documents(docs, Pieces.load(TOKENIZER)).select("doc_id", "n_ids", "ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Profiles, spaced seeds and the Viterbi search are no SQL; tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's table goes when the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{work_dir(spark)}/{name}"
        docs = stored(stage(spark, docs, sf_dir), path)
        if before:
            remove(spark, before)
        before = path
    return docs

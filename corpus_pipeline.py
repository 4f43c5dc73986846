"""From raw documents to token ids: a chain of stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.llm import decontaminate, near_dups, pieces, quality, suffix_dups
from gistmill.llm.blobs import text_size
from gistmill.session import FILE_BYTES, few_files, scratch_path

#: Of a document's words; one that holds more of benchmark items goes as a whole.
MOST_HIT = 0.5


def _kept(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of the ids in `kept` (id), with all their columns."""
    return docs.join(kept.select(F.col("id").alias("_id")).distinct(), F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")), "left_semi")


def _in_few_files(left: DataFrame, docs: DataFrame) -> DataFrame:
    """What a shuffle has left of `docs`, in as few files as their text needs; the next stages have as many tasks."""
    return few_files(left, text_size(docs), FILE_BYTES)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject. Verdicts are on rows: of one id, texts are judged one by one."""
    return quality.keep_good(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8), the document with the least id stays; documents without an id stay too."""
    groups = near_dups.near_duplicates(docs)
    return _in_few_files(_kept(docs, groups.where("id is null or id = component_id")), docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes strings of 200 bytes that are there again out of the texts, at all their places. Bytes that are left of a broken character go too."""
    return _in_few_files(suffix_dups.without_repeats(docs), docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of benchmark items out of the texts; a document of which they are more than half goes as a whole."""
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), MOST_HIT)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text: doc_id, n_tokens, ids, round_trip."""
    return pieces.round_trips(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dup_stage),
    ("suffix_dedup", repeats_stage),
    ("decontamination", benchmark_stage),
    ("sentencepiece", pieces_stage),
]

#: Signatures, suffix buckets and tokenizers are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

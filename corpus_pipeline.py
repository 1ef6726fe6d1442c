"""A training corpus from raw documents: quality, near-duplicates, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.llm.common import Scratch, crc_of_id
from trialloom.llm.packing import place_pieces, tokenised_pieces
from trialloom.llm.quality import keep_quality
from trialloom.llm.queries import tokenizer_file
from trialloom.llm.secrets import redact_secrets
from trialloom.llm.shingle_dedup import drop_similar


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled rows that op7 learns from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_quality(docs, labels, crc_of_id(F.col("doc_id")) % 5 != 0, threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest id.

    Documents are near-duplicates whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Candidates come
    from op9's trees over fingerprints first, what they cannot reach from shared shingles."""
    return drop_similar(docs, width=5, similarity=0.8)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; n_chars follows the text."""
    clean = redact_secrets(docs, mark="[SECRET]")
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    pieces = tokenised_pieces(docs, tokenizer_file(), capacity=2048)
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return place_pieces(digest, capacity=2048, order=("doc_id", "piece", "ids_crc32"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: SQL can express none of the stages' models, links or token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs

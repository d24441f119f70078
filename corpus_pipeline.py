"""Cleaning pipeline over ``documents``: toxicity, line dedup, near-dedup, benchmark decontamination, and
SentencePiece encoding. Each stage works on what its predecessor kept, and each is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, prepare, table
from tessera.llm.decontaminate import keep_uncontaminated
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.near_copies import keep_one_near
from tessera.llm.sentencepiece_codec import encode_documents
from tessera.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in one document each; text and n_chars change with them."""
    prepare(spark)
    held = {c: f"__held_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    kept = dedup_lines(docs.withColumnsRenamed(held))
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return kept.select(*[(new[c] if c in new else F.col(held.get(c, c))).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 or more of 5-word shingles) stays, the one with the
    smallest doc_id."""
    prepare(spark)
    return keep_one_near(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    prepare(spark)
    return keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and whether they decode to its text and equal the sentencepiece library's."""
    prepare(spark)
    encoded = encode_documents(docs.select("doc_id", "lang", "source", "text"))
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip", "parity")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

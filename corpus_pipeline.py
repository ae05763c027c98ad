"""The corpus pipeline: documents through five training-data operators, each stage's result written and read again.

Every stage but the last returns the columns of ``documents``; a text that a
stage changes has its new length in n_chars.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._shared import Tables, keep, table
from plumbline.llm.decontamination import contaminated_removed
from plumbline.llm.jaccard_join import near_duplicates_removed
from plumbline.llm.quality_rules import clean_documents
from plumbline.llm.sentencepiece_codec import encode_pieces
from plumbline.llm.substring_dedup import dedup_substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject, and without the lines of the others that many documents of their source have."""
    cleaned = clean_documents(docs.select(COLUMNS))
    return cleaned.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest id."""
    return near_duplicates_removed(docs.select(COLUMNS)).select(COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the words of windows that a document with a smaller id has; documents that keep no word go."""
    found = dedup_substrings(docs.select(COLUMNS))
    kept = found.where((F.col("n_removed") < F.col("n_words")) | (F.col("n_words") == 0))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    return contaminated_removed(docs.select(COLUMNS), table(spark, sf_dir, "benchmark", "item_id", "text"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    encoded = encode_pieces(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), ids=False, digests=True)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", encoding),
]

#: SQL cannot express the last stage's ids; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Tables(spark) as tables:
        for _, stage in STAGES[:-1]:
            before, docs = docs, tables.keep(stage(spark, docs, sf_dir))
            if id(before) in tables.paths:
                tables.drop(before)
        return keep(STAGES[-1][1](spark, docs, sf_dir))

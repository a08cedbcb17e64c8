"""A corpus pipeline over `documents`: five stages, each an operator of quillstone.llm.

A stage takes what its predecessor kept and returns a DataFrame; all but the last return the columns
of documents. `run` writes every stage's result to the shared folder and reads it back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import line_dedup, mixing, ngram_join, piece_fst, quality_rules
from quillstone.llm.common import Scratch
from quillstone.llm.vocabularies import default_path, vocabulary_bytes


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.apply_rules(docs, Scratch(spark, "stage-quality"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of near-equal lines stays; documents left without a word go."""
    return line_dedup.apply_lines(docs, Scratch(spark, "stage-lines"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays, the one with the least doc_id."""
    return ngram_join.apply_join(docs, Scratch(spark, "stage-ngrams"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, or as far, as the mix of sources takes them."""
    return mixing.apply_mix(docs, Scratch(spark, "stage-mix"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with the proof that they decode to its text."""
    model = vocabulary_bytes(default_path("piece_bpe_32k.model"))
    return piece_fst.encode_documents(docs, model, with_text=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mixture),
    ("SentencePiece encoding", pieces),
]

#: Expectation-maximisation, MinHash and the piece model can't be said in SQL; tests/llm holds the
#: stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)

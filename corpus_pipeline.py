"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last
give rows of ``docs`` with their columns as they were. ``run`` writes the result
of each stage to the shared folder and reads it again for the next one.

Rows with nulls, empty texts or repeated rows go through the stages by the rules
of their operators: quality rules reject texts under 50 words (so null and empty
ones), repeated rows are exact copies of which one stays, and an empty table
gives an empty table. Texts are read whole; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recsmith.llm import decontam, langid, minhash, packing, quality_rules
from recsmith.llm.common import materialize, read_table
from recsmith.llm.queries import word_bpe_path

#: Least mean probability of the language that wins; texts under it go.
LEAST_LANGUAGE_SCORE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled ones."""
    return quality_rules.keep(docs, read_table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network, trained on labelled ones of
    them, tells with enough certainty."""
    return docs.filter(langid.accepted(F.col("text"), langid.fit(docs), LEAST_LANGUAGE_SCORE))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return minhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed into sequences."""
    return packing.pack(docs, word_bpe_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: Trained networks and token ids are not SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus from raw documents to packed training sequences.

Quality rules reject documents, copies and near copies leave one document of each group, sources are
mixed to their weights, and what remains is packed into sequences. Every stage is written as Parquet
and the next one reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelens.llm import exact, mixing, near_text, packing, quality, token_counts
from capturelens.llm.work import written
from capturelens.llm.wordpieces import public_path

TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on the labels of the table folder, does not reject. Texts without
    words (null, empty) are judged by statistics of 0; repeated rows go or stay together; without labels that tell
    good from bad nothing is learnt, and the one score decides. No rows give no rows."""
    labels = spark.read.parquet(f"{str(sf_dir).rstrip('/')}/labels.parquet")
    return quality.drop_rejected(docs, labels)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest id; null is an empty text, a null id stays
    only where all ids of its text are null, rows equal in id and text stay together. No rows give no rows."""
    return exact.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 on shingles of five words. Texts without words are
    linked with nothing; of rows that share an id one stays. No rows give no rows."""
    return near_text.drop_near_copies(docs, words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their weights: rows repeat for every pass the mix makes over them. Texts without words cost nothing
    and stay once, a null source is a source, repeated ids are rows of their own. No rows give no rows."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each row lies in the packed sequences, counted in tokens and an end id. A row without
    text is an end id; repeated rows are packed one by one; no rows give no sequences."""
    return packing.pack(token_counts.token_lengths(docs, public_path(TOKENIZER)), F.col("length"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_rules),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# A fitted model and random paths cannot be said in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of the table folder."""
    docs = spark.read.parquet(f"{str(sf_dir).rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

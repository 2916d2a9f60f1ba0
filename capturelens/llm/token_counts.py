"""Token counts of texts through a cache of counts by content digest.

The cache is a Parquet folder of (tokenizer, digest, n_tokens). Texts whose (tokenizer, digest) it
holds are not encoded; of the rest each distinct text is encoded once and appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import new_folder, written
from .wordpieces import encoder

CACHE = "tokenizer string, digest binary, n_tokens bigint"


def unchanged(text: Column) -> Column:
    """The default normal form: null is empty, nothing else changes, so counts are the library's own."""
    return F.coalesce(text, F.lit(""))


def version_of(path: str) -> str:
    """Digest of a tokenizer file: another file, another version."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def read_cache(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """``digest, n_tokens`` known for one tokenizer version; a digest stored twice counts once."""
    try:
        stored = spark.read.schema(CACHE).parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = spark.createDataFrame([], CACHE)
    return stored.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def counter(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            counts = [len(ids) // 4 for ids in encode.packed(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return count


def lengths(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            counts = [len(ids) // 4 + 1 for ids in encode.packed(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "length"])

    return count


def token_lengths(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, length`` per row, written once: the tokens of its whole text and an end id.

    Rows are encoded where they are, without a shuffle or a cache by digest, so a text that many rows
    share stays spread; each distinct word of a task is encoded once. Null texts count as empty
    (length 1); null and repeated ids keep a row each.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return written(rows.mapInArrow(lengths(tokenizer), f"doc_id {kind}, length bigint"), "lengths")


def count_tokens(
    docs: DataFrame, tokenizer: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    limit: int = 2048, normal: Callable[[Column], Column] = unchanged,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row, and the cache folder grown by what was missing.

    Null texts count as empty (0 tokens); null and repeated ids keep a row each; other columns are not
    looked at, whatever their names. Without ``cache`` a new folder in the shared checkpoint folder is
    used. A copy of a text, however frequent, is encoded once: copies meet by digest, first inside each
    task. Texts are not cut.
    """
    spark = docs.sparkSession
    cache = cache or new_folder(spark, "token-counts")
    version = version_of(tokenizer)
    text = normal(F.col(text_col))
    keyed = docs.select(
        F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    known = read_cache(spark, cache, version)
    distinct = keyed.select("digest", "text").dropDuplicates(["digest"])
    missing = distinct.join(known, "digest", "left_anti").select("digest", "text")
    fresh = missing.mapInArrow(counter(tokenizer), "digest binary, n_tokens bigint")
    fresh.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    sizes = keyed.select("doc_id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes"))
    return sizes.join(read_cache(spark, cache, version), "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )

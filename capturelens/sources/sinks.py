"""Sinks of a study: fixed-column CSV, records, upserts, write-once lists, manifests, reports.

A table that is read and rewritten consists of buckets by key. A new version of a bucket is written
to a folder of its own; the table is what its log of versions names last for each bucket, and one
append to the log makes all buckets of a batch count at once. A job that is stopped anywhere leaves
the old table or the new one.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import fill_cell


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """CSV with exactly these columns: others are dropped, absent ones are blank."""
    have = set(df.columns)
    cols = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns]
    df.select(*cols).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def write_records(df: DataFrame, path: str, key: str) -> None:
    """Nested JSON, one directory per key."""
    df.write.mode("overwrite").partitionBy(key).json(path)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows whose key is not in the batch, followed by the batch."""
    batch = new.select(*keys).distinct()
    return old.join(batch, list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def keep_existing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the batch; those that exist keep what the old table says of them."""
    wanted = new.select(*keys).distinct()
    kept = old.join(wanted, list(keys), "left_semi")
    fresh = new.join(old.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


LOG = "bucket int, buckets int, version bigint, folder string"
BUCKETS = 32
BUCKET = "_bucket"


def stored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The files at a path; None where nothing was written yet."""
    try:
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def table_log(spark: SparkSession, path: str) -> list[Row]:
    """The newest version of every bucket of a table."""
    log = stored(spark, f"{path}/log", LOG)
    if log is None:
        return []
    newest = F.max_by(F.struct("buckets", "version", "folder"), F.col("version")).alias("_v")
    return log.groupBy("bucket").agg(newest).select("bucket", "_v.*").collect()  # one row a bucket


def read_buckets(spark: SparkSession, path: str, log: Sequence[Row]) -> DataFrame:
    parts = [f"{path}/{r['folder']}/{BUCKET}={r['bucket']}" for r in log]
    return spark.read.option("mergeSchema", True).parquet(*parts)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A table of buckets as its log has it; None where there is none yet."""
    log = table_log(spark, path)
    return read_buckets(spark, path, log) if log else None


def upsert_table(
    new: DataFrame, path: str, keys: Sequence[str], version: str | None = None, buckets: int = BUCKETS,
) -> None:
    """Upsert a batch into a table of buckets; only buckets with keys of the batch are written anew.

    With a ``version`` column the row of the highest version stays, so a batch that arrives again, or
    late, changes nothing. One writer at a time.
    """
    spark = new.sparkSession
    log = table_log(spark, path)
    buckets = log[0]["buckets"] if log else buckets
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    touched = [r[BUCKET] for r in new.select(bucket.alias(BUCKET)).distinct().collect()]
    if not touched:
        return
    old_parts = [r for r in log if r["bucket"] in touched]
    merged = new
    if old_parts:
        old = read_buckets(spark, path, old_parts)
        merged = upsert(old, new, keys) if version is None else newest_rows(
            old.unionByName(new, allowMissingColumns=True), keys, version)
    folder = f"data-{uuid.uuid4().hex}"
    merged.withColumn(BUCKET, bucket).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/{folder}")
    number = 1 + max((r["version"] for r in log), default=0)
    rows = [(b, buckets, number, folder) for b in touched]
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")


def newest_rows(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row of the highest version of each key; the largest row of equal versions."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(version), F.struct(*rest)))
    return rows.groupBy(*keys).agg(best.alias("_r")).select(*[F.col(k) for k in keys], "_r.*").select(*rows.columns)


def append_new(new: DataFrame, path: str, keys: Sequence[str], order: str | None = None) -> None:
    """Append rows whose key the table does not have; accepted keys never change.

    Of rows with the same key in a batch the first in ``order`` counts (the smallest row without it).
    One writer at a time.
    """
    rest = [c for c in new.columns if c not in keys]
    first_of = F.struct(*([F.col(order)] if order else []), *[F.col(c) for c in rest])
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), first_of).alias("_r"))
    first = first.select(*[F.col(k) for k in keys], "_r.*").select(*new.columns)
    old = stored(new.sparkSession, path)
    if old is not None:
        first = first.join(old.select(*keys).distinct(), list(keys), "left_anti")
    first.write.mode("append").parquet(path)


def write_once(df: DataFrame, path: str) -> str:
    """Write a list that never changes afterwards.

    Returns ``written`` the first time, ``same`` for equal content, ``different`` when the content
    differs: it then goes to ``<path>.rerun`` and the committed list stays.
    """
    old = stored(df.sparkSession, path)
    if old is None:
        df.write.parquet(path)
        return "written"
    if old.exceptAll(df).isEmpty() and df.exceptAll(old).isEmpty():
        return "same"
    df.write.mode("overwrite").parquet(f"{path}.rerun")
    return "different"


def describe(path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Description of the first rule whose pattern matches; a path without one is an error."""
    text = F.raise_error(F.concat(F.lit("no description for "), path))
    for pattern, words in reversed(rules):
        text = F.when(path.rlike(pattern), words).otherwise(text)
    return text


def manifest(spark: SparkSession, root: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Path, size, checksum and description of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + root.rstrip("/") + "/", "")
    return files.select(
        rel.alias("path"), F.col("length").alias("size_bytes"), F.md5("content").alias("md5"),
        describe(rel, rules).alias("content"),
    )


def manifest_of(rows: DataFrame, path: Column, content: Column, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """The same manifest for contents held in a table."""
    return rows.select(
        path.alias("path"), F.octet_length(content).cast("bigint").alias("size_bytes"),
        F.md5(content.cast("binary")).alias("md5"), describe(path, rules).alias("content"),
    )


def report_lines(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Report rows as delimited text; a cell with a bar or a line break is an error."""
    cells = [fill_cell(F.col(c)) for c in columns]
    return rows.select("*", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def provenance(family: str, rows: DataFrame, keys: Column, run_dir: Column, job: Column, when: Column, empty: str = "") -> DataFrame:
    """Index rows of one family: where a table row comes from. A missing job reads ``empty``."""
    return rows.select(
        F.lit(family).alias("family"), keys.alias("row"), run_dir.alias("run_dir"),
        F.coalesce(F.nullif(job, F.lit("")), F.lit(empty)).alias("job"), F.date_format(when, "yyyy-MM-dd").alias("date"),
    )


def provenance_of_files(spark: SparkSession, root: str, pattern: str, names: Sequence[str], schema: str, family: str) -> DataFrame:
    """The index of record files: keys from the path, date from the file's modification time."""
    records = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root, multiLine=True)
    meta = F.col("_metadata.file_path")
    keyed = records.withColumns({
        **{n: F.regexp_extract(meta, pattern, i + 1) for i, n in enumerate(names)},
        "_dir": F.regexp_replace(meta, r"/[^/]+$", "/"), "_when": F.col("_metadata.file_modification_time"),
    })
    return provenance(family, keyed, F.concat_ws(" | ", *names), F.col("_dir"), F.col("job"), F.col("_when"))

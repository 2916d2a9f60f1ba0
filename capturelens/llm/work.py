"""Helpers of this folder: written intermediate tables, running totals, linked components.

Intermediate tables are Parquet files below the shared checkpoint folder of the session, so a lost
executor costs a rerun of its tasks only and values that depend on how rows were dealt (range
numbers) are fixed once they are written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
EDGES_PER_BLOCK = 200_000
READ_TASKS = 20_000


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a folder that does not exist yet, below the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base.removeprefix("file:")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_store(uri: str):
    """The file system of a URI as executors open it, and the path inside it."""
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """The frame written as Parquet (to a new shared folder unless one is given) and read again."""
    folder = folder or new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def task_a_file(manifest: DataFrame) -> DataFrame:
    """The rows of a manifest, one a task; more than ``READ_TASKS`` rows are dealt evenly over that many tasks.

    The number is given, so that the engine does not merge the few bytes of a manifest into one task; the rows, a
    name and some numbers for each file, are dealt in turn from one task, so that each file gets its own.
    """
    return manifest.coalesce(1).repartition(max(1, min(READ_TASKS, manifest.count())))


def hash_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hashes of the keys; few more than that are ever moved."""
    spread = 2**40
    below = min(spread, int(spread * 1.3 * rows / max(1, df.count())) + 1)
    place = F.pmod(F.xxhash64(*keys), F.lit(spread))
    return df.withColumn("_place", place).where(F.col("_place") < below).orderBy("_place", *keys).limit(rows).drop("_place")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("bigint")


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of the keys of two frames."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


def running_totals(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, into: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the same ``by`` that come before in ``order``.

    Rows are dealt by ranges of (by, order), so a group of any size is spread over many tasks; the
    ranges are written with their numbers, and totals cross ranges on one row per (by, range).
    Null keys form a group of their own; rows equal in all order columns come in any order.
    """
    part, start = "_range", "_start"
    keys = [*by, part]
    ranged = written(
        df.repartitionByRange(*[F.col(c) for c in [*by, *order]]).withColumn(part, F.spark_partition_id()), "ranges"
    )
    before = (Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    across = Window.partitionBy(*by).orderBy(part).rowsBetween(*before)
    starts = sums.select(*keys, F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias(start))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*before)
    rows = ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(starts, same(rows, starts, keys)).select(
        *[rows[c] for c in df.columns], (rows["_inside"] + starts[start]).alias(into)
    )


class Forest:
    """Disjoint sets over any ids; the smallest id of a set is its root."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        top = up.setdefault(x, x)
        while up[top] != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def join(self, a, b) -> bool:
        """True when two sets became one."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (a, b) of one task as (member, root) edges of the sets they form."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
    pairs = [(x, r) for x in list(forest.up) if (r := forest.root(x)) != x]
    if pairs:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``member, root`` for every vertex of the edges (a, b) but the roots; a root is the smallest id.

    Blocks of a fixed number of edges become stars where they are; then every vertex and its
    neighbours move to the smallest id seen, large neighbours first, then small ones, until nothing
    changes. The number of edges never grows and no vertex gathers its neighbours in one buffer.
    """
    clean = written(edges.select("a", "b").where("a <> b"), "edges")
    blocks = 1 + clean.count() // EDGES_PER_BLOCK
    stars = written(clean.repartition(blocks).mapInArrow(local_stars, "a bigint, b bigint"), "stars")
    if blocks == 1:  # the sets of all edges are already whole
        return stars.select(F.col("a").alias("member"), F.col("b").alias("root"))
    known = content(stars)
    while True:
        large = star(stars.union(stars.select("b", "a")), F.col("v") > F.col("u"))
        small = star(large.select(F.greatest("a", "b"), F.least("a", "b")), F.lit(True))
        stars = written(small.distinct(), "stars")
        before, known = known, content(stars)
        if before == known:
            return stars.select(F.col("a").alias("member"), F.col("b").alias("root"))


def content(edges: DataFrame) -> tuple:
    """Number and two digests of a set of edges."""
    digests = [F.bit_xor(F.xxhash64("a", "b", F.lit(i))) for i in range(2)]
    return tuple(edges.agg(F.count(F.lit(1)), *digests).first())


def star(edges: DataFrame, moved: Column) -> DataFrame:
    """One step: neighbours v of u for which ``moved`` holds, and u itself, point to the least of them."""
    edges = edges.toDF("u", "v")
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = edges.where(moved).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.union(least.select("u", "m")).where("a <> b")

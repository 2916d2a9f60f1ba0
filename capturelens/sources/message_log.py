"""A message log in chunks with statistics: scans open only the chunks that can hold what is asked for.

Chunks are Parquet files of a range of time each; an index beside them holds the first and last time and the
topics of every chunk. The source takes comparisons of the time column and equality or lists of the topic
column from the optimizer and drops chunks by the index before any of them is opened.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.pandas.types import to_arrow_schema

CHUNK_ROWS = 200_000
FORMAT = "chunked_log"


def write_chunks(messages: DataFrame, path: str, t: str, topic: str, chunks: int) -> None:
    """Writes the messages as about so many chunks by ranges of ``t``, and their index. Topics are few."""
    messages.repartitionByRange(chunks, t).sortWithinPartitions(t).write.parquet(f"{path}/chunks")
    kept = messages.sparkSession.read.schema(messages.schema).parquet(f"{path}/chunks")
    kept.select("_metadata.file_path", t, topic).groupBy("file_path").agg(
        F.min(t).alias("first"), F.max(t).alias("last"), F.array_sort(F.collect_set(topic)).alias("topics"),
        F.count_if(F.col(t).isNull()).alias("untimed"), F.count_if(F.col(topic).isNull()).alias("untitled"),
    ).coalesce(1).write.parquet(f"{path}/index")


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, as the executors open it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote("/" + uri.removeprefix("file:").lstrip("/"))
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


@dataclass
class Chunk(InputPartition):
    file: str


class ChunkReader(DataSourceReader):
    def __init__(self, schema: pa.Schema, path: str, t: str, topic: str):
        self.schema, self.path, self.t, self.topic = schema, path, t, topic
        self.low = self.high = None
        self.topics: set | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Notes what the index can decide; all filters stay for the rows of the chunks that are left."""
        for f in filters:
            match f:
                case GreaterThan((self.t,), v) | GreaterThanOrEqual((self.t,), v):
                    self.low = v if self.low is None else max(self.low, v)
                case LessThan((self.t,), v) | LessThanOrEqual((self.t,), v):
                    self.high = v if self.high is None else min(self.high, v)
                case EqualTo((self.topic,), v):
                    self.topics = {v} if self.topics is None else self.topics & {v}
                case In((self.topic,), vs):
                    self.topics = set(vs) if self.topics is None else self.topics & set(vs)
            yield f

    def chunk_fits(self, first, last, topics: list) -> bool:
        """Whether a chunk can hold a row for which all noted filters hold; null times and topics hold for none."""
        def plain(v):
            return v.astimezone(timezone.utc).replace(tzinfo=None) if isinstance(v, datetime) and v.tzinfo else v

        if self.low is not None and (last is None or plain(last) < plain(self.low)):
            return False
        if self.high is not None and (first is None or plain(first) > plain(self.high)):
            return False
        return self.topics is None or not self.topics.isdisjoint(topics)

    def partitions(self) -> list[InputPartition]:
        system, place = opened(f"{self.path}/index")
        rows = ds.dataset(place, filesystem=system, format="parquet").to_table().to_pylist()
        return [Chunk(r["file_path"]) for r in sorted(rows, key=lambda r: r["file_path"]) if self.chunk_fits(r["first"], r["last"], r["topics"])]

    def read(self, partition: Chunk | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no chunk is left
            return
        system, place = opened(partition.file)
        with system.open_input_file(place) as f:
            for batch in pq.ParquetFile(f).iter_batches():
                yield from pa.Table.from_batches([batch]).select(self.schema.names).cast(self.schema).to_batches()


class ChunkedLog(DataSource):
    """Options: ``path``, ``time`` and ``topic`` (names of columns); the schema is that of the messages."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(to_arrow_schema(schema), self.options["path"], self.options["time"], self.options["topic"])


def scan_chunks(spark: SparkSession, path: str, schema, t: str, topic: str) -> DataFrame:
    """The messages of a chunked log; filters on time and topic drop chunks unopened. Each chunk left is a task."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkedLog)
    return spark.read.format(FORMAT).schema(schema).option("path", path).option("time", t).option("topic", topic).load()

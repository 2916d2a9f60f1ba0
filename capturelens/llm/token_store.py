"""Token ids in binary shards, each document compressed alone with a shared trained dictionary.

A shard is ``magic, version, bytes of an id, dictionary hash``, one zstandard frame for each document,
then the index of (id, null flag, offset, size, tokens) and its place. The dictionary is a file of its
own, named by its hash. Writers stream to files of fresh names and report them; only the shards in the
written manifest count, so a task that runs twice does no harm.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .work import file_store, hash_sample, task_a_file
from .wordpieces import encoder

MAGIC, VERSION = b"CLTK", 1
HEAD = struct.Struct("<4sIB32s")
TAIL = struct.Struct("<QQ4s")
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("size", "<u8"), ("tokens", "<u8")])
MANIFEST = "part int, shard int, file string, n_docs bigint, n_tokens bigint, first_id bigint, last_id bigint, dictionary string"
SHARD_BYTES = 64 * 2**20
DICTIONARY_BYTES = 64 * 2**10
SAMPLE_DOCS = 1500
SAMPLE_CHARS = 20_000


def narrow(ids: bytes, width: int) -> bytes:
    wide = np.frombuffer(ids, "<u4")
    if width < 4 and len(wide) and int(wide.max()) >> 8 * width:
        raise ValueError(f"an id does not fit into {width} bytes")
    return wide.astype(f"<u{width}").tobytes()


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the samples themselves as its content where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples)[:size]).ljust(8, b"\0")


def learn_dictionary(rows: DataFrame, tokenizer: str, end_id: int, width: int) -> bytes:
    """From the whole id arrays of ``SAMPLE_DOCS`` rows chosen by hash, without those of more than
    ``SAMPLE_CHARS`` characters."""
    picked = hash_sample(rows, SAMPLE_DOCS, "doc_id").where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [narrow(x + struct.pack("<I", end_id), width) for x in encoder(tokenizer).packed(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    return train_dictionary([bytes(r["ids"]) for r in picked.mapInArrow(encode, "ids binary").collect()])


class ShardWriter:
    """One shard file under a name of its own."""

    def __init__(self, store, folder: str, digest: bytes, width: int):
        self.name = f"shard-{uuid.uuid4().hex}.cltk"
        self.out = store.open_output_stream(f"{folder}/{self.name}")
        self.index: list[tuple] = []
        self.at = HEAD.size
        self.out.write(HEAD.pack(MAGIC, VERSION, width, digest))

    def add(self, doc_id: int | None, frame: bytes, tokens: int) -> None:
        self.index.append((doc_id or 0, doc_id is None, self.at, len(frame), tokens))
        self.out.write(frame)
        self.at += len(frame)

    def close(self) -> tuple:
        self.out.write(np.array(self.index, INDEX).tobytes())
        self.out.write(TAIL.pack(self.at, len(self.index), MAGIC))
        self.out.close()
        ids = [None if x[1] else x[0] for x in (self.index[0], self.index[-1])]
        return self.name, len(self.index), sum(x[4] for x in self.index), *ids


def shard_writer(
    folder: str, tokenizer: str, dictionary: bytes, end_id: int, width: int, level: int, shard_bytes: int,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, path = file_store(folder)
        part, shards, shard = TaskContext.get().partitionId(), [], None
        digest = hashlib.sha256(dictionary).digest()
        pack = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary))
        end = struct.pack("<I", end_id)
        for batch in batches:
            ids = encoder(tokenizer).packed(batch.column(1).to_pylist())
            for doc_id, raw in zip(batch.column(0).to_pylist(), ids):
                shard = shard or ShardWriter(store, path, digest, width)
                shard.add(doc_id, pack.compress(narrow(raw + end, width)), len(raw) // 4 + 1)
                if shard.at >= shard_bytes:
                    shards.append(shard.close())
                    shard = None
        if shard:
            shards.append(shard.close())
        if shards:
            columns = [pa.array(c) for c in zip(*shards)]
            numbers = [pa.array([part] * len(shards), pa.int32()), pa.array(range(len(shards)), pa.int32())]
            firsts = [c.cast(t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 4))]
            names = [x.split()[0] for x in MANIFEST.split(", ")]
            yield pa.RecordBatch.from_arrays([*numbers, *firsts, pa.array([digest.hex()] * len(shards))], names)

    return write


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    width: int = 2, level: int = 3, shard_bytes: int = SHARD_BYTES,
) -> None:
    """Writes shards of all rows in ascending order of id, a dictionary and a manifest to a new folder.

    Every row gives one document, ended by ``end_id``: null and empty texts hold that only. Null ids come
    first, rows that repeat an id stand side by side; other columns are not looked at. ``width`` is the
    bytes of a stored id and must hold every id of the tokenizer. Texts are encoded whole.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    store, path = file_store(folder)
    store.create_dir(path, recursive=True)
    dictionary = learn_dictionary(rows, tokenizer, end_id, width)
    with store.open_output_stream(f"{path}/{hashlib.sha256(dictionary).hexdigest()}.dictionary") as out:
        out.write(dictionary)
    ordered = rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    write = shard_writer(folder, tokenizer, dictionary, end_id, width, level, shard_bytes)
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")


def read_index(file) -> np.ndarray:
    """The index of an open shard."""
    at, n, magic = TAIL.unpack(file.read_at(TAIL.size, file.size() - TAIL.size))
    if magic != MAGIC:
        raise ValueError("not a whole shard")
    return np.frombuffer(file.read_at(n * INDEX.itemsize, at), INDEX)


class ShardReader:
    """Documents of one shard by their place in the index."""

    def __init__(self, folder: str, name: str):
        store, path = file_store(folder)
        self.file = store.open_input_file(f"{path}/{name}")
        magic, version, self.width, digest = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError(f"not a shard of version {VERSION}: {name}")
        dictionary = store.open_input_file(f"{path}/{digest.hex()}.dictionary").read()
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"the dictionary of {name} was changed")
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        self.index = read_index(self.file)

    def ids(self, at: int) -> np.ndarray:
        entry = self.index[at]
        frame = self.file.read_at(int(entry["size"]), int(entry["offset"]))
        return np.frombuffer(self.unpack.decompress(frame), f"<u{self.width}").astype("<u4")


def read_document(folder: str, name: str, doc_id: int) -> np.ndarray | None:
    """The ids of one document of a shard, reading its index and its frame only."""
    shard = ShardReader(folder, name)
    found = np.flatnonzero((shard.index["doc_id"] == doc_id) & (shard.index["null"] == 0))
    return shard.ids(int(found[0])) if len(found) else None


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the shards; and ``ids`` if wanted.

    ``start`` counts the ids of all documents before it; totals of shards are summed on one row a shard.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = ShardReader(folder, name)
                for at in range(0, len(shard.index), 2000):
                    part = shard.index[at : at + 2000]
                    ids = [shard.ids(i) for i in range(at, at + len(part))]
                    sizes = np.array([len(x) for x in ids], np.int64)
                    starts = start + np.concatenate([[0], np.cumsum(sizes)[:-1]])
                    start += int(sizes.sum())
                    columns = [
                        pa.array(part["doc_id"], mask=part["null"].astype(bool)), pa.array(starts.astype(np.int64)),
                        pa.array(sizes), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns, names = [*columns, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(columns, names)

    kind = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return task_a_file(shards).mapInArrow(read, kind)

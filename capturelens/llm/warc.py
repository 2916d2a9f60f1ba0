"""WARC archives: one gzip member for each record, written by tasks and read back sequentially.

A page is a ``response`` record with its HTTP head, or a ``revisit`` of the page that holds the same
payload. The reader inflates a file piece by piece, frames records by their content length, and
compares lengths and digests with what the records say; anything else raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import file_store, task_a_file

PIECE = 64 * 1024
FILE_BYTES = 64 * 2**20
GZIP = 31  # window bits of a gzip member
ID = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, n_records bigint, n_bytes bigint"
READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def base32_sha1(*pieces: bytes) -> str:
    digest = hashlib.sha1()
    for piece in pieces:
        digest.update(piece)
    return base64.b32encode(digest.digest()).decode()


def page_urn(page_id: int | None) -> str:
    return f"<{ID}{'null' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    value = (urn or "")[len(ID) + 1 : -1]
    return int(value) if value not in ("", "null") else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP head of it only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = [head] if revisit else [head, payload]
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", page_urn(page_id)), ("WARC-Date", date),
        ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)), ("WARC-Block-Digest", "sha1:" + base32_sha1(*block)),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(sum(map(len, block)))),
    ]
    if revisit:
        fields += [("WARC-Refers-To", page_urn(refers_to)), ("WARC-Profile", PROFILE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub("[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url)))
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"".join([b"WARC/1.1\r\n", lines.encode(), b"\r\n", *block, b"\r\n\r\n"])


def plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """``page_id, url, payload, refers_to``: of equal payloads the smallest id is kept as a response.

    Only (digest, id) is grouped; a payload that a third of all pages share leaves each task once.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    keyed = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), html.alias("payload"),
        F.unhex(F.sha2(html, 256)).alias("digest"),
    )
    firsts = keyed.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"))
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    return keyed.join(firsts, "digest", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def archive_writer(
    folder: str, date: str, level: int, file_bytes: int,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = file_store(folder)
        done, out, name, records, size = [], None, "", 0, 0
        for batch in batches:
            payloads = batch.column(2).cast(pa.binary()).to_pylist()
            for page_id, url, payload, refers in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), payloads, batch.column(3).to_pylist(),
            ):
                if out is None:
                    name, records, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                member = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                packed = member.compress(record_bytes(page_id, url, payload, refers, date)) + member.flush()
                out.write(packed)
                records, size = records + 1, size + len(packed)
                if size >= file_bytes:
                    out.close()
                    done.append((name, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records, size))
        if done:
            names, counts, sizes = zip(*done)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["file", "n_records", "n_bytes"])

    return write


def write_pages(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", level: int = 4, file_bytes: int = FILE_BYTES,
) -> None:
    """Writes one record per row to new files in the folder, and a manifest of them.

    Null html is an empty payload, a null url gives no target. Of equal payloads of at least
    ``least_bytes`` bytes the page with the smallest id is the response; rows that repeat that id are
    responses too. Null ids refer to the smallest id, or are responses where no equal page has an id.
    Files that a lost task left are not in the manifest. Other columns are not looked at.
    """
    store, path = file_store(folder)
    store.create_dir(path, recursive=True)
    records = plan_records(pages, id_col, url_col, html_col, least_bytes)
    records.mapInArrow(archive_writer(folder, date, level, file_bytes), MANIFEST).write.parquet(f"{folder}/manifest")


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes

    @property
    def payload_bytes(self) -> int:
        """Of the full payload, also where a revisit leaves it out."""
        return int(self.http["content-length"])


def fields(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines.decode().split("\r\n") if ":" in x)}


class Inflated:
    """The inflated bytes of one member after the other, never more than a piece ahead."""

    def __init__(self, stream):
        self.stream, self.ahead = stream, b""
        self.buffer = bytearray()
        self.member = None

    def begin(self) -> bool:
        """Starts the next member; False at the end of the file."""
        if not self.ahead:
            self.ahead = self.stream.read(PIECE)
        if not self.ahead:
            return False
        self.member, self.buffer = zlib.decompressobj(GZIP), bytearray()
        return True

    def more(self) -> bool:
        """Inflates one more piece of the member; False at its end."""
        if self.member.eof:
            return False
        feed = self.member.unconsumed_tail or self.ahead
        if not feed:
            feed = self.stream.read(PIECE)
            if not feed:
                raise ValueError("the file ends inside a record")
        try:
            self.buffer += self.member.decompress(feed, PIECE)
        except zlib.error as e:
            raise ValueError(f"damaged member: {e}") from e
        self.ahead = self.member.unused_data if self.member.eof else b""
        return True

    def until(self, mark: bytes) -> bytes:
        """The bytes before the mark, which is taken too."""
        seen = 0
        while (at := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark))
            if not self.more():
                raise ValueError("a record without a whole head")
        out = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.more():
                raise ValueError("a record shorter than its content length")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def read_records(stream) -> Iterator[Record]:
    """The records of an archive in order, verified."""
    source = Inflated(stream)
    while source.begin():
        version, _, head = source.until(b"\r\n\r\n").partition(b"\r\n")
        if not version.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        headers = fields(head)
        left, block = int(headers["content-length"]), hashlib.sha1()
        pieces = []
        while left:
            piece = source.take(min(left, PIECE))
            block.update(piece)
            pieces.append(piece)
            left -= len(piece)
        if source.take(4) != b"\r\n\r\n" or source.buffer or source.more() and source.buffer:
            raise ValueError("a record longer than its content length")
        while source.more():
            if source.buffer:
                raise ValueError("a record longer than its content length")
        if "sha1:" + base64.b32encode(block.digest()).decode() != headers["warc-block-digest"]:
            raise ValueError(f"block digest of {headers['warc-record-id']} differs")
        http, _, payload = b"".join(pieces).partition(b"\r\n\r\n")
        record = Record(headers, fields(http), payload)
        if headers["warc-type"] == "response":
            if "sha1:" + base32_sha1(payload) != headers["warc-payload-digest"]:
                raise ValueError(f"payload digest of {headers['warc-record-id']} differs")
            if record.payload_bytes != len(payload):
                raise ValueError(f"payload of {headers['warc-record-id']} is cut")
        yield record


def read_pages(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record; and ``payload``
    if wanted (null for revisits). Each file is read in one pass."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file", "n_records")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = file_store(folder)
        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for record in read_records(stream):
                        h = record.headers
                        expected -= 1
                        row = (
                            page_of(h["warc-record-id"]), record.payload_bytes, h["warc-payload-digest"].removeprefix("sha1:"),
                            h["warc-type"], page_of(h.get("warc-refers-to")),
                        )
                        rows.append((*row, record.payload if h["warc-type"] == "response" else None))
                        if len(rows) == 1000:
                            yield batch_of(rows, with_payload)
                            rows = []
                if expected:
                    raise ValueError(f"{name} has not the records of the manifest")
                if rows:
                    yield batch_of(rows, with_payload)

    return task_a_file(files).mapInArrow(read, READ + ", payload binary" * with_payload)


def batch_of(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    n = 5 + with_payload
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(columns[i], kinds[i]) for i in range(n)], names[:n])

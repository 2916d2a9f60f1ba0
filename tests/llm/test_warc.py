"""WARC archives: exact round trip, revisits, and damaged files."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from capturelens.llm.warc import read_pages, read_records, record_bytes, write_pages
from capturelens.llm.work import file_store, new_folder

SF = "/root/testdata/sf0.001"
DATE = "2000-01-01T00:00:00Z"


def expected(rows, least=0):
    first = {}
    for page_id, html in rows:
        first[html or ""] = min(first.get(html or "", page_id), page_id)
    out = {}
    for page_id, html in rows:
        raw = (html or "").encode()
        same = len(raw) >= least and first[html or ""] != page_id
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out[page_id] = (len(raw), digest, "revisit" if same else "response", first[html or ""] if same else None)
    return out


def result(df):
    return {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()}


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    folder = new_folder(spark, "warc")
    write_pages(pages, folder)
    rows = [(r["page_id"], r["html"]) for r in pages.collect()]
    back = read_pages(spark, folder, with_payload=True)
    assert result(back) == expected(rows)
    html = dict(rows)
    assert all(bytes(r["payload"]).decode() == html[r["page_id"]] for r in back.where("record_type = 'response'").collect())


@pytest.mark.parametrize("least", [0, 5])
def test_copies_nulls_long_payloads_and_many_files(spark, least):
    long = "é\r\n\r\nWARC/1.1 " * 60_000
    rows = [(5, "same page"), (3, "same page"), (9, None), (7, ""), (4, long), (8, long + "x"), (6, "abc"), (2, "abc")]
    table = spark.createDataFrame(
        [(i, "http://a.example/b c\n" if i % 2 else None, h, "x") for i, h in rows],
        "page_id bigint, url string, html string, digest string").repartition(3)
    folder = new_folder(spark, "warc")
    write_pages(table, folder, least_bytes=least, file_bytes=200)
    assert result(read_pages(spark, folder)) == expected(rows, least)
    files, tasks = spark.read.parquet(f"{folder}/manifest").count(), read_pages(spark, folder).select(F.spark_partition_id().alias("p"))
    assert files > 3 and tasks.distinct().count() == files


def test_null_ids_repeats_and_an_empty_table(spark):
    schema = "page_id bigint, url string, html string"
    folder, empty = new_folder(spark, "warc"), new_folder(spark, "warc")
    write_pages(spark.createDataFrame([(None, None, "a"), (2, None, "a"), (2, None, "a"), (None, None, "b")], schema), folder)
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in read_pages(spark, folder).collect()), key=repr)
    assert got == [(2, "response", None)] * 2 + [(None, "response", None), (None, "revisit", 2)]
    write_pages(spark.createDataFrame([], schema), empty)
    assert read_pages(spark, empty).count() == 0


def test_other_tools_can_inflate_it(spark):
    folder = new_folder(spark, "warc")
    write_pages(spark.createDataFrame([(1, "u", "one"), (2, "u", "two")], "page_id bigint, url string, html string").coalesce(1), folder)
    store, path = file_store(folder)
    name = spark.read.parquet(f"{folder}/manifest").first()["file"]
    plain = gzip.decompress(store.open_input_stream(f"{path}/{name}", compression=None).read())
    assert plain.count(b"WARC/1.1\r\n") == 2 and b"\r\n\r\ntwo\r\n\r\n" in plain


def test_damage_is_noticed():
    records = [record_bytes(i, "http://x", b"payload %d" % i * 50, None, DATE) for i in range(3)]
    whole = b"".join(map(gzip.compress, records))
    assert [r.payload for r in read_records(io.BytesIO(whole))] == [b"payload %d" % i * 50 for i in range(3)]
    assert list(read_records(io.BytesIO(b""))) == []
    for bad in (
        whole[:-20], gzip.compress(records[0].replace(b"payload 0p", b"payload 1p")), gzip.compress(records[0] + b"x"),
        gzip.compress(records[0][:-200]), gzip.compress(b"HTTP/1.1\r\n\r\n"), gzip.compress(records[0] + records[1]),
    ):
        with pytest.raises(ValueError):
            list(read_records(io.BytesIO(bad)))

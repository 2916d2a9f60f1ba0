"""Sources and sinks over temporary trees."""

from __future__ import annotations

import json
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from capturelens.operators.documents import document_tokens, number_labels
from capturelens.sources import readers as rd
from capturelens.sources.message_log import scan_chunks, write_chunks
from capturelens.sources import sinks as sk


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)
    return str(path)


def png(path, w, h, channels, rows):
    """A PNG written byte by byte."""
    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    raw = b"".join(b"\0" + bytes(r) for r in rows)
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if channels == 1 else 2, 0, 0, 0)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_csv_is_all_text_and_round_trips(spark, tmp_path):
    path = put(f"{tmp_path}/a.csv", 'id,n,note\nx,01,"a, b"\ny,,n/a\n')
    df = rd.read_csv(spark, path)
    assert set(dict(df.dtypes).values()) == {"string"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("x", "01", "a, b"), ("y", "", "n/a")]
    out = f"{tmp_path}/out"
    sk.write_csv(df.withColumn("extra", F.lit(1)), out, ["note", "id", "absent"])
    back = rd.read_csv(spark, out).orderBy("id")
    assert back.columns == ["note", "id", "absent"]
    assert [tuple(r) for r in back.collect()] == [("a, b", "x", ""), ("n/a", "y", "")]


def test_keyed_csv(spark, tmp_path):
    a = put(f"{tmp_path}/a.csv", "dataset,sequence_id,k\nbtg,Row1,3\n")
    b = put(f"{tmp_path}/b.csv", "id,k\nbtg_Row1,4\n")
    assert rd.read_csv_keyed(spark, a, "char_").first().asDict() == {"key": "btg_Row1", "char_dataset": "btg", "char_sequence_id": "Row1", "char_k": "3"}
    assert rd.read_csv_keyed(spark, b).first()["key"] == "btg_Row1"


def test_records_and_tree(spark, tmp_path):
    root = f"{tmp_path}/C"
    for cond, seed in (("raw", 0), ("raw", 1), ("full", 0)):
        put(f"{root}/set/s1/{cond}/seed{seed}/summary.json", json.dumps({"psnr": 20.0 + seed, "job": f"j{seed}"}))
    put(f"{root}/reg/s1.quality.json", json.dumps({"n": 4}))
    recs = rd.read_records(spark, f"{root}/reg/*.json", "n int", r"([^/]+)\.quality\.json$")
    keys = spark.createDataFrame([("s1",), ("s2",)], "key string")
    assert {r.key: r.n for r in rd.with_records(keys, recs).collect()} == {"s1": 4, "s2": None}
    tree = rd.read_tree(spark, f"{root}/set", "psnr double, job string", r"set/([^/]+)/([^/]+)/seed(\d+)/", ["sequence", "condition", "seed"])
    conds = spark.createDataFrame([("s1", "raw"), ("s1", "full"), ("s1", "empty")], "sequence string, condition string")
    rows = rd.conditions_with_seeds(conds, tree, ["sequence", "condition"]).collect()
    assert sorted((r.condition, r.seed or "-") for r in rows) == [("empty", "-"), ("full", "0"), ("raw", "0"), ("raw", "1")]
    index = sk.provenance_of_files(spark, f"{root}/set", r"set/([^/]+)/([^/]+)/seed(\d+)/", ["sequence", "condition", "seed"], "job string", "ablations")
    got = index.orderBy("row").first()
    assert got["row"] == "s1 | full | 0" and got["job"] == "j0" and len(got["date"]) == 10


def test_first_named_file(spark):
    files = spark.createDataFrame([("a", "x.registration.json"), ("a", "registration.json"), ("b", "z.registration.json"), ("b", "y.registration.json")], "key string, path string")
    rank = F.when(F.col("path") == "registration.json", 0).otherwise(1)
    assert {r.key: r.path for r in rd.first_named(files, ["key"], rank, "path").collect()} == {"a": "registration.json", "b": "y.registration.json"}


def test_frame_list(spark, tmp_path):
    put(f"{tmp_path}/lists/blt_1.txt", "frame_000000.png\tbag_time=1.250s header_stamp=1650.500\nframe_000001.png\tclip.mp4:7 (global 42)\n")
    rows = rd.read_frame_list(spark, f"{tmp_path}/lists").orderBy("name").collect()
    assert (rows[0].seq_id, rows[0].bag_time, rows[0].header_stamp, rows[0].global_index) == ("blt_1", 1.25, 1650.5, None)
    assert rows[1].global_index == 42


def test_images(spark, tmp_path):
    png(f"{tmp_path}/a.png", 4, 2, 1, [[0, 10, 20, 30], [40, 50, 60, 255]])
    png(f"{tmp_path}/b.png", 2, 2, 3, [[255, 0, 0, 0, 255, 0], [0, 0, 255, 255, 255, 255]])
    rows = {os.path.basename(r.path): r for r in rd.read_images(spark, str(tmp_path)).collect()}
    assert (rows["a.png"].h, rows["a.png"].w) == (2, 4)
    assert list(rows["a.png"].grey) == [0, 10, 20, 30, 40, 50, 60, 255]
    assert list(rows["b.png"].grey) == [76, 150, 29, 255]


def test_time_window_scan_prunes(spark, tmp_path):
    log = spark.range(1000).select((F.col("id") / 10).alias("t"), F.col("id"))
    rd.write_log(log, f"{tmp_path}/log", "t", 10.0)
    df = rd.scan_window(spark, f"{tmp_path}/log", "t", 25.0, 31.0, 10.0)
    assert df.count() == 61
    assert "bucket" in df._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:120]


def test_catalog_long(spark, tmp_path):
    table = {"name": "readiness", "columns": ["Dataset", "Class"], "rows": [["A", "x (ripe)"], ["B", "y (unripe)"]], "row_ids": ["a", "b"], "row_classes": ["ripe", "unripe"]}
    put(f"{tmp_path}/r.json", json.dumps(table))
    rows = rd.catalog_long(rd.read_catalog(spark, f"{tmp_path}/r.json")).orderBy("index", "place").collect()
    assert [(r.id, r["class"], r.column, r.cell) for r in rows] == [
        ("a", "ripe", "Dataset", "A"), ("a", "ripe", "Class", "x (ripe)"), ("b", "unripe", "Dataset", "B"), ("b", "unripe", "Class", "y (unripe)")]


def test_bibliography(spark, tmp_path):
    path = put(f"{tmp_path}/x.bib", '@Article{k1,\n title = {A  b},\n doi = "10.1/x", year = 2020\n}\n@misc{k2, url = {http://u}}\n')
    rows = {r.key: r for r in rd.read_bibliography(spark, path).collect()}
    assert rows["k1"].type == "article" and rows["k1"].fields == {"title": "A b", "doi": "10.1/x", "year": "2020"}
    assert rows["k2"].fields == {"url": "http://u"}


def test_markup_rows_check_cells(spark):
    bad = spark.createDataFrame([(1, r"\toprule A & B \\ \midrule 1 & 2 & 3 \\ \bottomrule")], "k int, t string")
    with pytest.raises(Exception, match="wrong number of cells"):
        rd.markup_rows(bad, "k", "t").collect()


def test_numbering_of_a_document(spark):
    main = r"\section{A}\label{s}\begin{table}\caption{x}\label{t}\end{table}\subsection{B}\label{u}\begin{figure}\caption{y}\label{f}\end{figure}"
    back = r"\setcounter{table}{0}\section{C}\label{v}\begin{table}\caption{x}\label{w}\end{table}"
    docs = spark.createDataFrame([(1, 0, main), (1, 1, back)], "doc int, part int, text string")
    got = number_labels(document_tokens(docs, "doc", "part", "text"), "doc", "part", ["pos"])
    assert {r.label: r.number for r in got.collect()} == {"s": "1", "t": "1", "u": "1.1", "f": "1", "v": "A", "w": "A1"}


def test_records_upsert_and_write_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "run string, v int")
    sk.write_records(rows, f"{tmp_path}/rec", "run")
    assert spark.read.json(f"{tmp_path}/rec/run=a").first()["v"] == 1
    path = f"{tmp_path}/t"
    assert sk.read_table(spark, path) is None
    sk.upsert_table(rows, path, ["run"])
    sk.upsert_table(spark.createDataFrame([("b", 5), ("c", 6)], "run string, v int"), path, ["run"])
    assert {r.run: r.v for r in sk.read_table(spark, path).collect()} == {"a": 1, "b": 5, "c": 6}
    once = f"{tmp_path}/once"
    assert [sk.write_once(rows, once), sk.write_once(rows, once)] == ["written", "same"]
    assert sk.write_once(rows.where("v > 1"), once) == "different"
    assert spark.read.parquet(once).count() == 2 and spark.read.parquet(f"{once}.rerun").count() == 1


def test_stopped_upserts_leave_the_old_table(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    values = lambda: {r.run: r.v for r in sk.read_table(spark, path).collect()}
    sk.upsert_table(spark.createDataFrame([(f"r{i}", i) for i in range(100)], "run string, v int"), path, ["run"])
    before = values()
    batch = spark.createDataFrame([("r1", -1), ("new", 7)], "run string, v int")
    writer = type(batch.write)
    whole = writer.parquet

    def stop_at(part, after):
        def parquet(self, target, *a, **k):
            if part in target and not after:
                raise KeyboardInterrupt
            whole(self, target, *a, **k)
            if part in target:
                raise KeyboardInterrupt
        return parquet

    for part, after, want in (("/data-", False, before), ("/data-", True, before), ("/log", False, before), ("/log", True, before | {"r1": -1, "new": 7})):
        monkeypatch.setattr(writer, "parquet", stop_at(part, after))
        with pytest.raises(KeyboardInterrupt):
            sk.upsert_table(batch, path, ["run"])
        monkeypatch.undo()
        assert values() == want
    folders = {r["bucket"]: r["folder"] for r in sk.table_log(spark, path)}
    sk.upsert_table(spark.createDataFrame([("r5", 55)], "run string, v int"), path, ["run"])
    changed = [b for b, f in ((r["bucket"], r["folder"]) for r in sk.table_log(spark, path)) if folders[b] != f]
    assert len(changed) == 1 and values()["r5"] == 55 and len(values()) == 101


def test_older_versions_and_repeated_keys(spark, tmp_path):
    path, kept = f"{tmp_path}/t", f"{tmp_path}/k"
    rows = lambda *r: spark.createDataFrame(list(r), "run string, ver int, v int")
    sk.upsert_table(rows(("a", 2, 20), ("b", 1, 10)), path, ["run"], "ver")
    sk.upsert_table(rows(("a", 1, 99), ("b", 1, 10)), path, ["run"], "ver")
    assert {r.run: r.v for r in sk.read_table(spark, path).collect()} == {"a": 20, "b": 10}
    sk.append_new(rows(("a", 3, 1), ("a", 1, 2)), kept, ["run"], "ver")
    sk.append_new(rows(("a", 0, 9), ("b", 0, 3)), kept, ["run"], "ver")
    assert {r.run: r.v for r in spark.read.parquet(kept).collect()} == {"a": 2, "b": 3}


def test_unread_images_stay(spark, tmp_path):
    put(f"{tmp_path}/bad.png", "not a picture")
    (row,) = rd.read_images(spark, str(tmp_path)).collect()
    assert row.path.endswith("bad.png") and row.h is None and row.grey is None


def test_bibliography_groups_nest(spark):
    text = '@Article{k1, title = {The {GPS} {S{u}rvey}}, note = "a, {b, c}" , year=2024,}\n@misc{k2,\n author={A {\\"o} B}\n}'
    got = {r.key: dict(r.fields) for r in rd.bibliography(spark.createDataFrame([(text,), ("none",), (None,)], "value string"), "value").collect()}
    assert got == {"k1": {"title": "The {GPS} {S{u}rvey}", "note": "a, {b, c}", "year": "2024"}, "k2": {"author": 'A {\\"o} B'}}
    with pytest.raises(Exception, match="not closed"):
        rd.bibliography(spark.createDataFrame([("@a{b, c = {d",)], "value string"), "value").collect()


def test_manifest(spark, tmp_path):
    put(f"{tmp_path}/m/README.md", "hello")
    put(f"{tmp_path}/m/poses/a.csv", "x")
    rules = [(r"^README\.md$", "this file"), (r"^poses/", "poses")]
    rows = {r.path: r for r in sk.manifest(spark, f"{tmp_path}/m", rules).collect()}
    assert rows["README.md"].size_bytes == 5 and rows["README.md"].md5 == "5d41402abc4b2a76b9719d911017c592"
    assert rows["poses/a.csv"].content == "poses"
    put(f"{tmp_path}/m/other", "y")
    with pytest.raises(Exception, match="no description"):
        sk.manifest(spark, f"{tmp_path}/m", rules).collect()


def test_report_cells(spark):
    good = spark.createDataFrame([("a", 1)], "x string, y int")
    assert sk.report_lines(good, ["x", "y"]).first()["line"] == "| a | 1 |"
    with pytest.raises(Exception, match="bad cell"):
        sk.report_lines(spark.createDataFrame([("a|b", 1)], "x string, y int"), ["x", "y"]).collect()


def test_chunks_are_dropped_unopened(spark, tmp_path):
    """A scan opens the chunks whose times and topics can match, and gives what a filter on the messages gives."""
    rows = [(i, "odd" if i % 2 else "even" if i < 500 else "rare", float(i % 7)) for i in range(1000)] + [(None, "odd", 1.0), (5, None, 2.0)]
    log = spark.createDataFrame(rows, "s int, topic string, v double").select(F.timestamp_seconds("s").alias("t"), "topic", "v", "s")
    write_chunks(log, f"{tmp_path}/log", "t", "topic", 20)
    scan = scan_chunks(spark, f"{tmp_path}/log", log.schema, "t", "topic")
    at = lambda s: F.timestamp_seconds(F.lit(s))
    cases = {
        "all": (F.lit(True), 20, 20), "window": (F.col("t").between(at(310), at(340)), 1, 2), "topic": (F.col("topic") == "rare", 9, 12),
        "both": ((F.col("t") < at(520)) & F.col("topic").isin("rare", "none"), 1, 3), "none": (F.col("t") > at(5000), 0, 0),
    }
    for name, (rule, least, most) in cases.items():
        found = scan.where(rule)
        assert sorted(map(str, found.collect())) == sorted(map(str, log.where(rule).collect())), name
        assert least <= found.rdd.getNumPartitions() <= max(most, 1), name

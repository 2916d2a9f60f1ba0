"""Streams run to the end of their input give the batch result."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from capturelens.operators.sequence import log_attempts
from capturelens.sources.sinks import read_table
from capturelens.streaming import telemetry as st


def stream_of(spark, tmp_path, frames, name="in"):
    """A file stream with one file per frame, read in order."""
    path = f"{tmp_path}/{name}"
    for i, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(f"{path}/part={i:03d}")
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def collected(spark, out):
    return pd.concat(out) if out else pd.DataFrame()


def telemetry(spark):
    rows = [(f"j{i % 2}", f"gpu{i % 3}", i, float((i * 37) % 101)) for i in range(240)]
    return spark.createDataFrame(rows, "job string, device string, s int, gb double").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")))


def test_peak(spark, tmp_path):
    base = telemetry(spark)
    parts = [base.where(f"s >= {a} and s < {a + 60}") for a in range(0, 240, 60)]
    out = []
    st.run_to_end(st.telemetry_peak(stream_of(spark, tmp_path, parts), ["job", "device"], "gb"), lambda df: out.append(df.toPandas()), f"{tmp_path}/ck", "update")
    last = collected(spark, out).groupby(["job", "device"])["peak"].max()
    want = base.groupBy("job", "device").agg(F.max("gb").alias("peak")).toPandas().set_index(["job", "device"])["peak"]
    pd.testing.assert_series_equal(last.sort_index(), want.sort_index())


def test_timeline(spark, tmp_path):
    base = telemetry(spark)
    parts = [base.where(f"s >= {a} and s < {a + 60}") for a in range(0, 240, 60)]
    out = []
    st.run_to_end(st.telemetry_timeline(stream_of(spark, tmp_path, parts), ["job"], "ts", "gb"), lambda df: out.append(df.toPandas()), f"{tmp_path}/ck")
    got = collected(spark, out).set_index(["job", "start"])["n"]
    want = base.groupBy("job", F.window("ts", "1 minute").start.alias("start")).count().toPandas().set_index(["job", "start"])["count"]
    assert len(got) >= 4  # the last window stays open
    assert all(want[k] == v for k, v in got.items())


def test_event_time_selection(spark):
    rows = [(i, i + (40 if i % 10 == 0 else 2)) for i in range(100)]
    df = spark.createDataFrame(rows, "h int, b int").select(F.timestamp_seconds("h").alias("header"), F.timestamp_seconds("b").alias("bag"))
    at = lambda s: F.timestamp_seconds(F.lit(s))
    got = st.select_on_event_time(df, "header", "bag", at(20), at(50))
    assert got.count() == sum(20 <= h <= 50 and 20 <= b <= 80 for h, b in rows)
    assert got.where("late").count() == sum(20 <= h <= 50 and 20 <= b <= 80 and b - h > 30 for h, b in rows)


def test_dedup_within_lag(spark, tmp_path):
    df = spark.createDataFrame([(i % 5, i) for i in range(10)], "id int, s int").withColumn("header", F.timestamp_seconds("s"))
    out = []
    st.run_to_end(st.dedup_within_lag(stream_of(spark, tmp_path, [df]), ["id"], "header"), lambda d: out.append(d.toPandas()), f"{tmp_path}/ck")
    assert sorted(collected(spark, out)["id"]) == [0, 1, 2, 3, 4]


def test_upsert_and_write_once(spark, tmp_path):
    a = spark.createDataFrame([("r1", 1, 1.0), ("r2", 1, 2.0)], "run string, ver int, v double")
    b = spark.createDataFrame([("r2", 2, 5.0), ("r2", 3, 6.0), ("r3", 1, 7.0)], "run string, ver int, v double")
    st.upsert_stream(stream_of(spark, tmp_path, [a, b]), f"{tmp_path}/t", ["run"], "ver", f"{tmp_path}/ck").awaitTermination()
    assert {r.run: r.v for r in read_table(spark, f"{tmp_path}/t").collect()} == {"r1": 1.0, "r2": 6.0, "r3": 7.0}
    st.upsert_stream(stream_of(spark, tmp_path, [a], "late"), f"{tmp_path}/t", ["run"], "ver", f"{tmp_path}/ck3").awaitTermination()
    assert {r.run: r.v for r in read_table(spark, f"{tmp_path}/t").collect()} == {"r1": 1.0, "r2": 6.0, "r3": 7.0}
    st.write_once_stream(stream_of(spark, tmp_path, [a, b], "again"), f"{tmp_path}/w", ["run"], f"{tmp_path}/ck2").awaitTermination()
    assert {r.run: r.v for r in spark.read.parquet(f"{tmp_path}/w").collect()} == {"r1": 1.0, "r2": 2.0, "r3": 7.0}


def test_dispatch(spark, tmp_path):
    log = spark.createDataFrame([("metrics/psnr", "1"), ("metrics/skip", "2"), ("metadata/cfg", "3"), ("other", "4")], "key string, value string")
    sinks = {"metrics/": (f"{tmp_path}/m", ["metrics/skip"]), "metadata/": (f"{tmp_path}/d", [])}
    st.dispatch_log(stream_of(spark, tmp_path, [log]), "key", sinks, f"{tmp_path}/ck").awaitTermination()
    read = lambda p: {r.key for r in spark.read.option("recursiveFileLookup", True).parquet(p).collect()}
    assert read(f"{tmp_path}/m") == {"psnr"} and read(f"{tmp_path}/d") == {"cfg"}


def test_attempts_with_late_lines(spark, tmp_path):
    rows = []
    for run in range(3):
        for line in range(30):
            role = "start" if line % (7 + run) == 3 else ("step" if line % 2 else "other")
            role = "end" if line == 17 and run == 1 else role
            rows.append((run, line, role, "r" if line % 11 == 5 else None))
    log = spark.createDataFrame(rows, "run bigint, line bigint, role string, reason string").withColumn(
        "at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("line")))
    later = spark.createDataFrame([(9, 0, "other", None, 1_700_000_000 + s) for s in (300, 9000)], "run bigint, line bigint, role string, reason string, s bigint")
    later = later.select("run", "line", "role", "reason", F.timestamp_seconds("s").alias("at"))
    shuffled = [log.where("line % 3 = 1 AND line < 15"), log.where("line % 3 <> 1 AND line < 15"), log.where("line >= 15"), later.limit(1), later]
    out = []
    live = st.attempts_stream(stream_of(spark, tmp_path, shuffled), "at")
    st.run_to_end(live, lambda df: out.append(df.toPandas()), f"{tmp_path}/ck")
    got = sorted((r.run, r.attempt, r.first_line, r.n_after, r.discarded) for r in collected(spark, out).itertuples())
    start, step = F.col("role") == "start", F.col("role") == "step"
    batch = log_attempts(log.where("run <> 1 OR line <= 17"), "run", "line", start, step, F.col("reason"))
    after = log_attempts(log.where("run = 1 AND line > 17"), "run", "line", start, step, F.col("reason"))
    ended = batch.where("run = 1").count()
    want = batch.unionByName(after.withColumn("attempt", F.col("attempt") + ended))
    assert got == sorted((r.run, r.attempt, r.first_line, r.n_after, r.discarded) for r in want.collect())


def test_windows_that_are_a_stream(spark, tmp_path):
    """Early, late, overlapping and empty windows, late rows, two sequences: rows and closed windows equal the batch result."""
    secs = lambda c: F.timestamp_seconds(F.lit(1_700_000_000) + F.col(c))
    rows = [(i % 2, i, i + (25 if i % 10 == 0 else 40 if i % 37 == 5 else 2), float(i)) for i in range(600)] + [(None, 5, 6, 1.0)]
    frames = spark.createDataFrame(rows, "seq int, h int, b int, v double").select("seq", "h", "b", secs("h").alias("header"), secs("b").alias("bag"), "v")
    spans = [(0, "early", 200, 290), (0, "over", 250, 330), (1, "late", 60, 100), (1, "point", 301, 301), (0, "empty", 301, 301), (1, "open", 500, 2000)]
    wins = spark.createDataFrame(spans, "seq int, name string, a int, z int").select("seq", "name", "a", "z", secs("a").alias("start"), secs("z").alias("end"))
    parts = [frames.where("h < 120"), frames.where("h >= 120 AND h < 320"), frames.where("h >= 320")]
    more = spark.createDataFrame([(7, s, s, 0.0) for s in (4000, 9000)], "seq int, h int, b int, v double").select("seq", "h", "b", secs("h").alias("header"), secs("b").alias("bag"), "v")
    ends = spark.createDataFrame([(7, "end", s, s) for s in (4000, 9000)], "seq int, name string, a int, z int").select("seq", "name", "a", "z", secs("a").alias("start"), secs("z").alias("end"))
    first = wins.where("name IN ('early', 'over', 'empty', 'open')")
    wparts = [first.where("name IN ('early', 'over')"), first.where("name IN ('empty', 'open')").union(wins.where("name IN ('late', 'point')")), ends.limit(1), ends, ends]
    for folder, summary in (("rows", False), ("sums", True)):
        live = stream_of(spark, tmp_path, [*parts, more.where("h < 5000"), more], f"in-{folder}")
        ws = stream_of(spark, tmp_path, wparts, f"win-{folder}")
        met = st.rows_in_windows(live, ws, ["seq"], "header", "bag", "start", "end")
        stream = st.closed_windows(met, ["seq"], "name", "end", "v") if summary else met
        out = []
        st.run_to_end(stream, lambda df: out.append(df.toPandas()), f"{tmp_path}/ck-{folder}")
        got = collected(spark, out)
        got = got[got["name"] != "end"]
        want = {(s, n, h) for s, h, b, v in rows for t, n, a, z in spans if s == t and a <= h <= z and h >= z - 600}
        if summary:
            counts = {(s, n): sum((x[0], x[1]) == (s, n) for x in want) for s, n, _ in want}
            assert dict(zip(zip(got["seq"], got["name"]), got["n"])) == counts
            late = {(s, n): sum(b - h > 30 for t, h, b, _ in rows if (s, n, h) in want and t == s) for s, n in counts}
            assert dict(zip(zip(got["seq"], got["name"]), got["n_late"])) == late
        else:
            assert {(s, n, h) for s, n, h in zip(got["seq"], got["name"], got["h"])} == want and len(got) == len(want)

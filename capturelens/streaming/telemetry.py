"""Streaming forms of a study's incremental steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.sinks import append_new, newest_rows, upsert_table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def telemetry_peak(stream: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Running peak per job and device (update mode): state is one number per key."""
    return stream.groupBy(*keys).agg(F.max(value).alias("peak"), F.count(F.lit(1)).alias("n"))


def telemetry_timeline(
    stream: DataFrame, keys: Sequence[str], ts: str, value: str, window: str = "1 minute", late: str = "30 seconds"
) -> DataFrame:
    """Mean and peak per tumbling window; windows close when the watermark passes (append mode)."""
    return (
        stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, window))
        .agg(F.avg(value).alias("mean"), F.max(value).alias("peak"), F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("window.start").alias("start"), "mean", "peak", "n")
    )


def select_on_event_time(
    stream: DataFrame, header: str, arrival: str, start: Column, end: Column, lag: str = "30 seconds"
) -> DataFrame:
    """Rows whose event stamp lies in the window, read past it by the recording lag.

    The arrival clock bounds what is read, the event clock decides; rows that arrive later than
    the lag are marked late.
    """
    patience = F.expr(f"INTERVAL {lag}")
    return (
        stream.where((F.col(arrival) >= start) & (F.col(arrival) <= end + patience))
        .where(F.col(header).between(start, end))
        .withColumn("late", F.col(arrival) - F.col(header) > patience)
    )


def rows_in_windows(
    rows: DataFrame, windows: DataFrame, by: Sequence[str], header: str, arrival: str, start: str, end: str,
    lag: str = "30 seconds", longest: str = "10 minutes", bucket: int = 60,
) -> DataFrame:
    """Rows of one stream in the windows of another: each row once for every window that holds its event stamp.

    Windows may come before or after their rows and may overlap. Both wait in state until the watermark, ``lag``
    behind the newest event stamps, has passed all they could still meet; windows are at most ``longest`` (longer
    ones meet nothing before their last stretch of that length). ``late`` marks rows that arrived later than the
    lag but still in time. Rows and windows meet in buckets of so many seconds, so a busy sequence is spread over
    many tasks. Rows without a key or stamp are in no window.
    """
    place = lambda c: F.floor(F.unix_seconds(c) / bucket)
    spread = windows.withWatermark(end, lag).withColumn("_at", F.explode(F.sequence(
        place(F.greatest(F.col(start), F.col(end) - F.expr(f"INTERVAL {longest}"))), place(F.col(end)))))
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(by)]
    named = spread.select(*keys, "_at", *[c for c in windows.columns if c not in by])
    stamped = rows.withWatermark(header, lag).withColumn("_of", place(F.col(header)))
    met = (F.col("_of") == F.col("_at")) & (F.col(header) >= F.col(start)) & (F.col(header) <= F.col(end))
    met = met & (F.col(header) >= F.col(end) - F.expr(f"INTERVAL {longest}"))
    for i, k in enumerate(by):
        met = met & (F.col(k) == F.col(f"_k{i}"))
    joined = stamped.join(named, met).drop("_of", "_at", *[f"_k{i}" for i in range(len(by))])
    return joined.withColumn("late", F.col(arrival) - F.col(header) > F.expr(f"INTERVAL {lag}"))


def closed_windows(joined: DataFrame, by: Sequence[str], window_id: str, end: str, value: str) -> DataFrame:
    """One row per window once the watermark has passed its end and the lag: rows, late rows, mean and peak. Windows
    without rows give none."""
    return joined.groupBy(*by, window_id, end).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("late").alias("n_late"), F.avg(value).alias("mean"), F.max(value).alias("peak"))


def dedup_within_lag(stream: DataFrame, keys: Sequence[str], header: str, lag: str = "30 seconds") -> DataFrame:
    """Drop messages sent again within the recording lag; older keys leave the state."""
    return stream.withWatermark(header, lag).dropDuplicatesWithinWatermark(list(keys))


def upsert_stream(stream: DataFrame, path: str, keys: Sequence[str], version: str, checkpoint: str) -> StreamingQuery:
    """Upsert result rows by run key; the row of the highest version counts, in a batch and in the table."""

    def write(batch: DataFrame, _: int) -> None:
        upsert_table(newest_rows(batch, keys, version), path, keys, version)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_once_stream(
    stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str, order: str | None = None,
) -> StreamingQuery:
    """Accept each key once, for good: the target decides, so a repeated batch changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        append_new(batch, path, keys, order)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_log(batch: DataFrame, key: str, prefix: str, exclude: Sequence[str]) -> DataFrame:
    """Entries under a prefix, the prefix cut off; a key that is part of an excluded text is left out."""
    chosen = batch.where(F.col(key).startswith(prefix))
    for text in exclude:
        chosen = chosen.where(~F.lit(text).contains(F.col(key)))
    return chosen.withColumn(key, F.expr(f"substring({key}, {len(prefix) + 1})"))


def dispatch_log(
    stream: DataFrame, key: str, sinks: dict[str, tuple[str, Sequence[str]]], checkpoint: str
) -> StreamingQuery:
    """One stream to several tables by key prefix: ``prefix -> (path, excluded texts)``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        for prefix, (path, exclude) in sinks.items():
            split_log(batch, key, prefix, exclude).withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(
                f"{path}/batch={batch_id}"
            )

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Attempts(StatefulProcessor):
    """The open attempt of one run; it is emitted when the next one starts or the run ends.

    Lines are handled once no earlier line can still come: until the watermark passes them they wait
    in the state, so a line that arrives after its successors is counted where it belongs. A run that
    falls silent emits its open attempt when its timer runs out; the attempt number goes on if the
    run does.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "attempt bigint, first_line bigint, n_after bigint, discarded string, is_open boolean")
        self.waiting = handle.getListState("waiting", "line bigint, at_ms bigint, role string, reason string")

    def _emit(self, run: Any, state: tuple) -> pd.DataFrame:
        return pd.DataFrame(
            {"run": [run], "attempt": [state[0]], "first_line": [state[1]], "n_after": [state[2]], "discarded": [state[3]]}
        )

    def _advance(self, run: Any, lines: list[tuple]) -> Iterator[pd.DataFrame]:
        state = tuple(self.open.get()) if self.open.exists() else (0, 0, 0, None, False)
        for line, _, role, reason in sorted(lines, key=lambda x: x[0]):
            if role == "start":
                if state[4]:
                    yield self._emit(run, state)
                state = (state[0] + 1, int(line), 0, None, True)
            elif state[4] and role == "step":
                state = (state[0], state[1], state[2] + 1, state[3], True)
            if state[4] and isinstance(reason, str) and state[3] is None:
                state = (*state[:3], reason, True)
            if role == "end" and state[4]:
                yield self._emit(run, state)
                state = (*state[:4], False)
        self.open.update(state)

    def _keep(self, waiting: list[tuple], timer: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.waiting.clear()
        if waiting:
            self.waiting.put(waiting)
        self.handle.registerTimer(timer)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        for part in rows:
            texts = [r if isinstance(r, str) else None for r in part["reason"]]
            waiting += list(zip(map(int, part["line"]), map(int, part["at_ms"]), part["role"], texts))
        self._keep(waiting, min(w[1] for w in waiting))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        ready = [w for w in waiting if w[1] <= mark]
        rest = [w for w in waiting if w[1] > mark]
        if ready:
            yield from self._advance(key[0], ready)
            self._keep(rest, min(w[1] for w in rest) if rest else max(w[1] for w in ready) + self.idle_ms)
        elif not waiting and self.open.exists():
            state = tuple(self.open.get())
            if state[4]:
                yield self._emit(key[0], state)
                self.open.update((*state[:4], False))

    def close(self) -> None:
        pass


def attempts_stream(log: DataFrame, time: str, late: str = "1 minute", idle: str = "1 hour") -> DataFrame:
    """Attempts of a live log ``run, line, role, reason`` with event time ``time``; closed ones only.

    Roles are ``start``, ``step``, ``end`` (of the run) and any other. The state of a run is one small
    row and the lines of the last ``late``.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    timed = log.withWatermark(time, late).withColumn("at_ms", F.unix_millis(time))
    return timed.groupBy("run").transformWithStateInPandas(
        statefulProcessor=Attempts(idle_ms),
        outputStructType="run bigint, attempt bigint, first_line bigint, n_after bigint, discarded string",
        outputMode="append",
        timeMode="eventTime",
    )


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame], Any], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over everything that is there; each micro-batch goes to ``sink``."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: sink(df))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()

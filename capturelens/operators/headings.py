"""Passes along a corridor: runs of moving samples whose heading stays near that of the run's first sample.

For each sample the next one outside its heading cone is found: inside a block of samples by looking at it,
beyond it in a tree of ranges whose nodes hold the smallest arc of headings below them. A node whose arc lies
in the cone is skipped, so a search goes up the tree until a node does not fit and down to the sample. The
samples where a run begins are those met when following these pointers from the start of a stretch: the
pointers that leave a block are doubled until every block knows where it is entered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_through
from .ordered import Ordered, running_sum

BLOCK = 1024  # samples of a block, and nodes below a node of the tree

KEY = ["key", "stretch"]
ASK = "array<struct<ord: bigint, yaw: double>>"


def away(headings: np.ndarray, first: np.ndarray | float) -> np.ndarray:
    """Signed difference of headings in [-180, 180)."""
    return (headings - first + 180.0) % 360.0 - 180.0


def covering_arc(low: np.ndarray, high: np.ndarray) -> tuple[float, float]:
    """Ends of the smallest arc that holds all these arcs, each counter-clockwise from low to high; NaN if an
    arc is not known or all of the circle is covered."""
    if np.isnan(low).any() or np.isnan(high).any():
        return np.nan, np.nan
    order = np.argsort(low % 360.0, kind="stable")
    low, high = low[order], high[order]
    start = low % 360.0
    end = start + (high - low) % 360.0
    around = int(end.argmax())  # this arc may go on past 360 degrees, over the first ones
    upto = np.maximum.accumulate(np.append(end[around] - 360.0, end))[1:]
    last = np.maximum.accumulate(np.where(end == upto, np.arange(len(end)), -1))
    gaps = np.append(start[1:], start[0] + 360.0) - upto
    at = int(gaps.argmax())
    if gaps[at] <= 1e-9:
        return np.nan, np.nan
    return float(low[(at + 1) % len(low)]), float(high[last[at] if last[at] >= 0 else around])


def in_cone(yaw: np.ndarray, low: np.ndarray, high: np.ndarray, turn: float) -> np.ndarray:
    """Whether the arcs (columns) lie inside the cones around the headings (rows)."""
    a, b = away(low[None, :], yaw[:, None]), away(high[None, :], yaw[:, None])
    return (np.abs(a) < turn) & (np.abs(b) < turn) & (a <= b + 1e-9)


def following(yaw: np.ndarray, turn: float) -> np.ndarray:
    """For each sample of a block the next one outside its cone, or the number of samples."""
    n = len(yaw)
    out = ~(np.abs(away(yaw[None, :], yaw[:, None])) < turn)
    out &= np.arange(n)[None, :] > np.arange(n)[:, None]
    return np.where(out.any(axis=1), out.argmax(axis=1), n)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def mapped(df: DataFrame, fn: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """Rows to rows; each holds a block or the nodes below one node, so the work in it is array work."""
    names = [part.split()[0] for part in schema.split(", ") if " " in part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = empty_schema
        for row in rows_of(batches):
            out = fn(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=types)

    kinds = {
        "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
        "asks": pa.list_(pa.struct([("ord", pa.int64()), ("yaw", pa.float64())])),
    }
    fields = [part.split() for part in schema.split(", ")]
    empty_schema = pa.schema([(name, kinds[kind]) for name, kind in fields])
    spark_schema = ", ".join(f"{name} {ASK if kind == 'asks' else kind}" for name, kind in fields)
    return df.mapInArrow(run, spark_schema).select(*names)


def by_target(row: dict, found: np.ndarray, nodes: np.ndarray, asks: list[dict]) -> list[dict]:
    """The questions of a row, grouped by the node (a place in ``nodes``) in which each goes on."""
    groups: dict[int, list[dict]] = {}
    for at, ask in zip(found.tolist(), asks):
        groups.setdefault(int(nodes[at]), []).append(ask)
    return [{**{k: row[k] for k in KEY}, "node": n, "asks": g} for n, g in groups.items()]


def open_asks(turn: float):
    """A block to the questions that it can not answer: samples with nothing outside their cone behind them."""
    def fn(row: dict) -> list[dict]:
        yaw = np.array([s["yaw"] for s in row["samples"]], float)
        asks = [s for s, nxt in zip(row["samples"], following(yaw, turn)) if nxt == len(yaw)]
        return [{"key": row["key"], "stretch": row["stretch"], "node": row["node"], "asks": asks}]

    return fn


def arcs_of_block(row: dict) -> list[dict]:
    yaw = np.array([s["yaw"] for s in row["samples"]], float)
    low, high = covering_arc(yaw, yaw)
    return [{"key": row["key"], "stretch": row["stretch"], "node": row["node"], "low": low, "high": high}]


def arc_of_nodes(row: dict) -> list[dict]:
    low, high = covering_arc(*(np.array([a[c] for a in row["below"]], float) for c in ("low", "high")))
    return [{"key": row["key"], "stretch": row["stretch"], "node": row["up"], "low": low, "high": high}]


def upwards(turn: float):
    """Questions of a node and its siblings: they go on in the first later sibling that does not fit (``found``), or
    in the node above."""
    def fn(row: dict) -> list[dict]:
        nodes, low, high = (np.array([a[c] for a in row["below"]]) for c in ("node", "low", "high"))
        asks = row["asks"]
        bad = ~in_cone(np.array([a["yaw"] for a in asks], float), low.astype(float), high.astype(float), turn) & (nodes > row["node"])[None, :]
        hit = bad.any(axis=1)
        out = [{**r, "found": True} for r in by_target(row, bad.argmax(axis=1)[hit], nodes, [a for a, h in zip(asks, hit) if h])]
        rest = [a for a, h in zip(asks, hit) if not h]
        return out + ([{"key": row["key"], "stretch": row["stretch"], "node": row["up"], "asks": rest, "found": False}] if rest else [])

    return fn


def downwards(turn: float):
    """Questions of a node that does not fit go on in the first node below that does not."""
    def fn(row: dict) -> list[dict]:
        nodes, low, high = (np.array([a[c] for a in row["below"]]) for c in ("node", "low", "high"))
        bad = ~in_cone(np.array([a["yaw"] for a in row["asks"]], float), low.astype(float), high.astype(float), turn)
        return by_target(row, bad.argmax(axis=1), nodes, row["asks"])

    return fn


def answers(turn: float):
    """Questions that end in a block: the first sample outside the cone."""
    def fn(row: dict) -> list[dict]:
        samples = row["samples"]
        yaw = np.array([s["yaw"] for s in samples], float)
        asked = np.array([a["yaw"] for a in row["asks"]], float)
        at = (~(np.abs(away(yaw[None, :], asked[:, None])) < turn)).argmax(axis=1)
        return [
            {"key": row["key"], "stretch": row["stretch"], "ord": a["ord"], "nxt": samples[i]["ord"]} for a, i in zip(row["asks"], at.tolist())]

    return fn


def walked(turn: float, whole: bool):
    """From each entry of a block: where its walk leaves the block, or (``whole``) every sample where a run begins."""
    def fn(row: dict) -> list[dict]:
        first = row["samples"][0]["ord"]
        yaw = np.array([s["yaw"] for s in row["samples"]], float)
        nxt = following(yaw, turn)
        out = []
        for entry in sorted(row["entries"]):
            at = entry - first
            while nxt[at] < len(yaw):
                if whole:
                    out.append({"key": row["key"], "stretch": row["stretch"], "entry": entry, "ord": first + int(at)})
                at = nxt[at]
            out.append({"key": row["key"], "stretch": row["stretch"], "entry": entry, "ord": first + int(at)})
        return out

    return fn


NODE_SCHEMA = "key string, stretch bigint, node bigint, low double, high double"
ASK_SCHEMA = "key string, stretch bigint, node bigint, asks asks"
WALK_SCHEMA = "key string, stretch bigint, entry bigint, ord bigint"


def below(nodes: DataFrame, fan: int) -> DataFrame:
    """The nodes below each node ``up``, in order; at most ``fan`` of them."""
    held = F.array_sort(F.collect_list(F.struct("node", "low", "high")))
    return nodes.groupBy(*KEY, F.expr(f"node div {fan}").alias("up")).agg(held.alias("below"))


def first_outside(blocks: DataFrame, turn: float, fan: int) -> DataFrame:
    """``key, stretch, ord, nxt``: for samples whose block has none, the first sample of a later block outside their
    cone; samples without one are not listed. ``blocks`` are those of stretches of several blocks."""
    asks = mapped(blocks, open_asks(turn), ASK_SCHEMA)
    nodes = write_through(mapped(blocks, arcs_of_block, NODE_SCHEMA), "arcs")
    trees, found = [], []
    while True:
        tree = write_through(below(nodes, fan), "tree")
        trees.append(tree)
        moved = asks.withColumn("up", F.expr(f"node div {fan}")).join(tree, [*KEY, "up"])
        step = write_through(mapped(moved, upwards(turn), ASK_SCHEMA + ", found boolean"), "asks")
        found.append(step.where("found").drop("found"))
        asks = step.where("NOT found").drop("found")
        if tree.groupBy(*KEY).count().where("count > 1").isEmpty():
            break
        nodes = write_through(mapped(tree, arc_of_nodes, NODE_SCHEMA), "arcs")
    down = found.pop()
    while found:
        tree = trees[len(found) - 1]
        on = down.withColumnRenamed("node", "up").join(tree, [*KEY, "up"])
        down = mapped(on, downwards(turn), ASK_SCHEMA).unionByName(found.pop())
    return mapped(down.join(blocks, [*KEY, "node"]), answers(turn), "key string, stretch bigint, ord bigint, nxt bigint")


def entries_of(places: DataFrame, fan: int) -> DataFrame:
    return places.groupBy(*KEY, F.expr(f"ord div {fan}").alias("node")).agg(F.collect_set("ord").alias("entries"))


def run_starts(samples: DataFrame, turn: float, fan: int) -> DataFrame:
    """``key, ord`` of the samples where a run begins; samples are ``key, stretch, ord, yaw``."""
    dealt = samples.groupBy(*KEY, F.expr(f"ord div {fan}").alias("node"))
    blocks = write_through(dealt.agg(F.array_sort(F.collect_list(F.struct("ord", "yaw"))).alias("samples")), "heading-blocks")
    starts = blocks.groupBy(*KEY).agg(F.min(F.col("samples")[0]["ord"]).alias("ord"), F.count(F.lit(1)).alias("blocks"))
    starts = write_through(starts, "stretch-starts")
    long = starts.where("blocks > 1")
    reached = starts.select(*KEY, "ord")
    if not long.isEmpty():
        several = blocks.join(long.select(*KEY), KEY, "left_semi")
        nxt = write_through(first_outside(several, turn, fan), "pointers")
        places = long.select(*KEY, "ord").union(nxt.select(*KEY, "nxt")).distinct()
        leave = mapped(several.join(entries_of(places, fan), [*KEY, "node"]), walked(turn, False), WALK_SCHEMA)
        ptr = write_through(leave.join(nxt, [*KEY, "ord"]).select(*KEY, F.col("entry").alias("ord"), "nxt"), "pointers")
        while not ptr.isEmpty():
            reached = write_through(reached.union(reached.join(ptr, [*KEY, "ord"]).select(*KEY, "nxt")).distinct(), "reached")
            then = ptr.select(*KEY, F.col("ord").alias("nxt"), F.col("nxt").alias("then"))
            ptr = write_through(ptr.join(then, [*KEY, "nxt"]).select(*KEY, "ord", F.col("then").alias("nxt")), "pointers")
    return mapped(blocks.join(entries_of(reached, fan), [*KEY, "node"]), walked(turn, True), WALK_SCHEMA).select("key", "ord")


def heading_runs(moving: DataFrame, seq: str, t: str, x: str, y: str, speed: str, yaw: str, turn: float, fan: int = BLOCK) -> DataFrame:
    """Runs of the moving samples (``seq, stretch, ord`` and the named columns): ``run_start, n``, ends and speeds.

    A sample without a heading is in no cone and begins a run. The cone is at most a half circle.
    """
    if not 0 < turn <= 90:
        raise ValueError("turn must be above 0 and at most 90 degrees")
    named = moving.select(
        F.coalesce(F.concat(F.lit("="), F.col(seq).cast("string")), F.lit("")).alias("key"), F.col(seq).alias("_seq"), "stretch", "ord",
        *[F.col(c).cast("double").alias(a) for a, c in (("t", t), ("x", x), ("y", y), ("v", speed), ("yaw", yaw))])
    rows = write_through(named, "moving")
    starts = run_starts(rows.select(*KEY, "ord", "yaw"), turn, fan).withColumn("_new", F.lit(1).cast("bigint"))
    flagged = rows.join(starts, ["key", "ord"], "left")
    placed = Ordered(flagged, ["key"], ["ord"]).add(run=running_sum(F.coalesce("_new", F.lit(0)))).df
    at = F.struct("t", "x", "y")
    runs = placed.groupBy("key", "run").agg(
        F.first("_seq").alias(seq), F.min("ord").alias("run_start"), F.count(F.lit(1)).alias("n"),
        F.min_by(at, "ord").alias("a"), F.max_by(at, "ord").alias("b"), F.sum("v").alias("v_sum"))
    return runs.select(
        seq, "run_start", "n", F.col("a.t").alias("t0"), F.col("b.t").alias("t1"), F.col("a.x").alias("x0"), F.col("a.y").alias("y0"),
        F.col("b.x").alias("x1"), F.col("b.y").alias("y1"), "v_sum")

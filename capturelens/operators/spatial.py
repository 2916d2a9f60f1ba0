"""Nearest neighbours and containment in the plane and in space.

Neighbours are found by a best-first search over a pyramid of cell counts. The smallest own cell of a
query with enough sites bounds the distance it has to look; from cells of about that size it goes down to
leaves of few sites, dropping cells by their nearest corner and tightening the bound by the counts of the
others. Sites are touched in the leaves that are left only. Sites and queries at the same place are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_through
from .ordered import Ordered, attach, dealt, following, last_known, ordinal

CELL_SITES = 64  # places in a leaf, at most
FINER = 3  # halvings that cells with more places take at once
DIRECTIONS = 24  # in which extreme points are looked for
DEEPEST = 40  # halvings of the extent; places in one cell of that grid differ in their last bits only


def _box(level: Column, extent: float) -> Column:
    return F.lit(extent) / F.pow(F.lit(2.0), level)


class Pyramid:
    """Numbers of sites in the cells of ever finer grids; cells with few places are leaves.

    The first pass counts all grids down to the one that would hold a few places a cell if they were spread
    evenly; only what is denser goes on to finer ones. ``by`` are the group columns, sites are places
    ``_s0, …`` with a list ``_ids``.
    """

    def __init__(self, few: DataFrame, by: list[str], origin: list[float], extent: float):
        self.by, self.origin, self.extent, self.dims = by, origin, extent, len(origin)
        self.g = [f"_g{i}" for i in range(self.dims)]
        few = write_through(few, "places")
        self.first = max(0, min(20, math.ceil(math.log2(max(1, few.count()) / 8) / self.dims))) if few.count() > 8 else 0
        low, high, cells, leaves = 0, self.first, [], []
        while True:
            at = few.withColumn("_level", F.explode(F.array(*[F.lit(i) for i in range(low, high + 1)])))
            counted = self.placed(at, self.sites).groupBy(*by, "_level", *self.g).agg(
                F.sum(F.size("_ids")).alias("_w"), F.count(F.lit(1)).alias("_places"))
            done = (F.col("_level") == high) & ((F.col("_places") <= CELL_SITES) | (F.col("_level") >= DEEPEST))
            counted = write_through(counted.withColumn("_leaf", done), "cells")
            cells.append(counted)
            full = counted.where((F.col("_level") == high) & ~F.col("_leaf")).select(*by, *self.g)
            here = self.placed(few.withColumn("_level", F.lit(high)), self.sites)
            leaves.append(here.join(full, [*by, *self.g], "left_anti").select(*few.columns, "_level", *self.g))
            if full.isEmpty():
                break
            few = write_through(here.join(full, [*by, *self.g], "left_semi").select(*few.columns), "places")
            low, high = high + 1, high + FINER
        self.last = high
        self.cells, self.leaves = reduce(DataFrame.union, cells), reduce(DataFrame.union, leaves)

    @property
    def sites(self) -> list[str]:
        return [f"_s{i}" for i in range(self.dims)]

    @property
    def asks(self) -> list[str]:
        return [f"_c{i}" for i in range(self.dims)]

    def placed(self, df: DataFrame, coords: list[str]) -> DataFrame:
        """Adds the cell of a place at its ``_level``."""
        side = _box(F.col("_level"), self.extent)
        return df.withColumns({
            g: F.floor((F.col(c) - F.lit(o)) / side).cast("bigint") for g, c, o in zip(self.g, coords, self.origin)})

    def bounds(self) -> tuple[Column, Column]:
        """Squares of the smallest and the largest distance from a query to its row's cell."""
        side, slack = _box(F.col("_level"), self.extent), F.lit(self.extent * 1e-12)
        near, far = F.lit(0.0), F.lit(0.0)
        for g, c, o in zip(self.g, self.asks, self.origin):
            low = F.lit(o) + F.col(g) * side
            high = low + side
            gap = F.greatest(low - F.col(c), F.col(c) - high, F.lit(0.0)) - slack
            reach = F.greatest(F.abs(F.col(c) - low), F.abs(F.col(c) - high)) + slack
            near = near + F.when(gap > 0, gap * gap).otherwise(0.0)
            far = far + reach * reach
        return near, far

    def start(self, asked: DataFrame, need: int) -> DataFrame:
        """The cells each query begins with, and ``_tau``: the square of a distance within which it surely has
        ``need`` sites. That is the size of its smallest own cell with so many; the search begins in cells of
        about that size."""
        near, far = self.bounds()
        levels = F.explode(F.array(*[F.lit(i) for i in range(self.last + 1)]))
        own = self.placed(asked.withColumn("_level", levels), self.asks)
        met = own.join(self.cells.where(F.col("_w") >= need).select(*self.by, "_level", *self.g), [*self.by, "_level", *self.g])
        known = met.groupBy(*self.by, *self.asks).agg(F.min(far).alias("_tau"), F.max("_level").alias("_own"))
        begun = attach(asked, known, [*self.by, *self.asks])
        wide = F.floor(-F.log2(F.sqrt("_tau") / F.lit(self.extent)))
        level = F.greatest(F.least(F.coalesce(wide, F.lit(0)), F.coalesce("_own", F.lit(0))), F.lit(0)).cast("int")
        begun = begun.select(*self.by, *self.asks, F.coalesce("_tau", F.lit(float("inf"))).alias("_tau"), level.alias("_level"))
        moves = F.explode(F.array(*[F.array(*[F.lit(d).cast("bigint") for d in m]) for m in product((-1, 0, 1), repeat=self.dims)]))
        around = self.placed(begun, self.asks).withColumn("_m", moves).withColumns(
            {g: F.col(g) + F.col("_m")[i] for i, g in enumerate(self.g)}).drop("_m").where(near <= F.col("_tau"))
        # where the grid ends above that level, the leaf that covers the cell takes its place
        ends = [i for i in range(self.first, self.last + 1, FINER)]
        up = F.array_append(F.filter(F.array(*[F.lit(i) for i in ends]), lambda i: i < F.col("_level")), F.col("_level"))
        wanted = around.withColumn("_of", F.col("_level")).withColumn("_at", F.explode(up)).withColumns(
            {g: F.floor(F.col(g) / F.pow(F.lit(2.0), F.col("_level") - F.col("_at"))).cast("bigint") for g in self.g})
        wanted = wanted.drop("_level").withColumnRenamed("_at", "_level")
        found = wanted.join(self.cells, [*self.by, "_level", *self.g]).where((F.col("_level") == F.col("_of")) | F.col("_leaf"))
        return found.select(*self.by, *self.asks, "_tau", "_level", *self.g, "_w", "_leaf").distinct()

    def finer(self, front: DataFrame, need: int) -> DataFrame:
        """Cells that are no leaves become those below them, and all that are surely too far go."""
        near, far = self.bounds()
        up = {f"_p{i}": F.floor(F.col(g) / 2).cast("bigint") for i, g in enumerate(self.g)}
        children = self.cells.withColumns(up).withColumn("_up", F.col("_level") - 1).select(
            *self.by, "_level", *self.g, "_w", "_leaf", F.col("_up"), *up)
        inner = front.where("NOT _leaf").select(
            *self.by, *self.asks, "_tau", F.col("_level").alias("_up"), *[F.col(g).alias(p) for g, p in zip(self.g, up)])
        both = front.where("_leaf").unionByName(
            inner.join(children, [*self.by, "_up", *up]).select(*front.columns))
        query = Window.partitionBy(*self.by, *self.asks)
        upto = F.sum("_w").over(query.orderBy("_far", "_level", *self.g))
        enough = both.withColumns({"_near": near, "_far": far}).withColumn("_sum", upto)
        tau = F.min(F.when(F.col("_sum") >= need, F.col("_far"))).over(query)
        closer = enough.withColumn("_tau", F.least(F.col("_tau"), tau))
        return closer.where(F.col("_near") <= F.col("_tau")).select(*front.columns)

    def reached(self, asked: DataFrame, need: int) -> DataFrame:
        """Query places with the leaves that may hold one of their ``need`` nearest."""
        front = self.start(asked, need)
        while True:
            front = write_through(self.finer(self.finer(front, need), need), "front")
            if front.where("NOT _leaf").isEmpty():
                return front

    def nearest(self, asked: DataFrame, need: int) -> DataFrame:
        """The ``need`` nearest sites in each leaf that a query place reaches, as ``_near`` (d, id). A leaf is one row with
        its few sites, so that a task sorts query places and leaves, and no pairs."""
        cell = [*self.by, "_level", *self.g]
        front = self.reached(asked, need)
        front, leaves = dealt(cell, front, self.leaves, within=front)
        # places that no grid tells apart may be many: they are listed in parts
        part = F.when(F.col("_level") >= DEEPEST, F.pmod(F.xxhash64(*self.sites), F.lit(4096))).otherwise(0)
        sites = leaves.select(*cell, part.alias("_part"), *self.sites, F.explode("_ids").alias("_id"))
        listed = sites.groupBy(*cell, "_part").agg(F.collect_list(F.struct(*self.sites, "_id")).alias("_sites"))
        far = lambda s: F.sqrt(sum(((F.col(c) - s[n]) * (F.col(c) - s[n]) for c, n in zip(self.asks, self.sites)), F.lit(0.0)))
        met = F.transform("_sites", lambda s: F.struct(far(s).alias("d"), s["_id"].alias("id")))
        near = front.join(listed, cell).select(*self.by, *self.asks, F.slice(F.sort_array(met), 1, need).alias("_near"))
        return dealt([*self.by, *self.asks], near)[0]

    def candidates(self, asked: DataFrame, need: int) -> DataFrame:
        """Query places with the places that may be among their ``need`` nearest."""
        return self.reached(asked, need).join(self.leaves, [*self.by, "_level", *self.g])


def site_places(sites: DataFrame, by: list[str], coords: Sequence[str], site_id: str, need: int) -> DataFrame:
    """Sites at one place with the smallest ids there: only so many can be an answer."""
    names = [f"_s{i}" for i in range(len(coords))]
    return (
        sites.select(*by, *[F.col(c).cast("double").alias(s) for c, s in zip(coords, names)], F.col(site_id).alias("_id"))
        .where(_finite(names))
        .groupBy(*by, *names, F.pmod(F.xxhash64("_id"), F.lit(64)).alias("_salt"))
        .agg(F.slice(F.array_sort(F.collect_set("_id")), 1, need).alias("_ids"))
        .groupBy(*by, *names)
        .agg(F.slice(F.array_sort(F.flatten(F.collect_list("_ids"))), 1, need).alias("_ids"))
    )


def _finite(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.abs(F.col(c)) < float("inf") for c in names])


def _pyramid(queries: DataFrame, sites: DataFrame, by: list[str], coords: Sequence[str], site_id: str, need: int) -> tuple[Pyramid, DataFrame]:
    """The counts of the sites, and the places of queries (``_c0, …``)."""
    asks = [f"_c{i}" for i in range(len(coords))]
    asked = queries.select(*by, *[F.col(c).cast("double").alias(a) for c, a in zip(coords, asks)]).where(_finite(asks)).distinct()
    few = site_places(sites, by, coords, site_id, need)
    both = few.select(*[F.col(f"_s{i}").alias(a) for i, a in enumerate(asks)]).union(asked.select(*asks))
    ends = both.agg(*[f(c).alias(f"{m}{c}") for c in asks for m, f in (("lo", F.min), ("hi", F.max))]).first()
    if ends is None or ends[f"lo{asks[0]}"] is None:
        extent, origin = 1.0, [0.0] * len(coords)
    else:
        origin = [float(ends[f"lo{c}"]) for c in asks]
        extent = max(float(ends[f"hi{c}"]) - o for c, o in zip(asks, origin)) * 1.000001 or 1.0
    return Pyramid(few, by, origin, extent), asked


def search_pairs(queries: DataFrame, sites: DataFrame, by: list[str], coords: Sequence[str], site_id: str, need: int) -> DataFrame:
    """Places of queries (``_c0, …``) with the places of sites (``_s0, …``) they are compared with."""
    counts, asked = _pyramid(queries, sites, by, coords, site_id, need)
    return counts.candidates(asked, need)


def nearest(
    queries: DataFrame,
    sites: DataFrame,
    by: Sequence[str],
    coords: Sequence[str],
    query_id: str,
    site_id: str,
    k: int = 1,
    exclude_self: bool = False,
) -> DataFrame:
    """Exact ``k`` nearest sites of each query in its group: ``by, query_id, rank, site_id, dist``.

    Equal distances are ordered by site id. Queries of a group without sites give no rows, nor do places
    that are not finite or groups that are null.
    """
    by, need = list(by), k + exclude_self
    asks = [f"_c{i}" for i in range(len(coords))]
    counts, asked = _pyramid(queries, sites, by, coords, site_id, need)
    found = counts.nearest(asked, need).select(*by, *asks, F.explode("_near").alias("_n"))
    top = _smallest(found.select(*by, *asks, F.col("_n.d").alias("_d"), F.col("_n.id").alias("_id")), [*by, *asks], need)
    named = queries.select(*by, F.col(query_id).alias("_q"), *[F.col(c).cast("double").alias(a) for c, a in zip(coords, asks)])
    mine = named.join(top, [*by, *asks])
    others = F.filter("_top", lambda s: s["id"] != F.col("_q")) if exclude_self else F.col("_top")
    out = mine.select(*by, F.col("_q").alias(query_id), F.posexplode(F.slice(others, 1, k)).alias("_r", "_t"))
    return out.select(
        *by, query_id, (F.col("_r") + 1).cast("bigint").alias("rank"),
        F.col("_t.id").alias(site_id if site_id != query_id else "neighbour"), F.col("_t.d").alias("dist"),
    )


def _smallest(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k nearest of each query; row limits are pushed below the shuffle by the optimizer."""
    w = Window.partitionBy(*keys).orderBy("_d", "_id")
    ranked = found.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    pair = F.struct(F.col("_d").alias("d"), F.col("_id").alias("id"))
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(pair)).alias("_top"))


def knn_scale(points: DataFrame, by: Sequence[str], point_id: str, coords: Sequence[str], k: int = 3) -> DataFrame:
    """Root mean square distance of each point to its ``k`` nearest others, at least 1e-7."""
    found = nearest(points, points, by, coords, point_id, point_id, k, exclude_self=True)
    return found.groupBy(*by, point_id).agg(
        F.greatest(F.sqrt(F.avg(F.col("dist") * F.col("dist"))), F.lit(1e-7)).alias("scale")
    )


def points_in_boxes(points: DataFrame, boxes: DataFrame, box_id: str, x: str, y: str, cell: float) -> DataFrame:
    """Number of points inside each closed box ``x0, x1, y0, y1``.

    A box meets cells as wide as itself, by doublings of ``cell``, so it lies in four of them at most;
    a place is looked up once for each width that occurs.
    """
    at = points.select(F.col(x).alias("_x"), F.col(y).alias("_y")).groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_n"))
    longest = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).cast("double") / cell
    sized = boxes.withColumn("_class", F.ceil(F.log2(F.greatest(longest, F.lit(1.0)))).cast("int"))
    classes = [r[0] for r in sized.select("_class").where("_class is not null").distinct().collect()] or [0]  # doublings
    place = lambda c: F.floor(c / (F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_class")))).cast("bigint")
    counted = at.withColumn("_class", F.explode(F.array(*[F.lit(c) for c in sorted(classes)]))).withColumns(
        {"_gx": place(F.col("_x")), "_gy": place(F.col("_y"))}
    )
    span = lambda a, b: F.explode(F.sequence(place(F.col(a)), F.greatest(place(F.col(a)), place(F.col(b)))))
    tiles = sized.withColumn("_gx", span("x0", "x1")).withColumn("_gy", span("y0", "y1"))
    inside = F.col("_x").between(F.col("x0"), F.col("x1")) & F.col("_y").between(F.col("y0"), F.col("y1"))
    hits = tiles.join(counted, ["_class", "_gx", "_gy"]).where(inside).groupBy(box_id).agg(F.sum("_n").alias("_n"))
    return boxes.join(hits, box_id, "left").select(
        boxes["*"], F.coalesce("_n", F.lit(0).cast("bigint")).alias("n_inside")
    )


def _chain(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull of a few points, counter-clockwise."""
    ordered = sorted(set(points))
    if len(ordered) < 3:
        return ordered

    def half(seq: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (
                (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1])
                - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])
            ) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(ordered) + half(ordered[::-1])


def _cross(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Positive where p lies left of the line from a to b."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def _between(points: list[tuple[float, float]], a: tuple[float, float], b: tuple[float, float]) -> list[tuple[float, float]]:
    """Hull corners from a (with it) to b (without it), counter-clockwise; the points lie right of a to b."""
    ring = _chain([a, b, *points])
    ring = ring[ring.index(a):] + ring[: ring.index(a)]
    return ring[: ring.index(b)]


def hull_corners(points: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Hull corners of each group, numbered counter-clockwise.

    The extreme points in fixed directions are corners. What lies inside their polygon goes before anything is
    shuffled; the rest lies outside one of its sides, and the corners between the two ends of a side depend on
    the points outside that side only. So a group is dealt over as many tasks as it has sides, and each task
    reduces its own rows first. Points that are not finite are left out.
    """
    flat = points.select(group, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(_finite(["x", "y"]))
    at = [2 * math.pi * i / DIRECTIONS for i in range(DIRECTIONS)]
    p = F.struct("x", "y")
    ends = flat.groupBy(group).agg(F.array(*[
        F.max_by(p, F.struct(F.col("x") * math.cos(d) + F.col("y") * math.sin(d), "x", "y")) for d in at]).alias("_ends"))
    sides = ends.select(group, F.array_distinct("_ends").alias("_ends"))
    placed = attach(flat, ends, [group])
    e = F.col("_ends")
    side = F.lit(None).cast("int")
    for i in reversed(range(DIRECTIONS)):
        a, b = e[i], e[(i + 1) % DIRECTIONS]
        side = F.when(_cross(a["x"], a["y"], b["x"], b["y"], F.col("x"), F.col("y")) < 0, i).otherwise(side)
    a, b = F.get(e, F.col("side")), F.get(e, (F.col("side") + 1) % DIRECTIONS)
    outer = placed.withColumn("side", side).where("side IS NOT NULL").select(
        group, "side", "x", "y", a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))
    kind = flat.schema[group].dataType.simpleString()
    ends_of = ["ax", "ay", "bx", "by"]

    def corners(pdf: pd.DataFrame) -> tuple[list[tuple[float, float]], tuple]:
        ax, ay, bx, by = pdf[ends_of].iloc[0].tolist()
        return _between(list(zip(pdf["x"].tolist(), pdf["y"].tolist())), (ax, ay), (bx, by)), (ax, ay, bx, by)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (g, s), part in pdf.groupby([group, "side"], sort=False, dropna=False):
                found, tail = corners(part)
                if len(found) > 1:
                    yield pd.DataFrame([(part[group].iloc[0], s, px, py, *tail) for px, py in found[1:]], columns=[group, "side", "x", "y", *ends_of])

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        found, _ = corners(pdf)
        return pd.DataFrame(
            [(pdf[group].iloc[0], pdf["side"].iloc[0], i + 1, px, py) for i, (px, py) in enumerate(found[1:])],
            columns=[group, "side", "place", "x", "y"])

    local = outer.mapInPandas(partial, f"{group} {kind}, side int, x double, y double, ax double, ay double, bx double, by double")
    chains = local.groupBy(group, "side").applyInPandas(final, f"{group} {kind}, side int, place int, x double, y double")
    firsts = ends.select(group, F.posexplode("_ends").alias("side", "_e")).groupBy(group, "_e").agg(F.max("side").alias("side"), F.min("side").alias("_low"))
    # a corner that is extreme in the last and in the first directions stands before the first side
    wraps = (F.col("side") == DIRECTIONS - 1) & (F.col("_low") == 0)
    run = firsts.withColumn("side", F.when(wraps, -1).otherwise(F.col("side")))
    run = attach(run, sides.select(group, F.size("_ends").alias("_m")), [group])
    run = run.withColumn("side", F.when(F.col("_m") == 1, 0).otherwise(F.col("side")))
    every = run.select(group, "side", F.lit(0).alias("place"), "_e.x", "_e.y").unionByName(chains)
    return Ordered(every, [group], ["side", "place"]).add(corner=ordinal()).df.select(group, "x", "y", F.col("corner").cast("int").alias("corner"))


def points_in_hull(points: DataFrame, hulls: DataFrame, group: str, x: str, y: str, point_id: str) -> DataFrame:
    """Points and whether the hull of their group holds them (its border counts as inside).

    Seen from a place inside the hull, a point is compared with the one side it stands behind, found as the last
    corner before its angle. Groups of fewer than three corners hold nothing, points that are not finite are
    outside.
    """
    first = F.min_by(F.struct("x", "y"), "corner")
    facts = hulls.groupBy(group).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"), F.count(F.lit(1)).alias("_n"), first.alias("_first"))
    facts = facts.where("_n >= 3").drop("_n")
    angle = lambda a, b: F.atan2(b - F.col("_my"), a - F.col("_mx"))
    then = Ordered(hulls, [group], ["corner"]).add(_next=following(F.struct("x", "y"))).df
    ring = attach(then, facts, [group]).where("_mx IS NOT NULL").withColumns({
        "_angle": angle(F.col("x"), F.col("y")), "_side": F.struct(F.struct("x", "y").alias("a"), F.coalesce("_next", "_first").alias("b"))})
    before = ring.groupBy(group).agg(F.max_by("_side", "_angle").alias("_side")).select(group, F.lit(-10.0).alias("_angle"), "_side")
    sides = ring.select(group, "_angle", "_side").unionByName(before)
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    asked = attach(points.select(group, point_id, px.alias("_x"), py.alias("_y")), facts, [group])
    asked = asked.select(group, F.coalesce(angle(F.col("_x"), F.col("_y")), F.lit(-20.0)).alias("_angle"), F.lit(1).alias("_asked"), point_id, "_x", "_y")
    both = sides.withColumn("_asked", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    met = Ordered(both, [group], ["_angle", "_asked", point_id]).add(_s=last_known(F.col("_side"))).df.where("_asked = 1")
    a, b = F.col("_s.a"), F.col("_s.b")
    left = _cross(a["x"], a["y"], b["x"], b["y"], F.col("_x"), F.col("_y")) >= -1e-12
    return met.select(group, point_id, F.coalesce(left & _finite(["_x", "_y"]), F.lit(False)).alias("inside"))

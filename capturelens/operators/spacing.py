"""Greedy spacing of frames, decided in rounds over a grid.

A frame is kept when every earlier frame in reach is dropped, and dropped when an earlier kept frame is in
reach. Frames lie in cells as wide as the distance, cells in tiles with a margin. In a round each tile
looks at the earliest undecided frames of each of its cells, a bounded number, and keeps those whose
earlier neighbours it knows to be dropped; then all frames in reach of a kept one leave. The earliest
undecided frame of a sequence is always decided, and mostly whole tiles are; their borders move from round
to round. No sequence, cell or tile is ever gathered whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_through
from .ordered import Ordered, ordinal

LISTED = 64  # earliest undecided frames of a cell that a round looks at
TILE = 16  # cells along the side of a tile
MARGIN = 2  # cells around a tile that it sees
MERGED = 32  # rounds whose results are written together


def _moves(dims: int, reach: int = 1) -> list[tuple[int, ...]]:
    return list(product(range(-reach, reach + 1), repeat=dims))


def _keeping(dims: int, distance: float):
    """Decides the frames of one tile in order of their rank; returns those that are surely kept."""
    around = _moves(dims)

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        cells = list(zip(*(pdf[f"g{i}"].tolist() for i in range(dims))))
        centres = list(zip(*(pdf[f"c{i}"].tolist() for i in range(dims))))
        kept: dict[tuple, list] = {}
        unsure: dict[tuple, list] = {}
        closed: set[tuple] = set()  # cells with earlier frames that are not listed
        picked = []

        def meets(frames: dict[tuple, list], near: list[tuple], p: tuple) -> bool:
            return any(
                math.sqrt(sum((a - b) * (a - b) for a, b in zip(p, q))) < distance for c in near for q in frames.get(c, ()))

        for cell, p, more, seen in zip(cells, centres, pdf["more"].tolist(), pdf["inner"].tolist()):
            if more:
                closed.add(cell)
                picked.append(False)
                continue
            near = [tuple(a + b for a, b in zip(cell, m)) for m in around]
            sure = False
            if not meets(kept, near, p):
                sure = seen and closed.isdisjoint(near) and not meets(unsure, near, p)
                (kept if sure else unsure).setdefault(cell, []).append(p)
            picked.append(sure)
        return pdf.loc[picked, ["s", "rank", *[f"c{i}" for i in range(dims)]]]

    return keep


def _tiles(frames: DataFrame, dims: int, shift: int) -> DataFrame:
    """Each frame in every tile that sees it; ``inner`` where the tile sees all cells around the frame."""
    def tile(i: int, move: int) -> Column:
        return F.floor((F.col(f"g{i}") + F.lit(shift + move)) / TILE)

    steps = (-MARGIN, 0, MARGIN)
    choices = F.array_distinct(F.array(*[
        F.struct(*[tile(i, steps[m + 1]).alias(f"t{i}") for i, m in enumerate(move)]) for move in _moves(dims)]))
    seen = frames.withColumn("tile", F.explode(choices))
    inner = F.lit(True)
    for i in range(dims):
        first = F.col(f"tile.t{i}") * TILE - shift
        inner = inner & F.col(f"g{i}").between(first - (MARGIN - 1), first + TILE + (MARGIN - 2))
    return seen.withColumn("inner", inner)


def spaced_frames(poses: DataFrame, seq: str, order: str, centre: Sequence[str], distance: float) -> DataFrame:
    """Frames kept in order when they are at least ``distance`` from every kept frame of their sequence.

    Frames equal in ``order`` are taken by their centre; repeated rows count once. Null sequences form one of
    their own, null orders come first, frames without a finite centre are left out. A distance of 0 or less
    keeps every row.
    """
    cols = poses.select(seq, order, *centre)
    if distance <= 0:
        return cols
    dims, side = len(centre), distance * (1 + 1e-9)
    names, cells = [f"c{i}" for i in range(dims)], [f"g{i}" for i in range(dims)]
    finite = F.lit(True)
    for c in names:
        finite = finite & (F.abs(F.col(c)) < float("inf"))
    frames = cols.select(F.col(seq).alias("s"), F.col(order).alias("o"), *[F.col(c).cast("double").alias(n) for c, n in zip(centre, names)])
    frames = frames.where(finite).distinct().withColumns({g: F.floor(F.col(c) / side) for c, g in zip(names, cells)})
    frames = write_through(Ordered(frames, ["s"], ["o", *names]).add(rank=ordinal()).df, "frames")
    undecided, kept, rounds = frames.drop("o"), None, 0
    kinds = {f.name: f.dataType.simpleString() for f in undecided.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("s", "rank", *names))
    first = Window.partitionBy("s", *cells).orderBy("rank")
    while True:
        listed = undecided.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= LISTED + 1)
        seen = _tiles(listed.withColumn("more", F.col("_n") > LISTED), dims, rounds * 7 % TILE)
        new = write_through(seen.groupBy("s", "tile").applyInPandas(_keeping(dims, distance), schema).distinct(), "kept")
        kept, rounds = new if kept is None else kept.union(new), rounds + 1
        if rounds % MERGED == 0:
            kept = write_through(kept, "kept")
        move = F.explode(F.array(*[F.array(*[F.lit(d) for d in m]) for m in _moves(dims)]))
        at = new.select(F.col("s").alias("_s"), *[F.col(c).alias(f"_{c}") for c in names], move.alias("_m")).withColumns(
            {f"_{g}": F.floor(F.col(f"_{c}") / side) + F.col("_m")[i] for i, (c, g) in enumerate(zip(names, cells))})
        near = F.col("s").eqNullSafe(F.col("_s"))
        for g in cells:
            near = near & (F.col(g) == F.col(f"_{g}"))
        square = sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in names), F.lit(0.0))
        undecided = write_through(undecided.join(at, near & (F.sqrt(square) < distance), "left_anti"), "undecided")
        if undecided.isEmpty():
            break
    ours = kept.select(F.col("s").alias("_s"), F.col("rank").alias("_rank"))
    whole = frames.join(ours, F.col("s").eqNullSafe(F.col("_s")) & (F.col("rank") == F.col("_rank")), "left_semi")
    return whole.select(*[F.col(n).cast(cols.schema[c].dataType).alias(c) for n, c in zip(["s", "o", *names], cols.columns)])

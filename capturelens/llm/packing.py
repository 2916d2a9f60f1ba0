"""Variable-capacity best-fit packing of documents into sequences.

The plan is made on the histogram of lengths, which the longest permitted sequence bounds however many
documents there are: best fit, longest first, over groups of equal bins. Bins are opened at the size
that costs least for each token it is likely to hold, given the shorter pieces still to come, and
every bin is cut down to the smallest permitted size of its contents at the end. Documents then find
their bin by their rank among the pieces of their length, counted over ranges.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import running_totals, word_count

SIZES = (512, 1024, 2048, 4096, 8192)


def sequence_cost(size: int) -> float:
    """Cost of one sequence: its tokens, something for the sequence itself, and attention."""
    return size + 64 + size * size / 65536


class OpenBins:
    """Groups of bins (first number, how many) by the room they have left."""

    def __init__(self):
        self.rooms: list[int] = []
        self.groups: dict[int, list[tuple[int, int]]] = {}

    def add(self, room: int, first: int, many: int) -> None:
        if room and many:
            if room not in self.groups:
                insort(self.rooms, room)
            self.groups.setdefault(room, []).append((first, many))

    def tightest(self, length: int) -> tuple[int, int, int] | None:
        """Takes out the group with the least room that holds the length: room, first number, how many."""
        at = bisect_left(self.rooms, length)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        first, many = self.groups[room].pop()
        if not self.groups[room]:
            del self.groups[room], self.rooms[at]
        return room, first, many


def plan_bins(
    histogram: dict[int, int], sizes: Sequence[int] = SIZES, cost: Callable[[int], float] = sequence_cost,
) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, count, first bin, pieces a bin): the pieces of a length whose ranks
    start at ``first rank`` go to the bins from ``first bin`` on, so many to each."""
    sizes = sorted(sizes)
    placed, open_bins, n_bins = [], OpenBins(), 0
    lengths = sorted((x for x, n in histogram.items() if n > 0), reverse=True)
    below = [0] * (sizes[-1] + 1)  # tokens in pieces of at most this length
    for length in range(1, sizes[-1] + 1):
        below[length] = below[length - 1] + length * histogram.get(length, 0)

    def put(length: int, rank: int, count: int, room: int, first: int, many: int) -> int:
        """Fills bins of one group, each as far as it goes; how many pieces found a place."""
        each = room // length
        full = min(many, count // each)
        if full:
            placed.append((length, rank, full * each, first, each))
            open_bins.add(room - each * length, first, full)
        used, rest = full * each, 0
        if full < many and (rest := count - used):
            placed.append((length, rank + used, rest, first + full, rest))
            open_bins.add(room - rest * length, first + full, 1)
        open_bins.add(room, first + full + bool(rest), many - full - bool(rest))
        return used + rest

    def opening_size(length: int, count: int) -> int:
        def price(size: int) -> float:
            each = min(count, size // length)
            bins = -(-count // each)
            room = min(size - each * length, length - 1)
            return cost(size) / min(size, count * length / bins + below[max(0, room)] / bins)

        return min((s for s in sizes if s >= length), key=price)

    for length in lengths:
        rank, left = 0, histogram[length]
        while left:
            group = open_bins.tightest(length)
            if group is None:
                size = opening_size(length, left)
                many = -(-left // (size // length))
                group, n_bins = (size, n_bins, many), n_bins + many
            done = put(length, rank, left, *group)
            rank, left = rank + done, left - done
    return placed


def pack(
    docs: DataFrame, length: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
    sizes: Sequence[int] = SIZES, cost: Callable[[int], float] = sequence_cost,
) -> DataFrame:
    """``bin, bin_size, place, doc_id, piece, first, length``: where each piece of each row lies.

    ``length`` is what a row takes of its bin, in any unit, and the sizes are in the same unit. Bins hold
    tokens only when it counts tokens (``token_counts.token_lengths``); the default counts words as cut
    at ASCII white space and an end mark, so null and empty texts take 1. A null length counts as 0 and
    takes no place. Rows longer than the longest size are cut into
    pieces of that size (``piece``, starting at unit ``first``), nothing is dropped. ``place`` is the
    piece's first unit in its bin. Rows that repeat an id are packed one by one; null ids too.
    """
    top = max(sizes)
    tokens = F.coalesce(word_count(F.col(text_col)) + 1 if length is None else length.cast("bigint"), F.lit(0))
    rows = docs.select(F.col(id_col).alias("doc_id"), tokens.alias("tokens")).where("tokens > 0")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("tokens") - 1, F.lit(top).cast("bigint"))
    pieces = rows.select("doc_id", "tokens", F.posexplode(starts).alias("piece", "first")).select(
        "doc_id", "piece", "first", F.least(F.lit(top), F.col("tokens") - F.col("first")).alias("length"), F.lit(1).alias("one"),
    )
    ranked = running_totals(pieces, ["length"], ["doc_id", "piece"], "one", "rank")
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.sum("one").alias("n")).collect()}
    placements = docs.sparkSession.createDataFrame(
        plan_bins(counts, sizes, cost), "of bigint, from_rank bigint, count bigint, first_bin bigint, each bigint"
    )
    here = (
        (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("from_rank"))
        & (F.col("rank") < F.col("from_rank") + F.col("count"))
    )
    # at most some placements for each of the permitted lengths, whatever the number of rows
    dealt = ranked.join(F.broadcast(placements), here).select(
        (F.col("first_bin") + F.expr("(rank - from_rank) div each")).alias("bin"), "doc_id", "piece", "first", "length",
    )
    whole = Window.partitionBy("bin")
    inside = whole.orderBy(F.desc("length"), "doc_id", "piece").rowsBetween(Window.unboundedPreceding, -1)
    held = F.sum("length").over(whole)
    size = F.element_at(F.filter(F.array(*[F.lit(s) for s in sorted(sizes)]), lambda s: s >= F.col("held")), 1)
    return dealt.select(
        "*", held.alias("held"), F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("place")
    ).select("bin", size.alias("bin_size"), "place", "doc_id", "piece", "first", "length")

"""Catalog cells: readiness class, reason, search, order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Readiness classes in the order they are listed; rows without one come last.
CLASS_ORDER = {"ripe": 0, "ripening": 1, "unripe": 2}
NO_CLASS = 9


def readiness_class(cell: Column) -> Column:
    """The class named in brackets."""
    found = F.regexp_extract(cell, r"\((ripe|ripening|unripe)\)", 1)
    return F.nullif(found, F.lit(""))


def not_characterized(cell: Column) -> Column:
    """``no (reason)`` reads ``not characterized: reason``; other cells stay."""
    reason = F.regexp_extract(cell, r"^no \((.*)\)$", 1)
    return F.when(cell.rlike(r"^no \(.*\)$"), F.concat(F.lit("not characterized: "), reason)).otherwise(cell)


def class_rank(cls: Column) -> Column:
    rank = F.lit(NO_CLASS)
    for name, place in CLASS_ORDER.items():
        rank = F.when(cls == name, place).otherwise(rank)
    return rank


def matches(cells: Sequence[Column], text: str) -> Column:
    """Whether any part of the joined cells holds the text, case aside; all rows for no text."""
    wanted = text.strip().lower()
    if not wanted:
        return F.lit(True)
    return F.lower(F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells])).contains(wanted)


def listing_order(rank: Column, index: Column, descending: bool = False) -> list[Column]:
    """Sort columns: the direction turns the key, never the tie-break by input index."""
    return [rank.desc() if descending else rank.asc(), index.asc()]

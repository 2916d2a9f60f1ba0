"""Phrases of report cells.

What a phrase lists comes as rows: one per item with its place in its group, ranked in blocks, and one
row of counts per group. A phrase joins those rows in pieces of at most ``PIECE`` items, so no buffer
holds a group's items; the text itself, which holds them all by its definition, is the only long value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import Ordered, attach, ordinal
from .formats import fmt_pct

PIECE = 10_000


def accuracy_phrase(kind: Column, statuses: Column, captures: Column) -> Column:
    """What an anchor says of its own accuracy: fixes by status, captures, or its log."""
    each = F.transform(
        F.map_entries(statuses),
        lambda e: F.concat(e["value"].cast("string"), F.lit(" fixes with status "), e["key"].cast("string")),
    )
    captured = F.concat(F.lit("none stated ("), captures.cast("string"), F.lit(" captures with GPS)"))
    return F.when(kind == "fix", F.array_join(each, "; ")).when(kind == "exif", captured).otherwise(
        "log reports its own level"
    )


def listed_items(items: DataFrame, by: Sequence[str], order: Sequence[str], text: Column) -> DataFrame:
    """``*by, place, item``: every row that has a text, with its 0-based place in its group."""
    named = items.select(*by, *order, text.alias("item")).where(F.col("item").isNotNull())
    return Ordered(named, by, [*order, "item"]).add(place=ordinal()).df.select(*by, "place", "item")


def joined_items(listed: DataFrame, by: Sequence[str], name: str, sep: str) -> DataFrame:
    """``*by, name``: the listed items of each group as one text, joined piece by piece."""
    def join(rows: DataFrame, keys: Sequence[str], place: str, text: str, into: str) -> DataFrame:
        texts = F.array_sort(F.collect_list(F.struct(place, text)))
        return rows.groupBy(*keys).agg(F.array_join(F.transform(texts, lambda s: s[text]), sep).alias(into))

    pieces = listed.withColumn("_piece", F.expr(f"place div {PIECE}"))
    return join(join(pieces, [*by, "_piece"], "place", "item", "_text"), by, "_piece", "_text", name)


def with_counts(listed: DataFrame, counts: DataFrame) -> DataFrame:
    """The listed rows and one row per group that has its counts, and neither place nor item."""
    return listed.unionByName(counts, allowMissingColumns=True)


def _stability(members: DataFrame, group: str, name: str, good: str, runs: str) -> tuple[DataFrame, DataFrame]:
    rate = F.round(F.col(good) / F.col(runs), 3)
    one = F.concat(
        F.col(name).cast("string"), F.lit(": "), F.col(good).cast("string"), F.lit(" of "),
        F.col(runs).cast("string"), F.lit(" ("), fmt_pct(rate), F.lit(")"),
    )
    counts = members.groupBy(group).agg(F.count(F.lit(1)).alias("members"), F.count(runs).alias("repeated"))
    return listed_items(members.where(F.col(runs).isNotNull()), [group], [name], one), counts


def stability_rows(members: DataFrame, group: str, name: str, good: str, runs: str) -> DataFrame:
    """``group, place, item, members, repeated``: each repeated member as an item, and the counts of each group."""
    return with_counts(*_stability(members, group, name, good, runs))


def stability_phrase(members: DataFrame, group: str, name: str, good: str, runs: str) -> DataFrame:
    """``id: k of n (p %)`` for the repeated members of a group, the others named as single runs."""
    listed, counts = _stability(members, group, name, good, runs)
    text = F.coalesce("_text", F.lit(""))
    others = F.when(F.col("repeated") < F.col("members"), "; others single run").otherwise("")
    return attach(counts, joined_items(listed, [group], "_text", "; "), [group]).select(
        group, F.when(F.col("repeated") == 0, "single run").otherwise(F.concat(text, others)).alias("phrase")
    )


def _disagreement(checks: DataFrame, group: str, disagrees: Column, item: Column) -> tuple[DataFrame, DataFrame]:
    marked = checks.withColumns({"_bad": disagrees, "_item": item})
    counts = marked.groupBy(group).agg(
        F.count_if("_bad").alias("disagree"), F.count_if(~F.col("_bad")).alias("agree")
    )
    return listed_items(marked.where("_bad"), [group], ["_item"], F.col("_item").cast("string")), counts


def disagreement_rows(checks: DataFrame, group: str, disagrees: Column, item: Column) -> DataFrame:
    """``group, place, item, disagree, agree``: each check that disagrees, and the counts of each group."""
    return with_counts(*_disagreement(checks, group, disagrees, item))


def disagreement_phrase(checks: DataFrame, group: str, disagrees: Column, item: Column) -> DataFrame:
    """How many checks disagree and agree, and which ones disagree."""
    listed, counts = _disagreement(checks, group, disagrees, item)
    none = F.when(F.col("disagree") == 0, "no disagreement found")
    return attach(counts, joined_items(listed, [group], "_text", "; "), [group]).select(
        group, "disagree", "agree", none.otherwise(F.coalesce("_text", F.lit(""))).alias("phrase")
    )

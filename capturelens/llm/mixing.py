"""Mixing sources to target weights.

Every source gets a share of the whole by its weight, at most ``epochs`` times its own size. Inside a
source documents stand in the order of a hash of their id; the mix takes whole passes and then the
first documents of that order up to the exact budget, found by running totals over ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .work import WORD, running_totals, same, word_count

WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``; one row per source.

    Sources take the weights in turn, in the order of their names, null last. Sources are filled in
    the order of limit by weight: as long as a share of what is left would exceed the limit of a
    source, it gets its limit; the first that does not fixes the rate for all others.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    weighed = sizes.select(
        "source", "source_size", weight.cast("bigint").alias("w"), (F.col("source_size") * epochs).alias("cap"),
    )
    by_limit = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = weighed.select(
        "*", F.row_number().over(by_limit).alias("rank"),
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("rest"),
        (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("rest_w"),
    )
    fits = F.col("cap") * F.col("rest_w") > F.col("w") * F.col("rest")
    opened = left.select("*", F.min(F.when(fits, F.struct("rank", "rest", "rest_w"))).over(whole).alias("open"))
    capped = F.col("open").isNull() | (F.col("rank") < F.col("open.rank"))
    share = (F.col("w") * F.col("open.rest")).cast("double") / F.col("open.rest_w").cast("double")
    return opened.select("source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(share).alias("target"))


def placed_rows(sized: DataFrame, weights: Sequence[int], epochs: int, seed: str) -> DataFrame:
    """Rows (doc_id, size and any others) with ``source_size, target, taken`` of their ``source``."""
    keyed = sized.withColumn("key", F.md5(F.concat(F.lit(seed + "-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    placed = running_totals(keyed, ["source"], ["key", "doc_id", "size"], "size", "before")
    targets = source_targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    budget = F.floor("target").cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(0)
    rest = budget - passes * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    joined = placed.join(targets, same(placed, targets, ["source"]))
    return joined.select(
        *[c for c in sized.columns if c != "source"], "source_size", "target", (passes * F.col("size") + part).cast("bigint").alias("taken"))


def plan_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, epochs: int = 3, seed: str = "mix-0",
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per row; sizes and ``taken`` are words.

    Null texts have size 0 and null sources are a source of their own. A row's place in its source
    depends on its id and the seed only, so reruns agree; rows that repeat an id stand side by side.
    The document at the edge of a budget is taken up to that word, so a source takes its target
    rounded down. Other columns are not looked at.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    return placed_rows(sized, weights, epochs, seed).select("doc_id", "size", "source_size", "target", "taken")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, epochs: int = 3, seed: str = "mix-0",
) -> DataFrame:
    """The mixed rows with the columns of ``docs``: one per whole pass over a document, and one whose
    text ends at the budget's last word (its words joined by spaces) for the document at the edge.

    Every row takes what ``plan_mix`` says of it, rows that share an id too; of rows equal in id and number of
    words any may be the one at the edge. Documents without words (null, empty, blank) cost nothing and stay once.
    Null ids and sources are values like any other, columns may have any names, an empty table gives no rows.
    """
    row = F.struct(*[docs[c] for c in docs.columns])
    mark = F.concat(F.sha2(F.coalesce(docs[text_col], F.lit("")), 256), F.hex(F.xxhash64(*[docs[c] for c in docs.columns if c != text_col])))
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), mark.alias("mark"))
    planned = placed_rows(sized, weights, epochs, seed)
    # rows equal in all columns are one row here, which takes what the plan gives to all of them
    takes = planned.groupBy("doc_id", "mark").agg(F.first("size").alias("size"), F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("rows"))
    texts = docs.select(F.col(id_col).alias("doc_id"), mark.alias("mark"), row.alias("row")).groupBy("doc_id", "mark").agg(F.first("row").alias("row"))
    joined = texts.join(takes.hint("merge"), same(texts, takes, ["doc_id", "mark"])).select("row", "size", "taken", "rows")
    times = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.col("rows"))
    edge = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    copies = F.concat(
        F.array_repeat(F.lit(None).cast("bigint"), times.cast("int")),
        F.when(edge > 0, F.array(edge)).otherwise(F.array().cast("array<bigint>")),
    )
    pieces = joined.select("row", F.explode(copies).alias("first_words"))
    text = F.col("row").getField(text_col)
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.col("first_words").cast("int")), " ")
    cut = F.when(F.col("first_words").isNull(), text).otherwise(head)
    return pieces.select(*[(cut if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])

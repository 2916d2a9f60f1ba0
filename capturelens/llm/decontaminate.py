"""Benchmark decontamination by n-gram windows, in DataFrame functions only.

The windows of all test items (``size`` consecutive words; a shorter item is one window) become a hash
set. Documents are scanned once: the hashes of all their windows are looked up in the set, and what hits
is compared word by word with the items' windows. The set is broadcast in parts of a checked size, one scan for
each part, so windows of documents are never shuffled before they hit; a usual benchmark is one part.

Words are runs of characters above U+007F, ASCII digits and letters, A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import same, written

WORD_RUN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LAST_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIZE = 10
BROADCAST_WINDOWS = 400_000  # of one part: some 50 bytes each for the scan, 300 for what verifies its hits


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD_RUN), F.lit(0))


def digest_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def places(n: Column, length: int | Column) -> Column:
    """First words (from 1) of the windows of ``length`` in ``n`` words."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.when(n >= length, F.sequence(F.lit(1), n - length + 1)).otherwise(F.array().cast("array<int>"))


def bound_once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, also where a lambda refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def item_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """``window, item_id, length``: the different windows (words joined by spaces) of every item."""
    def cut(words: Column) -> Column:
        length = F.least(F.size(words), F.lit(size))
        starts = F.when(length > 0, places(F.size(words), length)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, length), " "))

    found = items.select(F.col(item_col).cast("string").alias("item_id"), F.explode(bound_once(words_of(F.col(text_col)), cut)).alias("window"))
    return found.distinct().withColumn("length", F.size(F.split("window", " ")))


def scan(
    docs: DataFrame, windows: DataFrame, lengths: Sequence[int], id_col: str, text_col: str,
) -> DataFrame:
    """``doc_id, digest, n_words, first, length, window``: one row without a window for each document, and one
    for each of its windows whose hash is in the set of these windows, which must be fit for a broadcast."""
    def of_length(words: Column, k: int) -> Column:
        return F.transform(places(F.size(words), k), lambda i: F.xxhash64(F.slice(words, i, k)))

    def hashes(words: Column) -> Column:
        return F.concat(F.array(F.lit(None).cast("bigint")), *[of_length(words, k) for k in lengths])

    rows = docs.select(
        F.col(id_col).alias("doc_id"), digest_of(F.col(text_col)).alias("digest"), words_of(F.col(text_col)).alias("words"),
    ).select("doc_id", "digest", "words", F.size("words").alias("n"), bound_once(F.col("words"), hashes).alias("hashes"))
    looked = rows.select("doc_id", "digest", "words", "n", F.posexplode("hashes").alias("at", "hash"))
    keys = windows.select("hash", F.col("length").alias("k")).distinct()
    met = looked.join(F.broadcast(keys), "hash", "left").where("k is not null or at = 0")
    start, first = F.lit(1), F.lit(None).cast("int")
    for k in lengths:  # the windows of one length stand side by side
        first = F.when(F.col("k") == k, F.col("at") - start).otherwise(first)
        start = start + F.greatest(F.col("n") - k + 1, F.lit(0))
    inside = (first >= 0) & (first + F.col("k") <= F.col("n"))
    text = F.when(inside, F.array_join(F.slice("words", first + 1, F.col("k")), " "))
    return met.select(
        "doc_id", "digest", F.col("n").cast("bigint").alias("n_words"), first.alias("first"),
        F.col("k").alias("length"), text.alias("window"),
    )


def overlaps(
    docs: DataFrame, items: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """``doc_id, digest, n_words, hit, items`` per row: which words lie in a window of an item.

    ``hit`` holds the numbers (from 0, ascending) of the words inside occurrences of windows, ``items`` the
    ids of the items with occurring windows, as strings in ascending order. Null and empty texts have no
    words; items without words have no windows; windows of items without an id hit words without being
    listed. Rows that repeat an id and a text get equal results, one row each; rows that share an id only
    are told apart by their texts' digests. A part of the set has ``broadcast_windows`` windows or a few more. Empty tables give no rows or no hits. Other columns are not
    looked at, no text is cut. Lists are as long as a document's own words and the items it meets.
    """
    windows = item_windows(items, item_col, item_text_col, size).withColumn("hash", F.xxhash64(F.split("window", " ")))
    windows = written(windows, "item-windows")
    lengths = [r["length"] for r in windows.select("length").distinct().orderBy("length").collect()]  # at most `size`
    parts = 1 + windows.select("window").distinct().count() // broadcast_windows
    key = ["doc_id", "digest"]
    found = []
    for part in range(parts):
        some = windows.where(F.pmod("hash", F.lit(parts)) == part)
        rows = written(scan(docs, some, lengths, id_col, text_col), "scanned")
        near = rows.where("length is not null").select(*key, "first", "length", "window")
        found.append(near.join(F.broadcast(some.select("window").distinct()), "window", "left_semi"))
    sure = reduce(DataFrame.union, found)
    cover = F.transform(F.collect_set(F.struct("first", "length")), lambda s: F.sequence(s["first"], s["first"] + s["length"] - 1))
    hits = sure.groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(cover))).alias("hit"))
    met = sure.select(*key, "window").distinct().join(windows, "window").groupBy(*key)
    listed = met.agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    both = hits.join(listed, same(hits, listed, key)).select(hits["doc_id"], hits["digest"], "hit", "items")
    base = rows.where("length is null").select(*key, "n_words")
    out = base.join(both, same(base, both, key), "left")
    return out.select(
        base["doc_id"], base["digest"], "n_words", F.coalesce("hit", F.array().cast("array<int>")).alias("hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def mark_contaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` per row (see ``overlaps``)."""
    return overlaps(docs, items, **how).select(
        "doc_id", "n_words", F.size("hit").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"),
    )


def without_words(text: Column, hit: Column) -> Column:
    """The text without the words of these numbers and what stands between each and the word before it."""
    def join(pieces: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), hit)
        return F.array_join(F.transform(left, lambda i: F.element_at(pieces, i + 1)), "")

    body = bound_once(F.regexp_extract_all(text, F.lit(CASED_PIECE), F.lit(0)), join)
    return F.concat(body, F.regexp_extract(text, LAST_SEPARATORS, 0))


def remove_contaminated(
    docs: DataFrame, items: DataFrame, spans: bool = False, id_col: str = "doc_id", text_col: str = "text", **how,
) -> DataFrame:
    """The rows of ``docs`` with all their columns, without contaminated ones; with ``spans`` all rows stay and
    only the words that are hit go from their texts. Nulls and repeats as in ``overlaps``."""
    found = overlaps(docs, items, id_col=id_col, text_col=text_col, **how).where(F.size("hit") > 0)
    marks = found.select("doc_id", "digest", "hit").dropDuplicates(["doc_id", "digest"])
    here = docs[id_col].eqNullSafe(marks["doc_id"]) & (digest_of(docs[text_col]) == marks["digest"])
    if not spans:
        return docs.join(marks, here, "left_anti")
    joined = docs.join(marks, here, "left")
    kept = F.when(marks["hit"].isNull(), docs[text_col]).otherwise(without_words(docs[text_col], marks["hit"]))
    return joined.select(*[kept.alias(c) if c == text_col else docs[c] for c in docs.columns])

"""Spelling variants: words of a corpus that are one edit apart, and the form each stands for.

A pair of words with one code point inserted, deleted or replaced agrees before and after the edit. Every
word is cut into segments; words that agree in all but one segment meet in a group, and each pair belongs
to the segment in which the two first differ. In a group the differing parts form a sorted list, and all
words walk down its ranges of equal prefixes together: the banded row of the edit matrix of a range is
worked out once for all that share its prefix, and a range whose row exceeds one edit is skipped whole.
Groups of more words than a task should hold are cut again inside their segment, down to single code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import written

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, FEWEST = 5, 3
GROUP_WORDS = 20_000  # more than words that differ in one place of one segment can be: 90 letters, 8,190 parts
BATCH_WORDS = 40_000
BATCH_CELLS = 2_000_000
QUERIES_AT_ONCE = 8_000
FAR = 2  # any distance above one


def slipped(run: Column, doc_id: Column, every: int = 97) -> Column:
    """The run, without one of its code points where ``every`` divides the hash of the document and the run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def vocabulary(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: bool = False,
    shortest: int = SHORTEST, fewest: int = FEWEST,
) -> DataFrame:
    """``word, n``: runs of letters with A-Z lower-cased that are long and frequent enough; null texts have none.
    With ``slips`` some occurrences lose a letter first (``slipped``)."""
    lowered = F.translate(F.col(text_col), UPPER, LOWER)
    runs = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.select((slipped(F.col("run"), F.col("doc_id")) if slips else F.col("run")).alias("word"))
    counted = words.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= fewest)


def in_lists(words: DataFrame) -> DataFrame:
    """``word, of, start, stop``: a word of L letters stands in the list of words of L and of one more, and in
    that of one less, with the whole of the shorter length as its first segment."""
    length = F.char_length("word")
    return words.select("word", F.explode(F.array(length, length - 1)).alias("of")).select(
        "word", "of", F.lit(0).alias("start"), F.col("of").alias("stop"))


def halved(rows: DataFrame) -> DataFrame:
    """Every segment cut into two; segments of one letter stay."""
    middle = F.expr("start + (stop - start) div 2")
    both = F.array(
        F.struct(F.col("start").alias("start"), middle.alias("stop")), F.struct(middle.alias("start"), F.col("stop").alias("stop")))
    one = F.array(F.struct("start", "stop"))
    return rows.select("word", "of", F.explode(F.when(F.col("stop") - F.col("start") > 1, both).otherwise(one)).alias("s")).select(
        "word", "of", F.col("s.start").alias("start"), F.col("s.stop").alias("stop"))


def grouped(rows: DataFrame) -> DataFrame:
    """Rows with ``before``, ``part`` and ``after``: the word cut at its segment, and the ``key`` of its group."""
    more = F.char_length("word") - F.col("of")
    return rows.withColumns({
        "before": F.substring("word", F.lit(1), F.col("start")),
        "part": F.substring("word", F.col("start") + 1, F.col("stop") - F.col("start") + more),
        "after": F.substring("word", F.col("stop") + more + 1, F.col("of")),
    }).withColumn("key", F.concat_ws(" ", "of", "start", "stop", "before", "after"))


def letters(parts: list[str], width: int) -> np.ndarray:
    """Code points of the parts, ended and filled by 0."""
    flat = np.frombuffer("".join(p.ljust(width, "\0") for p in parts).encode("utf-32-le"), np.uint32)
    return flat.reshape(len(parts), width)


def walk(group: np.ndarray, parts: list[str], asking: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (i, j) of one group whose parts are one edit apart, of rows sorted by (group, part).

    ``asking`` marks the words of the list's own length, one of which is in each pair; ``last`` marks groups of
    the last segment: in others a part that goes on where the other ends belongs to a later segment. Each pair
    comes once, the part that is not longer first.
    """
    length = np.array([len(p) for p in parts])
    width = int(length.max()) + 1
    text = letters(parts, width)
    changed = np.flatnonzero(group[1:] != group[:-1]) + 1
    shared = np.full(len(parts), -1)  # letters in common with the row above; -1 where a group starts
    if len(parts) > 1:
        differ = text[1:] != text[:-1]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        shared[changed] = -1
    sizes = np.diff(np.concatenate([[0], changed, [len(parts)]]))
    starts = np.repeat(np.concatenate([[0], changed]), sizes)
    ends = np.repeat(np.concatenate([changed, [len(parts)]]), sizes)
    asks = np.flatnonzero(asking & (ends - starts > 1))
    ranges = []  # at each depth: where ranges of one prefix begin, and how many begin before each row
    for depth in range(width):
        begins = shared <= depth
        ranges.append((np.flatnonzero(begins), np.concatenate([[0], np.cumsum(begins)])))
    padded = np.concatenate([text, np.zeros((len(parts), 3), np.uint32)], axis=1)
    left, right = [], []
    for at in range(0, len(asks), QUERIES_AT_ONCE):
        q = asks[at : at + QUERIES_AT_ONCE]
        lo, hi = starts[q], ends[q]
        rows = np.stack([np.full(len(q), FAR), np.zeros(len(q)), np.where(length[q] >= 1, 1, FAR)]).astype(np.int8)
        for depth in range(width):
            begins, count = ranges[depth]
            a, b = count[lo], count[hi]
            many = b - a
            take = np.repeat(np.arange(len(q)), many)
            child = np.repeat(a - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            q, lo = q[take], begins[child]
            # a range ends where the next begins, or with the range above it
            hi = np.minimum(np.append(begins, len(parts))[child + 1], hi[take])
            old = rows[:, take]
            letter = text[lo, depth]
            done = letter == 0
            # at the end of a word the row holds its distance to the first `depth` letters and one less or more
            m = length[q]
            column = m - depth + 1
            found = done & (column >= 0) & (column <= 2)
            if found.any():
                hit = np.flatnonzero(found)
                hit = hit[old[column[hit], hit] == 1]
                hit = hit[(length[lo[hit]] > m[hit]) | (lo[hit] > q[hit])]
                left.append(q[hit])
                right.append(lo[hit])
            here = np.flatnonzero(~done)
            q, lo, hi, old, letter, m = q[here], lo[here], hi[here], old[:, here], letter[here], m[here]
            same = [padded[q, depth + j - 1] == letter if depth + j >= 1 else np.zeros(len(q), bool) for j in range(3)]
            inside = [(depth + j) <= m for j in range(3)]
            zero = np.where(inside[0], np.minimum(old[1] + 1, old[0] + ~same[0]), FAR)
            one = np.where(inside[1], np.minimum(np.minimum(old[2] + 1, old[1] + ~same[1]), zero + 1), FAR)
            two = np.where(inside[2], np.minimum(old[2] + ~same[2], one + 1), FAR)
            rows = np.minimum(np.stack([zero, one, two]), FAR).astype(np.int8)
            alive = np.flatnonzero(rows.min(axis=0) < FAR)
            q, lo, hi, rows = q[alive], lo[alive], hi[alive], rows[:, alive]
            if not len(q):
                break
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j = np.concatenate(left), np.concatenate(right)
    whole = np.array([len(parts[y]) > len(parts[x]) and parts[y].startswith(parts[x]) for x, y in zip(i, j)], bool)
    mine = last[i] | ~whole
    return i[mine], j[mine]


def near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, before, after, asking, last) sorted by (key, part) to pairs of words (a, b)."""
    keys: list[str] = []
    rows: list[tuple] = []
    longest = 0

    def pairs(upto: int) -> pa.RecordBatch:
        parts = [r[0] for r in rows[:upto]]
        order = sorted(range(upto), key=lambda i: (keys[i], parts[i]))
        numbers = np.cumsum([0] + [keys[x] != keys[y] for x, y in zip(order, order[1:])])
        i, j = walk(numbers, [parts[x] for x in order], *(np.array([rows[x][c] for x in order]) for c in (3, 4)))
        words = [[rows[order[x]][1] + parts[order[x]] + rows[order[x]][2] for x in side] for side in (i, j)]
        return pa.RecordBatch.from_arrays([pa.array(w, pa.string()) for w in words], ["a", "b"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in range(6)]
        for key, *row in zip(*columns):
            if keys and key != keys[-1] and (len(keys) >= BATCH_WORDS or len(keys) * longest >= BATCH_CELLS):
                yield pairs(len(keys))
                keys, rows, longest = [], [], 0
            keys.append(key)
            rows.append(tuple(row))
            longest = max(longest, len(row[0]) + 1)
    if keys:
        yield pairs(len(keys))


def one_edit_apart(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """``a, b``: each unordered pair of different words (column ``word``, no repeats) one edit apart, once."""
    out = None
    rows = halved(in_lists(words))
    while True:
        rows = grouped(rows)
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.col("stop") - F.col("start")).alias("wide"))
        large = written(sizes.where((F.col("size") > group_words) & (F.col("wide") > 1)).select("key"), "large-groups")
        asking, last = F.char_length("word") == F.col("of"), F.col("stop") == F.col("of")
        small = rows.join(large, "key", "left_anti").select("key", "part", "before", "after", asking.alias("asking"), last.alias("last"))
        dealt = small.repartition("key").sortWithinPartitions("key", "part")
        found = written(dealt.mapInArrow(near_pairs, "a string, b string"), "near-words")
        out = found if out is None else out.union(found)
        if large.isEmpty():
            return out
        rows = halved(rows.join(large, "key", "left_semi").select("word", "of", "start", "stop"))


def with_roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words with a form (word, form): where following forms ends. Pointers double each round;
    a form is at least twice as frequent as its word, so there are no circles and few rounds."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        at = written(moved, "roots")
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(vocab: DataFrame, times: int = 2, group_words: int = GROUP_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of a vocabulary (word, n) without repeats.

    Two words are near when one code point is inserted, deleted or replaced. A word's form is its most
    frequent near word (ties: the least in code-point order), if that is at least ``times`` as frequent,
    else null; its root is where forms lead, the word itself if it has none. Null words are dropped, an
    empty vocabulary gives no rows.
    """
    words = written(vocab.where("word is not null").select("word", "n"), "vocabulary")
    pairs = one_edit_apart(words.select("word"), group_words)
    both = pairs.union(pairs.select("b", "a")).toDF("word", "other")
    counts = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = both.join(counts, "other").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    near = words.join(best, "word", "left")
    enough = -F.col("best.less") >= times * F.col("n")
    formed = written(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(enough, F.col("best.form")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    roots = with_roots(formed.where("form is not null").select("word", "form"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: bool = False) -> DataFrame:
    """``variants`` of the vocabulary of a documents table. Null and empty texts have no words, null ids count as
    empty ones, repeated rows count again; other columns are not looked at and no text is cut."""
    return variants(vocabulary(docs, id_col, text_col, slips))

"""Exact duplicates: given tables, forced digest clashes, edge rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from capturelens.llm.exact import drop_copies, mark_copies


def marks(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect()), key=repr)


def clash(text):
    """A digest that most texts share."""
    return F.encode(F.substring(text, 1, 1), "utf-8")


@pytest.mark.parametrize("digest", [None, clash])
def test_marks(documents, digest):
    rows = [(1, "a"), (2, "a"), (3, "ab"), (4, ""), (5, None), (6, "A"), (7, "a "), (8, "ab"), (9, "b" * 300_000), (None, "a"), (None, "n")]
    how = {"digest": digest} if digest else {}
    assert marks(mark_copies(documents(rows), **how)) == sorted([
        (1, 2, 3, False), (2, 2, 3, True), (3, 8, 2, False), (4, 5, 2, False), (5, 5, 2, True), (6, 6, 1, True), (7, 7, 1, True),
        (8, 8, 2, True), (9, 9, 1, True), (None, 2, 3, False), (None, None, 1, True),
    ], key=repr)


def test_hot_text_repeated_rows_and_empty_table(documents):
    rows = [(i, "hot") for i in range(3000)] + [(5000, "x"), (5000, "x")]
    got = marks(mark_copies(documents(rows)))
    assert [r for r in got if r[3]] == [(2999, 2999, 3000, True), (5000, 5000, 2, True), (5000, 5000, 2, True)]
    assert mark_copies(documents([])).count() == 0


def test_kept_rows_have_all_columns(documents):
    table = documents([(1, "a"), (2, "a"), (3, None), (4, "b"), (None, "c")])
    left = drop_copies(table)
    assert left.columns == table.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == [(0, "c"), (2, "a"), (3, None), (4, "b")]

"""Exact duplicates: copies are combined where they are, then by salted digest, then over the salts.

Digests only deal the rows out; texts are equal when their whole content is. Everything is built from
DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import written

SALTS = 16


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def keyed_texts(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), digest(text).alias("digest"))


def distinct_texts(keyed: DataFrame) -> DataFrame:
    """``digest, text, keep_id, group_size``: one row per text, the largest id stays.

    A text that a third of all rows hold leaves each task once, meets in one of the salted groups and
    leaves those as at most ``SALTS`` rows.
    """
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
    salted = keyed.groupBy("digest", "text", salt).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def mark_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """``doc_id, digest, keep_id, group_size, kept`` for every row, dropped ones too.

    Null texts count as empty texts. The row with the largest id of equal texts stays; a null id stays
    only when all ids of its text are null; rows that repeat an id and a text stay or go together. An
    empty table gives no rows, and other columns are not looked at. Texts that share a digest without
    being equal are told apart by their content.
    """
    keyed = keyed_texts(docs, id_col, text_col, digest)
    groups = written(distinct_texts(keyed).select("digest", "keep_id", "group_size"), "copies")
    shared = groups.groupBy("digest").count().where("count > 1").select("digest")
    rows = keyed.select("doc_id", "digest")
    if shared.isEmpty():
        marked = rows.join(groups, "digest")
    else:
        again = keyed.join(shared, "digest", "left_semi")
        apart = again.join(distinct_texts(again), ["digest", "text"]).select(
            "digest", "doc_id", "keep_id", "group_size"
        )
        marked = rows.join(groups.join(shared, "digest", "left_anti"), "digest").unionByName(apart)
    return marked.select(
        "doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns (see ``mark_copies``)."""
    stays = mark_copies(docs, id_col, text_col).where("kept").select("doc_id", "digest").distinct().hint("merge")
    ours = sha256(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(stays, docs[id_col].eqNullSafe(stays["doc_id"]) & (ours == stays["digest"]), "left_semi")

"""Documents and the catalog: numbering of labelled items, catalog rows, listing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import class_rank, listing_order, matches, not_characterized
from .ordered import Ordered, last_known, previous, running_sum

# Environments that float, and the counter their captions share.
FLOATS = {"table": "table", "sidewaystable": "table", "figure": "figure"}


def document_tokens(docs: DataFrame, doc: str, part: str, text: str) -> DataFrame:
    """Structure tokens of documents in order: ``doc, part, pos, kind, label``.

    The text is cut before every command with an argument; a piece is then told by the name of its
    command and its first argument.
    """
    pieces = F.split(text, r"(?=\\[a-z]+\s*\{)")
    found = docs.select(doc, part, F.posexplode(pieces).alias("pos", "_c"))
    name = F.regexp_extract("_c", r"^\\([a-z]+)\s*\{", 1)
    given = F.regexp_extract("_c", r"^\\[a-z]+\s*\{([^{}]*)", 1)
    family = F.try_element_at(F.create_map(*[F.lit(x) for pair in FLOATS.items() for x in pair]), given)
    to_zero = F.col("_c").rlike(r"^\\setcounter\{\w+\}\{0\}")
    kind = (
        F.when(name.isin("section", "subsection", "caption", "label"), name)
        .when(name == "begin", F.concat(F.lit("begin_"), family))
        .when((name == "end") & family.isNotNull(), "end")
        .when((name == "setcounter") & to_zero & given.isin("table", "figure"), F.concat(F.lit("reset_"), given))
    )
    tokens = found.select(doc, part, "pos", kind.alias("kind"), F.when(name == "label", given).alias("label"))
    return tokens.where(F.col("kind").isNotNull())


def number_labels(tokens: DataFrame, doc: str, part: str, order: Sequence[str]) -> DataFrame:
    """Printed number of every label: ``doc, label, number``.

    ``part`` is 0 for the main text and 1 for the appendix, whose sections are lettered and lead
    the numbers of tables and figures. ``order`` runs through the whole document.
    """
    kind = F.col("kind")
    one = lambda c: c.cast("bigint")
    # parts follow each other inside a document: its sections less those before the part are the part's
    rows = Ordered(tokens, [doc], [part, *order]).add(
        _secs=running_sum(one(kind == "section")), _part=previous(F.struct(part)),
        _subs=running_sum(one(kind == "subsection")),
        _last=last_known(F.when(kind.isin("section", "subsection"), kind)),
        _env=last_known(F.when(kind.startswith("begin_") | (kind == "end"), kind)),
    )
    counts = {
        f"_{f}s": running_sum(one((kind == "caption") & (F.col("_env") == f"begin_{f}"))) for f in ("table", "figure")
    }
    before = F.col("_secs") - F.coalesce(one(kind == "section"), F.lit(0))
    rows = rows.add(
        _sub0=last_known(F.when(kind == "section", F.col("_subs"))),
        _sec0=last_known(F.when(~F.struct(part).eqNullSafe(F.col("_part")), before)), **counts)
    rows = rows.add(**{
        f"_{f}0": last_known(F.when(kind == f"reset_{f}", F.col(f"_{f}s"))) for f in ("table", "figure")
    })
    since = lambda a, b: F.col(a) - F.coalesce(F.col(b), F.lit(0))
    sec = F.col("_secs") - F.col("_sec0")
    head = F.when(F.col(part) == 1, F.char(F.lit(64) + sec)).otherwise(sec.cast("string"))
    lead = F.when(F.col(part) == 1, head).otherwise("")
    number = (
        F.when(F.col("_env") == "begin_table", F.concat(lead, since("_tables", "_table0").cast("string")))
        .when(F.col("_env") == "begin_figure", F.concat(lead, since("_figures", "_figure0").cast("string")))
        .when(F.col("_last") == "section", head)
        .otherwise(F.concat(head, F.lit("."), since("_subs", "_sub0").cast("string")))
    )
    return rows.df.where(kind == "label").select(doc, "label", number.alias("number"))


def catalog_rows(found: DataFrame, classes: DataFrame, names: DataFrame, links: DataFrame, key: str, cell: str) -> DataFrame:
    """Datasets with class, reason, full name and links; ``key`` is null for rows without details."""
    out = found.join(classes, key, "left").join(names, key, "left").join(links, "index", "left")
    reason = F.when(F.col(key).isNotNull(), "").otherwise(not_characterized(F.col(cell)))
    return out.withColumn("reason", reason)


def catalog_search(rows: DataFrame, cells: Sequence[str], text: str) -> DataFrame:
    return rows.where(matches([F.col(c) for c in cells], text))


def sorted_listing(rows: DataFrame, index: str, by: Column | None = None, cls: str = "class", descending: bool = False) -> DataFrame:
    """Rows in listing order; by class unless another key is given."""
    key = class_rank(F.col(cls)) if by is None else by
    return rows.orderBy(*listing_order(key, F.col(index), descending))

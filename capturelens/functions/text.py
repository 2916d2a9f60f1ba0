"""Catalog text: markup to plain text, links, notes, numbering patterns, escapes."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# A link that contains one of these points at a data deposit.
DATA_HOSTS = [
    "10.5281/zenodo",
    "zenodo.org",
    "kaggle.com",
    "10.34740/kaggle",
    "data.mendeley.com",
    "10.17632/",
    "researchoutput.csu.edu.au",
]

# Commands whose argument is kept as it is.
UNWRAP = ["rev", "acc", "textbf", "textit", "emph", "mbox", "url"]

# Markup on the left, plain text on the right, applied in this order.
PLAIN_TEXT = {
    "\\,": " ",
    "\\%": "%",
    "\\_": "_",
    "\\&": "&",
    "\\-": "",
    "\\quad": " ",
    "---": "\u2014",
    "--": "\u2013",
    "~": " ",
    "``": "\u201c",
    "''": "\u201d",
}

# Characters that markup must not contain, and their entities.
ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;"}

# Accent commands and the combining mark each one stands for.
ACCENTS = {"'": "\u0301", "`": "\u0300", "~": "\u0303", '"': "\u0308", "^": "\u0302", "c": "\u0327"}


# Raised marks and what they are in plain text.
RAISED = {"\\circ": "\u00b0", "a": "\u1d43", "b": "\u1d47", "c": "\u1d9c", "d": "\u1d48", "e": "\u1d49", **dict(zip("0123456789", "\u2070\u00b9\u00b2\u00b3\u2074\u2075\u2076\u2077\u2078\u2079"))}

# The format dictates these: a mark before a letter or a cedilla around it, a stroked letter, a product, raised marks.
LETTERS = re.compile(
    r"""\\(?:(?P<mark>['`~"^])\s*|c(?=\{))(?P<brace>\{)?(?P<letter>[A-Za-z])(?(brace)\})"""
    r"""|(?P<stroked>\{\\l\}|\\l(?![A-Za-z]))|(?P<times>\$\s*\\times\s*\$)|\$\s*\^\{(?P<raised>[^{}$]*)\}\s*\$""")
SILENT = r"\\(?:cite\{[^{}]*\}|addlinespace(?:\[[^\]]*\])?)"  # what leaves no text
KEPT = r"\\(?:" + "|".join(UNWRAP) + r")\{([^{}]*)\}"
HELD = "\ue000"  # stands for an escaped percent sign meanwhile


def squeeze(text: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_comments(text: Column) -> Column:
    """Lines up to their first percent sign that is not escaped."""
    hidden = F.replace(text, F.lit("\\%"), F.lit(HELD))
    lines = F.transform(F.split(hidden, "\n"), lambda line: F.substring_index(line, "%", 1))
    return F.replace(F.array_join(lines, "\n"), F.lit(HELD), F.lit("\\%"))


def replace_all(text: Column, table: dict[str, str]) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), table.items(), text)


@F.pandas_udf(StringType())
def compose_accents(text: pd.Series) -> pd.Series:
    """Unicode normal form C (Spark has no built-in for it)."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def letter_of(hit: re.Match) -> str:
    """What an accent, a stroked letter or a math form stands for; forms that are not known stay."""
    kind = hit.lastgroup
    if kind == "letter":
        return unicodedata.normalize("NFC", hit["letter"] + ACCENTS[hit["mark"] or "c"])
    if kind == "raised":
        marks = [m.strip() for m in hit["raised"].split(",")]
        return "".join(RAISED[m] for m in marks) if all(m in RAISED for m in marks) else hit[0]
    return {"stroked": "\u0142", "times": "\u00d7"}[kind]


@F.pandas_udf(StringType())
def read_letters(text: pd.Series) -> pd.Series:
    """Accented and stroked letters, products and raised marks of a markup fragment as characters."""
    return text.map(lambda s: None if s is None else LETTERS.sub(letter_of, s))


def cited_keys(text: Column) -> Column:
    """The keys a fragment cites, in order."""
    lists = F.regexp_extract_all(strip_comments(text), F.lit(r"\\cite\{([^{}]*)\}"), 1)
    return F.flatten(F.transform(lists, lambda keys: F.transform(F.split(keys, ","), lambda k: F.trim(k))))


def numbered_references(text: Column, numbers: Column) -> Column:
    """References to labels as the numbers they have; a label without one is an error."""
    labels = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\\ref\{([^{}]*)\}"), 1))
    lost = F.filter(labels, lambda k: ~F.coalesce(F.map_contains_key(numbers, k), F.lit(False)))
    known = F.when(F.size(lost) > 0, F.raise_error(F.concat(F.lit("labels without number: "), F.array_join(lost, ", ")))).otherwise(labels)
    return F.aggregate(known, text, lambda t, k: F.replace(t, F.concat(F.lit("\\ref{"), k, F.lit("}")), F.element_at(numbers, k)))


def markup_to_text(text: Column, numbers: Column | None = None) -> Column:
    """Plain text of a markup fragment; any command left over is an error.

    ``numbers`` maps labels to what references to them show (see ``documents.number_labels``). Citations are left
    out; ``cited_keys`` has them.
    """
    shown = read_letters(F.regexp_replace(strip_comments(text), SILENT, ""))
    if numbers is not None:
        shown = numbered_references(shown, numbers)
    # commands inside commands: a pass takes the innermost, and there are no more levels than braces
    levels = F.sequence(F.lit(1), F.length(shown) - F.length(F.replace(shown, F.lit("{"), F.lit(""))) + 1)
    shown = F.aggregate(levels, shown, lambda t, _: F.regexp_replace(t, KEPT, "$1"))
    plain = F.translate(replace_all(shown, PLAIN_TEXT), "{}", "")
    return F.when(plain.rlike(r"[\\$]"), F.raise_error(F.concat(F.lit("unconverted markup: "), plain))).otherwise(squeeze(plain))


def page_text(html: Column) -> Column:
    """Plain text of a page: comments, scripts, styles and tags go, entities are read."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", "")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    text = replace_all(text, {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&amp;": "&"})
    return squeeze(text)


def link_kind(url: Column, doi: Column) -> Column:
    """Where an entry points: url, else the rebuilt DOI address; null when it has neither."""
    number = F.regexp_replace(F.coalesce(doi, F.lit("")), r"^https?://(dx\.)?doi\.org/", "")
    rebuilt = F.when(number != "", F.concat(F.lit("https://doi.org/"), number)).otherwise("")
    given = F.coalesce(url, F.lit(""))
    target = F.replace(F.when(given != "", given).otherwise(rebuilt), F.lit("\\_"), F.lit("_"))
    hosted = reduce(lambda c, h: c | F.lower(target).contains(h), DATA_HOSTS, F.lit(False))
    kind = F.when(hosted, "data").otherwise("paper")
    return F.when(target != "", F.struct(kind.alias("kind"), target.alias("url")))


def legend(caption: Column, lead: str = "The columns are ") -> Column:
    """Map of abbreviation to name out of ``Name (ABB), … and Name (ABB)``.

    Every closing bracket ends an item. A name holds no comma and no "and", which would be an item without an
    abbreviation, and only full stops follow the last one.
    """
    parts = F.split(F.substring_index(caption, lead, -1), r"\)")
    n = F.size(parts)

    def item(part: Column) -> Column:
        name = F.ltrim(F.substring_index(part, "(", 1), F.lit(", \n\t"))
        name = F.trim(F.when(F.startswith(name, F.lit("and ")), F.substr(name, F.lit(5))).otherwise(name))
        return F.struct(F.substring_index(part, "(", -1).alias("key"), name.alias("value"))

    items = F.transform(F.slice(parts, 1, n - 1), item)
    odd = F.filter(items, lambda i: ~i["key"].rlike("^[A-Z]+$") | (i["value"] == "") | F.contains(i["value"], F.lit(",")) | F.contains(i["value"], F.lit(" and ")))
    rest = F.trim(F.translate(F.element_at(parts, -1), ".", ""))
    wrong = F.array_compact(F.array_append(F.transform(odd, lambda i: i["value"]), F.when(rest != "", rest)))
    bad = F.raise_error(F.concat(F.lit("not a name with its abbreviation: "), F.array_join(wrong, "; ")))
    return F.map_from_entries(F.when(F.size(wrong) > 0, bad).otherwise(items))


def first_sentence(text: Column) -> Column:
    """Up to the first full stop before a new sentence (white space, then a capital or a bracket) that does not end
    an initial, a capital standing alone."""
    parts = F.split(text, r"\.(?=\s+[A-Z(])")
    ends = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: ~p.rlike(r"(^|[^\w\p{L}\p{N}])[A-Z]\z"))
    at = F.array_position(ends, F.lit(True))
    return F.when(at > 0, F.concat(F.array_join(F.slice(parts, F.lit(1), at.cast("int")), "."), F.lit("."))).otherwise(text)


def footnotes(caption: Column, marks: str) -> Column:
    """The notes of a caption, each from its marker to the next; the first is a marker before a capital."""
    parts = F.split(caption, f"(?=[{marks}])")
    letter = lambda p, i: F.substr(p, F.lit(i), F.lit(1))
    begins = F.transform(parts, lambda p: F.contains(F.lit(marks), letter(p, 1)) & letter(p, 2).between("A", "Z"))
    at = F.array_position(begins, F.lit(True)).cast("int")
    return F.transform(F.when(at > 0, F.slice(parts, at, F.size(parts))).otherwise(F.slice(parts, 1, 0)), lambda p: F.trim(p))


def html_escape(text: Column) -> Column:
    return replace_all(text, ENTITIES)


def set_pairs(text: Column) -> Column:
    """``key=value`` lines to a map; a value is JSON when it reads back as JSON, else a string.

    The parser takes some cut-off input, so a bracketed value must also be closed.
    """
    lines = F.filter(F.split(text, "\n"), lambda s: s.contains("="))

    def value(s: Column) -> Column:
        raw = F.substring_index(s, "=", 1)
        rest = F.substr(s, F.length(raw) + 2)
        number = rest.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$")
        word = rest.isin("true", "false", "null")
        quoted = rest.rlike(r'^"([^"\\]|\\.)*"$')
        boxed = rest.rlike(r"(?s)^(\[.*\]|\{.*\})$") & F.try_parse_json(rest).isNotNull()
        return F.when(number | word | quoted | boxed, rest).otherwise(
            F.concat(F.lit('"'), rest, F.lit('"'))
        )

    return F.map_from_arrays(
        F.transform(lines, lambda s: F.substring_index(s, "=", 1)), F.transform(lines, value)
    )


def join_notes(own: Column, shared: Column) -> Column:
    """A sequence's notes followed by those of its dataset."""
    empty = F.array().cast("array<string>")
    return F.array_join(F.concat(F.coalesce(own, empty), F.coalesce(shared, empty)), " | ")


def notes_when(*notes: tuple[Column, Column]) -> Column:
    """The notes whose condition holds, in order."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, n) for c, n in notes])), " | ")


def region(value: Column, opening: str, closing: str) -> Callable[[Column], Column]:
    """What follows an opening mark, with the value up to the closing one; without that it stays."""
    def filled(part: Column) -> Column:
        end = F.call_function("locate", F.lit(closing), part)
        return F.concat(F.lit(opening), F.when(end > 0, F.concat(value, F.substr(part, end))).otherwise(part))

    return filled


def fill_regions(template: Column, regions: dict[str, Column]) -> Column:
    """Named regions of a page filled, wherever they stand; a region without content is an error."""
    def parted(page: Column, mark: str) -> Column:
        return F.split(page, re.escape(mark))

    for name, value in regions.items():
        opening, closing = f"<!--@{name}-->", f"<!--/@{name}-->"
        parts = parted(template, opening)

        rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), region(value, opening, closing))
        template = F.concat(F.element_at(parts, 1), F.array_join(rest, ""))
    parts = parted(template, "<!--@")
    names = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.substring_index(p, "-->", 1))
    left = F.array_except(names, F.array(*[F.lit(n) for n in regions]).cast("array<string>"))
    return F.when(
        F.size(left) > 0,
        F.raise_error(F.concat(F.lit("regions without content: "), F.array_join(left, ", "))),
    ).otherwise(template)

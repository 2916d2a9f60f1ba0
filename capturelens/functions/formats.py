"""Report text of stored values: missing markers, half-up rounding, units."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Texts that mean "no value", and the texts shown in their place.
MISSING = ["", "undetermined", "n/a", "None", "nan"]
DASH = "—"
NOT_APPLICABLE = "n/a"
UNDETERMINED = "undetermined"

DEC = "decimal(38,12)"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def norm_missing(value: Column) -> Column:
    """Null for every text that means a missing value."""
    text = F.trim(value.cast("string"))
    return F.when(~text.isin(MISSING), text)


def as_decimal(value: Column) -> Column:
    """The decimal number written in a text (or the shortest text of a double); null for other texts.

    A number too large for the decimal type is an error, not a missing value.
    """
    text = norm_missing(value)
    return F.when(text.rlike(NUMBER), text).cast(DEC)


def half_up(value: Column, digits: int) -> Column:
    """Text of a decimal rounded half away from zero with a fixed number of digits.

    A negative number that rounds to zero keeps its sign.
    """
    text = F.round(value.cast(DEC), digits).cast(f"decimal(38,{digits})").cast("string")
    lost = (value < 0) & ~text.startswith("-")
    return F.when(lost, F.concat(F.lit("-"), text)).otherwise(text)


def fmt_num(value: Column, digits: int) -> Column:
    return F.coalesce(half_up(as_decimal(value), digits), F.lit(DASH))


def fmt_pct(value: Column) -> Column:
    shown = F.concat(half_up(as_decimal(value) * 100, 1), F.lit(" %"))
    return F.coalesce(shown, F.lit(DASH))


def fmt_int(value: Column) -> Column:
    """Whole part with thousands separators."""
    whole = as_decimal(value).cast("decimal(38,0)")
    number = as_decimal(value)
    cut = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number))
    return F.when(whole.isNull(), F.lit(DASH)).otherwise(F.format_number(cut, 0))


def fmt_plain(value: Column) -> Column:
    """Stored value in plain notation: an exponent is written out, no digits are added."""
    text = norm_missing(value)
    wide = text.try_cast("decimal(38,18)").cast("string")
    written = F.when(
        F.lower(text).contains("e"), F.regexp_replace(F.regexp_replace(wide, r"0+$", ""), r"\.$", "")
    ).otherwise(text)
    return F.coalesce(written, F.lit(DASH))


@F.pandas_udf(StringType())
def _significant(value: pd.Series, digits: pd.Series) -> pd.Series:
    """Rounds the exact binary value; Spark's formats round its shortest decimal text instead."""
    return pd.Series([None if pd.isna(v) else f"{v:.{int(d)}g}" for v, d in zip(value, digits)], dtype=object)


def fmt_sig(value: Column, digits: int = 4) -> Column:
    """Text with a number of significant digits; null as undetermined."""
    return F.coalesce(_significant(value.cast("double"), F.lit(digits)), F.lit(UNDETERMINED))


def fmt_container(value: Column) -> Column:
    """Arrays, maps and structs as compact JSON; null as undetermined."""
    return F.coalesce(F.to_json(value), F.lit(UNDETERMINED))


def fmt_sizes(value: Column) -> Column:
    """A JSON list of model sizes as ``a, b, c``."""
    sizes = F.from_json(norm_missing(value), "array<int>")
    return F.coalesce(F.array_join(sizes.cast("array<string>"), ", "), F.lit(DASH))


def shown_range(
    middle: Column, low: Column, high: Column, n: Column, total: Column, kind: str
) -> Column:
    """``median [min–max] (n = k)``; the bracket goes when both ends look the same."""
    digits = {"pct": 1, "deg": 1}.get(kind, 2)
    scale = 100 if kind == "pct" else 1

    def show(c: Column) -> Column:
        if kind == "count":
            return F.when(c == F.floor(c), half_up(c, 0)).otherwise(half_up(c, 1))
        return half_up(c.cast("decimal(28,11)") * scale, digits)

    unit = F.lit(" %" if kind == "pct" else "")
    bracket = F.when(
        (n > 1) & (show(low) != show(high)),
        F.concat(F.lit(" ["), show(low), F.lit("–"), show(high), F.lit("]")),
    ).otherwise("")
    short = F.when(n < total, F.concat(F.lit(" (n = "), n.cast("string"), F.lit(")"))).otherwise("")
    return F.when(n > 0, F.concat(show(middle), unit, bracket, short)).otherwise(F.lit(DASH))


def fill_cell(value: Column) -> Column:
    """A report cell: a bar or a line break in it is an error."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    bad = text.contains("|") | text.contains("\n")
    return F.when(bad, F.raise_error(F.concat(F.lit("bad cell: "), text))).otherwise(text)

"""Reports over populations: fixed rules over several sources, summed up in one pass.

A population is a rule over the rows of one source; a row may be in many of them, which a bit mask says.
Every source is read once, equal values of equal membership are counted, and one ranking of these counts
gives the median, the ends and the counts of all populations: at each value one running count per population.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import as_decimal, shown_range
from .ordered import Ordered, group_total, running_sum


@dataclass(frozen=True)
class Population:
    """Rows of a source for which a rule (an SQL predicate) holds; ``hidden`` values are not shown for them."""

    code: str
    name: str
    source: str
    rule: str
    hidden: tuple[str, ...] = ()


def membership(populations: Sequence[Population], source: str) -> Column:
    """Bit i says whether a row of the source is in population i; a rule that is not known does not hold."""
    bits = [
        F.when(F.expr(p.rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
        for i, p in enumerate(populations) if p.source == source
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("bigint"))


def in_population(i: int) -> Column:
    return F.col("members").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0


def population_values(sources: Mapping[str, DataFrame], populations: Sequence[Population], values: Mapping[str, str]) -> DataFrame:
    """``i, code, pop, source, value, rows, known, lo, mid, hi`` for every population and every value (a column
    and the kind of its text); a source without the column has no known values, an empty population no rows.

    At most 62 populations. Values are decimals, so equal text is an equal value.
    """
    if len(populations) > 62:
        raise ValueError("at most 62 populations")
    number = lambda df, v: as_decimal(F.col(v)) if v in df.columns else F.lit(None)
    long = []
    for name, df in sources.items():
        held = df.withColumn("members", membership(populations, name)).where("members <> 0")
        cells = F.array(*[F.struct(F.lit(v).alias("value"), number(df, v).cast("decimal(28,10)").alias("v")) for v in values])
        long.append(held.select("members", F.explode(cells).alias("c")).select("members", "c.value", "c.v"))
    counted = reduce(DataFrame.union, long).groupBy("value", "v", "members").agg(F.count(F.lit(1)).alias("c"))
    every = range(len(populations))
    mine = {i: F.when(in_population(i) & F.col("v").isNotNull(), F.col("c")).otherwise(0) for i in every}
    ranked = Ordered(counted, ["value"], ["v", "members"]).add(
        **{f"upto{i}": running_sum(mine[i]) for i in every}, **{f"k{i}": group_total(mine[i]) for i in every}).df

    def facts(i: int) -> Column:
        here = in_population(i) & F.col("v").isNotNull()
        low, high = F.floor((F.col(f"k{i}") - 1) / 2), F.ceil((F.col(f"k{i}") - 1) / 2)
        at = lambda rank: F.max(F.when(here & (F.col(f"upto{i}") - mine[i] <= rank) & (F.col(f"upto{i}") > rank), F.col("v")))
        return F.struct(
            F.lit(i).alias("i"), F.sum(F.when(in_population(i), F.col("c")).otherwise(0)).alias("rows"), F.max(f"k{i}").alias("known"),
            F.min(F.when(here, F.col("v"))).alias("lo"), ((at(low) + at(high)) / F.lit(2)).cast("decimal(28,11)").alias("mid"),
            F.max(F.when(here, F.col("v"))).alias("hi"))

    found = ranked.groupBy("value").agg(F.array(*[facts(i) for i in every]).alias("f")).select("value", F.explode("f").alias("f")).select("value", "f.*")
    spark = counted.sparkSession
    listed = spark.createDataFrame(
        [(i, p.code, p.name, p.source, v) for i, p in enumerate(populations) for v in values],
        "i int, code string, pop string, source string, value string")  # the rules themselves, a few dozen rows
    known = F.coalesce("known", F.lit(0)).cast("bigint").alias("known")
    return listed.join(found, ["i", "value"], "left").select(
        "i", "code", "pop", "source", "value", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"), known, "lo", "mid", "hi")


def population_table(sources: Mapping[str, DataFrame], populations: Sequence[Population], values: Mapping[str, str]) -> DataFrame:
    """One row per population: ``code, pop, sequences, source`` and the cell of every value, a dash where it is hidden
    or nothing is known."""
    facts = population_values(sources, populations, values)
    cell = F.lit(None).cast("string")
    for v, kind in values.items():
        shown = shown_range(*[F.col(c) for c in ("mid", "lo", "hi", "known", "rows")], kind)
        hidden = [i for i, p in enumerate(populations) if v in p.hidden]
        text = F.when(F.col("i").isin(hidden), "—").otherwise(shown) if hidden else shown
        cell = F.when(F.col("value") == v, text).otherwise(cell)
    cells = [F.max(F.when(F.col("value") == v, F.col("cell"))).alias(v) for v in values]
    return facts.withColumn("cell", cell).groupBy("i", "code", "pop", "source").agg(F.max("rows").alias("sequences"), *cells).drop("i")

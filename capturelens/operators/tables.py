"""Joins and set checks of study tables: wide joins, inheritance, lookups, audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import pair_number
from .ordered import dealt


def prefixed(df: DataFrame, prefix: str, key: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c != key})


def wide_join(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Full outer join of several tables on one key."""
    return reduce(lambda a, b: a.join(b, key, "full_outer"), tables)


def inherit(rows: DataFrame, base: DataFrame, key: str, derived: str, columns: Sequence[str]) -> DataFrame:
    """Rows without own values take those of the row they derive from; ``properties_from`` says so.

    ``rows`` holds all ids; ``base`` the properties by id. A row counts as having own values when
    its id is in ``base``.
    """
    own = base.select(key, *columns, F.lit(True).alias("_own"))
    other = base.select(F.col(key).alias(derived), *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(True).alias("_has"))
    joined = rows.join(own, key, "left").join(other, derived, "left")
    takes = F.col("_own").isNull() & F.col("_has").isNotNull()
    return joined.select(
        key, *[c for c in rows.columns if c not in (key,)],
        *[F.when(takes, F.col(f"_b_{c}")).otherwise(F.col(c)).alias(c) for c in columns],
        F.when(takes, F.col(derived)).alias("properties_from"),
    )


def lookup(rows: DataFrame, table: DataFrame, on: Sequence[str], absent: Mapping[str, str]) -> DataFrame:
    """Left lookup; a text stands where the table has no row."""
    marked = table.withColumn("_hit", F.lit(True))
    out = rows.join(marked, list(on), "left")
    return out.withColumns({
        c: F.when(F.col("_hit").isNull(), text).otherwise(F.col(c).cast("string")) for c, text in absent.items()
    }).drop("_hit")


def dereference(rows: DataFrame, targets: DataFrame, pointer: str, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows that point at another record take its values, others keep their own and are not part of the join, as it
    would put them all, however many they are, into the task of the null key."""
    there = targets.select(F.col(key).alias(pointer), *[F.col(c).alias(f"_t_{c}") for c in columns])
    out = rows.where(F.col(pointer).isNotNull()).join(there, pointer, "left")
    out = out.withColumns({c: F.col(f"_t_{c}") for c in columns}).drop(*[f"_t_{c}" for c in columns])
    return out.unionByName(rows.where(F.col(pointer).isNull()))


def marked_by_names(views: DataFrame, holdout: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every view and whether it is ``listed``, by one join."""
    rows, names = dealt(keys, views, holdout.select(*keys).distinct())
    out = rows.join(names.withColumn("_hit", F.lit(True)), list(keys), "left")
    return out.select(*[out[c] for c in views.columns], F.col("_hit").isNotNull().alias("listed"))


def split_by_names(views: DataFrame, holdout: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Test views (listed) and training views (not listed)."""
    marked = marked_by_names(views, holdout, keys)
    return marked.where("listed").drop("listed"), marked.where("NOT listed").drop("listed")


def pair_by_name(truth: DataFrame, guess: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Truth and prediction of the same name; unmatched rows go."""
    return truth.join(guess, list(keys))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Fail when the frame is empty (one row is looked at)."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def candidate_lookup(rows: DataFrame, names: DataFrame, row_key: Sequence[str], candidates: Column, name: str) -> DataFrame:
    """The existing name that comes first among each row's candidates; null when none exists."""
    tried = rows.select(*row_key, F.posexplode(candidates).alias("_rank", name))
    hits = tried.join(names.select(name).distinct(), name)
    best = hits.groupBy(*row_key).agg(F.min_by(name, "_rank").alias(name))
    return rows.join(best, list(row_key), "left")


def missing_members(members: DataFrame, group: str, member: str, needed: Sequence[str]) -> DataFrame:
    """Groups that lack any needed member, with what they lack."""
    have = members.where(F.col(member).isin(list(needed))).select(group, member).distinct()
    seen = have.groupBy(group).agg(F.collect_set(member).alias("_have"))
    lack = F.array_except(F.array(*[F.lit(n) for n in needed]), F.coalesce("_have", F.array().cast("array<string>")))
    everyone = members.select(group).distinct().join(seen, group, "left")
    return everyone.select(group, F.array_join(F.array_sort(lack), ",").alias("missing")).where("missing <> ''")


def absent_rows(listed: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Listed keys that are not present."""
    return listed.join(present.select(*keys).distinct(), list(keys), "left_anti")


def pair_details(pairs: DataFrame, images: DataFrame, geometry: DataFrame, a: str, b: str) -> DataFrame:
    """Names, frame gap and inliers of image pairs.

    ``images(image, name, index)``, ``geometry(pair, inliers)`` with ``pair`` a pair number.
    """
    side = lambda p, k: images.select(F.col("image").alias(k), F.col("name").alias(f"name_{p}"), F.col("index").alias(f"_i{p}"))
    return (
        pairs.join(side("a", a), a, "left").join(side("b", b), b, "left")
        .withColumn("pair", pair_number(F.col(a), F.col(b)))
        .join(geometry, "pair", "left")
        .withColumn("frame_gap", F.abs(F.col("_ia") - F.col("_ib"))).drop("_ia", "_ib")
    )


def attach_rates(runs: DataFrame, rates: DataFrame, masked: Column, sequence: str, excluded: Column) -> DataFrame:
    """Success rate by (sequence, masked); excluded conditions stay open and count as pending."""
    found = rates.select(F.col("sequence").alias(sequence), F.col("masked").alias("_m"), F.col("rate").alias("_rate"))
    out = runs.withColumn("_m", masked).join(found, [sequence, "_m"], "left")
    rate = F.when(~excluded, F.col("_rate"))
    return out.withColumns({"registration_success_rate": rate, "pending_repeats": rate.isNull()}).drop("_m", "_rate")


def merge_columns(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """New values over old ones; unknown ids are added, missing values are empty text."""
    fresh = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns])
    merged = old.join(fresh, key, "full_outer")
    has = set(old.columns)
    value = lambda c: F.coalesce(
        F.col(f"_n_{c}").cast("string"), *([F.col(c).cast("string")] if c in has else []), F.lit("")
    )
    return merged.withColumns({c: value(c) for c in columns}).drop(*[f"_n_{c}" for c in columns])


def audit_columns(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Cells on which two tables disagree for the same key; no rows means they agree."""
    other = b.select(key, *[F.col(c).cast("string").alias(f"_o_{c}") for c in columns])
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("left"), F.col(f"_o_{c}").alias("right"))
        for c in columns
    ]))
    both = a.join(other, key).select(key, cells.alias("_c")).select(key, "_c.*")
    return both.where(~F.col("left").eqNullSafe(F.col("right")))


def unpivot_column(table: DataFrame, key: str, group: str, order: str, column: str) -> DataFrame:
    """One dataset's column out of a property-by-dataset table."""
    return table.select(key, group, order, F.col(column).cast("string").alias("value"))


def key_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).subtract(b.select(key))


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    left = key_difference(a, b, key).withColumn("only_in", F.lit("left"))
    return left.unionByName(key_difference(b, a, key).withColumn("only_in", F.lit("right")))


def touching(chunks: DataFrame, topics: Column, wanted: Sequence[str]) -> DataFrame:
    """Chunks that hold any wanted topic."""
    return chunks.where(F.arrays_overlap(topics, F.array(*[F.lit(t) for t in wanted])))


def append_rows(*frames: DataFrame) -> DataFrame:
    """Rows of different kinds under the union of their columns, in first-seen order."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_summary(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """One record per run from several partial ones; later parts win, lists are left out."""
    out = parts[0]
    for part in parts[1:]:
        scalars = [f.name for f in part.schema.fields if f.dataType.typeName() != "array" and f.name != key]
        fresh = part.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in scalars])
        out = out.join(fresh, key, "left")
        have = set(out.columns)
        out = out.withColumns({
            c: F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)) if c in have else F.col(f"_n_{c}")
            for c in scalars
        }).drop("_hit", *[f"_n_{c}" for c in scalars])
    return out


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group; the limit is applied before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


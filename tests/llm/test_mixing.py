"""Mixing: targets against a plain water filling, exact budgets, reruns, edge rows."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from capturelens.llm.mixing import mix, plan_mix, source_targets


def filled(sizes, weights=(5, 2, 1), epochs=3):
    """Targets by filling in rounds: what exceeds a limit goes to the others by weight."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_names = {}, sum(sizes.values()), set(names)
    while open_names:
        share = {s: left * w[s] / sum(w[x] for x in open_names) for s in open_names}
        over = {s for s in open_names if share[s] > epochs * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = float(epochs * sizes[s])
            left -= epochs * sizes[s]
        open_names -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:02d}": rng.choice([0, 1, 10, 1000, 50_000]) for i in range(rng.randint(1, 12))} | {None: 70}
    got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint"))
    want = filled(sizes)
    assert {r["source"]: r["target"] for r in got.collect()} == pytest.approx(want, abs=1e-6)


def some_rows():
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), f"s{rng.choice([0, 0, 0, 1, 2, 3])}") for i in range(400)]
    return rows + [(1000, None, "s1"), (1001, "", None), (1002, "one two", None), (1003, "w " * 30_000, "s4"), (1004, "a b", "S")]


def test_budgets_are_exact_and_reruns_agree(documents):
    rows = some_rows()
    table = documents(rows)
    got = plan_mix(table).collect()
    source = {r[0]: r[2] for r in rows}
    per = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        per[source[r["doc_id"]]] += r["taken"]
    for r in got:
        assert per[source[r["doc_id"]]] == int(r["target"])
    assert sorted(got) == sorted(plan_mix(table.repartition(7)).collect())


def test_mixed_rows_hold_what_the_plan_takes(documents):
    table = documents(some_rows())
    taken = {r["doc_id"]: r["taken"] for r in plan_mix(table).collect()}
    mixed = mix(table)
    assert mixed.columns == table.columns
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len((r["text"] or "").split())
    assert {i: n for i, n in words.items() if n} == {i: n for i, n in taken.items() if n}
    assert {1000, 1001} <= set(words)


def test_null_and_repeated_ids_and_empty_table(documents):
    rows = [(None, "a b c", "x"), (5, "d e", "x"), (5, "d e", "x"), (6, "f", "y")]
    got = plan_mix(documents(rows)).collect()
    assert len(got) == 4 and sum(r["taken"] for r in got) == sum({int(r["target"]) for r in got})
    assert plan_mix(documents([])).count() == 0 and mix(documents([])).count() == 0


def test_every_row_of_a_repeated_id_takes_its_part(documents):
    """Three unequal texts of one id: the mix holds as many words as the plan takes."""
    rows = [(5, "a b c d e f g", "x"), (5, "h i", "x"), (5, "j " * 20, "x"), (None, "k l", "x"), (6, "m " * 9, "y"), (7, "n " * 40, None)]
    table = documents(rows)
    taken = Counter()
    for r in plan_mix(table).collect():
        taken[r["doc_id"]] += r["taken"]
    held = Counter()
    for r in mix(table).collect():
        held[r["doc_id"]] += len(r["text"].split())
    assert held == taken


def test_mix_of_columns_with_any_names(documents):
    rows = [(1, "a b c", "x"), (2, "d", "y"), (3, None, None)]
    table = documents(rows)
    for name in ("_size", "_taken", "_rows", "_words", "size", "taken", "row", "key", "before", "target"):
        table = table.withColumn(name, F.lit(1))
    mixed = mix(table)
    assert mixed.columns == table.columns and {r["doc_id"] for r in mixed.collect()} == {1, 2, 3}

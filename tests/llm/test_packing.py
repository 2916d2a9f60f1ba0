"""Packing: the plan against one-by-one best fit, whole contents, edge rows."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from test_tokens import ODD, WORDS, library

from capturelens.llm.packing import SIZES, pack, plan_bins, sequence_cost
from capturelens.llm.queries import QUERIES


def bins_of(histogram, placed):
    out = defaultdict(list)
    seen = Counter()
    for length, rank, count, first, each in placed:
        assert rank == seen[length]
        seen[length] += count
        for r in range(count):
            out[first + r // each].append(length)
    assert seen == Counter({k: v for k, v in histogram.items() if v})
    return out


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit(seed):
    """With one size the groups of equal bins do what best fit decreasing does piece by piece."""
    rng = random.Random(seed)
    histogram = Counter(rng.choice([rng.randint(1, 100), rng.randint(1, 12), 100]) for _ in range(rng.randint(1, 800)))
    got = bins_of(histogram, plan_bins(histogram, [100]))
    rooms: list[int] = []
    for length in sorted(histogram.elements(), reverse=True):
        fitting = [(room, -i) for i, room in enumerate(rooms) if room >= length]
        if fitting:
            rooms[-min(fitting)[1]] -= length
        else:
            rooms.append(100 - length)
    assert sorted(100 - sum(b) for b in got.values()) == sorted(rooms)


def test_several_sizes_cost_less_than_one():
    rng = random.Random(1)
    histogram = Counter(min(8192, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(5000))
    small = lambda n: next(s for s in SIZES if s >= n)
    cost = lambda sizes: sum(sequence_cost(small(sum(b))) for b in bins_of(histogram, plan_bins(histogram, sizes)).values())
    assert cost(SIZES) < min(cost([8192]), 1.2 * sum(k * v for k, v in histogram.items()))


def test_plan_does_not_grow_with_the_rows():
    rng = random.Random(3)
    histogram = {n: rng.randint(0, 10**9) for n in range(1, 8193)}
    assert len(plan_bins(histogram)) < 30 * 8192


def test_every_token_has_one_place(documents):
    rng = random.Random(7)
    rows = [(i, "w " * rng.choice([0, 3, 40, 700, 2500])) for i in range(300)]
    rows += [(900, "w " * 20_000), (901, None), (None, "a b"), (None, "a b"), (902, "x"), (902, "x y")]
    got = pack(documents(rows)).collect()
    want = Counter((i, len((t or "").split()) + 1) for i, t in rows)
    whole = defaultdict(int)
    for r in got:
        whole[r["doc_id"]] += r["length"]
    totals = defaultdict(int)
    for (i, n), c in want.items():
        totals[i] += n * c
    assert whole == totals
    assert sorted(r["first"] for r in got if r["doc_id"] == 900) == [0, 8192, 16384]
    by_bin = defaultdict(list)
    for r in got:
        by_bin[r["bin"]].append(r)
    for held in by_bin.values():
        at = 0
        for r in sorted(held, key=lambda r: r["place"]):
            assert r["place"] == at
            at += r["length"]
        assert {r["bin_size"] for r in held} == {min(s for s in SIZES if s >= at)}
    assert pack(documents([])).count() == 0


def test_query_packs_tokens(spark, documents, tmp_path):
    """Digits, marks and texts without spaces take the tokens they have, cut into pieces where they are long."""
    rng = random.Random(4)
    base64 = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=30_000))
    texts = [*ODD, base64, "日本語" * 5000, "1234567890 " * 400, "plain words here"]
    rows = [*enumerate(texts), (3, texts[3]), (None, "a1!"), (None, "a1!")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op10_best_fit_packing"](spark, str(tmp_path)).collect()
    want, whole, held = Counter(), Counter(), Counter()
    for (i, _), ids in zip(rows, library(WORDS, [t for _, t in rows])):
        want[i] += len(ids) + 1
    for r in got:
        whole[r["doc_id"]] += r["length"]
        held[r["bin"], r["bin_size"]] += r["length"]
    assert whole == want and max(r["piece"] for r in got) > 0
    assert all(size == min(s for s in SIZES if s >= n) for (_, size), n in held.items())

"""Nearest sites and hulls against a comparison of all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from capturelens.operators import spatial as spt


def brute(queries, sites, k, exclude_self=False):
    out = {}
    for g, q, *p in queries:
        near = sorted((np.sqrt(sum((a - b) * (a - b) for a, b in zip(p, c))), i) for h, i, *c in sites if h == g and not (exclude_self and i == q))
        out[(g, q)] = [(i, round(float(d), 9)) for d, i in near[:k]]
    return {key: v for key, v in out.items() if v}


def found(df, site):
    out = {}
    for r in df.orderBy("rank").collect():
        out.setdefault((r["g"], r["q"]), []).append((r[site], round(r["dist"], 9)))
    return out


def clusters(rng, n, dims):
    """A very dense cluster, a wide one, a line, copies of places, and a site far away."""
    dense = 100 + rng.normal(0, 1e-4, (n, dims))
    wide = rng.random((n, dims)) * 1000
    line = np.repeat(np.linspace(0, 50, n // 4)[:, None], dims, axis=1)
    same = np.tile(wide[:3], (n // 12, 1))
    return np.concatenate([dense, wide, line, same, np.full((1, dims), -4000.0)])


@pytest.mark.parametrize("dims,k,own", [(2, 1, False), (3, 3, True), (1, 2, False)])
def test_nearest_equals_brute_force(spark, monkeypatch, dims, k, own):
    monkeypatch.setattr(spt, "CELL_SITES", 8)
    rng = np.random.default_rng(dims)
    names = ["x", "y", "z"][:dims]
    sites = [(int(i % 2), i, *map(float, p)) for i, p in enumerate(clusters(rng, 120, dims))]
    queries = sites if own else [(int(i % 3), i, *map(float, p)) for i, p in enumerate(clusters(rng, 60, dims))]
    shape = "".join(f", {c} double" for c in names)
    qs = spark.createDataFrame(queries, "g int, q int" + shape).repartition(3)
    ss = spark.createDataFrame(sites, "g int, s int" + shape).repartition(3) if not own else qs
    got = spt.nearest(qs, ss, ["g"], names, "q", "q" if own else "s", k, exclude_self=own)
    assert found(got, "neighbour" if own else "s") == brute(queries, sites, k, own)


def test_few_sites_are_compared(spark):
    """Queries in and between two clusters whose densities differ by a factor of a billion look at few sites each."""
    rng = np.random.default_rng(9)
    at = np.concatenate([rng.normal(0, 1e-3, (3000, 2)), 500 + rng.normal(0, 30, (3000, 2))])
    sites = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(at)], "g int, s int, x double, y double")
    asked = np.concatenate([at[::60] + 1e-5, [[250.0, 250.0], [-900.0, 40.0]]])
    queries = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(asked)], "g int, q int, x double, y double")
    pairs = spt.search_pairs(queries, sites, ["g"], ["x", "y"], "s", 1)
    many = [r["count"] for r in pairs.groupBy("_c0", "_c1").count().collect()]
    assert len(many) == len(asked) and max(many) <= 9 * spt.CELL_SITES and np.mean(many) <= 3 * spt.CELL_SITES
    plan = pairs._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_nearest_without_answers(spark):
    none = spark.createDataFrame([], "g int, s int, x double")
    some = spark.createDataFrame([(1, 1, 2.0), (None, 2, 1.0), (1, 3, None), (1, 4, float("nan"))], "g int, q int, x double")
    assert spt.nearest(some, none, ["g"], ["x"], "q", "s").collect() == []
    got = spt.nearest(some, some.withColumnRenamed("q", "s"), ["g"], ["x"], "q", "s", k=2).collect()
    assert [(r.q, r.s, r.dist) for r in got] == [(1, 1, 0.0)]
    assert spt.nearest(some.drop("g"), some.drop("g").withColumnRenamed("q", "s"), [], ["x"], "q", "s").count() == 2


def plain_hull(points):
    ordered = sorted(set(points))
    if len(ordered) < 3:
        return ordered

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(ordered) + half(ordered[::-1])


def test_hulls_and_points_in_them(spark):
    """A circle (every point a corner), a cloud, a grid, a line, one place, two places, a null group."""
    rng = np.random.default_rng(2)
    turn = np.linspace(0, 2 * np.pi, 400, endpoint=False)
    groups = {
        1: np.stack([np.cos(turn), np.sin(turn)], axis=1) * 1000, 2: rng.normal(0, 5, (500, 2)), 3: np.array([(i, j) for i in range(9) for j in range(7)], float),
        4: np.array([(i, 2 * i) for i in range(10)], float), 5: np.full((6, 2), 3.0), 6: np.array([(0.0, 0.0), (1.0, 1.0)]), None: rng.random((40, 2)),
    }
    rows = [(g, float(a), float(b)) for g, ps in groups.items() for a, b in ps]
    df = spark.createDataFrame(rows + [(2, float("nan"), 1.0), (2, None, 1.0)], "g bigint, x double, y double").repartition(5)
    corners = spt.hull_corners(df, "g", "x", "y")
    got = {}
    for r in corners.orderBy("corner").collect():
        got.setdefault(r.g, []).append((r.x, r.y))
    for g, ps in groups.items():
        want = plain_hull([tuple(map(float, p)) for p in ps])
        assert set(got[g]) == set(want) and len(got[g]) == len(want), g
        at = want.index(got[g][0])
        assert got[g] == want[at:] + want[:at] or len(want) < 3
    asked = [(g, i, float(a), float(b)) for i, g in enumerate([1, 2, 3, 4, None] * 40) for a, b in [rng.normal(3, 4, 2) * (200 if g == 1 else 0.2 if g is None else 1)]]
    asked += [(3, 1000, 8.0, 3.0), (3, 1001, 8.0001, 3.0), (3, 1002, 0.0, 0.0), (2, 1003, float("nan"), 0.0), (9, 1004, 0.0, 0.0), (3, 1005, 4.0, 3.0)]
    points = spark.createDataFrame(asked, "g bigint, q bigint, x double, y double")
    inside = {r.q: r.inside for r in spt.points_in_hull(points, corners, "g", "x", "y", "q").collect()}
    for g, q, a, b in asked:
        ring = plain_hull([tuple(map(float, p)) for p in groups.get(g, [])])
        held = len(ring) > 2 and all(
            (bx - ax) * (b - ay) - (by - ay) * (a - ax) >= -1e-9 for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]))
        assert inside[q] == held, (g, q)


def test_a_leaf_gives_its_nearest_sites_only(split, monkeypatch):
    """What is sorted by query are the few nearest sites of each leaf, not all pairs; cut or not, they are the nearest."""
    rng = np.random.default_rng(3)
    points = [(1, i, *map(float, p)) for i, p in enumerate(rng.random((60, 2)))] + [(2, i, *map(float, p)) for i, p in enumerate(np.concatenate([rng.random((300, 2)), np.zeros((20, 2))]))]
    df = split.createDataFrame(points, "g int, q int, x double, y double")
    rows, smallest = [], spt._smallest
    monkeypatch.setattr(spt, "_smallest", lambda found, keys, k: rows.append(found) or smallest(found, keys, k))
    got = found(spt.nearest(df, df, ["g"], ["x", "y"], "q", "q", 1, exclude_self=True), "neighbour")
    assert got == brute(points, points, 1, True)
    assert 2 * rows[0].count() < spt.search_pairs(df, df, ["g"], ["x", "y"], "q", 2).count()

"""Population reports and static pixels against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from capturelens.operators import raster as rs
from capturelens.operators.populations import Population, population_table, population_values

POPS = [
    Population("a", "all", "one", "true"), Population("a", "large", "one", "x >= 5"), Population("a", "unknown rule", "one", "y > 1"),
    Population("b", "few", "two", "k = 1", hidden=("x",)), Population("b", "none", "two", "k > 100"), Population("c", "no source", "three", "true"),
]


@pytest.fixture
def sources(spark):
    rng = np.random.default_rng(0)
    one = [(round(float(v), 2), None if i % 3 else float(i)) for i, v in enumerate(rng.random(60) * 10)] + [(None, 5.0), (4.0, 2.0), (4.0, 2.0)]
    two = [(i % 4, float(i)) for i in range(20)]
    return one, two, {"one": spark.createDataFrame(one, "x double, y double"), "two": spark.createDataFrame(two, "k int, x double")}


def test_values_equal_plain_medians(sources, split):
    one, two, frames = sources
    rows = {0: one, 1: [r for r in one if r[0] is not None and r[0] >= 5], 2: [r for r in one if r[1] is not None and r[1] > 1],
            3: [(x,) for k, x in two if k == 1], 4: [], 5: []}
    got = {(r.i, r.value): r for r in population_values(frames, POPS, {"x": "f2", "y": "count"}).collect()}
    assert len(got) == len(POPS) * 2
    for i, held in rows.items():
        for at, v in enumerate(("x", "y")):
            known = [r[at] for r in held if len(r) > at and r[at] is not None]
            r = got[i, v]
            assert (r.rows, r.known) == (len(held), len(known)), (i, v)
            want = (min(known), float(np.median(known)), max(known)) if known else (None,) * 3
            assert tuple(None if c is None else float(c) for c in (r.lo, r.mid, r.hi)) == pytest.approx(want)


def test_table_hides_and_dashes(sources):
    got = {r["pop"]: r for r in population_table(sources[2], POPS, {"x": "f2", "y": "count"}).collect()}
    assert len(got) == len(POPS) and got["few"]["x"] == "—" and got["none"]["x"] == "—" and got["none"]["sequences"] == 0
    assert got["all"]["sequences"] == 63 and "(n = 62)" in got["all"]["x"] and got["no source"]["sequences"] == 0


def test_static_pixels_of_many_frames(spark, monkeypatch):
    """Counted medians equal those of the values, over several tiles, even and odd numbers of frames, null frames."""
    monkeypatch.setattr(rs, "TILES_HELD", 1)
    rng = np.random.default_rng(4)
    frames = {s: rng.integers(0, 256, (n, 130)) * (rng.random(130) < 0.3) + 100 * (rng.random(130) < 0.5) % 256 for s, n in ((1, 41), (2, 40), (None, 7))}
    rows = [(s, np.clip(f, 0, 255).astype(float).tolist()) for s, fs in frames.items() for f in fs] + [(1, None)]
    df = spark.createDataFrame(rows, "seq int, data array<double>").repartition(5)
    got = {(r.seq, r.p): r.static for r in rs.static_pixels(df, "seq", "data").collect()}
    for s, fs in frames.items():
        v = np.clip(fs, 0, 255)
        want = (np.abs(v - np.median(v, axis=0)) < 10).mean(axis=0) > 0.9
        assert [got[s, p] for p in range(130)] == want.astype(float).tolist()
    plan = rs.static_pixels(df, "seq", "data")._jdf.queryExecution().toString()
    assert "Generate" not in plan
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0])], "seq int, data array<double>")
    assert rs.static_share(odd, "seq", "data", 1, F.lit(False)).first()["state"] == "undetermined"

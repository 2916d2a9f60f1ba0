"""Kernels and rules against brute force on small fixtures."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from capturelens.functions import formats as fm
from capturelens.functions import geometry as geo
from capturelens.functions import text as tx
from capturelens.operators import cloud as cl
from capturelens.operators import pose as ps
from capturelens.operators import raster as rs
from capturelens.operators import robust as rb
from capturelens.operators import sampling as sp
from capturelens.operators import sequence as sq
from capturelens.operators import spacing
from capturelens.operators import spatial as spt
from capturelens.operators.headings import away, covering_arc, in_cone, run_starts
from capturelens.operators.spacing import spaced_frames


def frames(spark, sizes):
    rows = [(n, i) for n in sizes for i in range(n)]
    return spark.createDataFrame(rows, "seq int, t int")


SIZES = [1, 35, 36, 50, 199, 200, 399, 400]


def test_stride_sampling_edges(spark):
    got = sp.sample_stride(frames(spark, SIZES), "seq", ["t"]).groupBy("seq").agg(F.collect_list("ord").alias("o")).collect()
    for r in got:
        k = max(r.seq // 200, 1)
        assert sorted(r.o) == list(range(0, r.seq, k))[:200]


def test_half_even_step(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (3.0,), (5.0,), (7.0,), (None,)], "fps double")
    got = [r[0] for r in df.select(sp.stride(F.lit(100), F.col("fps"))).collect()]
    assert got == [max(0, round((f or 0) / 2), 1) for f in (0.5, 1.0, 3.0, 5.0, 7.0, None)]


def test_video_step_is_widened(spark):
    df = spark.createDataFrame([(1467, 12.0)], "n int, fps double")
    assert df.select(sp.video_step(F.col("n"), F.col("fps"), 2.0, 200)).first()[0] == 7


def test_block_holdout(spark):
    got = sp.split_block(sp.number_frames(frames(spark, SIZES), "seq", ["t"])).where("held_out").groupBy("seq").agg(F.collect_list("ord").alias("o")).collect()
    for r in got:
        n = r.seq
        want = list(range(n // 2 - 2, n // 2 + 2)) if n < 36 else [i for s in range(16, n, 32) if s + 4 < n for i in range(s, s + 4)]
        assert sorted(r.o) == [i for i in want if 0 <= i < n]


def test_half_up_and_significant(spark):
    texts = ["19.65", "0.125", "2.5", "-0.125", "1e-3", "undetermined", "", "nan"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    for nd in (0, 1, 2):
        got = [r[0] for r in df.select(fm.fmt_num(F.col("x"), nd)).collect()]
        want = [str(Decimal(x).quantize(Decimal(1).scaleb(-nd), rounding=ROUND_HALF_UP)) if x not in fm.MISSING else fm.DASH for x in texts]
        assert got == want
    values = [0.00012345, 29.985, 12.3, 123456.0, 0.0, 1e-9, -5.55555]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(fm.fmt_sig(F.col("x"))).collect()]
    assert got == [f"{v:.4g}" for v in values]


def test_edge_runs(spark):
    cases = {1: "1111", 2: "0000", 3: "1010", 4: "1101", 5: "1"}
    rows = [(s, i, c == "1") for s, text in cases.items() for i, c in enumerate(text)]
    got = {r.seq: (r.lead, r.trail) for r in sq.edge_runs(spark.createDataFrame(rows, "seq int, i int, f boolean"), "seq", "i", "f").collect()}
    assert got == {1: (4, 0), 2: (0, 0), 3: (1, 0), 4: (2, 1), 5: (1, 0)}


PASSES = {  # speeds, headings, then the first and last row of each pass
    "one": ([0.6] * 4, [0, 5, 10, 14], [(0, 3)]),
    "a turn starts a new one": ([0.6] * 5, [0, 10, 15, 20, 31], [(0, 1), (2, 3), (4, 4)]),
    "a stop ends it": ([0.6, 0.2, 0.6, 0.4, 0.9], [0] * 5, [(0, 0), (2, 2), (4, 4)]),
    "headings wrap around": ([0.6] * 4, [355, 2, 9, 11], [(0, 2), (3, 3)]),
    "never moving": ([0.1, 0.4], [0, 0], []),
}


def test_corridor_passes_by_hand(split):
    rows = [(name, float(i), v, float(yaw)) for name, (vs, yaws, _) in PASSES.items() for i, (v, yaw) in enumerate(zip(vs, yaws))]
    df = split.createDataFrame(rows, "seq string, t double, v double, yaw double").selectExpr("*", "t AS x", "t AS y")
    got = sq.corridor_passes(df, "seq", ["t"], "t", "x", "y", "v", "yaw").collect()
    for name, (_, _, want) in PASSES.items():
        assert sorted((r.run_start, r.run_start + r.n - 1) for r in got if r.seq == name) == want, name


@pytest.mark.parametrize("seed", [0, 1])
def test_corridor_passes(split, seed):
    """Every moving row is in one pass, near its first heading; the row behind a pass does not fit it."""
    rng = np.random.default_rng(seed)
    n = 600
    pdf = pd.DataFrame({"seq": np.repeat([0, 1], [500, 100]), "t": np.arange(n, dtype=float), "x": rng.random(n), "y": rng.random(n),
                        "v": rng.choice([0.2, 0.6, 0.9], n, p=[0.15, 0.5, 0.35]), "yaw": np.cumsum(rng.normal(0, 4, n)) % 360})
    got = sq.corridor_passes(split.createDataFrame(pdf), "seq", ["t"], "t", "x", "y", "v", "yaw").collect()
    for s, part in pdf.groupby("seq"):
        moving, yaw = (part["v"] > 0.4).to_numpy(), part["yaw"].to_numpy()
        spans = sorted((r.run_start, r.run_start + r.n) for r in got if r.seq == s)
        covered = np.zeros(len(part), int)
        for start, end in spans:
            covered[start:end] += 1
            turn = np.abs((yaw[start : end + 1] - yaw[start] + 180) % 360 - 180)
            assert (turn[: end - start] < 15).all()
            assert end == len(part) or not moving[end] or turn[-1] >= 15
        assert (covered == moving).all()


def _by_hand(samples, turn):
    """First rows of the passes of (stretch, ord, yaw) samples in order."""
    starts, now, first = [], None, None
    for stretch, o, yaw in samples:
        if stretch != now or not abs((yaw - first + 180.0) % 360.0 - 180.0) < turn:
            now, first = stretch, yaw
            starts.append(o)
    return starts


@pytest.mark.parametrize("turn", [15.0, 90.0])
def test_headings_over_many_blocks(spark, turn):
    """Stretches much longer than a block, with long straights, turns, jumps and missing headings."""
    rng = np.random.default_rng(int(turn))
    steps = [rng.normal(0, s, 300) for s in (0.01, 3, 0.0, 40)]
    yaws = {1: np.cumsum(np.concatenate(steps)) % 360, 2: np.full(500, 359.5), 3: rng.random(200) * 360, 4: np.array([0.0])}
    yaws[2][250:] = 3.0
    yaws[3][50] = np.nan
    rows, at = [], 0
    for stretch, yaw in yaws.items():
        rows += [(stretch, at + i, float(v)) for i, v in enumerate(yaw)]
        at += len(yaw) + 3
    df = spark.createDataFrame([("=s", *r) for r in rows] + [("", *r) for r in rows[:700]], "key string, stretch bigint, ord bigint, yaw double")
    got = run_starts(df.repartition(3), turn, fan=4).collect()
    assert sorted(r.ord for r in got if r.key == "=s") == _by_hand(rows, turn)
    assert sorted(r.ord for r in got if r.key == "") == _by_hand(rows[:700], turn)


def test_arcs_hold_their_headings():
    rng = np.random.default_rng(5)
    for _ in range(300):
        yaw = (rng.normal(rng.random() * 360, rng.choice([0, 5, 40, 200]), rng.integers(1, 12))) % 360
        low, high = covering_arc(yaw, yaw)
        for h in rng.random(20) * 360:
            inside = bool(in_cone(np.array([h]), np.array([low]), np.array([high]), 90.0)[0, 0])
            assert inside == bool((np.abs(away(yaw, h)) < 90.0).all())
        parts = np.array_split(yaw, 3)
        ends = np.array([covering_arc(p, p) for p in parts if len(p)])
        both = covering_arc(ends[:, 0], ends[:, 1])
        if not np.isnan(both[0]):
            assert (np.abs(away(yaw, both[0])) <= 180).all() and (((yaw - both[0]) % 360) <= ((both[1] - both[0]) % 360) + 1e-9).all()


def _greedy(rows, distance):
    kept = {}
    for s, _, *p in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2:])):
        mine = kept.setdefault(s, [])
        if all(np.sqrt(sum((a - b) * (a - b) for a, b in zip(p, q))) >= distance for q in mine):
            mine.append(tuple(p))
    return sorted(((s, p) for s, ps in kept.items() for p in ps), key=repr)


def test_greedy_spacing_of_one_hot_sequence(spark, monkeypatch):
    """A path that turns back, one that stands still, equal rows and orders, a null sequence; few listed frames a round."""
    monkeypatch.setattr(spacing, "LISTED", 4)
    monkeypatch.setattr(spacing, "TILE", 8)
    rng = np.random.default_rng(1)
    line = [(0, i, np.sin(i / 60) * 5, i / 300, 0.0) for i in range(900)]
    still = [(1, i // 2, *(rng.random(3) * 0.2)) for i in range(400)]
    rows = [(s, o, *map(float, p)) for s, o, *p in line + still + [(None, *r[1:]) for r in still[:50]] + [line[5]] * 20]
    df = spark.createDataFrame(rows, "seq bigint, i bigint, x double, y double, z double").repartition(4)
    got = spaced_frames(df, "seq", "i", ["x", "y", "z"], 0.3)
    plan = got._jdf.queryExecution().toString()
    assert "hashpartitioning(seq" not in plan
    assert sorted(((r.seq, (r.x, r.y, r.z)) for r in got.collect()), key=repr) == _greedy(rows, 0.3)
    odd = spark.createDataFrame([(1, 1, float("nan"), 0.0, 0.0), (1, 2, None, 0.0, 0.0)], df.schema)
    assert spaced_frames(odd, "seq", "i", ["x", "y", "z"], 0.3).collect() == []
    assert spaced_frames(df, "seq", "i", ["x", "y", "z"], 0.0).count() == len(rows)


def test_greedy_spacing(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"seq": np.repeat([0, 1], 150), "i": np.arange(300), "x": rng.random(300), "y": rng.random(300), "z": rng.random(300)})
    got = {r.i for r in spaced_frames(spark.createDataFrame(pdf), "seq", "i", ["x", "y", "z"], 0.3).collect()}
    want = set()
    for _, part in pdf.groupby("seq"):
        kept = []
        for r in part.itertuples():
            p = np.array([r.x, r.y, r.z])
            if all(np.linalg.norm(p - q) >= 0.3 for q in kept):
                kept.append(p)
                want.add(r.i)
    assert got == want


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    sites = np.vstack([rng.random((150, 3)), rng.random((150, 3)) * 0.01, np.repeat(rng.random((1, 3)), 20, axis=0)])  # dense and repeated places
    pdf = pd.DataFrame(sites, columns=["x", "y", "z"]).assign(i=np.arange(len(sites)), g=np.arange(len(sites)) % 2)
    df = spark.createDataFrame(pdf)
    got = spt.nearest(df, df, ["g"], ["x", "y", "z"], "i", "i", k=3, exclude_self=True).toPandas()
    for r in pdf.itertuples():
        same = pdf[(pdf["g"] == r.g) & (pdf["i"] != r.i)]
        d = np.sqrt(((same[["x", "y", "z"]].to_numpy() - [r.x, r.y, r.z]) ** 2).sum(1))
        np.testing.assert_allclose(sorted(got[got["i"] == r.i]["dist"]), np.sort(d)[:3], atol=1e-12)


def test_hull(spark):
    rng = np.random.default_rng(5)
    pts = pd.DataFrame({"g": np.repeat([0, 1], 200), "i": np.arange(400), "x": rng.normal(size=400), "y": rng.normal(size=400)})
    df = spark.createDataFrame(pts)
    hulls = spt.hull_corners(df, "g", "x", "y")
    assert spt.points_in_hull(df, hulls, "g", "x", "y", "i").where("NOT inside").count() == 0
    square = spark.createDataFrame([(0, 0.0, 0.0), (0, 2.0, 0.0), (0, 2.0, 2.0), (0, 0.0, 2.0), (0, 1.0, 1.0)], "g int, x double, y double")
    asked = spark.createDataFrame([(0, 1, 0.5, 1.5), (0, 2, 2.5, 1.0), (0, 3, 2.0, 1.0)], "g int, i int, x double, y double")
    corners = spt.hull_corners(square, "g", "x", "y")
    assert corners.count() == 4
    assert {r.i: r.inside for r in spt.points_in_hull(asked, corners, "g", "x", "y", "i").collect()} == {1: True, 2: False, 3: True}


def test_alignment_recovers_a_known_similarity(spark):
    rng = np.random.default_rng(6)
    src = rng.normal(size=(40, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    dst = 2.5 * src @ q.T + [1.0, -2.0, 3.0]
    pdf = pd.DataFrame(np.hstack([src, dst]), columns=["a", "b", "c", "d", "e", "f"]).assign(g=1)
    pairs = spark.createDataFrame(pdf)
    fit = ps.align_similarity(pairs, "g", ["a", "b", "c"], ["d", "e", "f"]).first()
    np.testing.assert_allclose(fit["scale"], 2.5)
    np.testing.assert_allclose(np.array(fit["rot"]).reshape(3, 3), q, atol=1e-9)
    np.testing.assert_allclose(fit["shift"], [1.0, -2.0, 3.0], atol=1e-9)
    err = ps.trajectory_error(pairs.limit(6), "g", ["a", "b", "c"], ["d", "e", "f"]).first()
    assert err["ate_rmse"] < 1e-9 and err["flagged"] == "yes"
    assert ps.trajectory_error(pairs.limit(3), "g", ["a", "b", "c"], ["d", "e", "f"]).first()["ate_rmse"] is None


def test_camera_to_world(spark):
    rng = np.random.default_rng(7)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    t = rng.normal(size=3)
    w2c = np.eye(4)
    w2c[:3, :3], w2c[:3, 3] = q, t
    want = np.linalg.inv(w2c)
    want[:3, 1:3] *= -1
    want = want[[0, 2, 1, 3]]
    want[2] *= -1
    df = spark.createDataFrame([(q.tolist(), t.tolist())], "r array<array<double>>, t array<double>")
    np.testing.assert_allclose(np.array(df.select(geo.camera_to_world(F.col("r"), F.col("t"))).first()[0]), want, atol=1e-12)


def test_full_mask_equals_no_mask(spark):
    rng = np.random.default_rng(8)
    a, b = rng.random(144), rng.random(144)
    df = spark.createDataFrame([(a.tolist(), b.tolist(), [True] * 144)], "a array<double>, b array<double>, k array<boolean>")
    whole, masked, m, mm = df.select(
        rs.ssim(F.col("a"), F.col("b"), F.lit(12)), rs.masked_ssim(F.col("a"), F.col("b"), F.col("k"), F.lit(12)),
        rs.mse(F.col("a"), F.col("b")), rs.masked_mse(F.col("a"), F.col("b"), F.col("k"))).first()
    assert abs(whole - masked) < 1e-12 and abs(m - mm) < 1e-12
    same = df.select(rs.psnr(rs.mse(F.col("a"), F.col("a")))).first()[0]
    assert same == float("inf")


def test_mad_floor_and_flat_scores(spark):
    obs = spark.createDataFrame([(1, 0.5, 0.5)] * 3 + [(2, 0.9, 0.1), (2, 0.5, 0.5), (2, 0.5, 0.5)], "point int, v double, s double")
    got = rb.veil_score(obs, "point", "v", "s").groupBy("point").agg(F.max("score").alias("m")).toPandas().set_index("point")["m"]
    assert got[1] == 0 and abs(got[2] - 2 * 0.4 / 0.02) < 1e-9
    flat = rb.flag_outliers(spark.createDataFrame([(0.0,)] * 4, "score double"), "score")
    assert flat.where("flagged").count() == 0


def test_view_coverage_of_one_axis(spark):
    poses = spark.createDataFrame([(1, 0.0, 0.0, 1.0)], "seq int, x double, y double, z double")
    got = ps.view_coverage(poses, "seq", ["x", "y", "z"]).first()["coverage_sr"]
    assert abs(got - 2 * np.pi * (1 - np.cos(np.radians(15)))) < 0.01


def test_log_without_attempts(spark):
    log = spark.createDataFrame([(1, 0, "step"), (2, 0, "start"), (2, 1, "off"), (2, 2, "off"), (2, 3, "start")], "run int, line int, role string")
    reason = F.when(F.col("role") == "off", F.concat(F.lit("r"), F.col("line").cast("string")))
    got = sq.log_attempts(log, "run", "line", F.col("role") == "start", F.col("role") == "step", reason)
    rows = sorted((r.run, r.attempt, r.discarded) for r in got.collect())
    assert rows == [(2, 1, "r1"), (2, 2, None)]
    best = sq.attempt_summary(got, "run").first()
    assert best["best_attempt"] == 1  # the first of equals


def test_unknown_markup_fails(spark):
    df = spark.createDataFrame([("a \\unknown{b}",)], "x string")
    with pytest.raises(Exception, match="unconverted"):
        df.select(tx.markup_to_text(F.col("x"))).collect()


def test_first_sentence(spark):
    texts = ["By A. Smith et al. Then more.", "One. Two.", "no end", "See Fig. 3. Next (a)."]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "x string").select(tx.first_sentence(F.col("x"))).collect()]
    assert got == ["By A. Smith et al.", "One.", "no end", "See Fig. 3."]


def test_principal_axis_and_seeded_sample(spark):
    rng = np.random.default_rng(9)
    pts = rng.normal(size=(400, 3)) * [5.0, 1.0, 0.2] @ np.linalg.qr(rng.normal(size=(3, 3)))[0]
    df = spark.createDataFrame(pd.DataFrame(pts, columns=["x", "y", "z"]).assign(g=1, i=np.arange(400)))
    got = cl.principal_axis(df, "g", ["x", "y", "z"]).first()
    want = np.linalg.svd(pts - pts.mean(0))[2][0]
    want = -want if want[2] < 0 else want
    np.testing.assert_allclose([got["ax"], got["ay"], got["az"]], want, atol=1e-6)
    one, two = ([r.i for r in cl.seeded_sample(df.repartition(n), "i", 50, 3).collect()] for n in (2, 7))
    assert one == two and len(set(one)) == 50
    assert one != [r.i for r in cl.seeded_sample(df, "i", 50, 4).collect()]


def test_nothing_is_lost_or_cut(spark):
    """Long values, deep markup, unknown kinds, odd legends, large numbers."""
    from capturelens.functions import names as nm
    from capturelens.functions import text as tx
    from capturelens.operators import metrics as mt
    from capturelens.operators.quantiles import exact_quantiles

    one = lambda **c: spark.createDataFrame([tuple(c.values())], ", ".join(f"{k} string" for k in c))
    long = "x" * 1_000_100
    assert one(a="k=" + long).select(F.length(F.variant_get(F.parse_json(F.to_json(tx.set_pairs(F.col("a")))), "$.k", "string")).alias("n")).first()["n"] >= 1_000_100
    ids = spark.createDataFrame([("btg_" + "a" * 1200 + "1_p0",), ("btg_" + "a" * 1200 + "2_p0",)], "s string")
    assert ids.select(nm.scene_group(F.col("s"))).distinct().count() == 2
    deep = "\\textbf{a \\emph{b \\rev{c \\acc{d \\mbox{e}}}}}"
    assert one(a=deep).select(tx.markup_to_text(F.col("a"))).first()[0] == "a b c d e"
    with pytest.raises(Exception, match="unconverted"):
        one(a="$x^2$").select(tx.markup_to_text(F.col("a"))).collect()
    with pytest.raises(Exception, match="abbreviation"):
        one(a="The columns are Depth (DEP), Width and Height (HEI).").select(tx.legend(F.col("a"))).collect()
    kinds = spark.createDataFrame([("a", 1), ("b", 2)], "kind string, v int")
    with pytest.raises(Exception, match="no preparer"):
        mt.dispatch(kinds, "kind", {"a": lambda d: d}).collect()
    with pytest.raises(Exception):
        one(a="1" + "0" * 40).select(fm.as_decimal(F.col("a"))).collect()
    nulls = spark.createDataFrame([("s", None), ("s", None), (None, 1.0), (None, 3.0)], "seq string, v double")
    got = {r.seq: (r.n, r.m) for r in exact_quantiles(nulls, ["seq"], F.col("v"), {"m": 0.5}).collect()}
    assert got == {"s": (0, None), None: (2, 2.0)}


def test_null_keys_give_the_same_rows_in_blocks(split):
    from capturelens.operators import ordered as od

    rows = [(None if i % 7 == 0 else i % 3, i % 50, i, float(i)) for i in range(1000)]
    df = split.createDataFrame(rows, "seq int, t int, id int, v double")
    add = lambda: od.Ordered(df, ["seq"], ["t", "id"]).add(n=od.ordinal(), s=od.running_sum(F.col("v"))).add(m=od.running_max(F.col("s")))
    cut = add()
    assert cut.split
    split.conf.unset("spark.capturelens.block.rows")
    assert sorted(cut.df.collect(), key=lambda r: r.id) == sorted(add().df.collect(), key=lambda r: r.id)


def test_markup_forms(spark):
    """Letters, products, raised marks, references; forms that are not known and labels without a number fail."""
    numbers = F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("B.1"))
    cases = {
        r"S\~{n}o \'e \^{o} \c{c}a {\l}a \l b": "Sño é ô ça ła ł b", r"2 $\times$ 3$^{\circ}$ x$^{a, b}$": "2 × 3° xᵃᵇ",
        r"see \ref{a}--\ref{b} and \textbf{\ref{a}}": "see 2–B.1 and 2", "50\\% of x % gone \\cite{k}\nnext": "50% of x next", "a\\cite{k}b": "ab",
    }
    df = spark.createDataFrame([(m, p) for m, p in cases.items()], "m string, p string")
    assert all(r["got"] == r["p"] for r in df.select("p", tx.markup_to_text(F.col("m"), numbers).alias("got")).collect())
    for wrong in ("$x^2$", "$^{q}$", "\\ref{zzz}", "\\unknown{a}"):
        with pytest.raises(Exception, match="markup|label"):
            spark.createDataFrame([(wrong,)], "m string").select(tx.markup_to_text(F.col("m"), numbers)).collect()
    keys = spark.createDataFrame([("x \\cite{a, b} y % \\cite{no}\n\\cite{c}",)], "m string").select(tx.cited_keys(F.col("m"))).first()[0]
    assert keys == ["a", "b", "c"]


def test_regions_and_notes(spark):
    page = "<!--@a-->x<!--/@a--> <!--@b-->y<!--/@b--> <!--@a--><!--/@a-->"
    one = spark.createDataFrame([(page, "See J. Smith. Then", "A ᵃ b. ᵃOne ᵇ two. ᵇThree")], "p string, s string, c string")
    filled = one.select(tx.fill_regions(F.col("p"), {"a": F.lit("$1\\"), "b": F.lit("")})).first()[0]
    assert filled == "<!--@a-->$1\\<!--/@a--> <!--@b--><!--/@b--> <!--@a-->$1\\<!--/@a-->"
    with pytest.raises(Exception, match="regions without content: b"):
        one.select(tx.fill_regions(F.col("p"), {"a": F.lit("1")})).collect()
    assert one.select(tx.first_sentence(F.col("s"))).first()[0] == "See J. Smith."
    assert one.select(tx.footnotes(F.col("c"), "ᵃᵇ")).first()[0] == ["ᵃOne", "ᵇ two.", "ᵇThree"]
    assert one.select(tx.footnotes(F.col("s"), "ᵃᵇ")).first()[0] == []


def test_rows_without_a_pointer_are_not_joined(spark):
    """Null pointers would meet in one task of the join, however many there are."""
    from capturelens.operators.tables import dereference

    rows = spark.createDataFrame([(1, 2, 0.1), (2, None, 0.2), (3, None, None), (4, 9, 0.4)], "level int, summary int, psnr double")
    out = dereference(rows, rows.select("level", "psnr"), "summary", "level", ["psnr"])
    got = {r.level: (r.summary, r.psnr) for r in out.collect()}
    assert got == {1: (2, 0.2), 2: (None, 0.2), 3: (None, None), 4: (9, None)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and "isnull(summary" in plan.split("Join")[0] + plan.split("Join")[1] and "isnotnull(summary" in plan.split("Join")[1]

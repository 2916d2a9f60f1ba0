"""Blocked windows and quantiles give the same values as plain ones, also for a hot sequence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from capturelens.operators import ordered as od
from capturelens.operators.quantiles import exact_median_decimal, exact_quantiles
from capturelens.operators.timejoin import asof_interp


def frame(spark, n=3000):
    rng = np.random.default_rng(1)
    seq = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 12, n))  # one sequence holds half of all rows
    pdf = pd.DataFrame({"seq": seq, "t": rng.integers(0, 500, n), "id": np.arange(n), "v": rng.integers(0, 40, n) / 4.0})
    pdf["w"] = pdf["v"].where(pdf["id"] % 7 == 0)
    return pdf, spark.createDataFrame(pdf).withColumn("w", F.when(~F.isnan("w"), F.col("w")))


def test_blocked_values(split):
    pdf, df = frame(split)
    o = od.Ordered(df, ["seq"], ["t", "id"])
    assert o.split
    got = o.add(
        ord=od.ordinal(), total=od.running_sum(F.col("v")), top=od.running_max(F.col("v")),
        rest=od.running_max(F.col("v"), backwards=True), n=od.group_total(F.lit(1)), prev=od.previous(F.col("v")),
        nxt=od.following(F.col("v")), last=od.last_known(F.col("w")), coming=od.next_known(F.col("w")),
    ).df.toPandas().sort_values(["seq", "t", "id"]).reset_index(drop=True)
    want = pdf.sort_values(["seq", "t", "id"]).reset_index(drop=True)
    g = want.groupby("seq")
    want["ord"], want["total"], want["top"] = g.cumcount(), g["v"].cumsum(), g["v"].cummax()
    want["rest"] = want[::-1].groupby("seq")["v"].cummax()[::-1]
    want["n"], want["prev"], want["nxt"] = g["v"].transform("size"), g["v"].shift(1), g["v"].shift(-1)
    want["last"], want["coming"] = g["w"].ffill(), g["w"].bfill()
    for c in want.columns:
        np.testing.assert_array_equal(got[c].to_numpy(float), want[c].to_numpy(float), err_msg=c)


def test_blocks_spread_a_hot_sequence(split):
    _, df = frame(split)
    o = od.Ordered(df, ["seq"], ["t", "id"])
    sizes = o._df.where("seq = 0").groupBy(od.BLK).count().toPandas()["count"]
    assert len(sizes) > 3 and sizes.max() < 1000


def test_quantiles_match_numpy(split):
    pdf, df = frame(split)
    got = exact_quantiles(df, ["seq"], F.col("v"), {"a": 0.1, "b": 0.5, "c": 0.999}).toPandas().set_index("seq")
    for s, part in pdf.groupby("seq"):
        np.testing.assert_allclose(got.loc[s, ["a", "b", "c"]].to_numpy(float), np.percentile(part["v"], [10, 50, 99.9]))
    whole = exact_quantiles(df, [], F.col("v"), {"m": 0.5}).first()
    assert whole["m"] == np.median(pdf["v"]) and whole["n"] == len(pdf)


def test_decimal_median(spark):
    df = spark.createDataFrame([("0.61",), ("0.62",)], "x string")
    assert str(exact_median_decimal(df, [], F.col("x"), "m").first()["m"]).startswith("0.615")


def test_asof_interp_matches_numpy(split):
    rng = np.random.default_rng(2)
    left = pd.DataFrame({"s": rng.integers(0, 3, 800), "id": np.arange(800), "t": np.round(rng.random(800) * 100, 2)})
    right = pd.DataFrame({"s": rng.integers(0, 3, 500), "u": rng.permutation(np.arange(500)) / 5.0, "y": rng.random(500)})
    out = asof_interp(split.createDataFrame(left), split.createDataFrame(right), ["s"], "t", "u", ["y"]).toPandas()
    assert len(out) == len(left)
    for s, part in out.groupby("s"):
        ref = right[right["s"] == s].sort_values("u")
        np.testing.assert_allclose(part["y"], np.interp(part["t"], ref["u"], ref["y"]))
    ends = asof_interp(split.createDataFrame(left), split.createDataFrame(right), ["s"], "t", "u", ["y"], edges="drop").toPandas()
    span = right.groupby("s")["u"].agg(["min", "max"])
    inside = sum(span.loc[r.s, "min"] <= r.t <= span.loc[r.s, "max"] for r in left.itertuples())
    assert len(ends) == inside


def test_short_sequences_are_not_written(split, monkeypatch):
    """Sequences of at most a block stay whole; one longer sequence is enough to cut them. Both give the same rows."""
    pdf, _ = frame(split)
    short = split.createDataFrame(pdf[["id", "t", "v"]].assign(seq=pdf["id"] // 100).replace({"seq": {3: np.nan}}))
    short = short.withColumn("seq", F.when(~F.isnan("seq"), F.col("seq")))
    values = lambda o: o.add(n=od.ordinal(), prev=od.previous(F.col("v"))).add(s=od.running_sum(F.col("n"))).df
    cut = od.Ordered(short.withColumn("seq", F.lit(1)), ["seq"], ["t", "id"])
    assert cut.split
    with monkeypatch.context() as m:
        m.setattr(od, "short_groups", lambda df, by: False)
        want = sorted(values(od.Ordered(short, ["seq"], ["t", "id"])).collect(), key=lambda r: r.id)
        q = sorted(exact_quantiles(short, ["seq"], F.col("v"), {"m": 0.5}).collect(), key=str)
    m = monkeypatch
    m.setattr(od, "write_through", lambda *a: (_ for _ in ()).throw(AssertionError("written")))
    whole = od.Ordered(short, ["seq"], ["t", "id"])
    assert not whole.split
    assert sorted(values(whole).collect(), key=lambda r: r.id) == want
    assert sorted(exact_quantiles(short, ["seq"], F.col("v"), {"m": 0.5}).collect(), key=str) == q


def test_scores_of_short_and_long_points(split, monkeypatch):
    """Points of at most a block are scored where their rows are, without percentiles over blocks; longer ones as before."""
    from capturelens.operators import robust as rb

    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"point": rng.integers(0, 40, 900), "id": np.arange(900), "v": rng.integers(0, 12, 900) / 10, "s": rng.normal(size=900)})
    df = split.createDataFrame(pdf).withColumns({
        "point": F.when(F.col("point") != 5, F.col("point")), "v": F.when((F.col("id") % 9 != 0) & (F.col("point") != 7), F.col("v"))})
    score = lambda: sorted(rb.veil_score(rb.long_tracks(df, "point", 3, F.col("s") < 1.5), "point", "v", "s").collect(), key=lambda r: r.id)
    split.conf.set("spark.capturelens.block.rows", "20")
    want = score()
    split.conf.set("spark.capturelens.block.rows", "150")
    monkeypatch.setattr(rb, "_channel_medians", lambda *a: (_ for _ in ()).throw(AssertionError("in blocks")))
    got = score()
    assert len(got) == len(want) > 700 and got == want


def test_views_are_marked_by_one_join(spark):
    """Listed or not is told by one join, a name listed twice gives no second row, a null name is not listed."""
    from capturelens.operators.tables import marked_by_names

    views = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 0)], "run long, view long")
    marked = marked_by_names(views, spark.createDataFrame([(1, 1), (1, 1), (None, 0)], "run long, view long"), ["run", "view"])
    assert sorted((r["run"] or -1, r["view"], r["listed"]) for r in marked.collect()) == [(-1, 0, False), (1, 0, False), (1, 1, True), (2, 0, False)]
    assert marked._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_labels_are_numbered_in_one_order(spark, monkeypatch):
    """Sections of a part come from the document's count; a part may begin without a section and a kind may be null."""
    from capturelens.operators import documents as dc
    from capturelens.operators.ordered import Ordered

    made = []
    monkeypatch.setattr(dc, "Ordered", lambda *a: made.append(a) or Ordered(*a))
    kinds = [(0, ["section", "label", None, "section", "label"]), (1, ["label", "section", "label", "subsection", "label"])]
    tokens = spark.createDataFrame([("d", p, i, k, f"{p}{i}") for p, ks in kinds for i, k in enumerate(ks)], "doc string, part int, i int, kind string, label string")
    got = {r["label"]: r["number"] for r in dc.number_labels(tokens, "doc", "part", ["i"]).collect()}
    assert len(made) == 1 and (got["01"], got["04"], got["12"], got["14"]) == ("1", "2", "A", "A.1")


def test_dealt_tasks_follow_the_rows(split, tmp_path):
    """Frames joined by a key meet in as many tasks as their rows fill, not in a fixed number."""
    from capturelens.operators.ordered import dealt

    counts = []
    for n in (2_000, 20_000):
        split.range(n).write.parquet(f"{tmp_path}/{n}")
        both = dealt(["id"], split.read.parquet(f"{tmp_path}/{n}"), split.read.parquet(f"{tmp_path}/{n}"))
        counts.append(both[0].rdd.getNumPartitions())
        assert counts[-1] == both[1].rdd.getNumPartitions() and both[0].join(both[1], "id").count() == n
    assert counts[1] > 4 * counts[0]


def test_a_holdout_is_counted_in_tasks_that_follow_the_rows(split):
    """The marked views are dealt by run before they are counted, and cut or not, the counts are the same."""
    from capturelens.plans import QUERIES
    from capturelens.plans.bindings import Tables

    make = lambda: QUERIES["jon17_holdout_split"](Tables(split, "/root/testdata/sf0.001"))
    cut = make()
    plan = cut._jdf.queryExecution().optimizedPlan().toString().splitlines()
    got = sorted(map(tuple, cut.collect()))
    split.conf.unset("spark.capturelens.block.rows")
    join = next(i for i, x in enumerate(plan) if "Join " in x)
    assert any("RepartitionByExpression [run#" in x for x in plan[:join])
    assert got == sorted(map(tuple, make().collect())) and len(got) > 100

"""Report tables on rows small enough to read: gaps, ties, repeated rows, empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from capturelens.operators import reports as rp


def rows(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(
        [(1, "video", 100.0, "sheet a"), (2, "stills", None, None), (3, "video", 50.0, None), (4, "video", None, None)],
        "run long, population string, focal_doc double, focal_doc_source string")


def test_registration_rows(spark, runs):
    models = spark.createDataFrame([(1, 40.0), (1, 40.0), (1, 7.0), (2, 10.0), (3, 2.0)], "run long, size double")
    cameras = spark.createDataFrame([(1, 90.0), (1, 110.0), (2, 30.0), (3, None)], "run long, focal double")
    out = {r["run"]: r for r in rows(rp.registration(runs, models, cameras).select(*rp.registration_cells()), "run")}
    assert out[1]["model_sizes"] == "40, 40, 7" and out[1]["outcome"] == "partial" and out[1]["reg_rate"] == "0.4598"
    assert out[1]["notes"] == "focal_px_doc: sheet a | focal_px_est range 90.0-110.0 over 2 camera groups" and out[1]["focal_ratio"] == "1"
    assert out[2]["outcome"] == "ok" and out[2]["notes"] == "consecutive cameras = file-name order" and out[2]["focal_ratio"] == "undetermined"
    assert out[3]["outcome"] == "failed" and out[3]["focal_px_est"] == "undetermined"
    assert out[4]["outcome"] == "failed" and out[4]["model_sizes"] == "undetermined" and out[4]["n_registered"] == "undetermined"


def test_registration_of_a_hot_run(split, runs):
    """A run with most models is ranked in blocks, and its sizes still come largest first."""
    models = split.range(2_000).select(F.lit(1).cast("long").alias("run"), (F.col("id") % 700).cast("double").alias("size"))
    cameras = split.createDataFrame([], "run long, focal double")
    got = rp.registration(runs, models, cameras).where("run = 1").select("model_sizes", "n_models").first()
    want = sorted((i % 700 for i in range(2_000)), reverse=True)
    assert [int(x) for x in got["model_sizes"].split(", ")] == want and got["n_models"] == 2_000


def test_repeat_table_numbers_pairs_and_discards(spark):
    runs = spark.createDataFrame(
        [(7, "s", "c", 2, 9, 5, True), (5, "s", "c", 2, 9, 5, False), (6, "s", "c", 1, 9, None, False)],
        "run long, sequence string, condition string, t long, n_images long, largest_model long, success boolean")
    attempts = spark.createDataFrame(
        [(5, 1, 4, 9, 5, 12, 3.0, 'a"b', 1), (5, 2, 6, 2, 4, 20, 8.0, "x", 2), (5, 3, 8, 1, 7, 30, 8.0, "x", 3), (7, 1, 1, 2, 1, 5, 1.0, None, 1)],
        "run long, no int, a long, b long, gap long, inliers long, size double, cause string, after long")
    out = {r["run"]: r for r in rows(rp.repeat_table(runs, attempts, ["no"]), "run")}
    assert [out[r]["number"] for r in (6, 5, 7)] == [0, 1, 2]
    assert out[5]["discards"] == '{"a\\"b":1,"x":2}' and out[7]["discards"] == "{}"
    assert out[5]["first_init_pair"] == "4+9" and out[5]["largest_init_pair"] == "6+2" and out[5]["largest_init_registered_after"] == 2
    assert out[6]["n_init_attempts"] is None and out[6]["first_init_pair"] is None


def test_tail_slots_and_comparator(spark):
    placed = spark.createDataFrame(
        [("s", "raw", 0, 1, 8.0, 10.0, True), ("s", "raw", 1, 2, None, None, False), ("s", "trim", 0, 3, 5.0, 10.0, True), ("s", "trim", 6, 4, 5.0, 10.0, True)],
        "sequence string, condition string, no long, run long, largest double, total double, success boolean")
    frames = spark.createDataFrame([("s", 30)], "sequence string, n_frames long")
    scores = spark.createDataFrame([(1, 3, 20.0)], "run long, n_views long, psnr double")
    tail = rp.tail_runs(placed, frames, scores, F.col("condition") == "trim", 20, 3)
    got = {(r["condition"], r["no"]): r for r in rows(tail, "condition", "no")}
    assert len(got) == 6 and got["trim", 0]["frames"] == 20 and got["raw", 0]["frames"] == 30
    assert got["raw", 0]["psnr"] is None and got["raw", 0]["metrics_from"] is None
    assert got["trim", 0]["metrics_from"] == "training pending" and got["trim", 2]["status"] == "pending"
    views = spark.createDataFrame(
        [("s", "raw", 0, 0, 10.0), ("s", "raw", 0, 25, 90.0), ("s", "raw", 1, 0, 14.0), ("s", "trim", 0, 0, 1.0)],
        "sequence string, condition string, seed long, view long, psnr double")
    wide = {r["condition"]: r for r in rows(rp.tail_extended(tail, views, frames, ["raw"], 20, 3), "condition")}
    assert (wide["raw"]["comparator_seeds"], wide["raw"]["comparator_mean"], wide["raw"]["comparator_min"], wide["raw"]["comparator_max"]) == (2, 12.0, 10.0, 14.0)
    assert wide["trim"]["comparator_seeds"] == 0 and wide["trim"]["comparator_mean"] is None
    assert wide["raw"]["runs_done"] == 2 and wide["raw"]["successes"] == 1 and wide["raw"]["reg_frac_run0"] == 0.8 and wide["raw"]["shared_heldout_views"] == 3


def test_shared_levels_take_the_quality_row(spark):
    levels = spark.createDataFrame(
        [(1, "fps", 4.0, 5, 0, 40, 8), (1, "fps", 1.0, 3, 0, 60, 30), (1, "count", 2.0, 0, None, None, 15)],
        "seq long, kind string, value double, n_frames long, a long, b long, k long")
    metrics = spark.createDataFrame([(1, "fps", 4.0, 2, 1, 20.0, 19.0), (1, "fps", 1.0, 3, 1, 21.0, None)],
                                    "seq long, kind string, value double, n_registered long, n_models long, psnr double, psnr_at640 double")
    quality = spark.createDataFrame([(1, 4, 30.0)], "seq long, n_registered long, psnr double")
    out = rp.sweep_levels(levels, metrics, quality, (F.col("kind") == "fps") & (F.col("value") == 4), 30.0)
    got = {r["level"]: r for r in rows(rp.sweep_cells(out, {"fps": 0, "width": 1, "count": 2}), "place")}
    assert list(got) == ["1", "4 (shared level)", "2"]
    assert got["4 (shared level)"]["registered"] == "4 / 5" and got["4 (shared level)"]["psnr"] == "30.00"
    assert got["4 (shared level)"]["psnr_at640"] == "19.00" and got["4 (shared level)"]["span_s"] == "—"
    assert got["1"]["span_s"] == "2.00" and got["2"]["rate"] == "—" and got["2"]["registered"] == "— / 0"


def test_recordings_read_their_notes(spark):
    frames = spark.createDataFrame(
        [(1, "d", 120, 30.0, 2, 60, 5, 9), (2, "d", 1, None, 1, 1, None, 3)],
        "seq long, dataset string, n_total long, fps double, k long, n_images long, pass_from long, pass_to long")
    sizes = spark.createDataFrame([(1, "b", 2), (1, "a", 3)], "seq long, size string, n long")
    notes = spark.createDataFrame([(1, ["x", "GPS altitude median 3.5 m, min 1 m, max 9 m"]), (2, None)], "seq long, notes array<string>")
    one, two = rows(rp.recording(frames, sizes, notes), "seq")
    assert one["native_size"] == "a (3); b (2)" and one["pass_window_s"] == "5-9" and (one["alt_median"], one["alt_max"]) == ("3.5", "9")
    assert two["pass_window_s"] == "" and two["native_size"] is None and two["alt_min"] == "" and two["frame_spacing_s"] == "undetermined"


def test_masks_and_conditions(spark):
    attempts = spark.createDataFrame([("s", "p", 4, 0.5, 0.6, 0.1), ("s", "q", 4, 0.1, 0.6, 0.1), ("s", "r", None, None, None, None)],
                                     "sequence string, prompt string, n_masks long, iou_min double, iou_median double, area_median double")
    cond = spark.createDataFrame([("s", 3, 0.25)], "sequence string, n_masks long, masked_share_mean double")
    hand = spark.createDataFrame([("fixed", 64)], "mask_kind string, width long")
    out = rows(rp.mask_quality(cond, hand, attempts, 0.2), "kind", "prompt")
    assert [r["outcome"] for r in out] == ["accepted", "rejected", "no object found", None, None]
    assert out[3]["kind"] == "condition" and out[3]["width"] is None and out[4]["width"] == 64
    first = spark.createDataFrame([("s", "raw", 1200.0, 1500.0, 2, None), ("s", "masked", None, None, None, 0.5)],
                                  "sequence string, condition string, n_registered double, n_images double, n_models long, rate double")
    seeds = spark.createDataFrame([("s", "raw", 10.0), ("s", "raw", 12.0)], "sequence string, condition string, psnr double")
    masks = spark.createDataFrame([("s", "masked", "fixed", 0.125, True, False)],
                                  "sequence string, condition string, mask_kind string, masked_share double, sfm_mask boolean, loss_mask boolean")
    masked, raw = rows(rp.condition_values(first, seeds, masks, ["sequence", "condition"], {"psnr": 1}), "condition")
    assert raw["registered"] == "1,200 / 1,500" and raw["psnr"] == "11.0 [10.0–12.0]" and raw["mask_kind"] == "none" and raw["repeat_rate"] == "not repeated"
    assert masked["psnr"] == "not trained" and masked["masked_share"] == "12.5 %" and masked["sfm_mask"] == "True" and masked["loss_mask"] == "False"


def test_empty_tables(spark, runs):
    none = lambda s: spark.createDataFrame([], s)
    assert rp.registration(runs.limit(0), none("run long, size double"), none("run long, focal double")).count() == 0
    placed = none("sequence string, condition string, no long, run long, largest double, total double, success boolean")
    frames, scores = none("sequence string, n_frames long"), none("run long, n_views long, psnr double")
    tail = rp.tail_runs(placed, frames, scores, F.lit(True), 20, 3)
    views = none("sequence string, condition string, seed long, view long, psnr double")
    assert tail.count() == 0 and rp.tail_extended(tail, views, frames, ["raw"], 20, 3).count() == 0


def test_short_runs_are_registered_in_one_meeting(spark, runs, monkeypatch):
    """Rows of runs that fit into a block are not ranked apart, and give what ranking gives."""
    models = spark.createDataFrame([(1, 40.0), (1, 7.0), (1, None), (1, 40.0), (2, None), (None, 3.0)], "run long, size double")
    cameras = spark.createDataFrame([(1, 90.0), (1, 110.0), (1, 130.0), (1, 95.0), (3, None), (None, 1.0)], "run long, focal double")
    same = ["run", "n_models", "n_registered", "n_images", "model_sizes", "focal_min", "focal_max", "n_groups", "focal_px_est"]
    ranked = rows(rp._registered_ranked(runs, models, cameras).select(*same), "run")
    monkeypatch.setattr(rp, "_registered_ranked", None)
    assert rows(rp.registration(runs, models, cameras).select(*same), "run") == ranked


def test_conditions_read_the_lines_once_and_blocks_do_not_matter(split):
    """A run's lines meet once and a sequence's runs once, in tasks that follow the rows; cut or not, the rows are the same."""
    from capturelens.plans import QUERIES
    from capturelens.plans.bindings import Tables

    make = lambda: QUERIES["rpt12_condition_values"](Tables(split, "/root/testdata/sf0.001"))
    cut = make()
    scans = [x for x in cut._jdf.queryExecution().sparkPlan().toString().splitlines() if "Scan" in x and "lineitem.parquet" in x]
    got = rows(cut, *cut.columns)
    split.conf.unset("spark.capturelens.block.rows")
    whole = make()
    assert len(scans) == 1 and got == rows(whole, *whole.columns) and len(got) > 100


def test_parts_of_a_mean_add_up(spark):
    """The cell over parts is the cell over their rows; a group without parts has none, one without values a dash."""
    from capturelens.operators import rollup as ru

    values = spark.createDataFrame([("a", 1, 1.05), ("a", 1, None), ("a", 2, 2.25), ("b", 1, 7.0), ("c", 1, None)], "k string, p int, v double")
    parts = values.groupBy("k", "p").agg(ru.mean_parts(F.col("v"), "x")).union(spark.createDataFrame([("d", 1, None)], "k string, p int, x struct<n: long, total: decimal(38,10), low: decimal(28,10), high: decimal(28,10)>"))
    got = {r["k"]: r["c"] for r in parts.groupBy("k").agg(ru.mean_of_parts(F.col("x"), 1).alias("c")).collect()}
    want = {r["k"]: r["c"] for r in values.groupBy("k").agg(ru.mean_range(F.col("v"), 1).alias("c")).collect()}
    assert got == want | {"d": None} and got["c"] == "—"

"""Report tables put together from frames, runs, levels, masks and anchors.

Each function takes frames that hold one kind of row and returns the rows of one table. Numbers stay numbers
here; the text of a cell is made by the ``*_cells`` lists, so that a table can be audited before it is printed.
Everything per group is a partial aggregate, an exact percentile over ordered blocks or a lookup by key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats as fm
from ..functions.names import altitude_note
from ..functions.phrases import joined_items, listed_items
from ..functions.runs import outcome_class
from ..functions.text import notes_when
from .ordered import Ordered, attach, by_group, ordinal
from .quantiles import exact_quantiles
from .raster import clip_profile
from .rollup import comparator, mean_range, pivot_runs
from .sampling import span_and_rate
from .tables import append_rows, dereference

SHARED = "shared level"


def r6(c) -> Column:
    return F.round(c, 6)


def frame_quality(measured: DataFrame, static: DataFrame, seq: str, blur_below: float, dark: float, basis: int) -> DataFrame:
    """Content of each sequence: blur, clipping, exposure, static and black shares.

    ``measured`` holds a row per frame (``blur, clip, lum``), ``static`` what ``static_share`` returns. A sequence
    without a static row has nulls there. ``black_share_basis`` says whether more than ``basis`` frames were measured.
    """
    blur = exact_quantiles(measured, [seq], F.col("blur"), {"blur_p10": 0.1, "blur_p50": 0.5, "blur_p90": 0.9}).drop("n")
    n = F.count(F.lit(1))
    facts = measured.groupBy(seq).agg(
        n.alias("n_frames"), F.avg((F.col("blur") < blur_below).cast("double")).alias("blur_share_below"),
        F.stddev_pop("lum").alias("lum_mean_sigma"), F.avg((F.col("lum") < dark).cast("double")).alias("black_frames_share"),
        F.when(n > basis, "all frames").otherwise("sampled frames").alias("black_share_basis"),
    )
    known = attach(attach(facts, blur, [seq]), clip_profile(measured, seq), [seq])
    return attach(known, static, [seq])


def quality_cells(stills: str = "state") -> list[Column]:
    """Stored text of a content row: four significant digits, ``n/a`` where stills have no static share."""
    numbers = ["blur_p10", "blur_p50", "blur_p90", "blur_share_below", "clip_share_median", "clip_frames_gt5", "lum_mean_sigma", "black_frames_share"]
    shares = ["static_share", "static_share_top_third", "static_share_bottom_third"]
    sig = lambda c: fm.fmt_sig(r6(F.col(c)))
    return [
        sig("blur_p50").alias("blur_median"), *[sig(c).alias(c) for c in numbers],
        *[F.when(F.col(stills) == "n/a", fm.NOT_APPLICABLE).otherwise(sig(c)).alias(c) for c in shares], F.col("black_share_basis"),
    ]


def _registered_ranked(runs: DataFrame, models: DataFrame, cameras: DataFrame) -> DataFrame:
    """The runs with the facts of their models and cameras, ranked in blocks."""
    sizes = models.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_models"), F.max("size").alias("n_registered"), F.sum("size").alias("n_images"))
    ranked = models.select("run", (-F.col("size")).alias("_larger"), "size")
    text = joined_items(listed_items(ranked, ["run"], ["_larger"], F.col("size").cast("bigint").cast("string")), ["run"], "model_sizes", ", ")
    ends = cameras.groupBy("run").agg(F.min("focal").alias("focal_min"), F.max("focal").alias("focal_max"), F.count("focal").alias("n_groups"))
    focal = exact_quantiles(cameras, ["run"], F.col("focal"), {"focal_px_est": 0.5}).drop("n")
    out = runs
    for part in (sizes, text, ends, focal):
        out = attach(out, part, ["run"])
    return out


def _registered_dealt(runs: DataFrame, models: DataFrame, cameras: DataFrame) -> DataFrame | None:
    """The same where no run has more models or cameras than a block: each run's rows meet in one task, once."""
    double = lambda df, c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
    each = [df.select("run", F.lit(k).alias("k"), double(df, "size").alias("size"), double(df, "focal").alias("focal")) for k, df in ((1, models), (0, cameras))]
    rows = by_group(each[0].union(each[1]), ["run"])
    if rows is None:
        return None
    facts = rows.groupBy("run").agg(
        F.count_if(F.col("k") == 1).alias("n_models"), F.max("size").alias("n_registered"), F.sum("size").alias("n_images"),
        F.sort_array(F.collect_list("size"), asc=False).alias("_s"), F.min("focal").alias("focal_min"), F.max("focal").alias("focal_max"),
        F.count_if(F.col("k") == 0).alias("_cameras"), F.sort_array(F.collect_list("focal")).alias("_f"))
    n = F.size("_f")
    lo, hi = (F.get("_f", f((n - 1) * 0.5).cast("int")) for f in (F.floor, F.ceil))
    text = F.array_join(F.transform("_s", lambda v: v.cast("bigint").cast("string")), ", ")
    some = lambda held, c: F.when(F.col(held) > 0, c)
    known = facts.select(
        "run", some("n_models", F.col("n_models")).alias("n_models"), "n_registered", "n_images", F.when(F.size("_s") > 0, text).alias("model_sizes"),
        "focal_min", "focal_max", some("_cameras", n.cast("bigint")).alias("n_groups"),
        F.when(n > 0, lo + (hi - lo) * ((n - 1) * 0.5 - F.floor((n - 1) * 0.5))).alias("focal_px_est"))
    return attach(runs, known, ["run"])


def registration(runs: DataFrame, models: DataFrame, cameras: DataFrame) -> DataFrame:
    """One row per run: registered images, model sizes, focal length against the documented one, outcome, notes.

    ``runs(run, population, focal_doc, focal_doc_source)``, ``models(run, size)``, ``cameras(run, focal)``. The
    largest model counts as registered, all models as given. A run without models is kept: it failed.
    """
    out = _registered_dealt(runs, models, cameras)
    out = _registered_ranked(runs, models, cameras) if out is None else out
    share = F.try_divide(F.col("n_registered").cast("double"), F.col("n_images"))
    spread = F.concat(F.lit("focal_px_est range "), fm.half_up(r6("focal_min"), 1), F.lit("-"), fm.half_up(r6("focal_max"), 1),
                      F.lit(" over "), F.col("n_groups").cast("string"), F.lit(" camera groups"))
    notes = notes_when(
        (F.col("focal_doc_source").isNotNull(), F.concat(F.lit("focal_px_doc: "), F.col("focal_doc_source"))),
        (F.col("focal_min") != F.col("focal_max"), spread),
        (F.col("population") == "stills", F.lit("consecutive cameras = file-name order")))
    return out.withColumns({
        "reg_rate": share, "focal_ratio": F.try_divide(F.col("focal_px_est"), F.col("focal_doc")),
        "outcome": F.when(F.col("n_registered").isNull(), "failed").otherwise(outcome_class(F.col("n_registered"), F.col("n_images"), F.col("n_models"))), "notes": notes})


def registration_cells() -> list[Column]:
    """Stored text of a registration row; what a run does not have reads ``undetermined``."""
    whole = lambda c: F.coalesce(F.col(c).cast("bigint").cast("string"), F.lit(fm.UNDETERMINED)).alias(c)
    sig = lambda c: fm.fmt_sig(r6(F.col(c))).alias(c)
    return [F.col("run"), F.col("population"), whole("n_images"), whole("n_registered"), sig("reg_rate"), whole("n_models"),
            F.coalesce("model_sizes", F.lit(fm.UNDETERMINED)).alias("model_sizes"), sig("focal_px_est"), sig("focal_doc"), sig("focal_ratio"),
            F.col("outcome"), F.col("notes")]


def anchor_row(df: DataFrame, dataset: Column | str, kind: str, present: Column | str, resolvable: str, check: Sequence, notes: Sequence) -> DataFrame:
    """A row of the anchors table for each row of the frame; ``check`` and ``notes`` are texts and columns in order."""
    fixed = lambda v: F.lit(v) if isinstance(v, str) else v
    text = lambda parts: F.concat(*[fixed(p).cast("string") for p in parts]) if parts else F.lit("")
    return df.select(
        fixed(dataset).alias("dataset"), F.lit(kind).alias("anchor_type"), fixed(present).alias("anchor_present"), F.lit(resolvable).alias("anchor_resolvable"),
        text(check).alias("check"), text(notes).alias("notes"))


def repeat_table(runs: DataFrame, attempts: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per run of a repeat study with its number, discards and initial pairs.

    ``runs(run, sequence, condition, t, n_images, largest_model, success)``; ``attempts(run, a, b, gap, inliers, size, cause,
    after)`` with ``order`` as the order they were tried in. The pair of the largest model is that of the largest ``size``,
    the first of equal ones. A run without attempts has nulls and no discards.
    """
    pair = F.struct(F.concat_ws("+", F.col("a").cast("string"), F.col("b").cast("string")).alias("pair"), "gap", "inliers", "after")
    tried = F.struct(*order, "a", "b", "size", "inliers", "after")
    picks = attempts.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_init_attempts"), F.min_by(pair, tried).alias("_f"),
        F.min_by(pair, F.struct((-F.col("size")).alias("_larger"), *order, "a", "b", "inliers", "after")).alias("_l"))
    causes = attempts.where("cause is not null").groupBy("run", "cause").agg(F.count(F.lit(1)).alias("_n"))
    quoted = F.regexp_replace(F.to_json(F.array("cause")), r"^\[|\]$", "")
    listed = listed_items(causes, ["run"], ["cause"], F.concat(quoted, F.lit(":"), F.col("_n").cast("string")))
    out = Ordered(runs, ["sequence", "condition"], ["t", "run"]).add(number=ordinal()).df
    out = attach(attach(out, picks, ["run"]), joined_items(listed, ["run"], "_d", ","), ["run"])
    return out.select(
        "sequence", "condition", "run", "number", "n_images", "largest_model", "success", "n_init_attempts",
        F.concat(F.lit("{"), F.coalesce("_d", F.lit("")), F.lit("}")).alias("discards"),
        F.col("_f.pair").alias("first_init_pair"), F.col("_f.gap").alias("first_init_gap"), F.col("_f.inliers").alias("first_init_inliers"),
        F.col("_l.pair").alias("largest_init_pair"), F.col("_l.gap").alias("largest_init_gap"), F.col("_l.inliers").alias("largest_init_inliers"),
        F.col("_l.after").alias("largest_init_registered_after"))


def tail_runs(placed: DataFrame, frames: DataFrame, scores: DataFrame, trimmed: Column, keep: int, slots: int) -> DataFrame:
    """One row per (sequence, condition, slot): a slot without a run is pending.

    ``placed(sequence, condition, no, run, largest, total, success)``, ``frames(sequence, n_frames)``, ``scores(run, n_views,
    psnr)``. Only trimmed arms are scored, and say where the score is from or that it is to come.
    """
    numbers = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slots - 1).cast("bigint"))).alias("no")
    arms = placed.select("sequence", "condition").distinct()
    every = arms.select("sequence", "condition", numbers)
    rows = every.join(placed.where(F.col("no") < slots), ["sequence", "condition", "no"], "left")
    rows = rows.join(frames, "sequence", "left").join(scores, "run", "left").withColumn("trimmed", trimmed)
    scored = F.col("trimmed") & F.col("psnr").isNotNull()
    source = F.when(scored, "this run, trainer seed 0").when(F.col("trimmed") & F.col("success"), "training pending")
    return rows.select(
        "sequence", "condition", "no", "run", F.when(F.col("trimmed"), F.least(F.lit(keep), F.col("n_frames"))).otherwise(F.col("n_frames")).alias("frames"),
        "trimmed", F.when(F.col("run").isNull(), "pending").otherwise("done").alias("status"), F.col("largest").alias("n_registered"),
        F.round(F.try_divide(F.col("largest"), F.col("total")), 4).alias("reg_frac"), "success",
        F.when(scored, F.col("n_views")).alias("n_views"), F.when(scored, F.col("psnr")).alias("psnr"), source.alias("metrics_from"))


def tail_extended(runs: DataFrame, views: DataFrame, frames: DataFrame, compared: Sequence[str], keep: int, slots: int, every: int = 8, digits: int = 4) -> DataFrame:
    """Runs of ``tail_runs`` side by side with the comparator over trainer seeds on the shared views.

    ``views(sequence, condition, seed, view, psnr)``. Arms outside ``compared`` have no comparator: 0 seeds. The shared
    held-out views are every ``every``-th one of a sequence below ``keep``. Values are rounded to ``digits``.
    """
    key = ["sequence", "condition"]
    done = runs.where("status = 'done'")
    values = ["reg_frac", "n_registered", "psnr"]
    wide = pivot_runs(done, key, "no", range(slots), values)
    facts = done.groupBy(*key).agg(F.count_if("success").alias("successes"), F.count("psnr").alias("n_trained"))
    seeds = comparator(views.where(F.col("condition").isin(list(compared))), key, "seed", ["psnr"], F.col("view") < keep)
    seeds = seeds.withColumnsRenamed({f"psnr_{s}": f"comparator_{s}" for s in ("mean", "min", "max")})
    out = attach(attach(wide, facts, key), seeds, key).join(frames, "sequence", "left")
    shared = F.expr(f"(least(n_frames, {keep}) + {every - 1}) div {every}")
    names = [c for v in values for c in [*[f"{v}_run{i}" for i in range(slots)], f"{v}_mean", f"{v}_std"]]
    return out.select(
        *key, "runs_done", "successes", "n_trained", *[F.round(c, digits).alias(c) for c in names],
        F.coalesce("n_seeds", F.lit(0).cast("bigint")).alias("comparator_seeds"),
        *[F.round(f"comparator_{s}", digits).alias(f"comparator_{s}") for s in ("mean", "min", "max")],
        shared.alias("shared_heldout_views"))


def sweep_levels(levels: DataFrame, metrics: DataFrame, quality: DataFrame, shared: Column, fps: float) -> DataFrame:
    """One row per (sequence, sweep, level) with span, rate, registration and scores at the native and the common width.

    ``levels(seq, kind, value, n_frames, a, b, k)`` are the ends of the sampled frames, ``metrics(seq, kind, value,
    n_registered, n_models, psnr, psnr_at640)`` and ``quality(seq, n_registered, psnr)`` the row of the sequence
    that a shared level takes its result from. A shared level has no own span or rate.
    """
    ends = span_and_rate(F.col("a"), F.col("b"), F.lit(fps), F.col("k"))
    rows = levels.join(metrics, ["seq", "kind", "value"], "left").withColumns(
        {"summary": F.when(shared, F.col("seq")), "span_s": ends["span_s"], "fps_actual": ends["fps_actual"]})
    rows = dereference(rows, quality, "summary", "seq", ["n_registered", "psnr"])
    own = lambda c: F.when(F.col("summary").isNull(), F.col(c)).alias(c)
    return rows.select(
        "seq", "kind", "value", "n_frames", own("span_s"), own("fps_actual"), "n_registered", "n_models", "psnr", "psnr_at640",
        F.when(F.col("summary").isNotNull(), SHARED).otherwise("").alias("note"))


def sweep_cells(levels: DataFrame, rank: Mapping[str, int]) -> DataFrame:
    """Printed rows of the sweeps in their order: sequence, kind of sweep, level."""
    order = F.element_at(F.create_map(*[F.lit(x) for kv in rank.items() for x in kv]), F.col("kind"))
    placed = Ordered(levels.withColumn("_kind", order), ["seq"], ["_kind", "value"]).add(place=ordinal()).df
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(fm.DASH))
    rate = F.round(F.try_divide(F.col("n_registered").cast("double"), F.col("n_frames")), 9)
    level = F.concat(fm.half_up(F.col("value"), 0), F.when(F.col("note") == SHARED, f" ({SHARED})").otherwise(""))
    return placed.select(
        "seq", "kind", "place", level.alias("level"), F.concat_ws(" / ", whole("n_registered"), whole("n_frames")).alias("registered"),
        fm.fmt_pct(rate).alias("rate"), fm.fmt_num(r6("psnr"), 2).alias("psnr"), fm.fmt_num(r6("psnr_at640"), 2).alias("psnr_at640"),
        fm.fmt_num(r6("span_s"), 2).alias("span_s"))


def recording(frames: DataFrame, sizes: DataFrame, notes: DataFrame) -> DataFrame:
    """Recording values of each sequence next to what its notes state.

    ``frames(seq, dataset, n_total, fps, k, n_images, pass_from, pass_to)``; ``sizes(seq, size, n)`` are native sizes with
    their counts, shown as ``size (n)``; ``notes(seq, notes)`` holds free texts of which an altitude is read.
    """
    one = F.concat(F.col("size"), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    native = joined_items(listed_items(sizes, ["seq"], ["size"], one), ["seq"], "native_size", "; ")
    read = notes.select("seq", altitude_note(F.col("notes")).alias("_a")).select("seq", "_a.*")
    span = F.concat_ws("-", F.col("pass_from").cast("string"), F.col("pass_to").cast("string"))
    window = F.when(F.col("pass_from").isNotNull() & F.col("pass_to").isNotNull(), span).otherwise("")
    return attach(attach(frames, native, ["seq"]), read, ["seq"]).select(
        "seq", "dataset", "n_total", "k", "n_images", fm.fmt_sig(r6("fps")).alias("fps_source"),
        fm.fmt_sig(r6(F.try_divide(F.col("k").cast("double"), F.col("fps")))).alias("frame_spacing_s"), "native_size",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("alt_median", "alt_min", "alt_max")], window.alias("pass_window_s"))


def mask_quality(conditions: DataFrame, hand: DataFrame, attempts: DataFrame, least: float) -> DataFrame:
    """Three kinds of mask rows under the union of their columns.

    ``conditions(sequence, condition, n_masks, masked_share_mean, masked_share_max, sfm_mask, loss_mask)`` were trained with,
    ``hand(mask_kind, masked_share_mean, width, height, provenance)`` were drawn, ``attempts(sequence, prompt, n_masks,
    iou_min, iou_median, area_median)`` were asked for: without masks nothing was found, an unstable one is rejected.
    """
    found = F.when(F.coalesce("n_masks", F.lit(0)) == 0, "no object found").when(F.col("iou_min") >= least, "accepted").otherwise("rejected")
    kind = lambda df, name: df.withColumn("kind", F.lit(name))
    return append_rows(kind(conditions, "condition"), kind(hand, "hand_mask"), kind(attempts.withColumn("outcome", found), "attempt"))


def condition_values(first: DataFrame, seeds: DataFrame, masks: DataFrame, key: Sequence[str], digits: Mapping[str, int]) -> DataFrame:
    """Printed rows of the ablations: the run that fed training, its mask, and the scores over seeds.

    ``first(*key, n_registered, n_images, n_models, rate)``, ``seeds(*key, *digits)`` one row per trained seed,
    ``masks(*key, mask_kind, masked_share, sfm_mask, loss_mask)``. An untrained condition says so, one without a mask row has none.
    """
    trained = seeds.groupBy(*key).agg(F.count(F.lit(1)).alias("seeds"), *[mean_range(F.col(c), n).alias(f"{c}_cell") for c, n in digits.items()])
    return condition_rows(attach(first, trained, key), masks, key, list(digits))


def condition_rows(known: DataFrame, masks: DataFrame, key: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """``condition_values`` where each row of ``first`` has its ``seeds`` and the cell of each score already."""
    out = attach(known, masks.withColumn("_mask", F.lit(True)), key)
    plain = F.col("_mask").isNull()
    flag = lambda c: F.when(plain, "False").otherwise(F.initcap(F.col(c).cast("string"))).alias(c)
    return out.select(
        *key, F.when(plain, "none").otherwise(F.col("mask_kind")).alias("mask_kind"), fm.fmt_pct(F.col("masked_share")).alias("masked_share"),
        flag("sfm_mask"), flag("loss_mask"), F.concat_ws(" / ", fm.fmt_int(F.col("n_registered")), fm.fmt_int(F.col("n_images"))).alias("registered"),
        "n_models", F.when(F.col("rate").isNull(), "not repeated").otherwise(fm.fmt_pct(F.col("rate"))).alias("repeat_rate"),
        F.coalesce("seeds", F.lit(0).cast("bigint")).alias("seeds"), *[F.coalesce(f"{c}_cell", F.lit("not trained")).alias(c) for c in scores])

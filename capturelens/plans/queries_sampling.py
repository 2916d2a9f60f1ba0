"""Sampling, hold-outs and content profiles over events as frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats as fm
from ..operators import sampling as sp
from .bindings import FRAMES, NUMBERED
from .registry import query

FPS = 30.0  # a nominal source rate of the bound frames
KEYS = ["t", "event_id"]


def seconds():
    return F.col("t") / 1e6



@query("prj1_stride_sampling", f"""WITH {NUMBERED}, cut AS (
  SELECT *, greatest(n_total // 20, CAST(round_even(k / 2.0, 0) AS BIGINT), 1) AS step FROM numbered)
  SELECT seq, ord, event_id, n_total, CAST(step AS BIGINT) AS step FROM cut
  WHERE ord % step = 0 AND ord // step < 20""")
def _(t):
    frames = t.frames.withColumn("fps", F.col("k").cast("double"))
    numbered = sp.number_frames(frames, "seq", KEYS).withColumn("step", sp.stride(F.col("n_total"), F.col("fps"), 20))
    kept = numbered.where((F.col("ord") % F.col("step") == 0) & (F.floor(F.col("ord") / F.col("step")) < 20))
    return kept.select("seq", "ord", "event_id", "n_total", "step")


@query("prj1_default_sampling", f"""WITH {NUMBERED}, cut AS (SELECT *, greatest(n_total // 200, 1) AS k2 FROM numbered)
  SELECT seq, ord, event_id, n_total, k2 AS step FROM cut WHERE ord % k2 = 0 AND ord // k2 < 200""")
def _(t):
    return sp.sample_stride(t.frames.drop("k"), "seq", KEYS).select(
        "seq", "ord", "event_id", "n_total", F.col("k").alias("step"))


@query("prj2_video_sampling", f"""WITH {NUMBERED}, a AS (
  SELECT *, greatest(CAST(round_even((k + 1) / 2.0, 0) AS BIGINT), 1) AS s0 FROM numbered), b AS (
  SELECT *, CASE WHEN n_total // s0 > 15 THEN greatest(n_total // 15, 1) ELSE s0 END AS step FROM a)
  SELECT seq, ord, step, n_total FROM b WHERE ord % step = 0 AND ord // step < 15""")
def _(t):
    return sp.sample_video(t.frames, "seq", KEYS, (F.col("k") + 1).cast("double"), 2.0, 15).select(
        "seq", "ord", "step", "n_total")


LEVELS = [("fps", 1.0), ("fps", 4.0), ("width", 640.0), ("width", 3840.0), ("count", 2.0), ("count", 5.0)]
LEVEL_SQL = "levels(kind, value) AS (VALUES ('fps', 1.0), ('fps', 4.0), ('width', 640.0), ('width', 3840.0), ('count', 2.0), ('count', 5.0))"
SWEEP_SQL = f"""WITH {FRAMES}, n2 AS (
  SELECT seq, kind AS event, row_number() OVER (PARTITION BY seq ORDER BY t, event_id) - 1 AS ord FROM frames),
  {LEVEL_SQL}, s AS (SELECT n2.seq, n2.ord, l.kind, CAST(l.value AS DOUBLE) AS value,
    greatest(CAST(round_even(30.0 / CASE WHEN l.kind = 'fps' THEN l.value ELSE 2.0 END, 0) AS BIGINT), 1) AS k,
    CAST(CASE WHEN l.kind = 'width' THEN l.value ELSE 1600 END AS BIGINT) AS width,
    CASE WHEN l.kind = 'count' THEN l.value END AS cap FROM n2, levels l),
  kept AS (SELECT seq, ord, kind, value, k, width FROM s WHERE ord % k = 0 AND (cap IS NULL OR ord // k < cap))"""


def _sweep(t):
    return sp.sample_sweep(t.frames.drop("kind", "k"), "seq", KEYS, F.lit(FPS), LEVELS)


@query("prj3_sweep_sampling", SWEEP_SQL + " SELECT * FROM kept")
def _(t):
    return _sweep(t).select("seq", "ord", "kind", "value", "k", "width")


@query("prj4_span_and_rate", SWEEP_SQL + """ SELECT seq, kind, value, count(*) AS n_frames,
  round((max(ord) - min(ord)) / 30.0, 6) AS span_s, round(30.0 / max(k), 6) AS fps_actual,
  round(max(k) / 30.0, 6) AS frame_spacing_s FROM kept GROUP BY ALL""")
def _(t):
    ends = _sweep(t).groupBy("seq", "kind", "value").agg(
        F.count(F.lit(1)).alias("n_frames"), F.min("ord").alias("a"), F.max("ord").alias("b"), F.max("k").alias("k"))
    out = sp.span_and_rate(F.col("a"), F.col("b"), F.lit(FPS), F.col("k"))
    return ends.select("seq", "kind", "value", "n_frames", *[F.round(c, 6).alias(n) for n, c in out.items()])


@query("prj5_observed_rate", f"""WITH {FRAMES} SELECT seq, count(*) AS n,
  round(CASE WHEN count(*) > 1 THEN (count(*) - 1) / nullif((max(t) - min(t)) / 1e6, 0) END, 9) AS fps FROM frames GROUP BY seq""")
def _(t):
    return sp.observed_rate(t.frames, "seq", seconds()).select("seq", "n", F.round("fps", 9).alias("fps"))


@query("prj42_even_subsample", f"""WITH {NUMBERED}, want AS (
  SELECT DISTINCT seq, CAST(round_even(i * (n_total / 25.0), 0) AS BIGINT) AS ord
  FROM (SELECT DISTINCT seq, n_total FROM numbered) s, (SELECT unnest(range(25)) AS i) r WHERE n_total > 25)
  SELECT seq, ord, event_id FROM numbered WHERE n_total <= 25
  UNION ALL SELECT n.seq, n.ord, n.event_id FROM numbered n JOIN want USING (seq, ord)""")
def _(t):
    return sp.even_subsample(t.frames, "seq", KEYS, 25).select("seq", "ord", "event_id")


@query("win19_evenly_spaced", f"""WITH {NUMBERED}, want AS (
  SELECT DISTINCT seq, CASE WHEN i = least(n_total, 10) - 1 THEN n_total - 1
    ELSE CAST(floor(i * ((n_total - 1) / (least(n_total, 10) - 1)::DOUBLE)) AS BIGINT) END AS ord
  FROM (SELECT DISTINCT seq, n_total FROM numbered) s, (SELECT unnest(range(10)) AS i) r WHERE i < n_total)
  SELECT seq, ord, event_id FROM numbered JOIN want USING (seq, ord)""")
def _(t):
    return sp.evenly_spaced(t.frames, "seq", KEYS, 10).select("seq", "ord", "event_id")


@query("win12_every_8th_holdout", f"""WITH {NUMBERED} SELECT seq, ord, event_id, ord % 8 = 0 AS held_out FROM numbered""")
def _(t):
    return sp.split_interp(t.numbered).select("seq", "ord", "event_id", "held_out")


BLOCK = """CASE WHEN n_total < 36 THEN ord >= n_total // 2 - 2 AND ord < n_total // 2 + 2
  ELSE ord >= 16 AND (ord - 16) % 32 < 4 AND ord - (ord - 16) % 32 + 4 < n_total END"""


@query("win13_block_holdout", f"WITH {NUMBERED} SELECT seq, ord, event_id, {BLOCK} AS held_out FROM numbered")
def _(t):
    return sp.split_block(t.numbered).select("seq", "ord", "event_id", "held_out")


@query("win14_trimmed_holdout", f"""WITH {NUMBERED} SELECT seq, ord, event_id FROM numbered
  WHERE ord % 8 = 0 AND event_id % 1000 < 10 * seq""")
def _(t):
    marked = sp.split_trimmed(t.numbered, F.col("event_id") % 1000, F.col("seq") * 10)
    return marked.where("held_out").select("seq", "ord", "event_id")


@query("win15_shared_holdout", f"""WITH {NUMBERED} SELECT seq,
  CAST(count(*) FILTER (ord % 8 = 0 AND ord < 40) AS BIGINT) AS shared_views, count(*) AS n FROM numbered GROUP BY seq""")
def _(t):
    return sp.split_interp(t.numbered).groupBy("seq").agg(
        F.count_if(F.col("held_out") & (F.col("ord") < 40)).alias("shared_views"), F.count(F.lit(1)).alias("n"))


@query("win21_elapsed", f"""WITH {FRAMES} SELECT seq, event_id,
  round((t - min(t) OVER (PARTITION BY seq)) / 1e6, 6) AS elapsed_s FROM frames""")
def _(t):
    return sp.elapsed(t.frames, "seq", seconds()).select("seq", "event_id", F.round("elapsed_s", 6).alias("elapsed_s"))


@query("win11_sampling_interval", f"""WITH {FRAMES}, g AS (
  SELECT seq, (lead(t) OVER (PARTITION BY seq ORDER BY t, event_id) - t) / 1e6 AS gap FROM frames)
  SELECT seq, count(*) AS n, round(CASE WHEN count(*) > 2 THEN median(gap) END, 3) AS dt,
    round(CASE WHEN count(*) > 2 AND median(gap) > 0 THEN 1.0 / median(gap) END, 9) AS rate FROM g GROUP BY seq""")
def _(t):
    out = sp.sampling_interval(t.frames, "seq", KEYS, seconds())
    return out.select("seq", "n", F.round("dt", 3).alias("dt"), F.round("rate", 9).alias("rate"))


@query("set6_global_index", """WITH p AS (SELECT user_id AS seq, date_trunc('day', ts) AS day, count(*) AS n
    FROM events GROUP BY ALL)
  SELECT seq, epoch_us(day) // 86400000000 AS part, n,
    CAST(sum(n) OVER (PARTITION BY seq ORDER BY day) - n AS BIGINT) AS "offset" FROM p""")
def _(t):
    day = F.floor(F.col("t") / 86_400_000_000).cast("bigint")
    parts = t.frames.groupBy("seq", day.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return sp.global_index(parts, "seq", ["part"], "n")


@query("prj29_black_frames", f"""WITH {FRAMES} SELECT seq, CAST(count(*) FILTER (lum >= 8) AS BIGINT) AS n_kept,
  round(avg(CAST(lum < 8 AS INT)), 6) AS black_share FROM frames GROUP BY seq""")
def _(t):
    black = F.col("lum") < sp.BLACK_LUM
    return t.frames.groupBy("seq").agg(
        F.count_if(~black).alias("n_kept"), F.round(F.avg(black.cast("double")), 6).alias("black_share"))


def dec(x: str, nd: int) -> str:
    """SQL text of a half-up decimal."""
    return f"CAST(CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,12)), {nd}) AS DECIMAL(38,{nd})) AS VARCHAR)"


@query("agg1_content_profile", f"""WITH {NUMBERED}, kept AS (
    SELECT * FROM numbered WHERE ord % greatest(n_total // 200, 1) = 0 AND ord // greatest(n_total // 200, 1) < 200),
  prof AS (SELECT seq, count(*) AS n_frames, round(avg(CAST(lum < 100 AS INT)), 6) AS below,
    round(stddev_pop(lum), 6) AS sigma, round(avg(CAST(lum < 8 AS INT)), 6) AS black,
    round(quantile_cont(lum, 0.1), 6) AS p10, round(quantile_cont(lum, 0.5), 6) AS p50,
    round(quantile_cont(lum, 0.9), 6) AS p90 FROM kept GROUP BY seq)
  SELECT seq, n_frames, p10, p50, p90, sigma, {dec('below * 100', 1)} || ' %' AS share_below,
    {dec('black * 100', 1)} || ' %' AS black_share, {dec('p50', 2)} AS median_text FROM prof""")
def _(t):
    kept = sp.sample_stride(t.frames.drop("k"), "seq", KEYS)
    prof = sp.content_profile(kept, "seq", "lum", below=100.0)
    r = lambda c: F.round(c, 6)
    return prof.select(
        "seq", "n_frames", *[r(c).alias(c) for c in ("p10", "p50", "p90", "sigma")],
        fm.fmt_pct(r("share_below")).alias("share_below"), fm.fmt_pct(r("black_share")).alias("black_share"),
        fm.fmt_num(r("p50"), 2).alias("median_text"))


@query("src9_downsampled_scan", f"""WITH {FRAMES}, s AS (SELECT *, row_number() OVER (
    PARTITION BY kind, (t - (SELECT min(t) FROM frames)) // 3600000000 ORDER BY t, event_id) AS rn,
    (t - (SELECT min(t) FROM frames)) // 3600000000 AS mark FROM frames)
  SELECT kind, mark, event_id, t FROM s WHERE rn = 1""")
def _(t):
    from ..sources.readers import sample_by_mark

    return sample_by_mark(t.frames, "kind", "t", 3_600_000_000, ["t", "event_id"]).select("kind", "mark", "event_id", "t")


@query("prj41_pair_key", """SELECT l_partkey AS a, l_suppkey AS b, least(l_partkey, l_suppkey) AS lo,
  greatest(l_partkey, l_suppkey) AS hi, least(l_partkey, l_suppkey) * 2147483647 + greatest(l_partkey, l_suppkey) AS pair,
  count(*) AS n FROM lineitem GROUP BY ALL""")
def _(t):
    from ..functions.names import pair_key, pair_number

    a, b = F.col("l_partkey"), F.col("l_suppkey")
    return t.lineitem.groupBy(a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("n")).select(
        "a", "b", pair_key(F.col("a"), F.col("b"))["lo"].alias("lo"), pair_key(F.col("a"), F.col("b"))["hi"].alias("hi"),
        pair_number(F.col("a"), F.col("b")).alias("pair"), "n")



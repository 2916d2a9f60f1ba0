"""Time joins and motion along sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequence as sq
from ..operators import timejoin as tj
from ..operators.ordered import Ordered, following, ordinal
from ..operators.spacing import spaced_frames
from ..session import new_folder
from ..sources.message_log import scan_chunks, write_chunks
from .bindings import FRAMES, LOG, NUMBERED, POSES
from .registry import query


def r6(c):
    return F.round(c, 6)


def r4(c):
    return F.round(c, 4)


def stamps(t):
    """Clicks as frame stamps with two clocks, in seconds."""
    return t.frames.where("kind = 'click'").select("seq", "event_id", (F.col("t") / 1e6).alias("ts"), ((F.col("t") + 7_000_000) / 1e6).alias("bag"))


def fixes(t):
    """Views as fixes with two clocks, in seconds; two measured columns."""
    return t.frames.where("kind = 'view'").select(
        "seq", (F.col("t") / 1e6).alias("fts"), ((F.col("t") + F.col("lag_us")) / 1e6).alias("fbag"), "lum", F.col("k").cast("double").alias("k"))


TWO = FRAMES + """, st AS (SELECT seq, event_id, t / 1e6 AS ts, (t + 7000000) / 1e6 AS bag FROM frames WHERE kind = 'click'),
  fx AS (SELECT seq, t / 1e6 AS fts, (t + lag_us) / 1e6 AS fbag, lum, CAST(k AS DOUBLE) AS k FROM frames WHERE kind = 'view')"""


def near(l, r):
    """SQL: left rows with the samples before and after."""
    return f"""pv AS (SELECT st.*, f.{r} AS t0, f.lum AS l0, f.k AS k0 FROM st ASOF LEFT JOIN fx f ON st.seq = f.seq AND st.{l} >= f.{r}),
  nb AS (SELECT pv.*, f.{r} AS t1, f.lum AS l1, f.k AS k1 FROM pv ASOF LEFT JOIN fx f ON pv.seq = f.seq AND pv.{l} <= f.{r})"""


def blend(v, l):
    return f"CASE WHEN t0 IS NULL THEN {v}1 WHEN t1 IS NULL OR t1 = t0 THEN {v}0 ELSE {v}0 + ({l} - t0) / (t1 - t0) * ({v}1 - {v}0) END"


@query("jon6_asof_interp_clamped", f"WITH {TWO}, {near('ts', 'fts')} SELECT seq, event_id, round({blend('l', 'ts')}, 6) AS lum FROM nb")
def _(t):
    out = tj.asof_interp(stamps(t), fixes(t), ["seq"], "ts", "fts", ["lum"])
    return out.select("seq", "event_id", r6(F.col("lum")).alias("lum"))


@query("jon7_asof_interp_inside", f"""WITH {TWO}, {near('ts', 'fts')} SELECT seq, event_id, round({blend('l', 'ts')}, 6) AS lum, round({blend('k', 'ts')}, 6) AS k
  FROM nb WHERE t0 IS NOT NULL AND (t1 IS NOT NULL OR t0 = ts)""")
def _(t):
    out = tj.asof_interp(stamps(t), fixes(t), ["seq"], "ts", "fts", ["lum", "k"], edges="drop")
    return out.select("seq", "event_id", r6(F.col("lum")).alias("lum"), r6(F.col("k")).alias("k"))


GAPS = f"""gh AS (WITH {near('ts', 'fts')} SELECT seq, event_id, least(ts - t0, t1 - ts) AS gap_header FROM nb),
  gb AS (WITH {near('bag', 'fbag')} SELECT seq, event_id, least(bag - t0, t1 - bag) AS gap_bag FROM nb)"""


def _gaps(t):
    one = tj.nearest_gap(stamps(t), fixes(t), ["seq"], "ts", "fts", "gap_header")
    return tj.nearest_gap(one, fixes(t), ["seq"], "bag", "fbag", "gap_bag")


@query("jon8_nearest_gap", f"WITH {TWO}, {GAPS} SELECT seq, event_id, round(gap_header, 6) AS gap_header, round(gap_bag, 6) AS gap_bag FROM gh JOIN gb USING (seq, event_id)")
def _(t):
    return _gaps(t).select("seq", "event_id", r6(F.col("gap_header")).alias("gap_header"), r6(F.col("gap_bag")).alias("gap_bag"))


@query("agg46_anchor_coverage", f"""WITH {TWO}, {GAPS}, g AS (SELECT * FROM gh JOIN gb USING (seq, event_id))
  SELECT seq, count(*) AS n, round(avg(CAST(gap_header < 7200 AS INT)), 6) AS share_header, round(avg(CAST(gap_bag < 7200 AS INT)), 6) AS share_bag,
    round(median(gap_header), 3) AS median_header, round(median(gap_bag), 3) AS median_bag FROM g GROUP BY seq""")
def _(t):
    from ..operators.quantiles import exact_quantiles

    g = _gaps(t)
    share = g.groupBy("seq").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("gap_header") < 7200).cast("double"))).alias("share_header"),
        r6(F.avg((F.col("gap_bag") < 7200).cast("double"))).alias("share_bag"))
    h = exact_quantiles(g, ["seq"], F.col("gap_header"), {"median_header": 0.5}).drop("n")
    b = exact_quantiles(g, ["seq"], F.col("gap_bag"), {"median_bag": 0.5}).drop("n")
    return share.join(h, "seq", "left").join(b, "seq", "left").select(
        "seq", "n", "share_header", "share_bag", F.round("median_header", 3).alias("median_header"), F.round("median_bag", 3).alias("median_bag"))


@query("agg46_passes_covered", f"""WITH {TWO}, {GAPS}, s AS (SELECT seq, avg(CAST(gap_header < 7200 AS INT)) AS share FROM gh GROUP BY seq)
  SELECT count(*) AS passes, CAST(count(*) FILTER (share > 0.5) AS BIGINT) AS covered FROM s""")
def _(t):
    gaps = tj.nearest_gap(stamps(t), fixes(t), ["seq"], "ts", "fts", "gap")
    share = tj.share_within(gaps, ["seq"], "gap", 7200.0)
    return share.agg(F.count(F.lit(1)).alias("passes"), F.count_if(F.col("share") > 0.5).alias("covered"))


@query("jon9_two_clocks", f"""WITH {TWO}, h AS (WITH {near('ts', 'fts')} SELECT seq, event_id, {blend('l', 'ts')} AS v_hdr FROM nb),
  b AS (WITH {near('bag', 'fbag')} SELECT seq, event_id, {blend('l', 'bag')} AS v_bag FROM nb)
  SELECT seq, event_id, round(v_hdr, 6) AS v_hdr, round(v_bag, 6) AS v_bag FROM h JOIN b USING (seq, event_id)""")
def _(t):
    one = tj.asof_interp(stamps(t), fixes(t), ["seq"], "ts", "fts", ["lum"], suffix="_hdr")
    two = tj.asof_interp(one, fixes(t), ["seq"], "bag", "fbag", ["lum"], suffix="_bag")
    return two.select("seq", "event_id", r6(F.col("lum_hdr")).alias("v_hdr"), r6(F.col("lum_bag")).alias("v_bag"))


SPANS = FRAMES + """, runs AS (SELECT seq, t // 86400000000 AS day, min(t) / 1e6 AS t0, max(t) / 1e6 AS t1 FROM frames GROUP BY ALL HAVING count(*) > 1),
  cuts AS (SELECT seq, t // 216000000000 AS cut, (min(t) - 30000000) / 1e6 AS h0, (max(t) + 40000000) / 1e6 AS h1 FROM frames WHERE kind <> 'view' GROUP BY ALL)"""


def _spans(t):
    day = F.floor(F.col("t") / 86_400_000_000).cast("bigint")
    runs = t.frames.groupBy("seq", day.alias("day")).agg(
        (F.min("t") / 1e6).alias("t0"), (F.max("t") / 1e6).alias("t1"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    cut = F.floor(F.col("t") / 216_000_000_000).cast("bigint")
    cuts = t.frames.where("kind <> 'view'").groupBy("seq", cut.alias("cut")).agg(
        ((F.min("t") - 30_000_000) / 1e6).alias("h0"), ((F.max("t") + 40_000_000) / 1e6).alias("h1"))
    return runs, cuts


@query("jon10_overlap_best", f"""WITH {SPANS}, p AS (SELECT c.seq, c.cut, r.day, r.t0, least(t1, h1) - greatest(t0, h0) AS ov
    FROM runs r JOIN cuts c ON r.seq = c.seq AND least(t1, h1) - greatest(t0, h0) > 0)
  SELECT seq, cut, day, round(ov, 6) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY seq, cut ORDER BY ov DESC, t0) AS rn FROM p) WHERE rn = 1""")
def _(t):
    runs, cuts = _spans(t)
    best = tj.overlap_best(cuts, runs, ["seq"], ("h0", "h1"), ("t0", "t1"), "cut", 86400.0)
    return best.select("seq", "cut", "day", r6(F.col("overlap")).alias("overlap"))


@query("jon11_within_window", f"""WITH {SPANS}, st AS (SELECT seq, event_id, t / 1e6 AS ts, (t + lag_us) / 1e6 AS bag FROM frames)
  SELECT st.seq, st.event_id, c.cut FROM st JOIN cuts c ON st.seq = c.seq AND st.bag BETWEEN c.h0 AND c.h1""")
def _(t):
    _, cuts = _spans(t)
    frames = t.frames.select("seq", "event_id", ((F.col("t") + F.col("lag_us")) / 1e6).alias("bag"))
    return tj.within_intervals(frames, cuts, ["seq"], "bag", ("h0", "h1"), 86400.0).select("seq", "event_id", "cut")


@query("win10_recording_lag", f"""WITH {FRAMES} SELECT seq, round(greatest(0.0, max((t + lag_us) / 1e6 - (t / 1e6 - 1.5))), 6) AS lag FROM frames GROUP BY seq""")
def _(t):
    return sq.recording_lag(t.frames, ["seq"], (F.col("t") + F.col("lag_us")) / 1e6, F.col("t") / 1e6, F.lit(1.5)).select("seq", r6(F.col("lag")).alias("lag"))


STEPS = POSES + """, nx AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY image) - 1 AS idx FROM poses),
  reg AS (SELECT * FROM nx WHERE seq < 8 OR image % 5 <> 0),
  ld AS (SELECT *, lead(idx) OVER w AS i1, lead(cx) OVER w AS x1, lead(cy) OVER w AS y1, lead(cz) OVER w AS z1 FROM reg WINDOW w AS (PARTITION BY seq ORDER BY idx)),
  steps AS (SELECT seq, idx, sqrt((x1-cx)*(x1-cx) + (y1-cy)*(y1-cy) + (z1-cz)*(z1-cz)) AS step FROM ld WHERE i1 = idx + 1),
  med AS (SELECT seq, median(step) AS med FROM steps GROUP BY seq)"""


def registered(t):
    """Poses with their place in the sequence; some sequences have gaps."""
    placed = Ordered(t.poses, ["seq"], ["image"]).add(idx=ordinal()).df
    return placed.where((F.col("seq") < 8) | (F.col("image") % 5 != 0))


def _steps(t):
    return sq.camera_steps(registered(t), "seq", "idx", ["cx", "cy", "cz"])


@query("win1_camera_steps", f"WITH {STEPS} SELECT seq, idx, round(step, 6) AS step FROM steps")
def _(t):
    return _steps(t).select("seq", "idx", r6(F.col("step")).alias("step"))


@query("win2_stationary_steps", f"WITH {STEPS} SELECT seq, idx, round(step / med, 6) AS ratio, step < 0.7 * med AS stationary FROM steps JOIN med USING (seq)")
def _(t):
    return sq.stationary(_steps(t), "seq", 0.7).select("seq", "idx", r6(F.col("ratio")).alias("ratio"), "stationary")


@query("win3_edge_runs", f"""WITH {NUMBERED}, f AS (SELECT seq, ord, n_total, lum < 60 AS flag FROM numbered)
  SELECT seq, count(*) AS n, coalesce(min(CASE WHEN NOT flag THEN ord END), count(*)) AS lead,
    coalesce(count(*) - 1 - max(CASE WHEN NOT flag THEN ord END), 0) AS trail FROM f GROUP BY seq""")
def _(t):
    flagged = t.numbered.select("seq", "ord", (F.col("lum") < 60).alias("flag"))
    return sq.edge_runs(flagged, "seq", "ord", "flag")


@query("win4_slow_tail", f"""WITH {STEPS} SELECT seq, coalesce(max(CASE WHEN step >= 0.5 * med THEN idx END) + 1, 0) AS tail, count(*) AS n_steps
  FROM steps JOIN med USING (seq) GROUP BY seq""")
def _(t):
    marked = sq.stationary(_steps(t), "seq")
    fast = F.max(F.when(F.col("step") >= 0.5 * F.col("median_step"), F.col("idx")))
    return marked.groupBy("seq").agg(F.coalesce(fast + 1, F.lit(0)).alias("tail"), F.count(F.lit(1)).alias("n_steps"))


EDGE = f"""WITH {STEPS}, sz AS (SELECT seq, count(*) AS n_frames FROM nx GROUP BY seq), m AS (SELECT s.*, med, step < 0.7 * med AS st,
    row_number() OVER (PARTITION BY s.seq ORDER BY idx) - 1 AS o FROM steps s JOIN med USING (seq)),
  a AS (SELECT seq, count(*) AS n_steps, max(med) AS med, CAST(count(*) FILTER (st) AS BIGINT) AS below_tenth, min(CASE WHEN st THEN idx END) AS first_below,
    coalesce(min(CASE WHEN NOT st THEN o END), count(*)) AS lead, coalesce(count(*) - 1 - max(CASE WHEN NOT st THEN o END), 0) AS trail,
    coalesce(max(CASE WHEN step >= 0.5 * med THEN idx END) + 1, 0) AS tail FROM m GROUP BY seq HAVING count(*) >= 5)
  SELECT seq, n_frames, n_steps, n_steps = n_frames - 1 AS all_measured, round(med, 6) AS median_step,
    CASE WHEN n_steps = n_frames - 1 THEN lead END AS lead, CASE WHEN n_steps = n_frames - 1 THEN trail END AS trail, below_tenth, first_below,
    CASE WHEN n_steps = n_frames - 1 AND tail < n_frames - 1 THEN tail + 1 END AS slow_tail_first_frame,
    CASE WHEN n_steps = n_frames - 1 THEN n_frames - tail - 1 END AS slow_tail_frames FROM a JOIN sz USING (seq)"""


def edge_summary(t):
    sizes = t.poses.groupBy("seq").agg(F.count(F.lit(1)).alias("n_frames"))
    return sq.edge_summary(_steps(t), sizes, "seq", "idx", 0.7).withColumn("median_step", r6(F.col("median_step")))


@query("win5_edge_summary", EDGE)
def _(t):
    return edge_summary(t)


def odometry(t):
    """Events as odometry in seconds: speed from the value, heading from the property."""
    speed = F.col("lum") / 100
    return t.frames.select(
        "seq", "event_id", (F.col("t") / 1e6).alias("ts"), (F.col("t") / 1e6 * 0.001).alias("x"), (F.col("k") * 0.5).alias("y"),
        speed.alias("speed"), (F.col("k") * 3.6).alias("yaw"))


def passes(t):
    return sq.corridor_passes(odometry(t), "seq", ["ts", "event_id"], "ts", "x", "y", "speed", "yaw", fast=0.1, turn=90.0)


@query("win6_corridor_passes", f"""WITH RECURSIVE {NUMBERED}, mv AS (SELECT *, lum / 100 > 0.1 AS go, k * CAST(3.6 AS DOUBLE) AS yaw FROM numbered),
  st AS (SELECT *, sum(CASE WHEN go THEN 0 ELSE 1 END) OVER (PARTITION BY seq ORDER BY t, event_id) AS stretch FROM mv),
  s AS (SELECT seq, stretch, t, ord, yaw, row_number() OVER (PARTITION BY seq, stretch ORDER BY ord) AS rn FROM st WHERE go),
  r AS (SELECT seq, stretch, rn, ord, t, yaw AS first, ord AS run_start FROM s WHERE rn = 1
    UNION ALL SELECT s.seq, s.stretch, s.rn, s.ord, s.t, CASE WHEN near THEN r.first ELSE s.yaw END, CASE WHEN near THEN r.run_start ELSE s.ord END
    FROM r JOIN s ON s.seq = r.seq AND s.stretch = r.stretch AND s.rn = r.rn + 1,
      LATERAL (SELECT abs((s.yaw - r.first + 180.0) - 360.0 * floor((s.yaw - r.first + 180.0) / 360.0) - 180.0) < 90.0 AS near))
  SELECT seq, run_start, count(*) AS n, round(max(t) / 1e6 - min(t) / 1e6, 4) AS dur FROM r GROUP BY seq, run_start""")
def _(t):
    return passes(t).select("seq", "run_start", "n", r4(F.col("t1") - F.col("t0")).alias("dur"))


MOVING = f"""{NUMBERED}, mv AS (SELECT *, lum / 100 > 0.1 AS go FROM numbered),
  st AS (SELECT *, sum(CASE WHEN go THEN 0 ELSE 1 END) OVER (PARTITION BY seq ORDER BY t, event_id) AS stretch FROM mv)"""


@query("win6_moving_stretches", f"WITH {MOVING} SELECT seq, CAST(stretch AS BIGINT) AS stretch, min(ord) AS first_ord, max(ord) AS last_ord, count(*) AS n FROM st WHERE go GROUP BY ALL")
def _(t):
    moving = sq.moving_runs(odometry(t), "seq", ["ts", "event_id"], "speed", 0.1)
    return moving.groupBy("seq", "stretch").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.count(F.lit(1)).alias("n"))


# Passes without the heading rule, so that SQL can follow: the moving stretches.
CANDS = f"""{MOVING}, ends AS (SELECT seq, stretch, min(t) / 1e6 AS t0, max(t) / 1e6 AS t1, count(*) AS n, sum(lum / 100) AS vs,
    arg_min(k * 0.5, (t, event_id)) AS y0, arg_max(k * 0.5, (t, event_id)) AS y1 FROM st WHERE go GROUP BY ALL),
  cand AS (SELECT *, t1 - t0 AS dur, vs / n AS vmean, sqrt(((t1 - t0) * 0.001) * ((t1 - t0) * 0.001) + (y1 - y0) * (y1 - y0)) AS disp FROM ends WHERE t1 - t0 >= 10),
  c2 AS (SELECT *, disp / (vmean * dur * 0.005 + 1e-9) AS ratio FROM cand)"""


def candidates(t):
    moving = sq.moving_runs(odometry(t), "seq", ["ts", "event_id"], "speed", 0.1)
    order = F.struct("ts", "event_id")
    runs = moving.groupBy("seq", "stretch").agg(
        F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count(F.lit(1)).alias("n"), F.sum("speed").alias("v_sum"),
        F.lit(0.0).alias("x0"), ((F.max("ts") - F.min("ts")) * 0.001).alias("x1"),
        F.min_by("y", order).alias("y0"), F.max_by("y", order).alias("y1"))
    out = sq.pass_candidates(runs)
    return out.withColumn("ratio", F.col("disp") / (F.col("vmean") * F.col("dur") * 0.005 + 1e-9))


@query("win7_pass_candidates", f"WITH {CANDS} SELECT seq, CAST(stretch AS BIGINT) AS stretch, round(dur, 4) AS dur, round(disp, 7) AS disp, round(vmean, 9) AS vmean FROM c2")
def _(t):
    return candidates(t).select(
        "seq", "stretch", r4(F.col("dur")).alias("dur"), F.round("disp", 7).alias("disp"), F.round("vmean", 9).alias("vmean"))


@query("win8_pass_choice", f"""WITH {CANDS}, b AS (SELECT *, ratio BETWEEN 0.75 AND 1.25 AS strict FROM c2 WHERE n * 4 >= 8)
  SELECT seq, CAST(stretch AS BIGINT) AS stretch, strict, round(dur, 4) AS dur FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY strict DESC, dur DESC, t0) AS rn FROM b) WHERE rn = 1""")
def _(t):
    return sq.choose_pass(candidates(t).withColumn("lum", F.col("n") * 4), "seq", "lum").select("seq", "stretch", "strict", r4(F.col("dur")).alias("dur"))


@query("win9_window_trim", f"""WITH {CANDS}, b AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY dur DESC, t0) AS rn FROM c2), w AS (SELECT seq, t0, t1 FROM b WHERE rn = 1)
  SELECT w.seq, round(greatest(coalesce(min(CASE WHEN m.go THEN m.t / 1e6 END), any_value(w.t0) - 50000), any_value(w.t0) - 50000), 4) AS ta,
    round(least(coalesce(max(CASE WHEN m.go THEN m.t / 1e6 END), any_value(w.t1) + 50000), any_value(w.t1) + 50000), 4) AS tb
  FROM w JOIN mv m ON w.seq = m.seq AND m.t / 1e6 BETWEEN w.t0 - 50000 AND w.t1 + 50000 GROUP BY w.seq""")
def _(t):
    from ..operators.rollup import first_row

    longest = first_row(candidates(t), ["seq"], [-F.col("dur"), F.col("t0")])
    out = sq.trim_window(odometry(t), longest, "seq", "ts", "speed", margin=50000.0, fast=0.1)
    return out.select("seq", r4(F.col("ta")).alias("ta"), r4(F.col("tb")).alias("tb"))


ATT = LOG + """, a AS (SELECT *, CASE WHEN role = 'system' THEN split_part(text, ' ', 1) END AS reason,
    sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY line) AS attempt FROM log),
  att AS (SELECT run, CAST(attempt AS BIGINT) AS attempt, min(CASE WHEN role = 'user' THEN line END) AS first_line, CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS n_after,
    arg_min(reason, line) FILTER (reason IS NOT NULL) AS discarded FROM a WHERE attempt > 0 GROUP BY run, attempt)"""


def attempts(t):
    role = F.col("role")
    reason = F.when(role == "system", F.split_part("text", F.lit(" "), F.lit(1)))
    return sq.log_attempts(t.log, "run", "line", role == "user", role == "assistant", reason)


@query("win16_log_attempts", f"WITH {ATT} SELECT * FROM att")
def _(t):
    return attempts(t)


@query("win16_discard_reasons", f"WITH {ATT} SELECT reason, count(*) AS n FROM a WHERE reason IS NOT NULL GROUP BY reason")
def _(t):
    return t.log.where("role = 'system'").groupBy(F.split_part("text", F.lit(" "), F.lit(1)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("win17_first_and_best_attempt", f"""WITH {ATT} SELECT run, count(*) AS n_attempts, count(discarded) AS n_discarded, arg_min(n_after, attempt) AS first_after,
  arg_min(attempt, (-n_after, attempt)) AS best_attempt, max(n_after) AS best_after FROM att GROUP BY run""")
def _(t):
    return sq.attempt_summary(attempts(t), "run")


@query("win18_greedy_spacing", f"""WITH RECURSIVE {POSES}, p AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY image, cx, cy, cz) AS rn FROM poses),
  g AS (SELECT seq, rn, image, true AS keep, [[cx, cy, cz]] AS kept FROM p WHERE rn = 1
    UNION ALL SELECT p.seq, p.rn, p.image, ok, CASE WHEN ok THEN list_append(g.kept, [p.cx, p.cy, p.cz]) ELSE g.kept END
    FROM g JOIN p ON p.seq IS NOT DISTINCT FROM g.seq AND p.rn = g.rn + 1,
      LATERAL (SELECT len(list_filter(g.kept, lambda q: sqrt((q[1] - p.cx) * (q[1] - p.cx) + (q[2] - p.cy) * (q[2] - p.cy) + (q[3] - p.cz) * (q[3] - p.cz)) < 0.1)) = 0 AS ok))
  SELECT seq, image FROM g WHERE keep""")
def _(t):
    return spaced_frames(t.poses, "seq", "image", ["cx", "cy", "cz"], 0.1).select("seq", "image")


@query("win20_adjacent_groups", f"""WITH {NUMBERED}, c AS (SELECT *, CASE WHEN lag(kind) OVER w IS DISTINCT FROM kind THEN 1 ELSE 0 END AS new FROM numbered WINDOW w AS (PARTITION BY seq ORDER BY ord))
  SELECT seq, ord, kind, CAST(sum(new) OVER (PARTITION BY seq ORDER BY ord) AS BIGINT) AS group_no FROM c""")
def _(t):
    return sq.adjacent_groups(t.numbered.select("seq", "ord", "kind"), ["seq"], ["ord"], "kind")


@query("agg31_path_length", f"""WITH {POSES}, l AS (SELECT seq, sqrt(pow(cx - lag(cx) OVER w, 2) + pow(cy - lag(cy) OVER w, 2) + pow(cz - lag(cz) OVER w, 2)) AS s FROM poses WINDOW w AS (PARTITION BY seq ORDER BY image))
  SELECT seq, round(sum(s), 6) AS path_len FROM l GROUP BY seq""")
def _(t):
    return sq.path_length(t.poses, "seq", ["image"], ["cx", "cy", "cz"]).select("seq", r6(F.col("path_len")).alias("path_len"))


DETAIL = f"""WITH {TWO}, s2 AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY ts, event_id) - 1 AS ord FROM st), p AS (
    WITH {near('ts', 'fts')} SELECT nb.seq, nb.event_id, {blend('l', 'ts')} AS px, {blend('k', 'ts')} AS py FROM nb),
  b AS (WITH {near('bag', 'fbag')} SELECT seq, event_id, {blend('l', 'bag')} AS v_bag FROM nb),
  j AS (SELECT s2.seq, s2.ord, p.px, p.py, b.v_bag FROM s2 JOIN p USING (seq, event_id) JOIN b USING (seq, event_id)),
  d AS (SELECT *, sqrt(pow(lead(px) OVER w - px, 2) + pow(lead(py) OVER w - py, 2)) AS step FROM j WINDOW w AS (PARTITION BY seq ORDER BY ord)),
  m AS (SELECT seq, median(step) AS med FROM d GROUP BY seq)
  SELECT seq, ord, round(step, 6) AS rtk_step, round(step / nullif(med, 0), 6) AS rtk_ratio, step < 0.1 * med AS rtk_stationary, round(px, 6) AS v_hdr, round(v_bag, 6) AS v_bag
  FROM d JOIN m USING (seq) WHERE step IS NOT NULL"""


@query("rpt9_stationary_detail", DETAIL)
def _(t):
    placed = Ordered(stamps(t), ["seq"], ["ts", "event_id"]).add(ord=ordinal()).df
    at = tj.asof_interp(placed, fixes(t), ["seq"], "ts", "fts", ["lum", "k"], suffix="_h")
    both = tj.asof_interp(at, fixes(t), ["seq"], "bag", "fbag", ["lum"], suffix="_b")
    nxt = F.struct(F.col("lum_h").alias("x"), F.col("k_h").alias("y"))
    moved = Ordered(both, ["seq"], ["ord"]).add(_n=following(nxt)).df.where("_n.x IS NOT NULL")
    step = F.hypot(F.col("_n.x") - F.col("lum_h"), F.col("_n.y") - F.col("k_h"))
    out = sq.stationary(moved.withColumn("step", step), "seq", 0.1)
    return out.select("seq", "ord", r6(F.col("step")).alias("rtk_step"), r6(F.col("ratio")).alias("rtk_ratio"),
                      F.col("stationary").alias("rtk_stationary"), r6(F.col("lum_h")).alias("v_hdr"), r6(F.col("lum_b")).alias("v_bag"))


@query("rpt9_stationary_summary", EDGE)
def _(t):
    return edge_summary(t)


@query("src8_window_scan", f"""WITH {FRAMES}, b AS (SELECT min(t) AS a, max(t) AS z FROM frames)
  SELECT seq, t, event_id, lum, kind FROM frames, b WHERE t BETWEEN a + (z - a) // 4 AND a + (z - a) // 3 AND kind IN ('click', 'view')""")
def _(t):
    log = t.frames.select("seq", "t", "event_id", "lum", "kind")
    folder = new_folder(t.spark, "message-log")
    write_chunks(log, folder, "t", "kind", chunks=24)
    ends = log.agg(F.min("t").alias("a"), F.max("t").alias("z")).first()  # the window asked for: a twelfth of the log
    a, span = (ends["a"], ends["z"] - ends["a"]) if ends["a"] is not None else (0, 0)
    messages = scan_chunks(t.spark, folder, log.schema, "t", "kind")
    return messages.where(F.col("t").between(a + span // 4, a + span // 3) & F.col("kind").isin("click", "view"))

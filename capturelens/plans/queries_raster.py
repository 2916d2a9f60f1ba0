"""Raster measures over embeddings as 8x8 frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster as rs
from .bindings import PAIRS, PIXELS
from .registry import query

W = 8


def r6(c):
    return F.round(c, 6)


LAPLACE = PIXELS + """, lap AS (SELECT r.seq, r.frame, p.v AS v,
    data[(CASE WHEN y = 0 THEN 1 ELSE y - 1 END) * 8 + x + 1] + data[(CASE WHEN y = 7 THEN 6 ELSE y + 1 END) * 8 + x + 1]
    + data[y * 8 + (CASE WHEN x = 0 THEN 1 ELSE x - 1 END) + 1] + data[y * 8 + (CASE WHEN x = 7 THEN 6 ELSE x + 1 END) + 1] - 4 * p.v AS l
    FROM pixels p JOIN rasters r USING (seq, frame)),
  meas AS (SELECT seq, frame, var_pop(l) AS blur, avg(v) AS lum, avg(CAST(v >= 250 OR v <= 5 AS INT)) AS clip, avg(CAST(v >= 165 OR v <= 90 AS INT)) AS wide FROM lap GROUP BY seq, frame)"""


def measures(t):
    return rs.frame_measures(t.rasters, "data", W)


@query("agg2_sharpness", f"WITH {LAPLACE} SELECT seq, frame, round(blur, 6) AS blur FROM meas")
def _(t):
    return measures(t).select("seq", "frame", r6(F.col("blur")).alias("blur"))


@query("agg2_blur_profile", f"""WITH {LAPLACE} SELECT seq, round(median(blur), 5) AS blur_median, round(avg(CAST(blur < 8000 AS INT)), 6) AS blur_share_below, round(stddev_pop(lum), 6) AS lum_sigma FROM meas GROUP BY seq""")
def _(t):
    from ..operators.quantiles import exact_quantiles

    m = measures(t)
    med = exact_quantiles(m, ["seq"], F.col("blur"), {"blur_median": 0.5}).drop("n")
    rest = m.groupBy("seq").agg(r6(F.avg((F.col("blur") < 8000).cast("double"))).alias("blur_share_below"), r6(F.stddev_pop("lum")).alias("lum_sigma"))
    return rest.join(med, "seq").select("seq", F.round("blur_median", 5).alias("blur_median"), "blur_share_below", "lum_sigma")


@query("agg3_clipped_share", f"""WITH {LAPLACE} SELECT seq, round(median(clip), 6) AS clip_share_median, round(avg(CAST(clip > 0.05 AS INT)), 6) AS clip_frames_gt5 FROM meas GROUP BY seq""")
def _(t):
    out = rs.clip_profile(measures(t), "seq")
    return out.select("seq", r6(F.col("clip_share_median")).alias("clip_share_median"), r6(F.col("clip_frames_gt5")).alias("clip_frames_gt5"))


@query("agg3_wide_clip", f"""WITH {LAPLACE} SELECT seq, round(median(wide), 6) AS clip_share_median, round(avg(CAST(wide > 0.05 AS INT)), 6) AS clip_frames_gt5 FROM meas GROUP BY seq""")
def _(t):
    wide = rs.pixel_share(F.col("data"), lambda v: (v >= 165) | (v <= 90))
    out = rs.clip_profile(t.rasters.withColumn("clip", wide), "seq")
    return out.select("seq", r6(F.col("clip_share_median")).alias("clip_share_median"), r6(F.col("clip_frames_gt5")).alias("clip_frames_gt5"))


@query("agg4_static_share", f"""WITH {PIXELS}, med AS (SELECT seq, y, x, median(v) AS m FROM pixels GROUP BY ALL),
  wi AS (SELECT p.seq, p.y, p.x, avg(CAST(abs(v - m) < 10 AS INT)) > 0.9 AS s FROM pixels p JOIN med USING (seq, y, x) WHERE p.seq <> 3 GROUP BY ALL)
  SELECT seq, 'measured' AS state, round(avg(CAST(s AS INT)), 6) AS static_share, round(avg(CASE WHEN y < 2 THEN CAST(s AS INT) END), 6) AS static_share_top_third,
    round(avg(CASE WHEN y >= 5 THEN CAST(s AS INT) END), 6) AS static_share_bottom_third FROM wi GROUP BY seq
  UNION ALL SELECT 3, 'n/a', NULL, NULL, NULL""")
def _(t):
    out = rs.static_share(t.rasters, "seq", "data", W, stills=F.col("seq") == 3)
    return out.select("seq", "state", *[r6(F.col(c)).alias(c) for c in out.columns if c.startswith("static")])


@query("agg4_static_loose", f"""WITH {PIXELS}, sm AS (SELECT seq, y, x, floor(v / 16) AS v FROM pixels), med AS (SELECT seq, y, x, median(v) AS m FROM sm GROUP BY ALL),
  wi AS (SELECT p.seq, p.y, p.x, avg(CAST(abs(v - m) < 10 AS INT)) > 0.9 AS s FROM sm p JOIN med USING (seq, y, x) GROUP BY ALL)
  SELECT seq, round(avg(CAST(s AS INT)), 6) AS static_share FROM wi GROUP BY seq""")
def _(t):
    small = t.rasters.withColumn("data", F.transform("data", lambda v: F.floor(v / 16).cast("double")))
    return rs.static_share(small, "seq", "data", W).select("seq", r6(F.col("static_share")).alias("static_share"))


@query("agg5_part_joins", f"""WITH {PIXELS}, f AS (SELECT seq, frame, frame // 50 AS part, lag(frame) OVER (PARTITION BY seq ORDER BY frame) AS pf FROM rasters),
  j AS (SELECT f.seq, f.frame, f.pf FROM f WHERE pf IS NOT NULL AND pf // 50 <> part)
  SELECT j.seq, j.frame, round(avg(abs(a.v - b.v)), 6) AS join_diff FROM j JOIN pixels a ON a.frame = j.frame JOIN pixels b ON b.frame = j.pf AND a.p = b.p GROUP BY ALL""")
def _(t):
    parts = t.rasters.withColumn("part", F.floor(F.col("frame") / 50))
    return rs.part_joins(parts, "seq", ["frame"], "part", "data").select("seq", "frame", r6(F.col("join_diff")).alias("join_diff"))


@query("agg34_psnr", f"""WITH {PAIRS}, m AS (SELECT seq, frame, avg(pow(truth - guess, 2)) AS mse, avg(pow(truth - guess, 2)) FILTER (v < 140) AS mk, count(*) FILTER (v < 140) AS n FROM raster_pairs GROUP BY ALL)
  SELECT seq, frame, round(CASE WHEN mse > 0 THEN 10 * log10(1 / mse) END, 6) AS psnr, round(CASE WHEN mk > 0 THEN 10 * log10(1 / mk) END, 6) AS psnr_masked FROM m""")
def _(t):
    pairs = t.raster_pairs.withColumn("keep", F.transform("truth", lambda v: v * 255 < 139.5))
    whole = rs.psnr(rs.mse(F.col("truth"), F.col("guess")))
    part = rs.psnr(rs.masked_mse(F.col("truth"), F.col("guess"), F.col("keep")))
    finite = lambda c: F.when(c < float("inf"), r6(c))
    return pairs.select("seq", "frame", finite(whole).alias("psnr"), finite(part).alias("psnr_masked"))


@query("agg35_ssim", f"""WITH {PAIRS}, c AS (SELECT unnest([3, 4]) AS cy), d AS (SELECT cy, cx FROM c, (SELECT cy AS cx FROM c)),
  w AS (SELECT frame, cy, cx, avg(truth) AS ux, avg(guess) AS uy, var_samp(truth) AS vx, var_samp(guess) AS vy, covar_samp(truth, guess) AS vxy
    FROM raster_pairs, d WHERE y BETWEEN cy - 3 AND cy + 3 AND x BETWEEN cx - 3 AND cx + 3 GROUP BY ALL)
  SELECT frame, round(avg((2 * ux * uy + 0.0001) * (2 * vxy + 0.0009) / ((ux * ux + uy * uy + 0.0001) * (vx + vy + 0.0009))), 6) AS ssim FROM w GROUP BY frame""")
def _(t):
    return t.raster_pairs.select("frame", r6(rs.ssim(F.col("truth"), F.col("guess"), F.lit(W))).alias("ssim"))


@query("agg35_masked_ssim", f"""WITH {PAIRS}, c AS (SELECT unnest([3, 4]) AS cy), d AS (SELECT cy, cx FROM c, (SELECT cy AS cx FROM c)),
  w AS (SELECT frame, cy, cx, avg(truth) AS ux, avg(guess) AS uy, var_samp(truth) AS vx, var_samp(guess) AS vy, covar_samp(truth, guess) AS vxy
    FROM raster_pairs, d WHERE y BETWEEN cy - 3 AND cy + 3 AND x BETWEEN cx - 3 AND cx + 3 GROUP BY ALL),
  s AS (SELECT w.*, (2 * ux * uy + 0.0001) * (2 * vxy + 0.0009) / ((ux * ux + uy * uy + 0.0001) * (vx + vy + 0.0009)) AS s FROM w),
  k AS (SELECT frame, least(greatest(y, 3), 4) AS cy, least(greatest(x, 3), 4) AS cx, y BETWEEN 3 AND 4 AND x BETWEEN 3 AND 4 AS inside FROM pixels WHERE v < 140),
  h AS (SELECT frame, bool_or(inside) AS has FROM k GROUP BY frame),
  m AS (SELECT k.frame, avg(s.s) AS v FROM k JOIN h USING (frame) JOIN s ON s.frame = k.frame AND s.cy = k.cy AND s.cx = k.cx WHERE k.inside OR NOT has GROUP BY k.frame)
  SELECT f.frame, round(m.v, 6) AS ssim FROM (SELECT DISTINCT frame FROM raster_pairs) f LEFT JOIN m ON m.frame = f.frame""")
def _(t):
    pairs = t.raster_pairs.withColumn("keep", F.transform("truth", lambda v: v * 255 < 139.5))
    return pairs.select("frame", r6(rs.masked_ssim(F.col("truth"), F.col("guess"), F.col("keep"), F.lit(W))).alias("ssim"))


REGION = f"""WITH {PAIRS}, m AS (SELECT seq, frame, avg(CAST(x BETWEEN 2 AND 5 AND v >= 120 AS INT)) AS share, avg(pow(truth - guess, 2)) FILTER (x BETWEEN 2 AND 5 AND v >= 120) AS a,
    avg(pow(truth - guess, 2)) FILTER (NOT (x BETWEEN 2 AND 5 AND v >= 120)) AS b FROM raster_pairs GROUP BY ALL),
  c AS (SELECT unnest([3, 4]) AS cy), d AS (SELECT cy, cx FROM c, (SELECT cy AS cx FROM c)),
  w AS (SELECT frame, cy, cx, avg(truth) AS ux, avg(guess) AS uy, var_samp(truth) AS vx, var_samp(guess) AS vy, covar_samp(truth, guess) AS vxy
    FROM raster_pairs, d WHERE y BETWEEN cy - 3 AND cy + 3 AND x BETWEEN cx - 3 AND cx + 3 GROUP BY ALL),
  s AS (SELECT frame, cy, cx, (2 * ux * uy + 0.0001) * (2 * vxy + 0.0009) / ((ux * ux + uy * uy + 0.0001) * (vx + vy + 0.0009)) AS s FROM w),
  k AS (SELECT frame, x BETWEEN 2 AND 5 AND v >= 120 AS side, least(greatest(y, 3), 4) AS cy, least(greatest(x, 3), 4) AS cx, y BETWEEN 3 AND 4 AND x BETWEEN 3 AND 4 AS mid FROM raster_pairs),
  h AS (SELECT frame, side, bool_or(mid) AS has FROM k GROUP BY ALL),
  q AS (SELECT k.frame, k.side, avg(s.s) AS v FROM k JOIN h ON h.frame = k.frame AND h.side = k.side JOIN s ON s.frame = k.frame AND s.cy = k.cy AND s.cx = k.cx WHERE k.mid OR NOT has GROUP BY ALL),
  reg AS (SELECT seq, m.frame, share AS region_share, CASE WHEN a > 0 THEN 10 * log10(1 / a) END AS psnr_inside, CASE WHEN b > 0 THEN 10 * log10(1 / b) END AS psnr_outside, i.v AS ssim_inside, o.v AS ssim_outside
    FROM m LEFT JOIN q i ON i.frame = m.frame AND i.side LEFT JOIN q o ON o.frame = m.frame AND NOT o.side)"""


SCORES = ["region_share", "psnr_inside", "psnr_outside", "ssim_inside", "ssim_outside"]


def regions(t):
    inside = F.transform("truth", lambda v, i: (i % W).between(2, 5) & (v * 255 >= 119.5))
    return rs.region_scores(t.raster_pairs.withColumn("inside", inside), "truth", "guess", "inside", F.lit(W)).select("seq", "frame", *SCORES)


@query("agg36_region_scores", REGION + " SELECT seq, frame, round(region_share, 6) AS region_share, round(psnr_inside, 6) AS psnr_inside, round(psnr_outside, 6) AS psnr_outside, round(ssim_inside, 6) AS ssim_inside, round(ssim_outside, 6) AS ssim_outside FROM reg")
def _(t):
    return regions(t).select("seq", "frame", *[r6(F.col(c)).alias(c) for c in SCORES])


@query("agg37_region_means", REGION + " SELECT seq, count(*) AS n_views, round(avg(region_share), 6) AS region_share, round(avg(psnr_inside), 6) AS psnr_inside, round(avg(psnr_outside), 6) AS psnr_outside FROM reg GROUP BY seq")
def _(t):
    return regions(t).groupBy("seq").agg(F.count(F.lit(1)).alias("n_views"), *[r6(F.avg(c)).alias(c) for c in ("region_share", "psnr_inside", "psnr_outside")])


CONDITIONS = [("raw", 256.0), ("loose", 150.0), ("strict", 135.0)]


@query("agg39_common_pixels", f"""WITH {PAIRS} SELECT frame, count(*) AS n_pixels, CAST(count(*) FILTER (v < 135 AND p % 7 <> 0) AS BIGINT) AS n_common,
  round(avg(pow(truth - guess, 2)) FILTER (v < 135 AND p % 7 <> 0), 8) AS mse_common FROM raster_pairs GROUP BY frame""")
def _(t):
    limits = F.array(*[F.struct(F.lit(n).alias("condition"), F.lit(v).alias("limit")) for n, v in CONDITIONS])
    masks = t.rasters.select("frame", "data", F.explode(limits).alias("_c")).select(
        "frame", F.transform("data", lambda v, i: (v < F.col("_c.limit")) & ((i % 7 != 0) | (F.col("_c.condition") == "raw"))).alias("keep"))
    common = rs.common_mask(masks, ["frame"], "keep", W)
    both = t.raster_pairs.join(common, "frame")
    return both.select(
        "frame", F.size("keep").cast("bigint").alias("n_pixels"), F.size(F.filter("keep", lambda k: k)).cast("bigint").alias("n_common"),
        F.round(rs.masked_mse(F.col("truth"), F.col("guess"), F.col("keep")), 8).alias("mse_common"))


@query("agg40_mask_stability", f"""WITH {PIXELS}, f AS (SELECT seq, frame, lag(frame) OVER (PARTITION BY seq ORDER BY frame) AS pf FROM rasters),
  m AS (SELECT f.seq, f.frame, sum(CAST(a.v >= 128 AND b.v >= 128 AS INT)) AS i, sum(CAST(a.v >= 128 OR b.v >= 128 AS INT)) AS u FROM f JOIN pixels a ON a.frame = f.frame JOIN pixels b ON b.frame = f.pf AND a.p = b.p GROUP BY ALL),
  s AS (SELECT seq, min(CASE WHEN u = 0 THEN 1.0 ELSE i / u::DOUBLE END) AS iou_min, median(CASE WHEN u = 0 THEN 1.0 ELSE i / u::DOUBLE END) AS iou_median FROM m GROUP BY seq),
  a AS (SELECT seq, median(area) AS area_median, count(*) AS n_masks FROM (SELECT seq, frame, avg(CAST(v >= 128 AS INT)) AS area FROM pixels GROUP BY ALL) GROUP BY seq)
  SELECT seq, n_masks, round(iou_min, 6) AS iou_min, round(iou_median, 6) AS iou_median, round(area_median, 6) AS area_median, iou_min >= 0.2 AS accepted FROM s JOIN a USING (seq)""")
def _(t):
    masks = t.rasters.select("seq", "frame", F.transform("data", lambda v: v >= 128).alias("mask"))
    out = rs.mask_stability(masks, "seq", ["frame"], "mask", 0.2)
    return out.select("seq", "n_masks", *[r6(F.col(c)).alias(c) for c in ("iou_min", "iou_median", "area_median")], "accepted")


# Four consecutive rasters are the bands of one capture.
BANDS = PIXELS + ", bands AS (SELECT frame // 4 AS capture, frame % 4 AS band, p, v FROM pixels)"


def bands(t):
    return t.rasters.select(F.floor(F.col("frame") / 4).alias("capture"), (F.col("frame") % 4).alias("band"), "data")


def stretch_sql(keys):
    return f"""WITH {BANDS}, l AS (SELECT {keys}, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS h0 FROM bands GROUP BY {keys}), m AS (SELECT *, CASE WHEN h0 > lo THEN h0 ELSE lo + 1 END AS hi FROM l)
  SELECT capture, band, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi, round(avg(least(greatest((v - lo) / (hi - lo), 0.0), 1.0)), 9) AS mean FROM bands JOIN m USING ({keys}) GROUP BY capture, band"""


def _stretch(t, keys):
    out = rs.stretch(bands(t), keys, "data")
    return out.select("capture", "band", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), F.round(rs.pixel_mean(F.col("stretched")), 9).alias("mean"))


@query("agg41_joint_stretch", stretch_sql("capture"))
def _(t):
    return _stretch(t, ["capture"])


@query("agg41_band_stretch", stretch_sql("capture, band"))
def _(t):
    return _stretch(t, ["capture", "band"])


@query("agg42_pooled_scale", f"WITH {PIXELS} SELECT seq, count(*) AS n, round(quantile_cont(v, 0.999), 6) AS scale FROM pixels WHERE p % 16 = 0 GROUP BY seq")
def _(t):
    return rs.pooled_scale(t.rasters, ["seq"], "data").select("seq", "n", r6(F.col("scale")).alias("scale"))


@query("agg43_gray_world", f"""WITH {BANDS}, m AS (SELECT capture, band, avg(v / 255.0) AS m FROM bands GROUP BY ALL), g AS (SELECT capture, avg(m) AS tg FROM m GROUP BY capture)
  SELECT b.capture, b.band, round(any_value(tg / m), 6) AS gain, round(avg(least(b.v / 255.0 * tg / m, 1.0)), 9) AS mean FROM bands b JOIN m USING (capture, band) JOIN g USING (capture) GROUP BY b.capture, b.band""")
def _(t):
    unit = bands(t).withColumn("data", F.transform("data", lambda v: v / 255.0))
    out = rs.gray_world(unit, ["capture"], "band", "data")
    return out.select("capture", "band", r6(F.col("gain")).alias("gain"), F.round(rs.pixel_mean(F.col("balanced")), 9).alias("mean"))


@query("agg44_median_matrix", """WITH e AS (SELECT label AS seq, vec_id, CAST(embedding AS DOUBLE[])[1:9] AS h, vec_id % 6 <> 0 AS ok FROM embeddings),
  c AS (SELECT seq, i, median(h[i]) AS m FROM e, (SELECT unnest(range(1, 10)) AS i) WHERE ok GROUP BY ALL), u AS (SELECT seq, CAST(count(*) FILTER (ok) AS BIGINT) AS used, count(*) AS sampled FROM e GROUP BY seq)
  SELECT seq, used, sampled, round(max(m) FILTER (i = 1), 6) AS h00, round(max(m) FILTER (i = 5), 6) AS h11, round(max(m) FILTER (i = 9), 6) AS h22 FROM c JOIN u USING (seq) GROUP BY ALL""")
def _(t):
    h = F.when(F.col("vec_id") % 6 != 0, F.transform(F.slice("embedding", 1, 9), lambda v: v.cast("double")))
    out = rs.median_matrix(t.embeddings.select(F.col("label").alias("seq"), h.alias("h")), ["seq"], "h")
    return out.select("seq", "used", "sampled", *[r6(F.col("median")[i]).alias(n) for n, i in (("h00", 0), ("h11", 4), ("h22", 8))])


VEIL = PIXELS + """, d AS (SELECT a.frame, a.p, a.v / 255.0 AS c0, b.v / 255.0 AS c1, c.v / 255.0 AS c2, least(a.v, b.v, c.v) AS dark FROM pixels a JOIN pixels b ON a.frame = b.frame AND b.p = (a.p + 1) % 64
    JOIN pixels c ON a.frame = c.frame AND c.p = (a.p + 2) % 64), r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY dark DESC, p) AS rn FROM d), top AS (SELECT * FROM r WHERE rn <= 3)"""


def _veil(t, brightest):
    at = lambda i, d: F.get("data", (i + d) % 64)
    px = F.transform("data", lambda v, i: F.array(v / 255.0, at(i, 1) / 255.0, at(i, 2) / 255.0))
    dark = F.transform("data", lambda v, i: F.least(v, at(i, 1), at(i, 2)))
    veil = rs.veil_light(F.col("px"), F.col("dark"), share=0.05, brightest=brightest)
    wide = t.rasters.select("frame", px.alias("px"), dark.alias("dark")).select("frame", veil.alias("a"))
    return wide.select("frame", *[r6(F.col("a")[i]).alias(f"a{i}") for i in range(3)])


@query("agg45_veil_mean", "WITH " + VEIL + " SELECT frame, " + ", ".join(f"round(least(greatest(avg(c{i}), 0.5), 1.0), 6) AS a{i}" for i in range(3)) + " FROM top GROUP BY frame")
def _(t):
    return _veil(t, False)


@query("agg45_veil_brightest", "WITH " + VEIL + """, b AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY round((c0 + c1 + c2) * 255) DESC, c0, c1, c2) AS k FROM top)
  SELECT frame, """ + ", ".join(f"round(least(greatest(c{i}, 0.5), 1.0), 6) AS a{i}" for i in range(3)) + " FROM b WHERE k = 1")
def _(t):
    return _veil(t, True)


@query("rpt19_most_excluded_view", f"""WITH {PIXELS}, m AS (SELECT seq, frame, 1 - avg(CAST(v < 140 AS INT)) AS x FROM pixels GROUP BY ALL)
  SELECT seq, frame, round(x, 6) AS excluded_share FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY round(x, 9) DESC, frame) AS rn FROM m) WHERE rn = 1""")
def _(t):
    return rs.most_excluded(t.masks, ["seq"], "frame", "keep").select("seq", "frame", r6(F.col("excluded_share")).alias("excluded_share"))


@query("udf4_raster_kernels", f"WITH {LAPLACE} SELECT seq, count(*) AS n, round(avg(blur), 4) AS blur_mean, round(max(blur), 4) AS blur_max FROM meas GROUP BY seq")
def _(t):
    return measures(t).groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("blur"), 4).alias("blur_mean"), F.round(F.max("blur"), 4).alias("blur_max"))

"""Spatial joins, pose geometry, robust scores and point clouds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cloud as cl
from ..operators import pose as ps
from ..operators import robust as rb
from ..operators import spatial as spt
from ..operators.sampling import number_frames, split_interp
from .bindings import FRAMES, OBSERVATIONS, PIXELS, POSES
from .registry import query

XYZ = ["cx", "cy", "cz"]
AXIS = ["ax", "ay", "az"]


def r6(c):
    return F.round(c, 6)


SITES = """qs AS (SELECT c_custkey, CAST((c_custkey * 37) % 1009 AS DOUBLE) AS x, CAST((c_custkey * 53) % 997 AS DOUBLE) AS y FROM customer),
  ss AS (SELECT s_suppkey, CAST((s_suppkey * 211) % 1009 AS DOUBLE) AS x, CAST((s_suppkey * 89) % 997 AS DOUBLE) AS y FROM supplier)"""


def photos(t):
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", ((k * 37) % 1009).cast("double").alias("x"), ((k * 53) % 997).cast("double").alias("y"))


def trunks(t):
    k = F.col("s_suppkey")
    return t.supplier.select("s_suppkey", ((k * 211) % 1009).cast("double").alias("x"), ((k * 89) % 997).cast("double").alias("y"))


NEAR = SITES + ", d AS (SELECT c_custkey, min(sqrt(pow(qs.x - ss.x, 2) + pow(qs.y - ss.y, 2))) AS dist FROM qs, ss GROUP BY c_custkey)"


def nearest_site(t):
    return spt.nearest(photos(t), trunks(t), [], ["x", "y"], "c_custkey", "s_suppkey")


@query("jon12_nearest_site", f"WITH {NEAR} SELECT c_custkey, round(dist, 6) AS dist FROM d")
def _(t):
    return nearest_site(t).select("c_custkey", r6(F.col("dist")).alias("dist"))


@query("jon12_nearest_site_summary", f"""WITH {NEAR} SELECT count(*) AS n, round(avg(CAST(dist < 50 AS INT)), 6) AS share_within_50m, round(median(dist), 6) AS p50,
  round(quantile_cont(dist, 0.95), 6) AS p95, round(max(dist), 6) AS max_dist FROM d""")
def _(t):
    from ..operators.quantiles import exact_quantiles

    near = nearest_site(t)
    head = near.agg(r6(F.avg((F.col("dist") < 50).cast("double"))).alias("share_within_50m"), r6(F.max("dist")).alias("max_dist"))
    ranks = exact_quantiles(near, [], F.col("dist"), {"p50": 0.5, "p95": 0.95})
    return ranks.select("n", r6(F.col("p50")).alias("p50"), r6(F.col("p95")).alias("p95")).crossJoin(F.broadcast(head))  # one row each


@query("jon13_points_in_box", f"""WITH {SITES}, b AS (SELECT s_suppkey, x - 40 AS x0, x + 40 AS x1, y - 25 AS y0, y + 25 AS y1 FROM ss)
  SELECT s_suppkey, count(c_custkey) AS n_inside FROM b LEFT JOIN qs ON qs.x BETWEEN x0 AND x1 AND qs.y BETWEEN y0 AND y1 GROUP BY s_suppkey""")
def _(t):
    x, y = F.col("x"), F.col("y")
    boxes = trunks(t).select("s_suppkey", (x - 40).alias("x0"), (x + 40).alias("x1"), (y - 25).alias("y0"), (y + 25).alias("y1"))
    return spt.points_in_boxes(photos(t), boxes, "s_suppkey", "x", "y", 50.0).select("s_suppkey", "n_inside")


# A site is outside its nation's hull of photos when, seen from it, they leave a gap of more than half a turn.
@query("jon14_points_in_hull", f"""WITH {SITES}, f AS (SELECT c_nationkey AS g, x, y FROM customer JOIN qs USING (c_custkey)), p AS (SELECT s_nationkey AS g, s_suppkey, x, y FROM supplier JOIN ss USING (s_suppkey)),
  a AS (SELECT p.g, s_suppkey, f.x = p.x AND f.y = p.y AS same, atan2(f.y - p.y, f.x - p.x) AS a FROM p JOIN f USING (g)),
  gaps AS (SELECT s_suppkey, same, CASE WHEN NOT same THEN coalesce(lead(a) OVER w, first_value(a) OVER w + 2 * pi()) - a END AS gap FROM a WINDOW w AS (PARTITION BY s_suppkey, same ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  i AS (SELECT s_suppkey, bool_or(same) OR max(gap) <= pi() + 1e-9 AS inside FROM gaps GROUP BY s_suppkey)
  SELECT p.g, count(*) AS n_gcp, CAST(count(*) FILTER (inside) AS BIGINT) AS inside FROM p LEFT JOIN i USING (s_suppkey) GROUP BY p.g""")
def _(t):
    flown = t.customer.join(photos(t), "c_custkey").select(F.col("c_nationkey").alias("g"), "x", "y")
    hulls = spt.hull_corners(flown, "g", "x", "y")
    placed = t.supplier.join(trunks(t), "s_suppkey").select(F.col("s_nationkey").alias("g"), "s_suppkey", "x", "y")
    return spt.points_in_hull(placed, hulls, "g", "x", "y", "s_suppkey").groupBy("g").agg(
        F.count(F.lit(1)).alias("n_gcp"), F.count_if("inside").alias("inside"))


HELD = POSES + """, nm AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY image) - 1 AS ord FROM poses),
  pl AS (SELECT seq, sum(s) AS path FROM (SELECT seq, sqrt(pow(cx - lag(cx) OVER w, 2) + pow(cy - lag(cy) OVER w, 2) + pow(cz - lag(cz) OVER w, 2)) AS s
    FROM poses WINDOW w AS (PARTITION BY seq ORDER BY image)) GROUP BY seq),
  pr AS (SELECT a.seq, a.image, b.image AS nn_view, sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2) + pow(a.cz - b.cz, 2)) AS dist, a.ax * b.ax + a.ay * b.ay + a.az * b.az AS c
    FROM nm a JOIN nm b ON a.seq = b.seq AND a.ord % 8 = 0 AND b.ord % 8 <> 0),
  best AS (SELECT *, row_number() OVER (PARTITION BY seq, image ORDER BY dist, nn_view) AS rn FROM pr)"""


def overlap(t):
    placed = split_interp(number_frames(t.poses, "seq", ["image"]))
    return ps.view_overlap(placed, "seq", "image", XYZ, AXIS, ["image"])


@query("jon15_nearest_training_view", f"""WITH {HELD} SELECT seq, image, nn_view, round(dist / path, 6) AS nn_dist_frac, round(degrees(acos(least(greatest(c, -1), 1))), 6) AS nn_angle_deg
  FROM best JOIN pl USING (seq) WHERE rn = 1""")
def _(t):
    out = overlap(t)
    return out.select("seq", "image", "nn_view", r6(F.col("nn_dist_frac")).alias("nn_dist_frac"), r6(F.col("nn_angle_deg")).alias("nn_angle_deg"))


@query("jon16_knn_scale", f"""WITH {POSES}, d AS (SELECT a.seq, a.image, pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2) + pow(a.cz - b.cz, 2) AS d2
    FROM poses a JOIN poses b ON a.seq = b.seq AND a.image <> b.image), r AS (SELECT *, row_number() OVER (PARTITION BY seq, image ORDER BY d2) AS rn FROM d)
  SELECT seq, image, round(greatest(sqrt(avg(d2)), 1e-7), 6) AS scale FROM r WHERE rn <= 3 GROUP BY seq, image""")
def _(t):
    return spt.knn_scale(t.poses, ["seq"], "image", XYZ).select("seq", "image", r6(F.col("scale")).alias("scale"))


OBS3 = OBSERVATIONS + ", tall AS (SELECT * FROM observations WHERE point IN (SELECT point FROM observations GROUP BY point HAVING count(*) >= 3))"


def tall(t):
    return rb.long_tracks(t.observations, "point", 3)


def z_sql(ch, floor):
    return f"({ch} - med_{ch}) / greatest(1.4826 * mad_{ch}, {floor})"


def mad_ctes(chs, src="tall"):
    meds = ", ".join(f"median({c}) AS med_{c}" for c in chs)
    mads = ", ".join(f"median(abs({c} - med_{c})) AS mad_{c}" for c in chs)
    return f"med AS (SELECT point, {meds} FROM {src} GROUP BY point), away AS (SELECT * FROM {src} JOIN med USING (point)), mad AS (SELECT point, {mads} FROM away GROUP BY point), both2 AS (SELECT * FROM away JOIN mad USING (point))"


VEIL = f"{OBS3}, {mad_ctes(['v', 's'])}, scored AS (SELECT point, image, greatest({z_sql('v', 0.02)}, 0.0) + greatest(-({z_sql('s', 0.02)}), 0.0) AS score FROM both2)"
LABS = {"l": 1.0, "a": 0.3, "b": 0.3}
LAB = f"{OBS3}, {mad_ctes(['l', 'a', 'b'])}, scored AS (SELECT point, image, sqrt({' + '.join(f'pow({z_sql(c, f)}, 2)' for c, f in LABS.items())}) AS score FROM both2)"


def veil(t):
    return rb.veil_score(tall(t), "point", "v", "s")


@query("agg22_veil_score", f"WITH {VEIL} SELECT point, image, round(score, 6) AS score FROM scored")
def _(t):
    return veil(t).select("point", "image", r6(F.col("score")).alias("score"))


@query("agg23_colour_score", f"WITH {LAB} SELECT point, image, round(score, 6) AS score FROM scored")
def _(t):
    return rb.colour_score(tall(t), "point", rb.LAB_FLOORS).select("point", "image", r6(F.col("score")).alias("score"))


OTSU = f"""{VEIL}, top AS (SELECT max(score) AS top FROM scored), h AS (SELECT CAST(floor(score / top * 255) AS INT) AS bin, CAST(count(*) AS DOUBLE) AS w FROM scored, top GROUP BY 1),
  c AS (SELECT bin, sum(w) OVER o AS w0, sum(w * bin) OVER o AS m0, sum(w) OVER () AS wt, sum(w * bin) OVER () AS mt FROM h WINDOW o AS (ORDER BY bin)),
  v AS (SELECT bin, round(CASE WHEN wt > w0 THEN w0 * (wt - w0) * pow(m0 / w0 - (mt - m0) / (wt - w0), 2) ELSE 0 END, 6) AS b FROM c),
  th AS (SELECT arg_max(bin, (b, -bin)) / 255.0 * any_value(top) AS threshold FROM v, top)"""


@query("agg24_otsu_threshold", f"WITH {OTSU} SELECT round(threshold, 6) AS threshold FROM th")
def _(t):
    return rb.otsu_threshold(veil(t).select("score"), "score").select(r6(F.col("threshold")).alias("threshold"))


@query("agg24_flagged_frames", f"""WITH {OTSU} SELECT image, count(*) AS n, CAST(count(*) FILTER (score > threshold + 1e-9) AS BIGINT) AS n_flagged,
  round(avg(CAST(score > threshold + 1e-9 AS INT)), 6) AS flagged_share FROM scored, th GROUP BY image""")
def _(t):
    out = rb.flag_outliers(veil(t).select("image", "score"), "score")
    hit = F.col("score") > F.col("threshold") + 1e-9
    return out.groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_flagged"), r6(F.avg(hit.cast("double"))).alias("flagged_share"))


@query("agg25_track_length", """WITH a AS (SELECT *, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem), b AS (SELECT * FROM a WHERE n >= 3 AND l_quantity > 20),
  c AS (SELECT *, count(*) OVER (PARTITION BY l_partkey) AS n2 FROM b) SELECT l_partkey AS point, count(*) AS n FROM c WHERE n2 >= 3 GROUP BY l_partkey""")
def _(t):
    return rb.long_tracks(t.observations, "point", 3, F.col("l") > 20).groupBy("point").agg(F.count(F.lit(1)).alias("n"))


def pc(i):
    return f"(image * {i} % 101) / 50.0"


def px(i):
    return f"(point * {i} % 97) / 10.0"


TRI = f"""WITH {OBSERVATIONS}, o AS (SELECT point, image, row_number() OVER (PARTITION BY point ORDER BY l_orderkey, l_linenumber, image, l_quantity, l_extendedprice) AS rn,
    {px(7)} - {pc(3)} AS rx, {px(11)} - {pc(5)} AS ry, {px(13)} + 5 - {pc(9)} AS rz FROM observations), f AS (SELECT * FROM o WHERE rn <= 5),
  p AS (SELECT a.point, degrees(acos(least(greatest((a.rx*b.rx + a.ry*b.ry + a.rz*b.rz) / (sqrt(a.rx*a.rx + a.ry*a.ry + a.rz*a.rz) * sqrt(b.rx*b.rx + b.ry*b.ry + b.rz*b.rz) + 1e-12), -1), 1))) AS ang
    FROM f a JOIN f b ON a.point = b.point AND a.rn < b.rn), m AS (SELECT point, max(ang) AS ang FROM p GROUP BY point),
  tri AS (SELECT point, coalesce(ang, 0) AS ang FROM (SELECT DISTINCT point FROM observations) LEFT JOIN m USING (point))"""


def triangulated(t):
    place = lambda c, i, m, d: ((F.col(c) * i) % m) / F.lit(d)
    obs = t.observations.select(
        "point", "image", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.array(place("point", 7, 97, 10.0), place("point", 11, 97, 10.0), place("point", 13, 97, 10.0) + 5).alias("xyz"),
        F.array(place("image", 3, 101, 50.0), place("image", 5, 101, 50.0), place("image", 9, 101, 50.0)).alias("c"))
    return ps.triangulation_angle(obs, "point", ["l_orderkey", "l_linenumber", "image", "l_quantity", "l_extendedprice"], "xyz", "c")


@query("agg26_triangulation_angle", f"{TRI} SELECT point, round(ang, 5) AS tri_angle FROM tri")
def _(t):
    return triangulated(t).select("point", F.round("tri_angle", 5).alias("tri_angle"))


@query("agg26_triangulation_median", f"{TRI} SELECT round(median(ang), 5) AS tri_angle_median, count(*) AS n FROM tri")
def _(t):
    from ..operators.quantiles import exact_quantiles

    mid = exact_quantiles(triangulated(t), [], F.col("tri_angle"), {"tri_angle_median": 0.5})
    return mid.select(F.round("tri_angle_median", 5).alias("tri_angle_median"), "n")




def box(lo, hi, names=XYZ):
    return ", ".join(f"quantile_cont({c}, {lo}) AS {c}_lo, quantile_cont({c}, {hi}) AS {c}_hi" for c in names)


@query("agg27_baseline_fraction", f"""WITH {POSES}, l AS (SELECT seq, sqrt(pow(cx - lag(cx) OVER w, 2) + pow(cy - lag(cy) OVER w, 2) + pow(cz - lag(cz) OVER w, 2)) AS s FROM poses WINDOW w AS (PARTITION BY seq ORDER BY image)),
  m AS (SELECT seq, median(s) AS med FROM l GROUP BY seq), b AS (SELECT seq, {box(0.05, 0.95)} FROM poses GROUP BY seq)
  SELECT seq, round(med / (sqrt(pow(cx_hi - cx_lo, 2) + pow(cy_hi - cy_lo, 2) + pow(cz_hi - cz_lo, 2)) + 1e-12), 6) AS baseline_frac FROM m JOIN b USING (seq)""")
def _(t):
    return ps.baseline_fraction(t.poses, t.poses, "seq", ["image"], XYZ).select("seq", r6(F.col("baseline_frac")).alias("baseline_frac"))


@query("agg28_view_coverage", f"""WITH {POSES}, li AS (SELECT i, 1 - (2.0::DOUBLE * i + 1) / 20000 AS z, i * (pi() * (3 - sqrt(5.0))) AS phi FROM (SELECT unnest(range(20000)) AS i)),
  g AS (SELECT i, sqrt(1 - z*z) * cos(phi) AS x, sqrt(1 - z*z) * sin(phi) AS y, z FROM li),
  h AS (SELECT DISTINCT seq, i FROM poses, g WHERE ax * x + ay * y + az * z >= cos(radians(15.0)))
  SELECT seq, round(count(*) / 20000.0::DOUBLE * 4 * pi(), 6) AS coverage_sr FROM h GROUP BY seq""")
def _(t):
    return ps.view_coverage(t.poses, "seq", AXIS, directions=20000).select("seq", r6(F.col("coverage_sr")).alias("coverage_sr"))


@query("agg29_view_spread", f"""WITH {POSES}, m AS (SELECT seq, avg(ax) AS mx, avg(ay) AS my, avg(az) AS mz FROM poses GROUP BY seq),
  d AS (SELECT seq, degrees(acos(least(greatest((ax*mx + ay*my + az*mz) / (sqrt(mx*mx + my*my + mz*mz) + 1e-12), -1), 1))) AS dev FROM poses JOIN m USING (seq))
  SELECT seq, round(quantile_cont(dev, 0.9), 6) AS spread FROM d GROUP BY seq""")
def _(t):
    return ps.view_spread(t.poses, "seq", AXIS).select("seq", r6(F.col("spread")).alias("spread"))


@query("agg30_scene_scale", f"""WITH {POSES}, m AS (SELECT seq, avg(cx) AS mx, avg(cy) AS my, avg(cz) AS mz FROM poses GROUP BY seq),
  d AS (SELECT seq, sqrt(pow(cx - mx, 2) + pow(cy - my, 2) + pow(cz - mz, 2)) AS dist FROM poses JOIN m USING (seq))
  SELECT seq, round(greatest(quantile_cont(dist, 0.95), 1e-6), 6) AS scale FROM d GROUP BY seq""")
def _(t):
    return ps.scene_scale(t.poses, ["seq"], XYZ).select("seq", r6(F.col("scale")).alias("scale"))


def moved_pairs(t):
    """Camera centres and a turned, scaled, shifted copy with a small known error."""
    x, y, z = (F.col(c) for c in XYZ)
    wobble = (F.col("image") % 7 - 3) * 0.001
    return t.poses.select(
        "seq", "image", *XYZ, (2.5 * y + 1 + wobble).alias("dx"), (-2.5 * x + 2).alias("dy"), (2.5 * z - 3).alias("dz"))


def squared(n):
    """A symmetric n x n matrix (a list ``m``) times itself, over its trace: the way to its largest eigenvector."""
    one = f"list_transform(range({n * n}), lambda i: list_sum(list_transform(range({n}), lambda k: m[(i // {n}) * {n} + k + 1] * m[k * {n} + i % {n} + 1])))"
    trace = "list_sum(list_transform(m, lambda x: x * x))"
    return f"list_transform({one}, lambda x: x / {trace})"


def top_vector(n):
    """From m = v v' back to v, by its largest entry on the diagonal."""
    best = f"list_position(list_transform(range({n}), lambda i: m[i * {n} + i + 1]), list_max(list_transform(range({n}), lambda i: m[i * {n} + i + 1])))"
    return f"list_transform(range({n}), lambda j: m[({best} - 1) * {n} + j + 1] / sqrt(m[({best} - 1) * {n} + {best}]))"


# The best rotation as a unit quaternion: the largest eigenvector of a symmetric 4 x 4 matrix, made positive by a shift.
ALIGNED = f"""WITH RECURSIVE {POSES}, pr AS (SELECT seq, image, cx, cy, cz, 2.5 * cy + 1 + (image % 7 - 3) * 0.001 AS dx, -2.5 * cx + 2 AS dy, 2.5 * cz - 3 AS dz FROM poses),
  mu AS (SELECT seq, count(*) AS n, avg(cx) AS mx, avg(cy) AS my, avg(cz) AS mz, avg(dx) AS ux, avg(dy) AS uy, avg(dz) AS uz FROM pr GROUP BY seq),
  ctr AS (SELECT seq, cx - mx AS x, cy - my AS y, cz - mz AS z, dx - ux AS a, dy - uy AS b, dz - uz AS c FROM pr JOIN mu USING (seq)),
  s AS (SELECT seq, sum(x*a) AS xx, sum(x*b) AS xy, sum(x*c) AS xz, sum(y*a) AS yx, sum(y*b) AS yy, sum(y*c) AS yz, sum(z*a) AS zx, sum(z*b) AS zy, sum(z*c) AS zz, sum(x*x + y*y + z*z) AS ss FROM ctr GROUP BY seq),
  h AS (SELECT *, abs(xx) + abs(xy) + abs(xz) + abs(yx) + abs(yy) + abs(yz) + abs(zx) + abs(zy) + abs(zz) AS up FROM s),
  pw AS (SELECT seq, 0 AS k, [up+xx+yy+zz, yz-zy, zx-xz, xy-yx, yz-zy, up+xx-yy-zz, xy+yx, zx+xz, zx-xz, xy+yx, up-xx+yy-zz, yz+zy, xy-yx, zx+xz, yz+zy, up-xx-yy+zz] AS m FROM h
    UNION ALL SELECT seq, k + 1, {squared(4)} FROM pw WHERE k < 24),
  q AS (SELECT seq, {top_vector(4)} AS q FROM pw WHERE k = 24),
  r AS (SELECT seq, q[1]*q[1]+q[2]*q[2]-q[3]*q[3]-q[4]*q[4] AS r11, 2*(q[2]*q[3]-q[1]*q[4]) AS r12, 2*(q[2]*q[4]+q[1]*q[3]) AS r13, 2*(q[2]*q[3]+q[1]*q[4]) AS r21,
    q[1]*q[1]-q[2]*q[2]+q[3]*q[3]-q[4]*q[4] AS r22, 2*(q[3]*q[4]-q[1]*q[2]) AS r23, 2*(q[2]*q[4]-q[1]*q[3]) AS r31, 2*(q[3]*q[4]+q[1]*q[2]) AS r32, q[1]*q[1]-q[2]*q[2]-q[3]*q[3]+q[4]*q[4] AS r33 FROM q),
  f AS (SELECT *, (r11*xx + r12*yx + r13*zx + r21*xy + r22*yy + r23*zy + r31*xz + r32*yz + r33*zz) / ss AS sc FROM r JOIN s USING (seq) JOIN mu USING (seq)),
  g AS (SELECT *, ux - sc*(r11*mx + r12*my + r13*mz) AS t0, uy - sc*(r21*mx + r22*my + r23*mz) AS t1, uz - sc*(r31*mx + r32*my + r33*mz) AS t2 FROM f),
  e AS (SELECT seq, count(*) AS n_matched, sqrt(avg(pow(sc*(r11*cx + r12*cy + r13*cz) + t0 - dx, 2) + pow(sc*(r21*cx + r22*cy + r23*cz) + t1 - dy, 2) + pow(sc*(r31*cx + r32*cy + r33*cz) + t2 - dz, 2))) AS err, any_value(sc) AS sc FROM pr JOIN g USING (seq) GROUP BY seq)"""
FLAGGED = "CASE WHEN n_matched BETWEEN 4 AND 7 THEN 'yes' ELSE '' END AS flagged"


@query("agg32_similarity_alignment", f"{ALIGNED} SELECT seq, n, round(sc, 4) AS scale, round(t0, 4) AS t0, round(t1, 4) AS t1, round(t2, 4) AS t2 FROM g")
def _(t):
    fit = ps.align_similarity(moved_pairs(t), "seq", XYZ, ["dx", "dy", "dz"])
    return fit.select("seq", "n", F.round("scale", 4).alias("scale"), *[F.round(F.col("shift")[i], 4).alias(f"t{i}") for i in range(3)])


@query("agg33_trajectory_rmse", f"{ALIGNED} SELECT seq, n_matched, CASE WHEN n_matched >= 4 THEN round(err, 6) END AS ate_rmse, CASE WHEN n_matched >= 4 THEN round(sc, 4) END AS scale, {FLAGGED} FROM e")
def _(t):
    out = ps.trajectory_error(moved_pairs(t), "seq", XYZ, ["dx", "dy", "dz"])
    return out.select("seq", "n_matched", r6(F.col("ate_rmse")).alias("ate_rmse"), F.round("scale", 4).alias("scale"), "flagged")


@query("agg47_bounding_box", f"WITH {POSES} SELECT seq, min(cx) AS x0, max(cx) AS x1, min(cy) AS y0, max(cy) AS y1, min(cz) AS z0, max(cz) AS z1 FROM poses GROUP BY seq")
def _(t):
    ends = [f(c).alias(f"{c[1]}{i}") for c in XYZ for i, f in ((0, F.min), (1, F.max))]
    return t.poses.groupBy("seq").agg(*ends)


@query("agg48_robust_limits", f"""WITH {FRAMES} SELECT seq, round(median(lum) - 3 * stddev_pop(lum), 6) AS lo, round(median(lum) + 3 * stddev_pop(lum), 6) AS hi FROM frames GROUP BY seq""")
def _(t):
    return rb.robust_limits(t.frames, ["seq"], F.col("lum")).select("seq", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"))


@query("cld1_seeded_sample", f"WITH {POSES} SELECT image, cx, cy, cz FROM poses ORDER BY md5('0:' || image), image LIMIT 100")
def _(t):
    return cl.seeded_sample(t.poses.select("image", *XYZ), "image", 100, seed=0)


@query("cld2_voxel_downsample", f"""WITH {POSES} SELECT CAST(floor(cx / 0.1) AS BIGINT) AS g_cx, CAST(floor(cy / 0.1) AS BIGINT) AS g_cy, CAST(floor(cz / 0.1) AS BIGINT) AS g_cz,
  count(*) AS n, round(avg(cx), 6) AS cx, round(avg(cy), 6) AS cy, round(avg(cz), 6) AS cz FROM poses GROUP BY 1, 2, 3""")
def _(t):
    out = cl.voxel_downsample(t.poses, [], XYZ, 0.1)
    return out.select("g_cx", "g_cy", "g_cz", "n", *[r6(F.col(c)).alias(c) for c in XYZ])


@query("cld3_opacity_prune", f"WITH {POSES} SELECT seq, count(*) AS n_before, CAST(count(*) FILTER (1 / (1 + exp(-logit)) >= 0.5) AS BIGINT) AS n_after FROM poses GROUP BY seq")
def _(t):
    before = t.poses.groupBy("seq").agg(F.count(F.lit(1)).alias("n_before"))
    after = cl.prune_opacity(t.poses, "logit", 0.5).groupBy("seq").agg(F.count(F.lit(1)).alias("n_after"))
    return before.join(after, "seq", "left").fillna(0, ["n_after"])


def inside(pad):
    return " AND ".join(f"{c} BETWEEN {c}_lo - ({c}_hi - {c}_lo) * {pad} AND {c}_hi + ({c}_hi - {c}_lo) * {pad}" for c in XYZ)


@query("cld4_percentile_clip", f"WITH {POSES}, b AS (SELECT seq, {box(0.05, 0.95)} FROM poses GROUP BY seq) SELECT seq, image FROM poses JOIN b USING (seq) WHERE {inside(0.1)}")
def _(t):
    return cl.percentile_clip(t.poses, ["seq"], XYZ, 0.1).select("seq", "image")


@query("cld5_dense_centre", f"""WITH {POSES}, q AS (SELECT *, 1 / (1 + exp(-logit)) AS op FROM poses), u AS (SELECT seq, quantile_cont(op, 0.4) AS cut FROM q GROUP BY seq),
  c AS (SELECT seq, round(avg(cx), 6) AS cx_centre, round(avg(cy), 6) AS cy_centre, round(avg(cz), 6) AS cz_centre FROM q JOIN u USING (seq) WHERE op > cut GROUP BY seq),
  b AS (SELECT seq, {box(0.05, 0.95)} FROM poses GROUP BY seq)
  SELECT c.*, round(cx_hi - cx_lo, 6) AS cx_extent, round(cy_hi - cy_lo, 6) AS cy_extent, round(cz_hi - cz_lo, 6) AS cz_extent FROM c JOIN b USING (seq)""")
def _(t):
    out = cl.dense_centre(t.poses, ["seq"], XYZ, "logit")
    return out.select("seq", *[r6(F.col(c)).alias(c) for c in out.columns if c != "seq"])


@query("cld6_up_vector", f"""WITH {POSES}, m AS (SELECT seq, avg(ax) AS x, avg(ay) AS y, avg(az) AS z FROM poses GROUP BY seq), n AS (SELECT *, sqrt(x*x + y*y + z*z) AS l FROM m)
  SELECT seq, round(CASE WHEN l >= 0.1 THEN x / l ELSE 0 END, 6) AS ax, round(CASE WHEN l >= 0.1 THEN y / l ELSE 1 END, 6) AS ay, round(CASE WHEN l >= 0.1 THEN z / l ELSE 0 END, 6) AS az FROM n""")
def _(t):
    return ps.up_vector(t.poses, ["seq"], AXIS).select("seq", *[r6(F.col(c)).alias(c) for c in AXIS])


def axes(t):
    return cl.principal_axis(t.poses, "seq", XYZ).select("seq", F.col("ax").alias("ux"), F.col("ay").alias("uy"), F.col("az").alias("uz"))


AXES = f"""WITH RECURSIVE {POSES}, cv AS (SELECT seq, covar_pop(cx, cx) AS a, covar_pop(cx, cy) AS b, covar_pop(cx, cz) AS c, covar_pop(cy, cy) AS d, covar_pop(cy, cz) AS e, covar_pop(cz, cz) AS f FROM poses GROUP BY seq),
  pw AS (SELECT seq, 0 AS k, [a, b, c, b, d, e, c, e, f] AS m FROM cv UNION ALL SELECT seq, k + 1, {squared(3)} FROM pw WHERE k < 24),
  v AS (SELECT seq, {top_vector(3)} AS v FROM pw WHERE k = 24), ax AS (SELECT seq, list_transform(v, lambda x: CASE WHEN v[3] < 0 THEN -x ELSE x END) AS u FROM v)"""


@query("cld7_principal_axis", f"{AXES} SELECT seq, round(u[1], 5) AS ux, round(u[2], 5) AS uy, round(u[3], 5) AS uz FROM ax")
def _(t):
    return axes(t).select("seq", *[F.round(c, 5).alias(c) for c in ("ux", "uy", "uz")])


FIXED = "0.6 * cx - 0.8 * cy"


def _ordered(t):
    fixed = t.poses.select("seq").distinct().select("seq", F.lit(0.6).alias("ux"), F.lit(-0.8).alias("uy"), F.lit(0.0).alias("uz"))
    return cl.order_cameras(t.poses, fixed, "seq", XYZ, ["ux", "uy", "uz"], "image")


PLACED = f"WITH {POSES}, o AS (SELECT seq, image, {FIXED} AS along, row_number() OVER (PARTITION BY seq ORDER BY {FIXED}, image) - 1 AS place, count(*) OVER (PARTITION BY seq) AS n FROM poses)"


@query("cld8_camera_order", PLACED + " SELECT seq, image, place, n, round(along, 6) AS along FROM o")
def _(t):
    return _ordered(t).select("seq", "image", "place", "n", r6(F.col("along")).alias("along"))


@query("cld8_fraction_picks", PLACED + ", f AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS fraction) SELECT seq, fraction, image FROM o, f WHERE place = CAST(floor(fraction * (n - 1)) AS BIGINT)")
def _(t):
    return cl.pick_fractions(_ordered(t), [0.0, 0.25, 0.5, 0.75, 1.0]).select("seq", "fraction", "image")


@query("cld8_axis_order", f"{AXES} SELECT seq, image, row_number() OVER (PARTITION BY seq ORDER BY cx * u[1] + cy * u[2] + cz * u[3], image) - 1 AS place FROM poses JOIN ax USING (seq)")
def _(t):
    return cl.order_cameras(t.poses, axes(t), "seq", XYZ, ["ux", "uy", "uz"], "image").select("seq", "image", "place")


@query("cld9_pinhole_projection", f"""WITH {POSES}, c AS (SELECT seq, image, cx * 4 AS x, cy * 4 AS y, cz + 0.5 AS z FROM poses),
  p AS (SELECT *, 32 / (2 * tan(radians(35.0))) * x / z + 16 AS u, 32 / (2 * tan(radians(35.0))) * y / z + 12 AS v FROM c WHERE z > 0.1),
  b AS (SELECT *, CAST(floor(u) AS BIGINT) AS px, CAST(floor(v) AS BIGINT) AS py FROM p WHERE u >= 0 AND u < 32 AND v >= 0 AND v < 24)
  SELECT seq, px, py, arg_min(image, (z, image)) AS image, round(min(z), 6) AS depth, count(*) AS n FROM b GROUP BY seq, px, py""")
def _(t):
    xyz = [F.col("cx") * 4, F.col("cy") * 4, F.col("cz") + 0.5]
    out = cl.project_pinhole(t.poses, ["seq"], "image", xyz, 32, 24, 70.0)
    return out.select("seq", "px", "py", "image", r6(F.col("depth")).alias("depth"), "n")


@query("cld10_robust_centre", f"""WITH {POSES}, b AS (SELECT seq, {box(0.1, 0.9)} FROM poses GROUP BY seq), e AS (SELECT *, cx_hi - cx_lo AS ex, cy_hi - cy_lo AS ey, cz_hi - cz_lo AS ez FROM b)
  SELECT seq, round((cx_lo + cx_hi) / 2, 6) AS cx_centre, round((cy_lo + cy_hi) / 2, 6) AS cy_centre, round((cz_lo + cz_hi) / 2, 6) AS cz_centre, round(ex, 6) AS cx_extent, round(ey, 6) AS cy_extent,
    round(ez, 6) AS cz_extent, round(greatest(ex, ez) / 2 / tan(radians(35.0)) * 1.25, 6) AS dist_top, round(greatest(ex, ey, ez) / 2 / tan(radians(35.0)) * 1.25, 6) AS dist_side FROM e""")
def _(t):
    out = cl.robust_centre(t.poses, ["seq"], XYZ)
    return out.select("seq", *[r6(F.col(c)).alias(c) for c in out.columns if c != "seq"])


@query("cld11_excluded_box", f"""WITH {PIXELS}, m AS (SELECT seq, frame, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pixels WHERE v >= 150 GROUP BY ALL)
  SELECT r.seq, r.frame, coalesce(greatest(0, x0 - CAST(floor((x1 - x0) * 0.15) AS BIGINT)), 0) AS x0, coalesce(greatest(0, y0 - CAST(floor((y1 - y0) * 0.15) AS BIGINT)), 0) AS y0,
    coalesce(least(8, x1 + CAST(floor((x1 - x0) * 0.15) AS BIGINT)), 8) AS x1, coalesce(least(8, y1 + CAST(floor((y1 - y0) * 0.15) AS BIGINT)), 8) AS y1 FROM rasters r LEFT JOIN m USING (seq, frame)""")
def _(t):
    keep = F.transform("data", lambda v: v < 150)
    return t.rasters.select("seq", "frame", cl.excluded_box(keep, 8).alias("_b")).select("seq", "frame", "_b.*")

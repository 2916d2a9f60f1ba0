"""Row-wise operators: dimensions, ids, formats, angles, poses and colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats as fm
from ..functions import geometry as geo
from ..functions import names as nm
from ..operators import raster as rs
from ..operators import sampling as sp
from .bindings import FRAMES, PIXELS
from .registry import query


def dec(x: str, nd: int) -> str:
    """SQL text of a half-up decimal."""
    return f"CAST(CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,12)), {nd}) AS DECIMAL(38,{nd})) AS VARCHAR)"


def r6(c):
    return F.round(c, 6)


# Dimensions of the bound pictures: width and height in pixels from a part's size and price.
DIM = "SELECT p_partkey, p_size * 80 AS w, CAST(floor(p_retailprice) AS INT) + 7 AS h, p_size, p_retailprice FROM part"


def _dims(t):
    return t.part.select(
        "p_partkey", (F.col("p_size") * 80).alias("w"), (F.floor("p_retailprice").cast("int") + 7).alias("h"),
        "p_size", "p_retailprice")


@query("prj6_fit_width", f"""SELECT p_partkey, least(w, 1600)::BIGINT AS w2,
  CASE WHEN w <= 1600 THEN h::BIGINT ELSE CAST(round_even(h * 1600.0::DOUBLE / w, 0) AS BIGINT) END AS h2 FROM ({DIM})""")
def _(t):
    d = sp.fit_width(F.col("w"), F.col("h"))
    return _dims(t).select("p_partkey", d["w"].alias("w2"), d["h"].alias("h2"))


@query("prj7_fit_longest", f"""SELECT p_partkey, CASE WHEN s < 1 THEN CAST(round_even(w * s, 0) AS BIGINT) ELSE w END AS w2,
  CASE WHEN s < 1 THEN CAST(round_even(h * s, 0) AS BIGINT) ELSE h END AS h2
  FROM (SELECT *, least(1.0, 1000.0::DOUBLE / greatest(w, h)) AS s FROM ({DIM}))""")
def _(t):
    d = sp.fit_longest(F.col("w"), F.col("h"), 1000)
    return _dims(t).select("p_partkey", d["w"].alias("w2"), d["h"].alias("h2"))


IDS = """(SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'btg' WHEN c_custkey % 4 = 1 THEN 'bot'
    WHEN c_custkey % 4 = 2 THEN 'mots' ELSE 'blt' END AS dataset,
  CASE WHEN c_custkey % 4 = 0 THEN 'Row' || (c_custkey % 9) || '.1' || CASE WHEN c_custkey % 8 = 0 THEN '_p' || (c_custkey % 5) ELSE '' END
    WHEN c_custkey % 4 = 1 THEN c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '_V1' ELSE '_V2' END || CASE WHEN c_custkey % 5 = 0 THEN '_rgb' ELSE '' END
    WHEN c_custkey % 4 = 2 THEN 'Path_' || c_custkey ELSE CASE WHEN c_custkey % 3 = 0 THEN 'gr_' ELSE 'uk_' END || c_custkey END AS sequence FROM customer)"""


def ids(t):
    """Customers as sequences with the id forms the rules look at."""
    k = F.col("c_custkey")
    s = k.cast("string")
    part = F.when(k % 8 == 0, F.concat(F.lit("_p"), (k % 5).cast("string"))).otherwise("")
    flight = F.when(k % 3 == 0, "_V1").otherwise("_V2")
    rgb = F.when(k % 5 == 0, "_rgb").otherwise("")
    return t.customer.select(
        "c_custkey",
        F.when(k % 4 == 0, "btg").when(k % 4 == 1, "bot").when(k % 4 == 2, "mots").otherwise("blt").alias("dataset"),
        F.when(k % 4 == 0, F.concat(F.lit("Row"), (k % 9).cast("string"), F.lit(".1"), part))
        .when(k % 4 == 1, F.concat(s, flight, rgb))
        .when(k % 4 == 2, F.concat(F.lit("Path_"), s))
        .otherwise(F.concat(F.when(k % 3 == 0, "gr_").otherwise("uk_"), s)).alias("sequence"))


@query("prj8_composite_id", f"SELECT c_custkey, dataset || '_' || sequence AS id FROM {IDS}")
def _(t):
    return ids(t).select("c_custkey", nm.composite_id(F.col("dataset"), F.col("sequence")).alias("id"))


DERIVED = """CASE WHEN id LIKE '%\\_rgb' ESCAPE '\\' THEN regexp_replace(id, '_rgb$', '')
  WHEN id LIKE 'btg\\_%' ESCAPE '\\' AND contains(id, '_p') THEN regexp_replace(id, '^(.*)_p.*$', '\\1') ELSE '' END"""


@query("prj9_derived_from", f"SELECT id, {DERIVED} AS derived FROM (SELECT DISTINCT dataset || '_' || sequence AS id FROM {IDS})")
def _(t):
    keyed = ids(t).select(nm.composite_id(F.col("dataset"), F.col("sequence")).alias("id")).distinct()
    return keyed.select("id", nm.derived_from(F.col("id")).alias("derived"))


@query("prj10_scene_group", f"""SELECT scene, count(*) AS n FROM (SELECT CASE WHEN id LIKE 'mots\\_%' ESCAPE '\\' THEN 'mots_plot'
  WHEN id LIKE 'blt\\_gr\\_%' ESCAPE '\\' THEN 'blt_gerovassiliou' WHEN id LIKE 'blt\\_uk\\_%' ESCAPE '\\' THEN 'blt_riseholme'
  WHEN id LIKE 'btg\\_%' ESCAPE '\\' THEN 'btg_' || split_part(substr(id, 5), '_p', 1)
  WHEN id LIKE 'bot\\_%' ESCAPE '\\' THEN CASE WHEN contains(id, 'V2') THEN 'bot_V2' ELSE 'bot_V1' END ELSE id END AS scene
  FROM (SELECT dataset || '_' || sequence AS id FROM {IDS})) GROUP BY scene""")
def _(t):
    keyed = ids(t).select(nm.composite_id(F.col("dataset"), F.col("sequence")).alias("id"))
    return keyed.groupBy(nm.scene_group(F.col("id")).alias("scene")).agg(F.count(F.lit(1)).alias("n"))


# A text cell as a study's CSV may hold it: numbers, blanks and the known markers.
CELL = """CASE WHEN l_linenumber = 1 THEN 'undetermined' WHEN l_linenumber = 2 THEN ' n/a ' WHEN l_linenumber = 3 THEN ''
  ELSE CAST(l_quantity / 8 + l_discount AS VARCHAR) END"""


def _cells(t):
    n = F.col("l_linenumber")
    cell = F.when(n == 1, "undetermined").when(n == 2, " n/a ").when(n == 3, "").otherwise(
        (F.col("l_quantity") / 8 + F.col("l_discount")).cast("string"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice", "l_tax", cell.alias("cell"))


@query("prj11_missing_values", f"""SELECT l_linenumber, count(*) AS n, count(v) AS n_known FROM (
  SELECT l_linenumber, CASE WHEN trim({CELL}) NOT IN ('', 'undetermined', 'n/a', 'None', 'nan') THEN trim({CELL}) END AS v FROM lineitem)
  GROUP BY l_linenumber""")
def _(t):
    return _cells(t).withColumn("v", fm.norm_missing(F.col("cell"))).groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("n_known"))


KNOWN = f"(SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_extendedprice, CASE WHEN l_linenumber > 3 THEN {CELL} END AS c FROM lineitem)"


@query("prj12_half_up_number", f"SELECT shown, count(*) AS n FROM (SELECT coalesce({dec('c', 2)}, '—') AS shown FROM {KNOWN}) GROUP BY shown")
def _(t):
    return _cells(t).groupBy(fm.fmt_num(F.col("cell"), 2).alias("shown")).agg(F.count(F.lit(1)).alias("n"))


@query("prj13_percent", f"""SELECT shown, count(*) AS n FROM (SELECT coalesce({dec('CAST(CAST(c AS VARCHAR) AS DECIMAL(38,12)) * 100', 1)} || ' %', '—') AS shown
  FROM {KNOWN}) GROUP BY shown""")
def _(t):
    return _cells(t).groupBy(fm.fmt_pct(F.col("cell")).alias("shown")).agg(F.count(F.lit(1)).alias("n"))


@query("prj14_integer_text", """SELECT o_orderkey, format('{:,}', CAST(trunc(o_totalprice * 10) AS BIGINT)) AS shown FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", fm.fmt_int(F.col("o_totalprice") * 10).alias("shown"))


@query("prj15_plain_notation", """SELECT l_discount, l_tax, CASE WHEN l_linenumber = 1 THEN '—' WHEN l_linenumber = 2 THEN '0.000025' WHEN l_linenumber = 3 THEN '1250'
  ELSE CAST(l_discount AS VARCHAR) END AS shown, count(*) AS n FROM lineitem GROUP BY ALL""")
def _(t):
    n = F.col("l_linenumber")
    cell = F.when(n == 1, "nan").when(n == 2, "2.5e-05").when(n == 3, "1.25E3").otherwise(F.col("l_discount").cast("string"))
    return t.lineitem.groupBy("l_discount", "l_tax", fm.fmt_plain(cell).alias("shown")).agg(F.count(F.lit(1)).alias("n"))


@query("prj16_significant_digits", """WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN 0
    ELSE o_totalprice / pow(10.0, o_orderkey % 12) END AS x FROM orders)
  SELECT o_orderkey, CASE WHEN x IS NULL THEN 'undetermined' ELSE format('{:.4g}', x) END AS shown FROM v""")
def _(t):
    k = F.col("o_orderkey") % 7
    x = F.when(k == 0, None).when(k == 1, 0.0).otherwise(F.col("o_totalprice") / F.pow(F.lit(10.0), F.col("o_orderkey") % 12))
    return t.orders.select("o_orderkey", fm.fmt_sig(x).alias("shown"))


SIZES = "(SELECT l_orderkey, list(CAST(l_quantity AS INT) ORDER BY l_quantity DESC) AS sizes FROM lineitem GROUP BY l_orderkey)"


def sizes(t):
    """Model sizes of a run, largest first; a run's models are few."""
    return t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_quantity").cast("int")), asc=False).alias("sizes"))


@query("prj17_sizes_text", f"""SELECT l_orderkey, array_to_string(sizes, ', ') AS shown, '[' || array_to_string(sizes, ',') || ']' AS json FROM {SIZES}""")
def _(t):
    js = fm.fmt_container(F.col("sizes"))
    return sizes(t).select("l_orderkey", fm.fmt_sizes(js).alias("shown"), js.alias("json"))


LABEL = """SELECT event_id, 'clip_' || user_id || '/frame_' || lpad(CAST(event_id AS VARCHAR), 6, '0') || CASE WHEN event_id % 3 = 0 THEN '.png.png' ELSE '.jpg' END AS name,
  CASE WHEN event_id % 2 = 0 THEN 'part.mp4:' || user_id || ' (global ' || event_id || ')'
  ELSE 'bag_time=' || CAST(event_id AS VARCHAR) || '.5s header_stamp=' || CAST(event_id * 3 AS VARCHAR) || '.250' END AS label FROM events"""


def labels(t):
    """Events as frame names and frame-list labels."""
    e, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    tail = F.when(F.col("event_id") % 3 == 0, ".png.png").otherwise(".jpg")
    name = F.concat(F.lit("clip_"), u, F.lit("/frame_"), F.lpad(e, 6, "0"), tail)
    label = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("part.mp4:"), u, F.lit(" (global "), e, F.lit(")"))).otherwise(
        F.concat(F.lit("bag_time="), e, F.lit(".5s header_stamp="), (F.col("event_id") * 3).cast("string"), F.lit(".250")))
    return t.events.select("event_id", name.alias("name"), label.alias("label"))


@query("prj18_frame_index", f"SELECT event_id, name, TRY_CAST(regexp_extract(name, '(\\d+)\\.\\w+$', 1) AS BIGINT) AS idx FROM ({LABEL})")
def _(t):
    return labels(t).select("event_id", "name", nm.frame_index(F.col("name")).alias("idx"))


@query("prj19_label_parse", f"""SELECT event_id, TRY_CAST(nullif(regexp_extract(label, 'global (\\d+)', 1), '') AS BIGINT) AS g,
  TRY_CAST(nullif(regexp_extract(label, 'bag_time=([\\d.]+)s', 1), '') AS DOUBLE) AS bag,
  TRY_CAST(nullif(regexp_extract(label, 'header_stamp=([\\d.]+)', 1), '') AS DOUBLE) AS stamp FROM ({LABEL})""")
def _(t):
    c = F.col("label")
    return labels(t).select("event_id", nm.label_global(c).alias("g"), nm.label_bag_time(c).alias("bag"), nm.label_header_stamp(c).alias("stamp"))


@query("prj20_frame_stem", f"SELECT event_id, regexp_replace(name, '(\\.(png|jpe?g))+$', '') AS stem FROM ({LABEL})")
def _(t):
    return labels(t).select("event_id", nm.frame_stem(F.col("name")).alias("stem"))


@query("prj21_note_mining", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) || '.5' END AS alt_median,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS alt_min,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_nationkey + 1 AS VARCHAR) END AS alt_max FROM customer""")
def _(t):
    n = F.col("c_nationkey")
    note = F.concat(F.lit("kept; GPS altitude median "), n.cast("string"), F.lit(".5 m, min "), n.cast("string"),
                    F.lit(" m, max "), (n + 1).cast("string"), F.lit(" m (legs)"))
    notes = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("none"))).otherwise(F.array(F.lit("first"), note))
    return t.customer.select("c_custkey", nm.altitude_note(notes).alias("_a")).select("c_custkey", "_a.*")


@query("prj22_yaw", """SELECT vec_id, round(degrees(atan2(2 * (e[1] * e[4] + e[2] * e[3]), 1 - 2 * (e[3] * e[3] + e[4] * e[4]))), 6) AS yaw
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""")
def _(t):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return t.embeddings.select("vec_id", r6(geo.yaw_degrees(e(0), e(1), e(2), e(3))).alias("yaw"))


@query("prj23_heading_difference", f"""WITH {FRAMES} SELECT event_id, CAST(round(abs(((k * 3.6 - 90.0 + 180.0) % 360.0 + 360.0) % 360.0 - 180.0), 6) AS DOUBLE) AS d FROM frames""")
def _(t):
    return t.frames.select("event_id", r6(geo.heading_difference(F.col("k") * 3.6, F.lit(90.0))).alias("d"))


@query("prj24_dms_degrees", """SELECT c_custkey, round((c_nationkey + (c_custkey % 60) / 60.0::DOUBLE + (c_custkey % 50) / 3600.0::DOUBLE)
  * CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END, 6) + 0.0 AS deg FROM customer""")
def _(t):
    k = F.col("c_custkey")
    ref = F.when(k % 4 == 0, "S").when(k % 4 == 2, "W").otherwise("N")
    return t.customer.select("c_custkey", r6(geo.dms_degrees(F.col("c_nationkey"), k % 60, k % 50, ref)).alias("deg"))


@query("prj25_focal_px", f"""SELECT p_partkey, round(CASE WHEN p_partkey % 3 > 0 THEN p_size * CASE p_partkey % 5 WHEN 3 THEN p_retailprice / 10.0
    WHEN 4 THEN p_retailprice ELSE p_retailprice / 25.4 END WHEN p_size > 25 THEN p_size / 43.27 * sqrt(1.0 * w * w + 1.0 * h * h) END, 4) AS f FROM ({DIM})""")
def _(t):
    k = F.col("p_partkey")
    given = F.when(k % 3 > 0, F.col("p_size").cast("double"))
    film = F.when(F.col("p_size") > 25, F.col("p_size").cast("double"))
    f = geo.focal_px(given, F.col("p_retailprice"), (k % 5).cast("int"), film, F.col("w"), F.col("h"))
    return _dims(t).select("p_partkey", F.round(f, 4).alias("f"))


ENU0 = f"WITH {FRAMES}, f AS (SELECT *, first_value(lum / 10) OVER w AS la0, first_value(k / 5.0) OVER w AS lo0 FROM frames WINDOW w AS (PARTITION BY seq ORDER BY t, event_id))"


@query("prj26_enu", ENU0 + """ SELECT event_id, round(radians(k / 5.0 - lo0) * 6378137.0 * cos(radians(la0)), 3) AS east,
  round(radians(lum / 10 - la0) * 6378137.0, 3) AS north, 0.0::DOUBLE AS up FROM f""")
def _(t):
    from ..operators.rollup import first_row

    at = t.frames.select("seq", "t", "event_id", (F.col("lum") / 10).alias("lat"), (F.col("k") / 5.0).alias("lon"))
    origin = first_row(at, ["seq"], [F.col("t"), F.col("event_id")]).select("seq", F.col("lat").alias("lat0"), F.col("lon").alias("lon0"))
    none = F.lit(None).cast("double")
    place = geo.enu(F.col("lat"), F.col("lon"), none, F.col("lat0"), F.col("lon0"), none)
    out = at.join(origin, "seq").select("event_id", place.alias("_p"))
    return out.select("event_id", F.round("_p.east", 3).alias("east"), F.round("_p.north", 3).alias("north"), F.col("_p.up").alias("up"))


MODELS = f"SELECT l_orderkey, sizes, list_max(sizes) AS n, list_sum(sizes)::BIGINT AS total, len(sizes) AS n_models FROM {SIZES}"


def _models(t):
    return sizes(t).select(
        "l_orderkey", "sizes", F.array_max("sizes").alias("n"), F.size("sizes").alias("n_models"),
        F.aggregate("sizes", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


@query("prj27_outcome_class", f"""SELECT l_orderkey, CASE WHEN n < 3 THEN 'failed' WHEN n / total::DOUBLE < 0.5 OR n_models > 1 THEN 'partial' ELSE 'ok' END AS outcome FROM ({MODELS})""")
def _(t):
    from ..functions.runs import outcome_class

    return _models(t).select("l_orderkey", outcome_class(F.col("n"), F.col("total"), F.col("n_models")).alias("outcome"))


@query("prj28_gate", f"SELECT l_orderkey, n / total::DOUBLE >= 0.5 AS gate_pass FROM ({MODELS})")
def _(t):
    from ..functions.runs import gate_pass

    return _models(t).select("l_orderkey", gate_pass(F.col("sizes"), F.col("total")).alias("gate_pass"))


@query("prj30_focal_ratio", """SELECT p_partkey, round(CASE WHEN p_size % 10 > 0 THEN p_retailprice / (p_size % 10) END, 6) AS ratio FROM part""")
def _(t):
    return t.part.select("p_partkey", r6(F.try_divide("p_retailprice", F.col("p_size") % 10)).alias("ratio"))


def _rigid(t):
    """A rotation about z by the first element, a translation of the next three."""
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    c, s, z, o = F.cos(e(0)), F.sin(e(0)), F.lit(0.0), F.lit(1.0)
    rot = F.array(F.array(c, -s, z), F.array(s, c, z), F.array(z, z, o))
    return t.embeddings.select("vec_id", rot.alias("rot"), F.array(e(1), e(2), e(3)).alias("tr"), F.array(e(4), e(5), e(6)).alias("p"))


E7 = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
CENTRE = "-(cos(e[1]) * e[2] + sin(e[1]) * e[3]) AS x, -(-sin(e[1]) * e[2] + cos(e[1]) * e[3]) AS y, -e[4] AS z"


@query("prj31_camera_centre", f"SELECT vec_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM (SELECT vec_id, {CENTRE} FROM {E7})")
def _(t):
    c = geo.camera_centre(F.col("rot"), F.col("tr"))
    return _rigid(t).select("vec_id", c.alias("c")).select("vec_id", *[r6(F.col("c")[i]).alias(n) for i, n in enumerate("xyz")])


@query("prj32_pose_convention", f"""SELECT vec_id, round(cos(e[1]), 6) AS m00, round(-sin(e[1]), 6) AS m01, round(x, 6) AS m03,
  CAST(-1.0 AS DOUBLE) AS m12, round(z, 6) AS m13, round(sin(e[1]), 6) AS m20, round(-y, 6) AS m23 FROM (SELECT vec_id, e, {CENTRE} FROM {E7})""")
def _(t):
    m = geo.camera_to_world(F.col("rot"), F.col("tr"))
    cells = {"m00": (0, 0), "m01": (0, 1), "m03": (0, 3), "m12": (1, 2), "m13": (1, 3), "m20": (2, 0), "m23": (2, 3)}
    return _rigid(t).select("vec_id", m.alias("m")).select("vec_id", *[r6(F.col("m")[i][j]).alias(n) for n, (i, j) in cells.items()])


@query("prj33_affine_points", f"""SELECT vec_id, round(cos(e[1]) * e[5] - sin(e[1]) * e[6] + e[2], 6) AS x,
  round(sin(e[1]) * e[5] + cos(e[1]) * e[6] + e[3], 6) AS y, round(e[7] + e[4], 6) AS z FROM {E7}""")
def _(t):
    m = F.transform(F.arrays_zip("rot", "tr"), lambda s: F.concat(s["rot"], F.array(s["tr"])))
    out = _rigid(t).select("vec_id", geo.apply_affine(m, F.col("p")).alias("q"))
    return out.select("vec_id", *[r6(F.col("q")[i]).alias(n) for i, n in enumerate("xyz")])


@query("prj34_harmonic_colour", f"""SELECT vec_id, round((e[1] - 0.5) / 0.28209479177387814, 6) AS c0, round((e[2] - 0.5) / 0.28209479177387814, 6) AS c1,
  round(least(greatest(e[3], 0.0), 1.0), 6) AS back FROM {E7}""")
def _(t):
    rgb = F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double"))
    both = t.embeddings.select("vec_id", geo.harmonic_from_colour(rgb).alias("h"))
    return both.select("vec_id", r6(F.col("h")[0]).alias("c0"), r6(F.col("h")[1]).alias("c1"), r6(geo.colour_from_harmonic(F.col("h"))[2]).alias("back"))


@query("prj35_class_filter", f"""WITH {PIXELS} SELECT seq, frame, round(avg(CAST(v * 10 >= 1000 AND v * 10 < 2000 AS INT)), 6) AS share FROM pixels GROUP BY ALL""")
def _(t):
    big = F.transform("data", lambda v: v * 10)
    return t.rasters.select("seq", "frame", r6(rs.class_share(big)).alias("share"))


RGB = PIXELS + """, rgb AS (SELECT a.seq, a.frame, a.p, a.y, a.x, a.v AS r, b.v AS g, c.v AS b FROM pixels a JOIN pixels b ON a.frame = b.frame AND b.p = (a.p + 1) % 64
    JOIN pixels c ON a.frame = c.frame AND c.p = (a.p + 2) % 64), hsv0 AS (
  SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS d FROM rgb), hsv AS (
  SELECT *, CASE WHEN hi = 0 THEN 0.0 ELSE 255.0 * d / hi END AS s, hi AS v,
    CASE WHEN d = 0 THEN 0.0 WHEN hi = r THEN 60.0 * (g - b) / d WHEN hi = g THEN 120.0 + 60.0 * (b - r) / d ELSE 240.0 + 60.0 * (r - g) / d END AS hh FROM hsv0),
  pix AS (SELECT *, CASE WHEN hh < 0 THEN hh + 360.0 ELSE hh END / 2.0 AS h FROM hsv)"""


def rgb(t):
    """Pixels with three channels: a pixel and its next two (in a ring) as r, g, b."""
    ring = lambda d: F.transform("data", lambda v, i: F.get("data", (i + d) % 64))
    wide = t.rasters.select("seq", "frame", F.arrays_zip(F.col("data").alias("r"), ring(1).alias("g"), ring(2).alias("b")).alias("px"))
    flat = wide.select("seq", "frame", F.posexplode("px").alias("p", "c"))
    return flat.select("seq", "frame", "p", F.floor(F.col("p") / 8).alias("y"), (F.col("p") % 8).alias("x"), "c.*")


@query("prj36_flare_share", f"WITH {RGB} SELECT seq, frame, round(avg(CAST(v / 255.0 > 0.55 AND s / 255.0 < 0.15 AS INT)), 6) AS share FROM pix GROUP BY ALL")
def _(t):
    share = rs.flare_share(F.col("r"), F.col("g"), F.col("b"), value=0.55)
    return rgb(t).groupBy("seq", "frame").agg(r6(share).alias("share"))


@query("prj37_hsv_rules", f"""WITH {RGB} SELECT seq, frame, round(avg(CAST(
    (h BETWEEN 0 AND 179 AND s BETWEEN 0 AND 40 AND v BETWEEN 205 AND 255) OR (h BETWEEN 0 AND 20 AND s BETWEEN 80 AND 255 AND v BETWEEN 40 AND 255)
    OR (h BETWEEN 150 AND 179 AND s BETWEEN 80 AND 255 AND v BETWEEN 40 AND 255) OR (h BETWEEN 0 AND 179 AND s BETWEEN 0 AND 80 AND v BETWEEN 0 AND 30)
    OR (x >= 7 AND x < 8 AND y >= 6 AND y < 8) AS INT)), 6) AS share FROM pix GROUP BY ALL""")
def _(t):
    c = geo.hsv(F.col("r"), F.col("g"), F.col("b"))
    hit = rs.in_ranges(c, F.col("x"), F.col("y"), F.lit(8), F.lit(8))
    return rgb(t).groupBy("seq", "frame").agg(r6(F.avg(hit.cast("double"))).alias("share"))


@query("prj38_excess_green", f"WITH {RGB} SELECT seq, frame, round(avg((g - greatest(r, b)) / 255.0), 6) AS exg FROM pix GROUP BY ALL")
def _(t):
    return rgb(t).groupBy("seq", "frame").agg(r6(F.avg(geo.excess_green(F.col("r"), F.col("g"), F.col("b")))).alias("exg"))


@query("prj39_radiance", f"""WITH {PIXELS} SELECT frame, round(avg(least(greatest((v / 255.0 - 0.7) / least(greatest(1 - v / 255.0, 0.15), 1.0) + 0.7, 0.0), 1.0)), 6) AS radiance
  FROM pixels GROUP BY frame""")
def _(t):
    one = lambda v: geo.recover_radiance(v / 255.0, F.lit(0.7), 1 - v / 255.0)
    return t.rasters.select("frame", r6(rs.pixel_mean(F.transform("data", one))).alias("radiance"))


@query("prj40_readiness_class", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN ['ripe', 'ripening', 'unripe'][CAST(o_orderkey % 4 AS INT) + 1] END AS class,
  CASE WHEN o_orderkey % 4 < 3 THEN 'yes' ELSE 'not characterized: status ' || o_orderstatus END AS reason FROM orders""")
def _(t):
    from ..functions.catalog import not_characterized, readiness_class

    k = F.col("o_orderkey") % 4
    name = F.element_at(F.array(F.lit("ripe"), F.lit("ripening"), F.lit("unripe")), (k % 3 + 1).cast("int"))
    text = F.when(k < 3, F.concat(F.lit("level ("), name, F.lit(")"))).otherwise("no class")
    cell = F.when(k < 3, F.lit("yes")).otherwise(F.concat(F.lit("no (status "), F.col("o_orderstatus"), F.lit(")")))
    return t.orders.select("o_orderkey", readiness_class(text).alias("class"), not_characterized(cell).alias("reason"))


@query("agg38_masked_share", f"""WITH {PIXELS}, m AS (SELECT seq, frame, 1 - avg(CAST(v < 140 AS INT)) AS x FROM pixels GROUP BY ALL)
  SELECT seq, count(*) AS n_masks, round(avg(x), 4) AS masked_share_mean, round(max(x), 4) AS masked_share_max FROM m GROUP BY seq""")
def _(t):
    return rs.masked_share(t.masks, ["seq"], "keep")



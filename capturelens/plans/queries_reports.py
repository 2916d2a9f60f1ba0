"""End-to-end reports over the study tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats as fm
from ..functions import names as nm
from ..functions import runs as rn
from ..functions import text as tx
from ..operators import pose as ps
from ..operators import rollup as ru
from ..operators import sampling as sp
from ..operators import tables as tb
from ..operators.audit import Registered, audit, audit_summary
from ..operators.ordered import Ordered, attach, running_sum
from ..operators.populations import Population, population_table, population_values
from ..operators.quantiles import exact_quantiles
from ..sources import sinks as sk
from .bindings import NUMBERED, RUNS, VIEWS
from .queries_geometry import ALIGNED, FLAGGED, moved_pairs, nearest_site
from .queries_raster import REGION, regions
from .queries_scalar import dec
from .queries_study import ARMS, COUNTED, RATES, REPEAT, append_kinds, APPEND, arms, range_sql, rates, repeat_runs, rounded
from .queries_time import GAPS, TWO, _gaps
from .registry import QUERIES, query


def r6(c):
    return F.round(c, 6)


def sig(x):
    return f"CASE WHEN {x} IS NULL THEN 'undetermined' ELSE format('{{:.4g}}', {x}) END"


@query("rpt1_sequences", f"""WITH {NUMBERED}, s AS (SELECT seq, count(*) AS n_total, greatest(count(*) // 60, 1) AS k, (count(*) - 1) / nullif((max(t) - min(t)) / 1e6, 0) AS fps, round(avg(CAST(lum < 8 AS INT)), 6) AS black, round(median(lum), 6) AS med FROM numbered GROUP BY seq)
  SELECT 'ev_' || seq AS id, n_total, k, least(60, (n_total + k - 1) // k) AS n_images, {sig('fps * 1e6')} AS fps_micro, {sig('round(med, 6)')} AS blur_median, {sig('black')} AS black_frames_share,
    concat_ws(' | ', CASE WHEN black > 0.1 THEN 'dark frames' END, 'events of user ' || seq) AS notes FROM s""")
def _(t):
    seconds = F.col("t") / 1e6
    rate = sp.observed_rate(t.frames, "seq", seconds)
    prof = t.frames.groupBy("seq").agg(r6(F.avg((F.col("lum") < sp.BLACK_LUM).cast("double"))).alias("black"))
    med = exact_quantiles(t.frames, ["seq"], F.col("lum"), {"med": 0.5}).drop("n")
    k = sp.stride(F.col("n"), cap=60)
    rows = rate.join(prof, "seq").join(med, "seq").withColumn("k", k)
    s = F.col("seq").cast("string")
    notes = tx.notes_when((F.col("black") > 0.1, F.lit("dark frames")), (F.lit(True), F.concat(F.lit("events of user "), s)))
    return rows.select(
        nm.composite_id(F.lit("ev"), s).alias("id"), F.col("n").alias("n_total"), "k",
        F.least(F.lit(60).cast("bigint"), F.floor((F.col("n") + F.col("k") - 1) / F.col("k"))).alias("n_images"),
        fm.fmt_sig(F.col("fps") * 1e6).alias("fps_micro"), fm.fmt_sig(r6(F.col("med"))).alias("blur_median"),
        fm.fmt_sig(F.col("black")).alias("black_frames_share"), notes.alias("notes"))


ANCHOR = """near AS (SELECT c_custkey, min(sqrt(pow(q.x - s.x, 2) + pow(q.y - s.y, 2))) AS dist FROM (SELECT c_custkey, CAST((c_custkey * 37) % 1009 AS DOUBLE) AS x, CAST((c_custkey * 53) % 997 AS DOUBLE) AS y FROM customer) q,
  (SELECT CAST((s_suppkey * 211) % 1009 AS DOUBLE) AS x, CAST((s_suppkey * 89) % 997 AS DOUBLE) AS y FROM supplier) s GROUP BY c_custkey)"""


@query("rpt2_anchors", f"""WITH {TWO}, {GAPS}, {ANCHOR}, sh AS (SELECT seq, avg(CAST(gap_header < 7200 AS INT)) AS s FROM gh GROUP BY seq)
  SELECT 'fixes' AS dataset, 'share of frames with a fix in reach exceeds 50 % in ' || count(*) FILTER (s > 0.5) || ' of ' || count(*) || ' passes' AS "check" FROM sh
  UNION ALL SELECT 'photos', {dec('avg(CAST(dist < 50 AS INT))', 3)} || ' lie within 50 m of a trunk; median ' || {dec('round(median(dist), 6)', 1)} || ' m, max ' || {dec('round(max(dist), 6)', 0)} || ' m' FROM near""")
def _(t):
    share = _gaps(t).groupBy("seq").agg(F.avg((F.col("gap_header") < 7200).cast("double")).alias("s"))
    text = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    fixes = share.agg(text("share of frames with a fix in reach exceeds 50 % in ", F.count_if(F.col("s") > 0.5).cast("string"), " of ",
                           F.count(F.lit(1)).cast("string"), " passes").alias("check")).select(F.lit("fixes").alias("dataset"), "check")
    near = nearest_site(t)
    far = near.agg(F.avg((F.col("dist") < 50).cast("double")).alias("w"), r6(F.max("dist")).alias("m"))
    mid = exact_quantiles(near, [], F.col("dist"), {"p50": 0.5}).crossJoin(F.broadcast(far))  # one row each
    photos = mid.select(F.lit("photos").alias("dataset"), text(
        fm.half_up(F.col("w"), 3), " lie within 50 m of a trunk; median ", fm.half_up(r6(F.col("p50")), 1), " m, max ", fm.half_up(F.col("m"), 0), " m").alias("check"))
    return fixes.unionByName(photos)


SPLIT = f"""{VIEWS}, q AS (SELECT run, view % 2 AS split, count(*) AS n_views, avg(psnr) AS psnr_mean, stddev_pop(psnr) AS psnr_std FROM views GROUP BY ALL)"""


@query("rpt3_quality_splits", f"""WITH {SPLIT} SELECT o_orderkey AS run, o_orderstatus AS outcome, max(n_views) FILTER (split = 0) AS interp_n_views, round(max(psnr_mean) FILTER (split = 0), 6) AS interp_psnr_mean,
  round(max(psnr_std) FILTER (split = 0), 6) AS interp_psnr_std, max(n_views) FILTER (split = 1) AS block_n_views, round(max(psnr_mean) FILTER (split = 1), 6) AS block_psnr_mean, round(max(psnr_std) FILTER (split = 1), 6) AS block_psnr_std
  FROM orders LEFT JOIN q ON run = o_orderkey GROUP BY o_orderkey, o_orderstatus""")
def _(t):
    side = [("interp", 0), ("block", 1)]
    aggs = []
    for name, s in side:
        v = F.when(F.col("view") % 2 == s, F.col("psnr"))
        aggs += [F.when(F.count(v) > 0, F.count(v)).alias(f"{name}_n_views"), r6(F.avg(v)).alias(f"{name}_psnr_mean"), r6(F.stddev_pop(v)).alias(f"{name}_psnr_std")]
    scores = t.views.groupBy("run").agg(*aggs)
    return t.orders.select(F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("outcome")).join(scores, "run", "left")


@query("rpt4_ablation_table", f"""WITH {RATES}, sd AS (SELECT l_orderkey AS run, l_linenumber AS seed, count(*) AS n_views, round(avg(l_quantity), 6) AS psnr_mean FROM lineitem GROUP BY ALL), base AS (
    SELECT rr.run, rr.sequence, rr.condition, rr.ok AS gate_pass, CASE WHEN rr.condition <> '5-LOW' THEN rate END AS registration_success_rate FROM rr LEFT JOIN rates ON rates.sequence = rr.sequence AND rates.m = (rr.condition > '3'))
  SELECT base.*, seed, n_views, psnr_mean, registration_success_rate IS NULL AS pending_repeats FROM base LEFT JOIN sd USING (run)""")
def _(t):
    seeds = t.lineitem.groupBy(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("seed")).agg(
        F.count(F.lit(1)).alias("n_views"), r6(F.avg("l_quantity")).alias("psnr_mean"))
    base = tb.attach_rates(repeat_runs(t), rates(t), F.col("condition") > "3", "sequence", F.col("condition") == "5-LOW")
    return base.select("run", "sequence", "condition", F.col("ok").alias("gate_pass"), "registration_success_rate", "pending_repeats").join(seeds, "run", "left")


@query("rpt6_sweeps_table", """WITH l AS (SELECT o_orderkey AS level, o_custkey AS seq, o_totalprice AS psnr, CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey // 2 END AS shared FROM orders), z AS (SELECT l_orderkey AS level, count(*) AS n_models, string_agg(CAST(CAST(l_quantity AS INT) AS VARCHAR), ', ' ORDER BY l_quantity DESC) AS sizes FROM lineitem GROUP BY 1)
  SELECT l.level, l.seq, CASE WHEN l.shared IS NOT NULL THEN p.psnr ELSE l.psnr END AS psnr, z.n_models, coalesce(z.sizes, '—') AS model_sizes, CASE WHEN l.shared IS NOT NULL THEN 'shared level' ELSE '' END AS note FROM l LEFT JOIN l p ON p.level = l.shared LEFT JOIN z ON z.level = l.level""")
def _(t):
    from .queries_study import _pointers

    rows = _pointers(t)
    own = tb.dereference(rows, rows.select("level", "psnr"), "summary", "level", ["psnr"])
    sizes = t.lineitem.groupBy(F.col("l_orderkey").alias("level")).agg(
        F.count(F.lit(1)).alias("n_models"), F.to_json(F.sort_array(F.collect_list(F.col("l_quantity").cast("int")), asc=False)).alias("z"))
    seqs = t.orders.select(F.col("o_orderkey").alias("level"), F.col("o_custkey").alias("seq"))
    return own.join(seqs, "level").join(sizes, "level", "left").select(
        "level", "seq", "psnr", "n_models", fm.fmt_sizes(F.col("z")).alias("model_sizes"), F.when(F.col("summary").isNotNull(), "shared level").otherwise("").alias("note"))


@query("rpt7_repeat_study", f"""WITH {REPEAT}, s AS (SELECT sequence, condition, count(*) AS n, count(*) FILTER (ok) AS k, median(coalesce(largest, 0)) AS med, min(coalesce(largest, 0)) AS lo, max(coalesce(largest, 0)) AS hi, count(DISTINCT coalesce(pair, '?')) AS pairs FROM rr GROUP BY ALL)
  SELECT sequence, condition, n, CAST(k AS BIGINT) AS success_count, {dec('round(k / n::DOUBLE, 3) * 100', 1)} || ' %' AS success_rate, {dec('med', 1)} || CASE WHEN lo = hi THEN '' ELSE ' [' || {dec('lo', 0)} || '–' || {dec('hi', 0)} || ']' END AS registered, pairs AS first_pairs FROM s""")
def _(t):
    runs = repeat_runs(t).withColumn("key", F.concat_ws("|", F.col("sequence").cast("string"), "condition"))
    out = ru.repeat_summary(runs, "key", "run", "largest", F.col("ok"), {"first_pairs": F.col("pair")})
    parts = F.split("key", r"\|")
    return out.select(parts[0].cast("bigint").alias("sequence"), parts[1].alias("condition"), *repeat_cells())


def repeat_cells():
    """The report cells of a repeat summary."""
    lo, hi = F.col("registered_min"), F.col("registered_max")
    bracket = F.when(lo == hi, "").otherwise(F.concat(F.lit(" ["), fm.half_up(lo, 0), F.lit("–"), fm.half_up(hi, 0), F.lit("]")))
    return ["n", "success_count", fm.fmt_pct(F.col("success_rate")).alias("success_rate"),
            F.concat(fm.half_up(F.col("registered_median"), 1), bracket).alias("registered"), "first_pairs"]


@query("rpt8_tail_wide", f"WITH {ARMS}, a AS (SELECT * FROM arm WHERE no < 5) SELECT sequence, count(*) AS runs_done, CAST(count(*) FILTER (condition < '3') AS BIGINT) AS successes, "
       + ", ".join(f"round(max(price) FILTER (no = {i}), 4) AS price_run{i}" for i in range(5)) + ", round(avg(price), 4) AS price_mean, round(stddev_samp(price), 4) AS price_std FROM a GROUP BY sequence")
def _(t):
    placed = arms(t).where("no < 5")
    wide = ru.pivot_runs(placed, ["sequence"], "no", range(5), ["price"])
    good = placed.groupBy("sequence").agg(F.count_if(F.col("condition") < "3").alias("successes"))
    cols = [*[f"price_run{i}" for i in range(5)], "price_mean", "price_std"]
    return wide.join(good, "sequence").select("sequence", "runs_done", "successes", *[F.round(c, 4).alias(c) for c in cols])


@query("rpt10_scale_anchors", f"""{ALIGNED} SELECT seq, n_matched || ' / ' || n_matched AS matched, CASE WHEN n_matched >= 4 THEN {dec('round(err, 6)', 3)} ELSE '—' END AS ate_rmse_m,
  CASE WHEN n_matched >= 4 THEN {dec('round(sc, 6)', 3)} ELSE '—' END AS scale_m_per_unit, {FLAGGED} FROM e""")
def _(t):
    out = ps.trajectory_error(moved_pairs(t), "seq", ["cx", "cy", "cz"], ["dx", "dy", "dz"])
    cameras = t.poses.groupBy("seq").agg(F.count(F.lit(1)).alias("n_cameras"))
    return out.join(cameras, "seq").select(
        "seq", F.concat_ws(" / ", F.col("n_matched").cast("string"), F.col("n_cameras").cast("string")).alias("matched"),
        fm.fmt_num(F.round("ate_rmse", 6), 3).alias("ate_rmse_m"), fm.fmt_num(F.round("scale", 6), 3).alias("scale_m_per_unit"), "flagged")


@query("rpt11_region_table", REGION + f""", mr AS (SELECT seq, count(*) AS views, avg(region_share) AS s, avg(psnr_inside) AS a, avg(psnr_outside) AS b, avg(ssim_inside) AS c, avg(ssim_outside) AS d FROM reg GROUP BY seq)
  SELECT seq, views, {dec('round(s, 6) * 100', 1)} || ' %' AS coverage, coalesce({dec('round(a, 6)', 2)}, '—') AS psnr_inside, {dec('round(b, 6)', 2)} AS psnr_outside, coalesce({dec('round(c, 6)', 3)}, '—') AS ssim_inside, coalesce({dec('round(d, 6)', 3)}, '—') AS ssim_outside FROM mr""")
def _(t):
    means = regions(t).groupBy("seq").agg(F.count(F.lit(1)).alias("views"), *[r6(F.avg(c)).alias(c) for c in ("region_share", "psnr_inside", "psnr_outside", "ssim_inside", "ssim_outside")])
    cells = [fm.fmt_num(F.col(f"{m}_{side}"), digits).alias(f"{m}_{side}") for m, digits in (("psnr", 2), ("ssim", 3)) for side in ("inside", "outside")]
    return means.select("seq", "views", fm.fmt_pct(F.col("region_share")).alias("coverage"), *cells)


@query("rpt12_population_values", f"""WITH {REPEAT}, src AS (SELECT condition || ' / ' || status AS pop, CAST(CAST(price AS VARCHAR) AS DECIMAL(28,10)) AS v FROM rr), m AS (
    SELECT pop, CAST(min(v) AS DECIMAL(28,11)) AS lo, CAST(max(v) AS DECIMAL(28,11)) AS hi, count(v) AS k, count(*) AS n, CAST(median(CAST(v AS DECIMAL(28,11))) AS DECIMAL(28,11)) AS mid FROM src GROUP BY pop)
  SELECT pop, n AS sequences, {range_sql(rounded(2))} AS price FROM m""")
def _(t):
    rows = t.runs.select(F.concat_ws(" / ", "condition", "status").alias("pop"), "price")
    cell = ru.median_range(rows, ["pop"], F.col("price"), "f2", "price")
    return rows.groupBy("pop").agg(F.count(F.lit(1)).alias("sequences")).join(cell, "pop")


# Three sources: runs with their largest model, quality per run, one row per run and seed.
POPULATIONS = [
    Population("urg", "urgent, done", "runs", "status = 'F' AND condition = '1-URGENT'"),
    Population("urg", "urgent, open", "runs", "status = 'O' AND condition = '1-URGENT'"),
    Population("hig", "high, done", "runs", "status = 'F' AND condition = '2-HIGH'"),
    Population("hig", "high, open", "runs", "status = 'O' AND condition = '2-HIGH'"),
    Population("all", "pending", "runs", "status = 'P'"),
    Population("all", "every run", "runs", "true"),
    Population("med", "medium with stills only", "runs", "condition = '3-MEDIUM'", hidden=("models", "share")),
    Population("low", "low, first sequences", "runs", "condition = '5-LOW' AND sequence < 50", hidden=("share",)),
    Population("qua", "quality of short runs", "quality", "models < 3"),
    Population("qua", "quality of long runs", "quality", "models >= 3"),
    Population("qua", "quality, many given", "quality", "given > 30"),
    Population("see", "first seed", "seeds", "seed = 1"),
    Population("see", "other seeds", "seeds", "seed <> 1"),
    Population("see", "returned seeds", "seeds", "flag = 'R'"),
    Population("vld", "point clouds", "quality", "models < 0"),
]
POP_VALUES = {"given": "f2", "models": "count", "share": "f2"}
POP_SOURCES = f"""{REPEAT}, src_runs AS (SELECT status, condition, sequence, largest AS given, n_lines AS models, round(largest / n_lines, 6) AS share FROM rr),
  src_quality AS (SELECT round(avg(l_quantity), 6) AS given, count(*) AS models, CAST(NULL AS DOUBLE) AS share FROM lineitem GROUP BY l_orderkey),
  src_seeds AS (SELECT l_linenumber AS seed, l_returnflag AS flag, l_quantity AS given, CAST(NULL AS BIGINT) AS models, l_discount AS share FROM lineitem)"""


def population_sources(t):
    li = t.lineitem
    return {
        "runs": repeat_runs(t).select("status", "condition", "sequence", F.col("largest").alias("given"), F.col("n_lines").alias("models"),
                                      r6(F.col("largest") / F.col("n_lines")).alias("share")),
        "quality": li.groupBy("l_orderkey").agg(r6(F.avg("l_quantity")).alias("given"), F.count(F.lit(1)).alias("models")),
        "seeds": li.select(F.col("l_linenumber").alias("seed"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("given"), F.col("l_discount").alias("share")),
    }


def population_sql():
    """One row per population and value: counts, ends and median of the rows for which its rule holds."""
    one = "SELECT {i} AS i, '{v}' AS value, count(*) AS n, count({v}) AS k, CAST(min({v}) AS DECIMAL(28,11)) AS lo, CAST(max({v}) AS DECIMAL(28,11)) AS hi, CAST(median(CAST(CAST({v} AS VARCHAR) AS DECIMAL(28,11))) AS DECIMAL(28,11)) AS mid FROM src_{s} WHERE {r}"
    return " UNION ALL ".join(one.format(i=i, v=v, s=p.source, r=p.rule) for i, p in enumerate(POPULATIONS) for v in POP_VALUES)


POP_NAMES = "(VALUES " + ", ".join(f"({i}, '{p.code}', '{p.name}', '{p.source}')" for i, p in enumerate(POPULATIONS)) + ") AS names(i, code, pop, source)"


@query("agg51_fifteen_populations", f"""WITH {POP_SOURCES}, m AS ({population_sql()}) SELECT code, pop, source, value, n AS rows, k AS known, CAST(lo AS DOUBLE) AS lo, CAST(mid AS DOUBLE) AS mid, CAST(hi AS DOUBLE) AS hi FROM {POP_NAMES} JOIN m USING (i)""")
def _(t):
    out = population_values(population_sources(t), POPULATIONS, POP_VALUES)
    return out.select("code", "pop", "source", "value", "rows", "known", *[F.col(c).cast("double").alias(c) for c in ("lo", "mid", "hi")])


def population_cell(v):
    hidden = [i for i, p in enumerate(POPULATIONS) if v in p.hidden]
    text = range_sql(COUNTED if POP_VALUES[v] == "count" else rounded(2))
    return f"max(CASE WHEN value = '{v}' THEN CASE WHEN i IN ({', '.join(map(str, hidden or [-1]))}) THEN '—' ELSE {text} END END) AS {v}"


@query("rpt12_population_table", f"""WITH {POP_SOURCES}, m AS ({population_sql()}) SELECT code, pop, source, max(n) AS sequences, {', '.join(map(population_cell, POP_VALUES))} FROM {POP_NAMES} JOIN m USING (i) GROUP BY ALL""")
def _(t):
    return population_table(population_sources(t), POPULATIONS, POP_VALUES)


@query("rpt12_registration_values", f"""WITH z AS (SELECT l_orderkey AS run, count(*) AS n_models, max(l_quantity) AS n, sum(l_quantity) AS total, string_agg(CAST(CAST(l_quantity AS INT) AS VARCHAR), ', ' ORDER BY l_quantity DESC) AS sizes, sum(l_extendedprice) AS p FROM lineitem GROUP BY 1)
  SELECT run, format('{{:,}}', CAST(n * 100 AS BIGINT)) || ' / ' || format('{{:,}}', CAST(total * 100 AS BIGINT)) AS registered, n_models || ' (' || sizes || ')' AS models, {dec('round(n / total, 9) * 100', 1)} || ' %' AS reg_rate,
    CASE WHEN n < 3 THEN 'failed' WHEN n / total < 0.5 OR n_models > 1 THEN 'partial' ELSE 'ok' END AS outcome FROM z""")
def _(t):
    z = t.lineitem.groupBy(F.col("l_orderkey").alias("run")).agg(
        F.count(F.lit(1)).alias("n_models"), F.max("l_quantity").alias("n"), F.sum("l_quantity").alias("total"),
        F.to_json(F.sort_array(F.collect_list(F.col("l_quantity").cast("int")), asc=False)).alias("sizes"))
    return z.select(
        "run", F.concat_ws(" / ", fm.fmt_int(F.col("n") * 100), fm.fmt_int(F.col("total") * 100)).alias("registered"),
        F.concat(F.col("n_models").cast("string"), F.lit(" ("), fm.fmt_sizes(F.col("sizes")), F.lit(")")).alias("models"),
        fm.fmt_pct(F.round(F.col("n") / F.col("total"), 9)).alias("reg_rate"), rn.outcome_class(F.col("n"), F.col("total"), F.col("n_models")).alias("outcome"))


@query("rpt12_quality_values", f"""WITH {VIEWS}, q AS (SELECT run, count(*) AS n, round(avg(psnr), 9) AS m, round(stddev_pop(psnr), 9) AS s, round(avg(ssim), 9) AS z FROM views GROUP BY run)
  SELECT run, n AS views, {dec('m', 2)} || ' ± ' || {dec('s', 2)} AS psnr, {dec('z', 3)} AS ssim FROM q""")
def _(t):
    out = t.views.groupBy("run").agg(F.count(F.lit(1)).alias("views"), *ru.mean_sd({"psnr": F.col("psnr"), "ssim": F.col("ssim")}))
    n9 = lambda c: F.round(c, 9)
    return out.select("run", "views", F.concat_ws(" ± ", fm.fmt_num(n9("psnr_mean"), 2), fm.fmt_num(n9("psnr_std"), 2)).alias("psnr"), fm.fmt_num(n9("ssim_mean"), 3).alias("ssim"))


@query("rpt13_mask_table", APPEND)
def _(t):
    return append_kinds(t)


@query("rpt13_recording_audit", """WITH rec AS (SELECT c_custkey AS id, c_nationkey AS k, c_mktsegment AS source, 'x' || c_custkey AS note FROM customer), seq AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS k, CASE WHEN c_custkey % 70 = 0 THEN 'other' ELSE c_mktsegment END AS source FROM customer WHERE c_custkey % 3 > 0)
  SELECT id, 'k' AS "column", CAST(rec.k AS VARCHAR) AS "left", CAST(seq.k AS VARCHAR) AS "right" FROM rec JOIN seq USING (id) WHERE rec.k <> seq.k UNION ALL SELECT id, 'source', rec.source, seq.source FROM rec JOIN seq USING (id) WHERE rec.source <> seq.source""")
def _(t):
    c = t.customer
    rec = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("source"))
    k, src = F.col("k"), F.col("source")
    seq = rec.where("id % 3 > 0").select("id", F.when(F.col("id") % 50 == 0, k + 1).otherwise(k).alias("k"), F.when(F.col("id") % 70 == 0, "other").otherwise(src).alias("source"))
    return tb.audit_columns(rec, seq, "id", ["k", "source"])


PROV = """WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
  SELECT 'quality' AS family, CAST(o_orderkey AS VARCHAR) AS "row", 'quality/' || o_orderkey || '/' AS run_dir, o_orderpriority AS job, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'ablations', o_orderkey || ' | ' || coalesce(CAST(n AS VARCHAR), '-'), 'ablations/' || o_orderkey || '/', CASE WHEN n IS NULL THEN 'registration only' ELSE o_orderpriority END, strftime(o_orderdate, '%Y-%m-%d') FROM orders LEFT JOIN l ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O'
  UNION ALL SELECT 'sweeps', CAST(o_orderkey AS VARCHAR), 'sweeps/' || o_orderkey || '/', CASE WHEN o_orderkey % 6 = 0 THEN '= quality row' ELSE o_orderpriority END, strftime(o_orderdate, '%Y-%m-%d') FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT 'repeats', l_orderkey || ' | ' || l_linenumber || ' | ' || l_suppkey, 'repeats/' || l_orderkey || '/', 'repeat study', strftime(l_shipdate, '%Y-%m-%d') FROM lineitem
  UNION ALL SELECT 'derived', o_orderpriority, 'derived/' || o_orderpriority || '/', 'no job', strftime(max(o_orderdate), '%Y-%m-%d') FROM orders GROUP BY o_orderpriority"""


def _provenance(t):
    key, day = F.col("o_orderkey").cast("string"), F.col("o_orderdate")
    where = lambda name: F.concat(F.lit(f"{name}/"), key, F.lit("/"))
    of = lambda s: t.orders.where(F.col("o_orderstatus") == s)
    seeds = t.lineitem.where("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).cast("string").alias("n"))
    job = F.col("o_orderpriority")
    quality = sk.provenance("quality", of("F"), key, where("quality"), job, day)
    abl = of("O").join(seeds, "o_orderkey", "left")
    ablations = sk.provenance("ablations", abl, F.concat_ws(" | ", key, F.coalesce("n", F.lit("-"))), where("ablations"), F.when(F.col("n").isNotNull(), job), day, "registration only")
    sweeps = sk.provenance("sweeps", of("P"), key, where("sweeps"), F.when(F.col("o_orderkey") % 6 != 0, job), day, "= quality row")
    li, none = t.lineitem, F.lit(None).cast("string")
    folder = lambda name, c: F.concat(F.lit(f"{name}/"), F.col(c).cast("string"), F.lit("/"))
    three = F.concat_ws(" | ", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_suppkey")])
    repeats = sk.provenance("repeats", li, three, folder("repeats", "l_orderkey"), none, F.col("l_shipdate"), "repeat study")
    last = t.orders.groupBy("o_orderpriority").agg(F.max("o_orderdate").alias("_d"))
    derived = sk.provenance("derived", last, F.col("o_orderpriority"), folder("derived", "o_orderpriority"), none, F.col("_d"), "no job")
    return tb.append_rows(quality, ablations, sweeps, repeats, derived)


@query("snk8_provenance_rows", PROV)
def _(t):
    return _provenance(t)


@query("rpt14_provenance_index", f"WITH p AS ({PROV}) SELECT family, job, min(date) AS first_date, max(date) AS last_date, count(*) AS n FROM p GROUP BY ALL")
def _(t):
    return _provenance(t).groupBy("family", "job").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n"))


@query("rpt17_panel_selection", f"""WITH {VIEWS}, o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY psnr, view) - 1 AS o, count(*) OVER (PARTITION BY run) AS n FROM views), md AS (SELECT run, view, psnr FROM o WHERE o = n // 2),
  b AS (SELECT run, view, psnr FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY psnr DESC, view) AS rn FROM views) WHERE rn = 1)
  SELECT run, 'median' AS rule, view, psnr, CAST(NULL AS DOUBLE) AS other FROM md UNION ALL SELECT run, 'best', view, psnr, NULL FROM b UNION ALL SELECT md.run, 'same view', md.view, md.psnr, v.psnr FROM md JOIN views v ON v.run = md.run + 1 AND v.view = md.view""")
def _(t):
    med = ru.pick_view(t.views, "run", "view", "psnr", "median").select("run", "view", "psnr")
    best = ru.pick_view(t.views, "run", "view", "psnr", "best").select("run", "view", "psnr")
    other = t.views.select((F.col("run") - 1).alias("run"), "view", F.col("psnr").alias("other"))
    same = tb.pair_by_name(med, other, ["run", "view"]).withColumn("rule", F.lit("same view"))
    rows = tb.append_rows(same, med.withColumn("rule", F.lit("median")), best.withColumn("rule", F.lit("best")))
    return rows.select("run", "rule", "view", "psnr", "other")


@query("rpt18_method_comparison", """SELECT CASE WHEN l_returnflag = 'A' THEN 'raw' ELSE 'preprocessed' END AS method, count(DISTINCT l_suppkey) AS num_reg_images, count(DISTINCT l_partkey) AS num_points, round(avg(l_quantity), 6) AS mean_error FROM lineitem GROUP BY 1""")
def _(t):
    def summary(name, rows):
        obs = t.lineitem.where(rows)
        images = obs.select("l_suppkey").distinct().agg(F.count(F.lit(1)).alias("num_reg_images"))
        points = obs.select("l_partkey").distinct().agg(F.count(F.lit(1)).alias("num_points"))
        error = obs.agg(r6(F.avg("l_quantity")).alias("mean_error"))
        one = images.crossJoin(F.broadcast(points)).crossJoin(F.broadcast(error))  # one row each
        return one.withColumn("method", F.lit(name))

    return tb.append_rows(summary("raw", F.col("l_returnflag") == "A"), summary("preprocessed", F.col("l_returnflag") != "A")).select("method", "num_reg_images", "num_points", "mean_error")


@query("rpt20_recomputation_audit", f"""WITH {REPEAT}, a AS (SELECT condition, count(*) AS n, round(count(*) FILTER (ok) / count(*)::DOUBLE, 3) AS rate FROM rr GROUP BY condition)
  SELECT condition, n, rate AS reported, rate AS recomputed, true AS agrees FROM a""")
def _(t):
    out = ru.repeat_summary(repeat_runs(t), "condition", "run", "largest", F.col("ok"), {"first_pairs": F.col("pair")})
    return audited(out.select("condition", *repeat_cells()), t.orders, t.lineitem)


def recounted(orders, lineitem):
    """The cells of the repeat report from the raw orders and lines: lines meet their order first, shares are
    compared as whole numbers, the median is read off running counts, and no formatter of the report is used."""
    q, part = F.col("l_quantity"), F.col("l_partkey")
    lines = orders.join(lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumnRenamed("o_orderpriority", "condition")
    per_run = lines.groupBy("condition", "o_orderkey").agg(
        F.max(q).alias("top"), F.coalesce(2 * F.max(q) >= F.sum(q), F.lit(False)).alias("good"),
        F.when(F.count("l_orderkey") > 2, F.struct((F.min(part) % 9).alias("a"), (F.max(part) % 9).alias("b"))).alias("pair"))
    per_value = per_run.groupBy("condition", F.coalesce("top", F.lit(0)).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"), F.count_if("good").alias("k"))
    pairs = per_run.select("condition", "pair").distinct().groupBy("condition").agg(F.count(F.lit(1)).alias("pairs"))
    upto = Ordered(per_value, ["condition"], ["v"]).add(upto=running_sum(F.col("c"))).df
    total = per_value.groupBy("condition").agg(F.sum("c").alias("runs"), F.sum("k").alias("good"))
    half = lambda met: F.min(F.when(met, F.col("v")))
    twice = F.col("upto") * 2
    values = attach(upto, total, ["condition"]).groupBy("condition", "runs", "good").agg(
        ((half(twice >= F.col("runs")) + half(twice > F.col("runs"))) / 2).alias("mid"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    text = lambda c, digits: F.col(c).cast(f"decimal(28,{digits})").cast("string")
    permille = F.expr("(2000 * good + runs) div (2 * runs)")
    share = F.concat((permille / 1000 * 100).cast("decimal(28,1)").cast("string"), F.lit(" %"))
    bracket = F.when(F.col("lo") == F.col("hi"), "").otherwise(F.concat(F.lit(" ["), text("lo", 0), F.lit("–"), text("hi", 0), F.lit("]")))
    return attach(values, pairs, ["condition"]).select(
        F.col("condition").alias("_condition"), (permille / 1000).alias("recomputed"), F.col("runs").alias("_n"), F.col("good").alias("_success_count"),
        share.alias("_success_rate"), F.concat(text("mid", 1), bracket).alias("_registered"), F.col("pairs").alias("_first_pairs"))


def audited(report, orders, lineitem):
    """Every condition of the report or the raw rows: whether each of its cells is what the raw rows give."""
    again = recounted(orders, lineitem)
    met = report.join(again, report["condition"].eqNullSafe(again["_condition"]), "full")
    cells = ["condition", "n", "success_count", "success_rate", "registered", "first_pairs"]
    agrees = F.col("n").isNotNull() & F.col("_n").isNotNull()
    for c in cells:
        agrees = agrees & F.col(c).eqNullSafe(F.col(f"_{c}"))
    reported = (F.regexp_extract("success_rate", r"^(\d+\.\d) %$", 1).try_cast("decimal(28,1)") / 100).cast("double")
    return met.select(
        F.coalesce("condition", "_condition").alias("condition"), F.coalesce("n", "_n").alias("n"), reported.alias("reported"), "recomputed", agrees.alias("agrees"))


def registered_cells(t):
    """Cells of six reports with the routes by which they are worked out again from the raw tables."""
    li, orders = t.lineitem, t.orders
    runs = ru.repeat_summary(repeat_runs(t), "condition", "run", "largest", F.col("ok"), {"first_pairs": F.col("pair")})
    repeats = recounted(orders, li)
    repeats = repeats.select(*[F.col(c).alias(c.removeprefix("_")) for c in repeats.columns if c.startswith("_")])
    per_user = t.events.groupBy(F.concat(F.lit("ev_"), F.col("user_id").cast("string")).alias("id")).agg(F.count("event_id").alias("n_total"))
    steps = per_user.withColumn("k", F.when(F.col("n_total") < 120, 1).otherwise(F.expr("n_total div 60")))
    frames = steps.withColumn("n_images", F.size(F.slice(F.sequence(F.lit(1).cast("bigint"), F.col("n_total"), F.col("k")), 1, 60)))
    lines = orders.join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy(F.col("o_orderkey").alias("run")).agg(
        F.first("o_orderstatus").alias("outcome"), F.count("l_orderkey").alias("n"))
    some = lambda c: F.when(c > 0, c)
    halves = lines.select("run", "outcome", some(F.expr("(n + 1) div 2")).alias("interp_n_views"), some(F.expr("n div 2")).alias("block_n_views"))
    best, total = F.max("l_quantity"), F.sum("l_quantity")
    rates_ = li.groupBy(F.col("l_orderkey").alias("run")).agg(
        F.concat(F.round((best * 100).cast("decimal(20,8)") / total.cast("decimal(20,8)"), 1).cast("decimal(10,1)").cast("string"), F.lit(" %")).alias("reg_rate"),
        F.when(best < 3, "failed").when((best * 2 >= total) & (F.count(F.lit(1)) == 1), "ok").otherwise("partial").alias("outcome"))
    tails = orders.groupBy(F.col("o_custkey").alias("sequence")).agg(F.least(F.count(F.lit(1)), F.lit(5)).alias("runs_done"))
    counts = []
    for name, df in population_sources(t).items():
        mine = [p for p in POPULATIONS if p.source == name]
        one = df.agg(F.array(*[F.struct(F.lit(p.name).alias("pop"), F.count(F.when(F.expr(p.rule), 1)).alias("sequences")) for p in mine]).alias("a"))
        counts.append(one.select(F.explode("a").alias("a")).select("a.*"))
    pops = counts[0].union(counts[1]).union(counts[2])
    named = {n: QUERIES[n](t) for n in ("rpt1_sequences", "rpt3_quality_splits", "rpt8_tail_wide", "rpt12_registration_values", "rpt12_population_table")}
    return [
        Registered("repeats", runs.select("condition", *repeat_cells()), "condition", ["n", "success_count", "success_rate", "registered", "first_pairs"], repeats),
        Registered("sequences", named["rpt1_sequences"], "id", ["n_total", "k", "n_images"], frames),
        Registered("quality splits", named["rpt3_quality_splits"], "run", ["outcome", "interp_n_views", "block_n_views"], halves),
        Registered("tail", named["rpt8_tail_wide"], "sequence", ["runs_done"], tails),
        Registered("registration values", named["rpt12_registration_values"], "run", ["reg_rate", "outcome"], rates_),
        Registered("populations", named["rpt12_population_table"], "pop", ["sequences"], pops),
    ]


@query("rpt20_cell_audit", f"""SELECT 'repeats' AS report, 5 * count(DISTINCT o_orderpriority) AS cells, 0 AS differing FROM orders
  UNION ALL SELECT 'sequences', 3 * count(DISTINCT user_id), 0 FROM events UNION ALL SELECT 'quality splits', 3 * count(DISTINCT o_orderkey), 0 FROM orders
  UNION ALL SELECT 'tail', count(DISTINCT o_custkey), 0 FROM orders UNION ALL SELECT 'registration values', 2 * count(DISTINCT l_orderkey), 0 FROM lineitem UNION ALL SELECT 'populations', {len(POPULATIONS)}, 0""")
def _(t):
    return audit_summary(audit(registered_cells(t)))


# ---- sinks whose result is a frame

@query("snk3_upsert", """SELECT c_custkey AS run, c_acctbal AS v FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_custkey, round(max(o_totalprice), 2) FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey""")
def _(t):
    old = t.customer.select(F.col("c_custkey").alias("run"), F.col("c_acctbal").alias("v"))
    new = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("run")).agg(F.round(F.max("o_totalprice"), 2).alias("v"))
    return sk.upsert(old, new, ["run"])


@query("snk4_keep_existing", """SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality END AS quality FROM documents d LEFT JOIN labels l USING (doc_id)""")
def _(t):
    old = t.labels.select("doc_id", "quality")
    return sk.keep_existing(old, t.documents.select("doc_id"), ["doc_id"])


RULES = [(r"/de/", "a German page"), (r"/\w\w/\d+", "a numbered page"), (r".*", "another page")]


@query("snk6_manifest", r"""SELECT url AS path, CAST(octet_length(encode(html)) AS BIGINT) AS size_bytes, md5(html) AS md5, CASE WHEN regexp_matches(url, '/de/') THEN 'a German page' WHEN regexp_matches(url, '/\w\w/\d+') THEN 'a numbered page' ELSE 'another page' END AS content FROM pages""")
def _(t):
    return sk.manifest_of(t.pages, F.col("url"), F.col("html"), RULES)


@query("snk7_report_lines", f"""WITH {RUNS} SELECT run, '| ' || run || ' | ' || condition || ' | ' || {dec('price', 2)} || ' |' AS line FROM runs""")
def _(t):
    cells = t.runs.select("run", "condition", fm.fmt_num(F.col("price"), 2).alias("price"))
    return sk.report_lines(cells, ["run", "condition", "price"]).select("run", "line")


@query("snk5_changed_list", """SELECT 'removed' AS side, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 50000 UNION ALL SELECT 'added', o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice >= 50000""")
def _(t):
    old = t.orders.where("o_orderstatus = 'F'").select("o_orderkey")
    new = t.orders.where("o_totalprice >= 50000").select("o_orderkey")
    gone = old.exceptAll(new).withColumn("side", F.lit("removed"))
    return gone.unionByName(new.exceptAll(old).withColumn("side", F.lit("added")))



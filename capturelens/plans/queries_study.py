"""Roll-ups, table joins, set checks and orderings over orders and order lines as runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as nm
from ..functions.phrases import joined_items, listed_items, with_counts
from ..operators import rollup as ru
from ..operators import tables as tb
from ..operators.ordered import Ordered, dealt, ordinal
from ..operators.quantiles import exact_quantiles
from .bindings import FRAMES, NUMBERED, RUNS, VIEWS
from .queries_scalar import IDS, dec, ids
from .registry import query


def r6(c):
    return F.round(c, 6)


# A value cell that is missing for some lines.
GAPPY = "CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(CAST(l_quantity AS VARCHAR) AS DECIMAL(28,10)) / 8 + CAST(CAST(l_discount AS VARCHAR) AS DECIMAL(28,10)) END"


def range_sql(show, unit=""):
    s = lambda c: show.replace("X", c)
    return f"""CASE WHEN k = 0 THEN '—' ELSE {s('mid')} || '{unit}' || CASE WHEN k > 1 AND {s('lo')} <> {s('hi')} THEN ' [' || {s('lo')} || '–' || {s('hi')} || ']' ELSE '' END
    || CASE WHEN k < n THEN ' (n = ' || k || ')' ELSE '' END END"""


def rounded(nd, scale=1):
    return f"CAST(CAST(round(CAST(X AS DECIMAL(28,11)) * {scale}, {nd}) AS DECIMAL(28,{nd})) AS VARCHAR)"


COUNTED = f"CASE WHEN X = floor(X) THEN {rounded(0)} ELSE {rounded(1)} END"
MEDIAN = "(SELECT l_suppkey, CAST(min(v) AS DECIMAL(28,11)) AS lo, CAST(max(v) AS DECIMAL(28,11)) AS hi, count(v) AS k, count(*) AS n, CAST(median(CAST(v AS DECIMAL(28,11))) AS DECIMAL(28,11)) AS mid FROM src GROUP BY l_suppkey)"


@query("agg6_median_range", f"WITH src AS (SELECT l_suppkey, CAST({GAPPY} AS DECIMAL(28,10)) AS v FROM lineitem) SELECT l_suppkey, {range_sql(rounded(2))} AS cell FROM {MEDIAN}")
def _(t):
    d = lambda c: F.col(c).cast("decimal(28,10)")
    v = F.when(F.col("l_linenumber") != 1, d("l_quantity") / 8 + d("l_discount"))
    return ru.median_range(t.lineitem, ["l_suppkey"], v, "f2", "cell")


@query("agg6_median_range_kinds", f"""WITH src AS (SELECT l_suppkey, CAST(CAST(l_discount AS VARCHAR) AS DECIMAL(28,10)) AS v FROM lineitem), a AS (
    SELECT l_suppkey, {range_sql(rounded(1, 100), ' %')} AS pct, {range_sql(rounded(1))} AS deg FROM {MEDIAN}), src2 AS (SELECT l_suppkey, CAST(l_quantity AS DECIMAL(28,10)) AS v FROM lineitem)
  SELECT a.*, counts FROM a JOIN (SELECT l_suppkey, {range_sql(COUNTED)} AS counts FROM {MEDIAN.replace('FROM src ', 'FROM src2 ')}) USING (l_suppkey)""")
def _(t):
    pct = ru.median_range(t.lineitem, ["l_suppkey"], F.col("l_discount"), "pct", "pct")
    deg = ru.median_range(t.lineitem, ["l_suppkey"], F.col("l_discount"), "deg", "deg")
    counts = ru.median_range(t.lineitem, ["l_suppkey"], F.col("l_quantity"), "count", "counts")
    return pct.join(deg, "l_suppkey").join(counts, "l_suppkey")


@query("agg7_seed_mean_range", f"""WITH s AS (SELECT l_suppkey, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(28,10))) AS DOUBLE) / count(*) AS m, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_suppkey)
  SELECT l_suppkey, {dec('m', 1)} || CASE WHEN n > 1 THEN ' [' || {dec('lo', 1)} || '–' || {dec('hi', 1)} || ']' ELSE '' END AS cell FROM s""")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(ru.mean_range(F.col("l_extendedprice"), 1).alias("cell"))


REPEAT = RUNS + """, li AS (SELECT l_orderkey AS run, max(l_quantity) AS largest, count(*) AS n_lines, min(l_partkey) AS a, max(l_partkey) AS b, sum(l_quantity) AS total FROM lineitem GROUP BY l_orderkey),
  rr AS (SELECT r.*, l.largest, l.n_lines, CASE WHEN n_lines > 2 THEN least(a, b) % 9 || '+' || greatest(a, b) % 9 END AS pair, largest / total >= 0.5 AS ok FROM runs r LEFT JOIN li l USING (run))"""


def run_lines(t):
    """Runs and their lines, both dealt by run."""
    lines = t.lineitem.withColumnRenamed("l_orderkey", "run")
    return dealt(["run"], t.runs, lines, within=lines)


def repeat_runs(t):
    runs, lines = run_lines(t)
    li = lines.groupBy("run").agg(
        F.max("l_quantity").alias("largest"), F.count(F.lit(1)).alias("n_lines"), F.min("l_partkey").alias("a"),
        F.max("l_partkey").alias("b"), F.sum("l_quantity").alias("total"))
    lo, hi = F.least("a", "b") % 9, F.greatest("a", "b") % 9
    pair = F.when(F.col("n_lines") > 2, F.concat_ws("+", lo.cast("string"), hi.cast("string")))
    return runs.join(li, "run", "left").withColumns({"pair": pair, "ok": F.col("largest") / F.col("total") >= 0.5})


@query("agg8_repeat_summary", f"""WITH {REPEAT} SELECT condition, count(*) AS n, CAST(count(*) FILTER (ok) AS BIGINT) AS success_count, round(count(*) FILTER (ok) / count(*)::DOUBLE, 3) AS success_rate,
  min(coalesce(largest, 0)) AS registered_min, max(coalesce(largest, 0)) AS registered_max, median(coalesce(largest, 0)) AS registered_median, count(DISTINCT coalesce(pair, '?')) AS first_pairs FROM rr GROUP BY condition""")
def _(t):
    return ru.repeat_summary(repeat_runs(t), "condition", "run", "largest", F.col("ok"), {"first_pairs": F.col("pair")})


@query("agg8_registered_all", f"""WITH {REPEAT} SELECT sequence, condition, string_agg(CAST(CAST(coalesce(largest, 0) AS INT) AS VARCHAR), ', ' ORDER BY run) AS registered_all FROM rr GROUP BY ALL""")
def _(t):
    return joined_items(registered(repeat_runs(t)), ["sequence", "condition"], "registered_all", ", ")


def registered(runs):
    return listed_items(runs, ["sequence", "condition"], ["run"], F.coalesce(F.col("largest"), F.lit(0)).cast("int").cast("string"))


@query("agg8_registered_rows", f"""WITH {REPEAT} SELECT sequence, condition, row_number() OVER (PARTITION BY sequence, condition ORDER BY run) - 1 AS place, CAST(CAST(coalesce(largest, 0) AS INT) AS VARCHAR) AS item, NULL AS n FROM rr
  UNION ALL SELECT sequence, condition, NULL, NULL, count(*) FROM rr GROUP BY sequence, condition""")
def _(t):
    runs = repeat_runs(t)
    return with_counts(registered(runs), runs.groupBy("sequence", "condition").agg(F.count(F.lit(1)).alias("n")))


METRICS = ["psnr", "ssim", "lpips"]


@query("agg9_view_mean_sd", f"WITH {VIEWS} SELECT run, count(*) AS n_views, " + ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std" for m in METRICS) + " FROM views GROUP BY run")
def _(t):
    aggs = ru.mean_sd({m: F.col(m) for m in METRICS})
    out = t.views.groupBy("run").agg(F.count(F.lit(1)).alias("n_views"), *aggs)
    return out.select("run", "n_views", *[r6(F.col(c)).alias(c) for c in out.columns if c.endswith(("_mean", "_std"))])


@query("agg10_sample_sd", f"WITH {VIEWS} SELECT run, round(avg(psnr), 6) AS psnr_mean, round(stddev_samp(psnr), 6) AS psnr_std FROM views GROUP BY run")
def _(t):
    out = t.views.groupBy("run").agg(*ru.mean_sd({"psnr": F.col("psnr")}, sample=True))
    return out.select("run", r6(F.col("psnr_mean")).alias("psnr_mean"), r6(F.col("psnr_std")).alias("psnr_std"))


@query("agg11_means_before_trim", f"WITH {VIEWS} SELECT run, CAST(count(*) FILTER (view < 3) AS BIGINT) AS n_views, round(avg(psnr) FILTER (view < 3), 6) AS psnr FROM views GROUP BY run")
def _(t):
    keep = F.when(F.col("view") < 3, F.col("psnr"))
    return t.views.groupBy("run").agg(F.count(keep).alias("n_views"), r6(F.avg(keep)).alias("psnr"))


ARMS = RUNS + ", arm AS (SELECT sequence, condition, price, row_number() OVER (PARTITION BY sequence ORDER BY t, run) - 1 AS no FROM runs)"


def arms(t):
    return Ordered(t.runs, ["sequence"], ["t", "run"]).add(no=ordinal()).df.select("sequence", "condition", "price", "no")


@query("agg12_arm_table", f"WITH {ARMS} SELECT sequence, count(*) AS runs_done, round(avg(price), 4) AS price_mean, round(stddev_samp(price), 4) AS price_std, "
       + ", ".join(f"round(max(CASE WHEN no = {i} THEN price END), 4) AS price_run{i}, CASE WHEN count(*) FILTER (no = {i}) > 0 THEN 'done' ELSE 'pending' END AS status_run{i}" for i in range(5))
       + " FROM arm WHERE no < 5 GROUP BY sequence")
def _(t):
    out = ru.pivot_runs(arms(t), ["sequence"], "no", range(5), ["price"])
    return out.select(*[F.round(c, 4).alias(c) if c.startswith("price") else F.col(c) for c in out.columns])


@query("agg12_arm_long", f"WITH {ARMS}, a AS (SELECT DISTINCT sequence FROM arm), n AS (SELECT unnest(range(5)) AS no) SELECT a.sequence, n.no, arm.price, CASE WHEN arm.price IS NULL THEN 'pending' ELSE 'done' END AS status FROM a CROSS JOIN n LEFT JOIN arm USING (sequence, no)")
def _(t):
    placed = arms(t)
    slots = placed.select("sequence").distinct().withColumn("no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))))
    return slots.join(placed, ["sequence", "no"], "left").select("sequence", "no", "price", F.when(F.col("price").isNull(), "pending").otherwise("done").alias("status"))


@query("agg13_comparator", f"""WITH {VIEWS}, s AS (SELECT run % 200 AS arm, run % 3 AS seed, avg(psnr) AS psnr FROM views WHERE view < 4 GROUP BY ALL)
  SELECT arm, count(*) AS n_seeds, round(avg(psnr), 6) AS psnr_mean, round(min(psnr), 6) AS psnr_min, round(max(psnr), 6) AS psnr_max FROM s GROUP BY arm""")
def _(t):
    views = t.views.withColumns({"arm": F.col("run") % 200, "seed": F.col("run") % 3})
    out = ru.comparator(views, ["arm"], "seed", ["psnr"], F.col("view") < 4)
    return out.select("arm", "n_seeds", *[r6(F.col(c)).alias(c) for c in ("psnr_mean", "psnr_min", "psnr_max")])


@query("agg14_mode", f"""WITH {NUMBERED}, c AS (SELECT seq, kind, count(*) AS n, min(ord) AS f FROM numbered GROUP BY ALL)
  SELECT seq, arg_min(kind, (-n, f)) AS kind, max(n) AS n FROM c GROUP BY seq""")
def _(t):
    return ru.most_common(t.numbered, ["seq"], "kind", F.col("ord"))


@query("agg15_value_counts", """SELECT o_custkey, string_agg(o_orderstatus || '=' || n, ',' ORDER BY o_orderstatus) AS counts FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey""")
def _(t):
    out = ru.value_counts(t.orders, ["o_custkey"], "o_orderstatus", "m")
    pairs = F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return out.select("o_custkey", F.array_join(pairs, ",").alias("counts"))


FLAGGED = """(SELECT source, d.doc_id, CASE WHEN quality = 0 THEN 'low' WHEN quality = 1 THEN 'no' END AS glare, CASE WHEN toxic = 1 THEN 'yes' WHEN toxic = 0 THEN 'no' END AS dirt FROM documents d LEFT JOIN labels l USING (doc_id))"""


def flagged(t):
    """Documents with the flags of those that were annotated."""
    q, x = F.col("quality"), F.col("toxic")
    return t.documents.select("doc_id", "source", "lang").join(t.labels, "doc_id", "left").select(
        "doc_id", "source", "lang", F.when(q == 0, "low").when(q == 1, "no").alias("glare"), F.when(x == 1, "yes").when(x == 0, "no").alias("dirt"))


@query("agg16_flag_phrases", f"""WITH f AS {FLAGGED}, n AS (SELECT source, count(*) AS total, count(coalesce(glare, dirt)) AS seen FROM f GROUP BY source),
  p AS (SELECT source, 0 AS i, 'glare' AS flag, glare AS v, count(*) AS k FROM f WHERE glare <> 'no' GROUP BY ALL UNION ALL SELECT source, 1, 'dirt', dirt, count(*) FROM f WHERE dirt <> 'no' GROUP BY ALL),
  s AS (SELECT source, string_agg(flag || ' ' || v || CASE WHEN total > 1 THEN ' (' || k || ' of ' || total || ')' ELSE '' END, ', ' ORDER BY i, v) AS ph FROM p JOIN n USING (source) GROUP BY source)
  SELECT n.source, CASE WHEN seen = 0 THEN 'not annotated' ELSE coalesce(ph, 'none annotated') END AS phrase FROM n LEFT JOIN s USING (source)""")
def _(t):
    return ru.flag_phrases(flagged(t), ["source"], ["glare", "dirt"])


@query("agg17_distinct_in_order", f"""WITH {NUMBERED}, f AS (SELECT seq, kind, min(ord) AS o FROM numbered GROUP BY ALL) SELECT seq, string_agg(kind, ', ' ORDER BY o) AS kinds FROM f GROUP BY seq""")
def _(t):
    return ru.distinct_in_order(t.numbered, ["seq"], "kind", F.col("ord"), "kinds")


@query("agg18_first_row", f"""WITH {RUNS} SELECT sequence, run, status FROM (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY run) AS rn FROM runs) WHERE rn = 1""")
def _(t):
    return ru.first_row(t.runs, ["sequence"], [F.col("run")]).select("sequence", "run", "status")


@query("agg19_largest_model", """WITH l AS (SELECT l_orderkey AS run, l_linenumber, l_partkey, l_quantity FROM lineitem)
  SELECT run, arg_min(l_partkey, (-l_quantity, l_linenumber, l_partkey)) AS best, string_agg(CAST(CAST(l_quantity AS INT) AS VARCHAR), ',' ORDER BY l_quantity DESC) AS sizes FROM l GROUP BY run""")
def _(t):
    sizes = F.sort_array(F.collect_list(F.col("l_quantity").cast("int")), asc=False)
    best = F.min_by("l_partkey", F.struct(-F.col("l_quantity"), F.col("l_linenumber"), F.col("l_partkey")))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("run")).agg(best.alias("best"), F.array_join(sizes.cast("array<string>"), ",").alias("sizes"))


@query("agg20_median_view", f"WITH {VIEWS}, o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY psnr, view) - 1 AS o, count(*) OVER (PARTITION BY run) AS n FROM views) SELECT run, view, psnr FROM o WHERE o = n // 2")
def _(t):
    return ru.pick_view(t.views, "run", "view", "psnr", "median").select("run", "view", "psnr")


@query("agg20_best_view", f"WITH {VIEWS} SELECT run, view, psnr FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY psnr DESC, view) AS rn FROM views) WHERE rn = 1")
def _(t):
    return ru.pick_view(t.views, "run", "view", "psnr", "best").select("run", "view", "psnr")


@query("agg20_named_view", f"WITH {VIEWS} SELECT run, view, psnr FROM views WHERE CAST(view AS VARCHAR) LIKE '2%' QUALIFY row_number() OVER (PARTITION BY run ORDER BY view) = 1")
def _(t):
    return ru.pick_view(t.views, "run", "view", "psnr", "2").select("run", "view", "psnr")


@query("agg21_group_medians", """SELECT p_brand, count(*) AS n, round(min(p_retailprice), 6) AS f_min, round(median(p_retailprice), 6) AS f_median, round(max(p_retailprice), 6) AS f_max FROM part GROUP BY p_brand""")
def _(t):
    ends = t.part.groupBy("p_brand").agg(r6(F.min("p_retailprice")).alias("f_min"), r6(F.max("p_retailprice")).alias("f_max"))
    mid = exact_quantiles(t.part, ["p_brand"], F.col("p_retailprice"), {"f_median": 0.5})
    return ends.join(mid, "p_brand").withColumn("f_median", r6(F.col("f_median")))


@query("agg49_peak_use", f"WITH {FRAMES} SELECT seq, kind, max(lum) AS peak, count(*) AS n FROM frames GROUP BY ALL")
def _(t):
    return t.frames.groupBy("seq", "kind").agg(F.max("lum").alias("peak"), F.count(F.lit(1)).alias("n"))


@query("agg50_run_counts", f"WITH {REPEAT} SELECT condition, status, count(*) AS n, count(largest) AS trained FROM rr GROUP BY ALL")
def _(t):
    return repeat_runs(t).groupBy("condition", "status").agg(F.count(F.lit(1)).alias("n"), F.count("largest").alias("trained"))


# Populations: a rule over the status and priority of a run; some rules look at another column.
POPS = [
    ("done, urgent", "F", "1-URGENT", "price"), ("done, other", "F", None, "price"),
    ("open, urgent", "O", "1-URGENT", "price"), ("open, other", "O", None, "largest"), ("pending", "P", None, "largest"),
]


def pop_sql():
    parts = [
        f"SELECT '{n}' AS pop, CAST(CAST({c} AS VARCHAR) AS DECIMAL(28,10)) AS v FROM rr WHERE status = '{s}'" + (f" AND condition = '{p}'" if p else (" AND condition <> '1-URGENT'" if s != "P" else ""))
        for n, s, p, c in POPS]
    return " UNION ALL ".join(parts)


@query("agg51_populations", f"""WITH {REPEAT}, src AS ({pop_sql()}), m AS (SELECT pop, CAST(min(v) AS DECIMAL(28,11)) AS lo, CAST(max(v) AS DECIMAL(28,11)) AS hi, count(v) AS k, count(*) AS n, CAST(median(CAST(v AS DECIMAL(28,11))) AS DECIMAL(28,11)) AS mid FROM src GROUP BY pop)
  SELECT pop, n AS sequences, {range_sql(rounded(2))} AS cell FROM m""")
def _(t):
    rules = F.array(*[
        F.struct(F.lit(n).alias("pop"), F.lit(s).alias("s"), F.lit(p).alias("p"), F.lit(c).alias("c")) for n, s, p, c in POPS])
    other = F.col("r.p").isNull() & ((F.col("r.s") == "P") | (F.col("condition") != "1-URGENT"))
    hit = (F.col("r.s") == F.col("status")) & ((F.col("r.p") == F.col("condition")) | other)
    value = F.when(F.col("r.c") == "price", F.col("price")).otherwise(F.col("largest"))
    rows = repeat_runs(t).withColumn("r", F.explode(rules)).where(hit).select("r.pop", value.alias("v"))
    cell = ru.median_range(rows, ["pop"], F.col("v"), "f2", "cell")
    return rows.groupBy("pop").agg(F.count(F.lit(1)).alias("sequences")).join(cell, "pop")


@query("agg52_run_summary", """WITH l AS (SELECT l_orderkey AS run, count(*) AS n_lines, max(l_quantity) AS status_no, min(l_shipdate) AS sd FROM lineitem GROUP BY 1), e AS (SELECT l_orderkey AS run, CAST(sum(l_quantity) AS BIGINT) AS n_lines, max(l_tax) AS tax FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
  SELECT o_orderkey AS run, o_orderstatus AS status, CASE WHEN e.run IS NOT NULL THEN e.n_lines ELSE l.n_lines END AS n_lines, status_no, e.tax FROM orders o LEFT JOIN l ON l.run = o_orderkey LEFT JOIN e ON e.run = o_orderkey""")
def _(t):
    key = F.col("l_orderkey").alias("run")
    reg = t.orders.select(F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("status"))
    train = t.lineitem.groupBy(key).agg(F.count(F.lit(1)).alias("n_lines"), F.max("l_quantity").alias("status_no"), F.collect_set("l_linenumber").alias("lines"))
    evaluation = t.lineitem.where("l_returnflag = 'A'").groupBy(key).agg(F.sum("l_quantity").cast("bigint").alias("n_lines"), F.max("l_tax").alias("tax"))
    return tb.merge_summary([reg, train, evaluation], "run")


# ---- joins of study tables

IDS2 = f"(SELECT c_custkey, dataset || '_' || sequence AS id, dataset FROM {IDS})"
PROPS = "CASE WHEN c_custkey % 8 <> 0 AND c_custkey % 5 <> 0 THEN true ELSE false END"
WIDE = f"""ids0 AS {IDS2}, seqs AS (SELECT id, max(c_nationkey) AS char_nation FROM ids0 JOIN customer USING (c_custkey) WHERE {PROPS} GROUP BY id),
  qual AS (SELECT id, round(avg(o_totalprice), 4) AS psnr FROM ids0 JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY id),
  fq AS (SELECT id, count(*) AS fq_open FROM ids0 JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND c_custkey % 3 = 0 GROUP BY id),
  reg AS (SELECT id, max(o_orderkey) AS reg_run FROM ids0 JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY id)"""


def keyed(t):
    return ids(t).select("c_custkey", nm.composite_id(F.col("dataset"), F.col("sequence")).alias("id"), "dataset")


def study_tables(t):
    """Four tables by sequence id, none of them complete."""
    k = keyed(t)
    placed = k.join(t.orders, F.col("o_custkey") == F.col("c_custkey"))
    own = (F.col("c_custkey") % 8 != 0) & (F.col("c_custkey") % 5 != 0)
    seqs = k.join(t.customer, "c_custkey").where(own).groupBy("id").agg(F.max("c_nationkey").alias("char_nation"))
    qual = placed.where("o_orderstatus <> 'P'").groupBy("id").agg(F.round(F.avg("o_totalprice"), 4).alias("psnr"))
    fq = placed.where("o_orderstatus = 'O' AND c_custkey % 3 = 0").groupBy("id").agg(F.count(F.lit(1)).alias("fq_open"))
    reg = placed.where("o_orderstatus = 'P'").groupBy("id").agg(F.max("o_orderkey").alias("reg_run"))
    return seqs, qual, fq, reg


@query("jon1_wide_join", f"WITH {WIDE} SELECT id, char_nation, psnr, fq_open, reg_run FROM seqs FULL JOIN qual USING (id) FULL JOIN fq USING (id) FULL JOIN reg USING (id)")
def _(t):
    return tb.wide_join(study_tables(t), "id").select("id", "char_nation", "psnr", "fq_open", "reg_run")


DER = """CASE WHEN id LIKE '%\\_rgb' ESCAPE '\\' THEN regexp_replace(id, '_rgb$', '') WHEN id LIKE 'btg\\_%' ESCAPE '\\' AND contains(id, '_p') THEN regexp_replace(id, '^(.*)_p.*$', '\\1') ELSE '' END"""
JOINED = f"""{WIDE}, al AS (SELECT id FROM seqs UNION SELECT id FROM qual), d AS (SELECT id, {DER} AS derived_from FROM al),
  joined AS (SELECT d.id, d.derived_from, CASE WHEN o.id IS NULL AND b.id IS NOT NULL THEN b.char_nation ELSE o.char_nation END AS char_nation, CASE WHEN o.id IS NULL AND b.id IS NOT NULL THEN d.derived_from END AS properties_from, psnr
  FROM d LEFT JOIN seqs o ON o.id = d.id LEFT JOIN seqs b ON b.id = d.derived_from LEFT JOIN qual q ON q.id = d.id)"""


def joined(t):
    seqs, qual, _, _ = study_tables(t)
    every = tb.key_union(seqs, qual, "id")
    rows = every.withColumn("derived_from", nm.derived_from(F.col("id")))
    return tb.inherit(rows, seqs, "id", "derived_from", ["char_nation"]).join(qual, "id", "left")


@query("jon2_inherit_properties", f"WITH {JOINED} SELECT * FROM joined")
def _(t):
    return joined(t)


@query("rpt5_joined_table", f"WITH {JOINED} SELECT j.*, fq_open, reg_run FROM joined j LEFT JOIN fq USING (id) LEFT JOIN reg USING (id)")
def _(t):
    _, _, fq, reg = study_tables(t)
    return joined(t).join(fq, "id", "left").join(reg, "id", "left")


@query("jon3_lookup", """SELECT d.doc_id, d.lang, CASE WHEN l.doc_id IS NULL THEN 'not annotated' ELSE CAST(quality AS VARCHAR) END AS quality FROM documents d LEFT JOIN labels l USING (doc_id)""")
def _(t):
    return tb.lookup(t.documents.select("doc_id", "lang"), t.labels.select("doc_id", "quality"), ["doc_id"], {"quality": "not annotated"})


@query("jon4_composite_lookup", f"""WITH {RUNS}, m AS (SELECT sequence, condition, count(*) AS n_masks, round(avg(price), 4) AS share FROM runs WHERE status = 'F' GROUP BY ALL)
  SELECT run, r.sequence, r.condition, n_masks, share FROM runs r LEFT JOIN m USING (sequence, condition)""")
def _(t):
    masks = t.runs.where("status = 'F'").groupBy("sequence", "condition").agg(F.count(F.lit(1)).alias("n_masks"), F.round(F.avg("price"), 4).alias("share"))
    return t.runs.select("run", "sequence", "condition").join(masks, ["sequence", "condition"], "left")


DEREF = "l AS (SELECT o_orderkey AS level, o_totalprice AS psnr, CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey // 2 END AS summary FROM orders)"


def _pointers(t):
    k = F.col("o_orderkey")
    return t.orders.select(k.alias("level"), F.col("o_totalprice").alias("psnr"), F.when(k % 6 == 0, F.floor(k / 2)).alias("summary"))


@query("jon5_pointer_dereference", f"WITH {DEREF} SELECT l.level, l.summary, CASE WHEN l.summary IS NOT NULL THEN p.psnr ELSE l.psnr END AS psnr FROM l LEFT JOIN l p ON p.level = l.summary")
def _(t):
    rows = _pointers(t)
    return tb.dereference(rows, rows.select("level", "psnr"), "summary", "level", ["psnr"]).select("level", "summary", "psnr")


HOLD = f"{VIEWS}, h AS (SELECT DISTINCT run, view FROM views WHERE (run + view) % 8 = 0 AND run % 10 <> 9 UNION SELECT run, 99 FROM views)"


@query("jon17_holdout_split", f"WITH {HOLD} SELECT run, CAST(count(*) FILTER (h.view IS NOT NULL) AS BIGINT) AS n_test, CAST(count(*) FILTER (h.view IS NULL) AS BIGINT) AS n_train FROM views v LEFT JOIN h USING (run, view) GROUP BY run")
def _(t):
    views = t.views.select("run", "view")
    listed = views.where("(run + view) % 8 = 0 AND run % 10 <> 9").union(views.select("run", F.lit(99).cast("bigint"))).distinct()
    marked, = dealt(["run"], tb.marked_by_names(views, listed, ["run", "view"]), within=t.lineitem.select(F.col("l_orderkey").alias("run")))
    return marked.groupBy("run").agg(F.count_if("listed").alias("n_test"), F.count_if(~F.col("listed")).alias("n_train"))


@query("jon18_pair_by_name", """WITH a AS (SELECT event_id, regexp_replace('frame_' || event_id || '.png.png', '(\\.(png|jpe?g))+$', '') AS stem FROM events WHERE event_id % 3 > 0), b AS (SELECT event_id AS pred, regexp_replace('frame_' || event_id || '.jpg', '(\\.(png|jpe?g))+$', '') AS stem FROM events WHERE event_id % 5 > 0)
  SELECT stem, event_id, pred FROM a JOIN b USING (stem)""")
def _(t):
    name = lambda tail: nm.frame_stem(F.concat(F.lit("frame_"), F.col("event_id").cast("string"), F.lit(tail)))
    truth = t.events.where("event_id % 3 > 0").select(name(".png.png").alias("stem"), "event_id")
    guess = t.events.where("event_id % 5 > 0").select(name(".jpg").alias("stem"), F.col("event_id").alias("pred"))
    return tb.pair_by_name(truth, guess, ["stem"])


@query("jon19_mask_candidates", """WITH n AS (SELECT 'f' || event_id || CASE event_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.jpg.png' ELSE '.png.png' END AS m FROM events WHERE event_id % 5 > 0 UNION ALL SELECT 'f' || event_id || '.png.png' FROM events WHERE event_id % 7 = 0),
  c AS (SELECT event_id, unnest(['f' || event_id || '.jpg', 'f' || event_id || '.png', 'f' || event_id || '.jpg.png', 'f' || event_id || '.png.png']) AS m, unnest([0, 1, 2, 3]) AS r FROM events),
  b AS (SELECT event_id, arg_min(m, r) AS mask FROM c JOIN (SELECT DISTINCT m FROM n) USING (m) GROUP BY event_id) SELECT event_id, mask FROM events LEFT JOIN b USING (event_id)""")
def _(t):
    e = F.concat(F.lit("f"), F.col("event_id").cast("string"))
    kind = F.element_at(F.array(*[F.lit(x) for x in (".jpg", ".png", ".jpg.png", ".png.png")]), (F.col("event_id") % 4 + 1).cast("int"))
    have = t.events.where("event_id % 5 > 0").select(F.concat(e, kind).alias("mask")).union(
        t.events.where("event_id % 7 = 0").select(F.concat(e, F.lit(".png.png"))))
    rows = t.events.select("event_id", F.concat(e, F.lit(".jpg")).alias("name"))
    return tb.candidate_lookup(rows, have, ["event_id"], nm.mask_candidates(F.col("name")), "mask").select("event_id", "mask")


# Names with repeated extensions: every stem on the way to the bare name is tried, the longest first.
DEEP = ["png", "jpg.png", "png.jpeg.jpg", "tiff"]


@query("jon19_mask_middle_stems", f"""WITH e AS (SELECT event_id, 'f' || event_id || '.' || {DEEP}[CAST(event_id % 4 AS INT) + 1] AS name FROM events),
  n AS (SELECT DISTINCT 'f' || event_id || x AS m FROM events, (SELECT unnest(['.png.png', '.png.jpeg.png', '.png.jpg.png', '.jpg.png.png']) AS x, unnest([0, 1, 2, 3]) AS i) WHERE (event_id // 4) % 4 = i),
  s AS (SELECT event_id, name, name AS stem, 0 AS d FROM e UNION ALL SELECT event_id, name, regexp_replace(regexp_replace(regexp_replace(name, '\\.(png|jpg|jpeg)$', ''), CASE WHEN k > 1 THEN '\\.(png|jpg|jpeg)$' ELSE '^$' END, ''), CASE WHEN k > 2 THEN '\\.(png|jpg|jpeg)$' ELSE '^$' END, ''), k FROM e, (SELECT unnest([1, 2, 3]) AS k)
    WHERE k <= CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END),
  c AS (SELECT event_id, CASE WHEN d = 0 THEN stem ELSE stem || x END AS m, d * 3 + i AS r FROM s, (SELECT unnest(['.png', '.jpg.png', '.png.png']) AS x, unnest([0, 1, 2]) AS i) WHERE d > 0 OR i = 0),
  b AS (SELECT event_id, arg_min(m, r) AS mask FROM c JOIN n USING (m) GROUP BY event_id) SELECT e.event_id, name, mask FROM e LEFT JOIN b USING (event_id)""")
def _(t):
    e, k = F.concat(F.lit("f"), F.col("event_id").cast("string")), F.col("event_id")
    name = F.concat(e, F.lit("."), F.element_at(F.array(*[F.lit(d) for d in DEEP]), (k % 4 + 1).cast("int")))
    tails = F.element_at(F.array(*[F.lit(x) for x in (".png.png", ".png.jpeg.png", ".png.jpg.png", ".jpg.png.png")]), (F.floor(k / 4) % 4 + 1).cast("int"))
    rows, have = t.events.select("event_id", name.alias("name")), t.events.select(F.concat(e, tails).alias("mask"))
    return tb.candidate_lookup(rows, have, ["event_id"], nm.mask_candidates(F.col("name")), "mask").select("event_id", "name", "mask")


@query("jon20_required_members", """WITH b AS (SELECT DISTINCT o_custkey AS capture, o_orderstatus AS band FROM orders), n AS (SELECT unnest(['F', 'O', 'P']) AS band), c AS (SELECT DISTINCT capture FROM b)
  SELECT capture, string_agg(n.band, ',' ORDER BY n.band) AS missing FROM c CROSS JOIN n LEFT JOIN b USING (capture, band) WHERE b.band IS NULL GROUP BY capture""".replace("LEFT JOIN b USING (capture, band)", "LEFT JOIN b ON b.capture = c.capture AND b.band = n.band").replace("SELECT capture, string_agg", "SELECT c.capture, string_agg").replace("GROUP BY capture", "GROUP BY c.capture"))
def _(t):
    return tb.missing_members(t.orders, "o_custkey", "o_orderstatus", ["F", "O", "P"]).withColumnRenamed("o_custkey", "capture")


@query("jon21_missing_references", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(t):
    present = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return tb.absent_rows(t.customer.select("c_custkey"), present, ["c_custkey"])


@query("jon22_pair_details", """WITH p AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem), g AS (SELECT least(l_partkey, l_suppkey) * 2147483647 + greatest(l_partkey, l_suppkey) AS pair, CAST(sum(l_quantity) AS BIGINT) AS inliers FROM lineitem WHERE l_quantity > 5 GROUP BY 1),
  i AS (SELECT p_partkey AS image, 'frame_' || p_partkey || '.png' AS name FROM part)
  SELECT a, b, x.name AS name_a, y.name AS name_b, abs(x.image - y.image) AS frame_gap, inliers FROM p LEFT JOIN i x ON x.image = a LEFT JOIN i y ON y.image = b LEFT JOIN g ON g.pair = least(a, b) * 2147483647 + greatest(a, b)""")
def _(t):
    pairs = t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    geometry = t.lineitem.where("l_quantity > 5").groupBy(nm.pair_number(F.col("l_partkey"), F.col("l_suppkey")).alias("pair")).agg(F.sum("l_quantity").cast("bigint").alias("inliers"))
    name = F.concat(F.lit("frame_"), F.col("p_partkey").cast("string"), F.lit(".png"))
    images = t.part.select(F.col("p_partkey").alias("image"), name.alias("name"), nm.frame_index(name).alias("index"))
    return tb.pair_details(pairs, images, geometry, "a", "b").select("a", "b", "name_a", "name_b", "frame_gap", "inliers")


RATES = f"""{REPEAT}, rates AS (SELECT sequence, condition > '3' AS m, round(count(*) FILTER (ok) / count(*)::DOUBLE, 3) AS rate FROM rr WHERE status <> 'P' GROUP BY ALL)"""


def rates(t):
    runs = repeat_runs(t).where("status <> 'P'")
    rate = F.round(F.count_if(F.coalesce("ok", F.lit(False))) / F.count(F.lit(1)), 3)
    return runs.groupBy("sequence", (F.col("condition") > "3").alias("masked")).agg(rate.alias("rate"))


@query("jon25_repeat_rates", f"""WITH {RATES} SELECT run, CASE WHEN condition <> '5-LOW' THEN rate END AS registration_success_rate, condition = '5-LOW' OR rate IS NULL AS pending_repeats
  FROM rr LEFT JOIN rates ON rates.sequence = rr.sequence AND rates.m = (rr.condition > '3')""")
def _(t):
    out = tb.attach_rates(t.runs, rates(t), F.col("condition") > "3", "sequence", F.col("condition") == "5-LOW")
    return out.select("run", "registration_success_rate", "pending_repeats")


@query("jon26_stability_merge", f"""WITH {RATES}, old AS (SELECT c_custkey AS sequence, CASE WHEN c_custkey % 4 = 0 THEN 'kept' END AS stability FROM customer), nw AS (SELECT sequence, rate AS stability FROM rates WHERE m)
  SELECT sequence, coalesce(CAST(nw.stability AS VARCHAR), old.stability, '') AS stability FROM old FULL JOIN nw USING (sequence)""")
def _(t):
    old = t.customer.select(F.col("c_custkey").alias("sequence"), F.when(F.col("c_custkey") % 4 == 0, "kept").alias("stability"))
    new = rates(t).where("masked").select("sequence", F.col("rate").alias("stability"))
    return tb.merge_columns(old, new, "sequence", ["stability"])


@query("jon27_consistency_audit", """SELECT o_orderkey, 'status' AS "column", o_orderstatus AS "left", l_linestatus AS "right" FROM orders JOIN (SELECT l_orderkey, max(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus <> l_linestatus
  UNION ALL SELECT o_orderkey, 'n', CAST(o_orderkey % 4 + 1 AS VARCHAR), CAST(n AS VARCHAR) FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE n <> o_orderkey % 4 + 1""")
def _(t):
    a = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 4 + 1).alias("n"))
    b = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("status"), F.count(F.lit(1)).alias("n"))
    return tb.audit_columns(a, b, "o_orderkey", ["status", "n"])


# ---- orderings and sets

@query("srt1_level_order", """WITH r AS (SELECT o_custkey AS seq, CASE o_orderkey % 3 WHEN 0 THEN 'fps' WHEN 1 THEN 'width' ELSE 'count' END AS sweep, CAST(o_orderkey AS VARCHAR) AS value FROM orders)
  SELECT *, row_number() OVER (PARTITION BY seq ORDER BY CASE sweep WHEN 'fps' THEN 0 WHEN 'width' THEN 1 ELSE 2 END, CAST(value AS DOUBLE)) - 1 AS place FROM r""")
def _(t):
    k = F.col("o_orderkey")
    sweep = F.when(k % 3 == 0, "fps").when(k % 3 == 1, "width").otherwise("count")
    rows = t.orders.select(F.col("o_custkey").alias("seq"), sweep.alias("sweep"), k.cast("string").alias("value"))
    rank = F.when(F.col("sweep") == "fps", 0).when(F.col("sweep") == "width", 1).otherwise(2)
    keyed_ = rows.withColumns({"_r": rank, "_v": F.col("value").try_cast("double")})
    return Ordered(keyed_, ["seq"], ["_r", "_v"]).add(place=ordinal()).df.drop("_r", "_v")


@query("srt3_capture_order", """WITH c AS (SELECT event_id, user_id AS seq, strftime(ts, '%Y:%m:%d %H:%M') AS dt, CAST(microsecond(ts) // 1000 AS VARCHAR) AS sub FROM events)
  SELECT seq, event_id, row_number() OVER (PARTITION BY seq ORDER BY dt, lpad(sub, 6, '0'), event_id) - 1 AS place FROM c""")
def _(t):
    sub = F.floor(F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(60_000_000)) / 1000).cast("string")
    caps = t.events.select("event_id", F.col("user_id").alias("seq"), F.date_format("ts", "yyyy:MM:dd HH:mm").alias("dt"), sub.alias("sub"))
    padded = caps.withColumn("sub", F.lpad("sub", 6, "0"))
    return Ordered(padded, ["seq"], ["dt", "sub", "event_id"]).add(place=ordinal()).df.select("seq", "event_id", "place")


@query("srt4_top_k_per_group", """SELECT l_suppkey, rank, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 5""")
def _(t):
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    return tb.top_per_group(t.lineitem, ["l_suppkey"], order, 5).select("l_suppkey", "rank", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("srt5_first_candidates", f"WITH {RUNS} SELECT sequence, rank, run, price FROM (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY price DESC, run) AS rank FROM runs) WHERE rank <= 8")
def _(t):
    return tb.top_per_group(t.runs, ["sequence"], [F.col("price").desc(), F.col("run")], 8).select("sequence", "rank", "run", "price")


@query("set1_key_union", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def _(t):
    return tb.key_union(t.orders.select(F.col("o_custkey").alias("k")), t.customer.select(F.col("c_custkey").alias("k")), "k")


@query("set2_key_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    return tb.key_difference(t.customer.select(F.col("c_custkey").alias("k")), t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")), "k")


@query("set3_symmetric_difference", """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT l_suppkey * 20 AS k FROM lineitem)
  SELECT k, 'left' AS only_in FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'right' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""")
def _(t):
    customers = t.orders.select(F.col("o_custkey").alias("k"))
    return tb.symmetric_difference(customers, t.lineitem.select((F.col("l_suppkey") * 20).alias("k")), "k")


@query("set4_topic_intersection", """WITH c AS (SELECT user_id, date_trunc('day', ts) AS d, list(DISTINCT event_type) AS topics FROM events GROUP BY ALL)
  SELECT user_id, epoch_us(d) // 86400000000 AS chunk, len(topics)::BIGINT AS n_topics FROM c WHERE list_has_any(topics, ['error', 'signup'])""")
def _(t):
    chunk = F.floor(F.col("t") / 86_400_000_000).cast("bigint")
    chunks = t.frames.groupBy(F.col("seq").alias("user_id"), chunk.alias("chunk")).agg(F.collect_set("kind").alias("topics"))  # five kinds
    return tb.touching(chunks, F.col("topics"), ["error", "signup"]).select("user_id", "chunk", F.size("topics").cast("bigint").alias("n_topics"))


APPEND = """SELECT 'condition' AS kind, condition, count(*) AS n_masks, CAST(NULL AS VARCHAR) AS prompt, CAST(NULL AS BIGINT) AS width FROM (SELECT o_orderpriority AS condition FROM orders) GROUP BY condition
  UNION ALL SELECT 'hand', NULL, NULL, NULL, p_size * 10 FROM part WHERE p_size > 45 UNION ALL SELECT 'attempt', NULL, count(*), o_orderstatus, NULL FROM orders GROUP BY o_orderstatus"""


def append_kinds(t):
    a = t.orders.groupBy(F.col("o_orderpriority").alias("condition")).agg(F.count(F.lit(1)).alias("n_masks")).withColumn("kind", F.lit("condition"))
    b = t.part.where("p_size > 45").select(F.lit("hand").alias("kind"), (F.col("p_size").cast("bigint") * 10).alias("width"))
    c = t.orders.groupBy(F.col("o_orderstatus").alias("prompt")).agg(F.count(F.lit(1)).alias("n_masks")).withColumn("kind", F.lit("attempt"))
    return tb.append_rows(a, b, c).select("kind", "condition", "n_masks", "prompt", "width")


@query("set5_append_kinds", APPEND)
def _(t):
    return append_kinds(t)


@query("udf1_metric_registry", f"WITH {VIEWS} SELECT flag, round(avg(psnr), 6) AS psnr_mean, round(median(psnr), 6) AS psnr_median, round(max(ssim), 6) AS ssim_max, count(*) AS n_views FROM views GROUP BY flag")
def _(t):
    from ..operators import metrics as mt

    out = mt.compute(t.views, ["flag"], ["psnr_mean", "psnr_median", "ssim_max", "n_views"])
    return out.select("flag", *[r6(F.col(c)).alias(c) for c in ("psnr_mean", "psnr_median", "ssim_max")], "n_views")


@query("udf2_condition_table", f"""WITH {RUNS}, c AS (SELECT * FROM (VALUES ('raw', false, 1.0), ('dehaze', false, 0.5), ('ghost', true, 1.0)) v(mode, masked, gain))
  SELECT mode, status, count(*) AS n, CAST(round(sum(CASE WHEN masked THEN 0 ELSE gain END * 2), 4) AS DOUBLE) AS total FROM runs, c GROUP BY ALL""")
def _(t):
    from ..operators import metrics as mt

    modes = {"raw": (False, 1.0), "dehaze": (False, 0.5), "ghost": (True, 1.0)}
    rows = mt.with_conditions(t.runs, "mode", {m: {"masked": k, "gain": g} for m, (k, g) in modes.items()})
    score = F.when(F.col("masked"), 0.0).otherwise(F.col("gain")) * 2
    return rows.groupBy("mode", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(score), 4).alias("total"))


@query("udf3_kind_dispatch", f"WITH {FRAMES} SELECT kind, count(*) AS n, round(CASE kind WHEN 'click' THEN min(lum) WHEN 'view' THEN max(lum) ELSE avg(lum) END, 6) AS v FROM frames GROUP BY kind")
def _(t):
    from ..operators import metrics as mt

    def preparer(agg):
        return lambda df: df.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), r6(agg("lum")).alias("v"))

    kinds = {"click": preparer(F.min), "view": preparer(F.max)} | dict.fromkeys(["error", "purchase", "signup"], preparer(F.avg))
    return mt.dispatch(t.frames, "kind", kinds)



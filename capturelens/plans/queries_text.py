"""Text, links, notes and the catalog over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import phrases as ph
from ..functions import text as tx
from ..functions.catalog import class_rank
from ..operators import documents as dc
from ..operators import rollup as ru
from ..operators import tables as tb
from ..operators.ordered import Ordered, ordinal
from ..sources import readers as rd
from .bindings import FRAMES
from .queries_study import FLAGGED, REPEAT, flagged, repeat_runs
from .registry import query


@query("txt1_search", "SELECT doc_id, lang FROM documents WHERE contains(lower(text || ' ' || source || ' ' || lang), 'src1')")
def _(t):
    return dc.catalog_search(t.documents, ["text", "source", "lang"], " SRC1 ").select("doc_id", "lang")


@query("txt2_showing_count", "SELECT 'Showing ' || count(*) FILTER (contains(lower(text), 'the ')) || ' of ' || count(*) || ' datasets' AS shown FROM documents")
def _(t):
    hits = F.count_if(F.lower("text").contains("the ")).cast("string")
    total = F.count(F.lit(1)).cast("string")
    return t.documents.agg(F.concat(F.lit("Showing "), hits, F.lit(" of "), total, F.lit(" datasets")).alias("shown"))


@query("txt3_link_kind", """WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(url, 'example', 'kaggle') WHEN page_id % 3 = 1 THEN '' END AS u,
    CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 2 = 0 THEN 'https://doi.org/10.5281/zenodo.' || page_id ELSE '10.99/a\\_' || page_id END AS doi FROM pages),
  q AS (SELECT page_id, CASE WHEN coalesce(u, '') <> '' THEN u WHEN doi IS NOT NULL THEN 'https://doi.org/' || regexp_replace(doi, '^https?://(dx\\.)?doi\\.org/', '') ELSE '' END AS x FROM p)
  SELECT page_id, CASE WHEN x <> '' THEN CASE WHEN contains(lower(x), 'kaggle.com') OR contains(lower(x), '10.5281/zenodo') THEN 'data' ELSE 'paper' END END AS kind, nullif(replace(x, '\\_', '_'), '') AS url FROM q""")
def _(t):
    k = F.col("page_id")
    url = F.when(k % 3 == 0, F.replace("url", F.lit("example"), F.lit("kaggle"))).when(k % 3 == 1, "")
    doi = F.when(k % 5 == 0, None).when(k % 2 == 0, F.concat(F.lit("https://doi.org/10.5281/zenodo."), k.cast("string"))).otherwise(F.concat(F.lit("10.99/a\\_"), k.cast("string")))
    return t.pages.select("page_id", tx.link_kind(url, doi).alias("_l")).select("page_id", "_l.kind", "_l.url")


@query("txt4_markup_to_text", """SELECT doc_id, source || ' and ' || lang || ': n = ' || n_chars || ' % of & all – “quoted” x — y' AS plain FROM documents""")
def _(t):
    lit = F.lit
    markup = F.concat(lit("\\textbf{"), F.col("source"), lit("} and \\rev{\\emph{"), F.col("lang"), lit("}}: n~=~"), F.col("n_chars").cast("string"),
                      lit(" \\% of \\& all -- ``quoted'' \\cite{k1,k2} x --- y % a comment\n%another"))
    return t.documents.select("doc_id", tx.markup_to_text(markup).alias("plain"))


@query("txt4_references", """SELECT doc_id, source || ' × 3°: see Table ' || (n_chars % 9) || ' and A.' || (n_chars % 4) || 'ᵃ' AS plain, [lang, 'k2', source] AS cited FROM documents""")
def _(t):
    lit, n = F.lit, F.col("n_chars")
    markup = F.concat(F.col("source"), lit(" $\\times$ 3$^{\\circ}$: see Table~\\ref{tab:x}\\cite{"), F.col("lang"), lit(", k2} and \\ref{sec:y}$^{a}$ \\cite{"), F.col("source"), lit("}% \\cite{no}"))
    numbers = F.create_map(lit("tab:x"), (n % 9).cast("string"), lit("sec:y"), F.concat(lit("A."), (n % 4).cast("string")))
    return t.documents.select("doc_id", tx.markup_to_text(markup, numbers).alias("plain"), tx.cited_keys(markup).alias("cited"))


@query("txt4_page_text", r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'),
  '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS digest FROM pages""")
def _(t):
    return t.pages.select("page_id", F.md5(tx.page_text(F.col("html")).cast("binary")).alias("digest"))


@query("txt5_compose_accents", "SELECT doc_id, md5(nfc_normalize(replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)))) AS digest, length(text) AS n FROM documents")
def _(t):
    apart = tx.replace_all(F.col("text"), {"é": "e\u0301", "ü": "u\u0308"})
    return t.documents.select("doc_id", F.md5(tx.compose_accents(apart).cast("binary")).alias("digest"), F.length("text").cast("bigint").alias("n"))


@query("txt5_accent_commands", "SELECT n_nationkey, 'Muñoz & Señé, Łç ' || n_name AS shown FROM nation".replace("Ł", "ł"))
def _(t):
    raw = F.concat(F.lit("Mu\\~{n}oz \\& Se\\~n\\'{e}, {\\l}\\c{c} "), F.col("n_name"))
    return t.nation.select("n_nationkey", tx.markup_to_text(raw).alias("shown"))


@query("txt6_legend", """SELECT n_nationkey, 'NA=' || n_name || ';RE=Region ' || n_regionkey || ';ZZ=Last one' AS legend FROM nation""")
def _(t):
    caption = F.concat(F.lit("Properties. The columns are "), F.col("n_name"), F.lit(" (NA), Region "), F.col("n_regionkey").cast("string"), F.lit(" (RE), and Last one (ZZ)."))
    pairs = F.transform(F.map_entries(tx.legend(caption)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return t.nation.select("n_nationkey", F.array_join(pairs, ";").alias("legend"))


@query("txt7_first_sentence", r"""SELECT doc_id, md5(CASE WHEN regexp_matches(text, '(?s)^.*?(?:[^A-Z]|[\w\p{L}\p{N}][A-Z])\.\s+[A-Z(]') THEN regexp_extract(text, '(?s)^(.*?(?:[^A-Z]|[\w\p{L}\p{N}][A-Z])\.)\s+[A-Z(]', 1) ELSE text END) AS digest
  FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.md5(tx.first_sentence(F.col("text")).cast("binary")).alias("digest"))


@query("txt8_footnotes", "SELECT doc_id, 'ᵃFrom ' || source || '.|ᵇLanguage ' || lang AS notes FROM documents")
def _(t):
    caption = F.concat(F.lit("A table ᵃ of things. ᵃFrom "), F.col("source"), F.lit(". ᵇLanguage "), F.col("lang"), F.lit(" "))
    return t.documents.select("doc_id", F.array_join(tx.footnotes(caption, "ᵃᵇᶜ"), "|").alias("notes"))


# Events as the structure tokens of one document per user: each event gives a few tokens.
TOKEN_SETS = {
    "click": ["section", "label"], "view": ["subsection", "label"], "purchase": ["begin_table", "caption", "label", "end"],
    "error": ["begin_figure", "caption", "label", "caption", "end"], "signup": ["reset_table"],
}
TOKEN_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TOKEN_SETS.items()) + " END"


@query("txt9_numbering", f"""WITH {FRAMES}, tk AS (SELECT seq AS doc, CASE WHEN t // 86400000000 >= 19738 THEN 1 ELSE 0 END AS part, t, event_id, unnest({TOKEN_SQL}) AS kind, generate_subscripts({TOKEN_SQL}, 1) AS i FROM frames),
  a AS (SELECT *, sum(CAST(kind = 'section' AS INT)) OVER (PARTITION BY doc, part ORDER BY t, event_id, i) AS sec, sum(CAST(kind = 'subsection' AS INT)) OVER w AS subs,
    last_value(CASE WHEN kind IN ('section', 'subsection') THEN kind END IGNORE NULLS) OVER w AS last, last_value(CASE WHEN kind LIKE 'begin%' OR kind = 'end' THEN kind END IGNORE NULLS) OVER w AS env
    FROM tk WINDOW w AS (PARTITION BY doc ORDER BY part, t, event_id, i)),
  b AS (SELECT *, last_value(CASE WHEN kind = 'section' THEN subs END IGNORE NULLS) OVER w AS sub0, sum(CAST(kind = 'caption' AND env = 'begin_table' AS INT)) OVER w AS tabs, sum(CAST(kind = 'caption' AND env = 'begin_figure' AS INT)) OVER w AS figs
    FROM a WINDOW w AS (PARTITION BY doc ORDER BY part, t, event_id, i)),
  c AS (SELECT *, tabs - coalesce(last_value(CASE WHEN kind = 'reset_table' THEN tabs END IGNORE NULLS) OVER w, 0) AS tab, CASE WHEN part = 1 THEN chr(CAST(64 + sec AS INT)) ELSE CAST(sec AS VARCHAR) END AS head FROM b WINDOW w AS (PARTITION BY doc ORDER BY part, t, event_id, i))
  SELECT doc, 'l' || event_id AS label, CASE WHEN env = 'begin_table' THEN CASE WHEN part = 1 THEN head ELSE '' END || tab WHEN env = 'begin_figure' THEN CASE WHEN part = 1 THEN head ELSE '' END || figs
    WHEN last = 'section' THEN head ELSE head || '.' || (subs - coalesce(sub0, 0)) END AS number FROM c WHERE kind = 'label'""")
def _(t):
    sets = F.lit(None)
    for kind, tokens in TOKEN_SETS.items():
        sets = F.when(F.col("kind") == kind, F.array(*[F.lit(x) for x in tokens])).otherwise(sets)
    part = (F.floor(F.col("t") / 86_400_000_000) >= 19738).cast("int")
    tokens = t.frames.select(F.col("seq").alias("doc"), part.alias("part"), "t", "event_id", F.posexplode(sets).alias("i", "kind"))
    labelled = tokens.withColumn("label", F.concat(F.lit("l"), F.col("event_id").cast("string")))
    return dc.number_labels(labelled, "doc", "part", ["t", "event_id", "i"])


@query("txt10_template_fill", "SELECT n_nationkey, '<h1><!--@title-->' || replace(n_name, '&', '&amp;') || ' $1<!--/@title--></h1><p><!--@n-->' || n_regionkey || '<!--/@n--></p>' AS page FROM nation")
def _(t):
    template = F.lit("<h1><!--@title-->old<!--/@title--></h1><p><!--@n-->0\n1<!--/@n--></p>")
    regions = {"title": F.concat(tx.html_escape(F.col("n_name")), F.lit(" $1")), "n": F.col("n_regionkey").cast("string")}
    return t.nation.select("n_nationkey", tx.fill_regions(template, regions).alias("page"))


@query("txt11_html_escape", """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS digest FROM pages""")
def _(t):
    return t.pages.select("page_id", F.md5(tx.html_escape(F.col("html")).cast("binary")).alias("digest"))


@query("txt12_json_cells", """WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)
  SELECT o_custkey, '{' || string_agg('"' || o_orderstatus || '":' || n, ',' ORDER BY o_orderstatus) || '}' AS cell, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY o_custkey""")
def _(t):
    cell = F.to_json("m")
    back = F.aggregate(F.map_values(F.from_json("cell", "map<string,bigint>")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    out = ru.value_counts(t.orders, ["o_custkey"], "o_orderstatus", "m").withColumn("cell", cell)
    return out.select("o_custkey", "cell", back.alias("total"))


@query("txt13_set_pairs", """SELECT n_nationkey, 'id=' || n_nationkey || ';name="' || n_name || '";open="[1,2";list=[1,2];on=true' AS pairs FROM nation""")
def _(t):
    raw = F.concat(F.lit("id="), F.col("n_nationkey").cast("string"), F.lit("\nname="), F.col("n_name"), F.lit("\nopen=[1,2\nlist=[1,2]\non=true\nnothing"))
    pairs = F.transform(F.map_entries(tx.set_pairs(raw)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return t.nation.select("n_nationkey", F.array_join(pairs, ";").alias("pairs"))


@query("txt14_note_list", """SELECT c_custkey, concat_ws(' | ', CASE WHEN c_acctbal < 0 THEN 'negative' END, 'segment ' || c_mktsegment, CASE WHEN c_nationkey < 10 THEN 'documentation: early' END) AS notes FROM customer""")
def _(t):
    own = F.array_compact(F.array(F.when(F.col("c_acctbal") < 0, "negative"), F.concat(F.lit("segment "), F.col("c_mktsegment"))))
    shared = F.when(F.col("c_nationkey") < 10, F.array(F.lit("documentation: early")))
    return t.customer.select("c_custkey", tx.join_notes(own, shared).alias("notes"))


@query("txt15_conditional_notes", """SELECT p_partkey, concat_ws(' | ', CASE WHEN p_size > 10 THEN 'focal: ' || p_type END, CASE WHEN p_size % 2 = 0 THEN 'range ' || CAST(CAST(p_size AS DECIMAL(10,1)) AS VARCHAR) || '-' || CAST(CAST(p_size + 1 AS DECIMAL(10,1)) AS VARCHAR) END,
  CASE WHEN p_brand = 'Brand#1' THEN 'stills' END) AS notes FROM part""")
def _(t):
    size = lambda c: c.cast("decimal(10,1)").cast("string")
    notes = tx.notes_when(
        (F.col("p_size") > 10, F.concat(F.lit("focal: "), F.col("p_type"))),
        (F.col("p_size") % 2 == 0, F.concat(F.lit("range "), size(F.col("p_size")), F.lit("-"), size(F.col("p_size") + 1))),
        (F.col("p_brand") == "Brand#1", F.lit("stills")))
    return t.part.select("p_partkey", notes.alias("notes"))


@query("txt16_accuracy_phrase", f"""WITH {FRAMES}, c AS (SELECT seq, kind, count(*) AS n FROM frames GROUP BY ALL), m AS (SELECT seq, string_agg(n || ' fixes with status ' || kind, '; ' ORDER BY kind) AS ph, sum(n) AS n FROM c GROUP BY seq)
  SELECT seq, CASE seq % 3 WHEN 0 THEN ph WHEN 1 THEN 'none stated (' || n || ' captures with GPS)' ELSE 'log reports its own level' END AS phrase FROM m""")
def _(t):
    counts = ru.value_counts(t.frames, ["seq"], "kind", "m")
    kind = F.element_at(F.array(F.lit("fix"), F.lit("exif"), F.lit("log")), (F.col("seq") % 3 + 1).cast("int"))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return counts.select("seq", ph.accuracy_phrase(kind, F.col("m"), total).alias("phrase"))


STAB = f"""{REPEAT}, st AS (SELECT sequence, count(*) AS n, count(*) FILTER (ok) AS k FROM rr WHERE status = 'F' GROUP BY sequence)"""


@query("txt17_stability_phrase", f"""WITH {STAB}, m AS (SELECT c_nationkey, c_custkey, n, k FROM customer LEFT JOIN st ON sequence = c_custkey), g AS (SELECT c_nationkey, count(*) AS total, count(n) AS have,
    string_agg(c_custkey || ': ' || k || ' of ' || n || ' (' || CAST(CAST(round(CAST(round(k / n::DOUBLE, 3) AS DECIMAL(38,12)) * 100, 1) AS DECIMAL(38,1)) AS VARCHAR) || ' %)', '; ' ORDER BY c_custkey) FILTER (n IS NOT NULL) AS ph FROM m GROUP BY c_nationkey)
  SELECT c_nationkey, CASE WHEN have = 0 THEN 'single run' ELSE ph || CASE WHEN have < total THEN '; others single run' ELSE '' END END AS phrase FROM g""")
def _(t):
    return ph.stability_phrase(stability_members(t), "c_nationkey", "sequence", "k", "n")


def stability_members(t):
    runs = repeat_runs(t).where("status = 'F'").groupBy("sequence").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("ok", F.lit(False))).alias("k"))
    return t.customer.select("c_nationkey", F.col("c_custkey").alias("sequence")).join(runs, "sequence", "left")


@query("txt17_stability_rows", f"""WITH {STAB}, m AS (SELECT c_nationkey, c_custkey, n, k FROM customer LEFT JOIN st ON sequence = c_custkey)
  SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place, c_custkey || ': ' || k || ' of ' || n || ' (' || CAST(CAST(round(CAST(round(k / n::DOUBLE, 3) AS DECIMAL(38,12)) * 100, 1) AS DECIMAL(38,1)) AS VARCHAR) || ' %)' AS item, NULL AS members, NULL AS repeated FROM m WHERE n IS NOT NULL
  UNION ALL SELECT c_nationkey, NULL, NULL, count(*), count(n) FROM m GROUP BY c_nationkey""")
def _(t):
    return ph.stability_rows(stability_members(t), "c_nationkey", "sequence", "k", "n")


# ---- the catalog: documents as datasets found, labels as their readiness

CAT = """cat AS (SELECT d.doc_id AS "index", CASE WHEN l.doc_id IS NOT NULL THEN d.doc_id END AS id, d.source, d.lang, CASE WHEN l.doc_id IS NOT NULL THEN 'yes' ELSE 'no (' || d.lang || ')' END AS cell,
    CASE WHEN quality = 1 AND toxic = 0 THEN 'ripe' WHEN quality = 1 THEN 'ripening' WHEN quality = 0 THEN 'unripe' END AS class, CASE WHEN l.doc_id IS NOT NULL THEN '' ELSE 'not characterized: ' || d.lang END AS reason,
    CASE WHEN l.doc_id IS NOT NULL THEN 'Dataset ' || d.doc_id END AS full_name, p.url FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN pages p ON p.page_id = d.doc_id)"""


def catalog(t):
    marked = t.labels.select("doc_id", "quality", "toxic")
    found = t.documents.join(marked.select("doc_id", F.lit(True).alias("_in")), "doc_id", "left").select(
        F.col("doc_id").alias("index"), F.when(F.col("_in"), F.col("doc_id")).alias("id"), "source", "lang",
        F.when(F.col("_in"), "yes").otherwise(F.concat(F.lit("no ("), F.col("lang"), F.lit(")"))).alias("cell"))
    q = F.col("quality")
    cls = F.when((q == 1) & (F.col("toxic") == 0), "ripe").when(q == 1, "ripening").when(q == 0, "unripe")
    classes = marked.select(F.col("doc_id").alias("id"), cls.alias("class"))
    names = marked.select(F.col("doc_id").alias("id"), F.concat(F.lit("Dataset "), F.col("doc_id").cast("string")).alias("full_name"))
    links = t.pages.select(F.col("page_id").alias("index"), "url")
    return dc.catalog_rows(found, classes, names, links, "id", "cell")


@query("jon23_catalog_join", f"WITH {CAT} SELECT * FROM cat")
def _(t):
    return catalog(t).select("index", "id", "source", "lang", "cell", "class", "reason", "full_name", "url")


@query("jon24_detail_transpose", """WITH m AS (SELECT p_brand AS property, p_type AS grp, p_partkey AS pos, p_size, p_retailprice FROM part), c AS (
    SELECT *, row_number() OVER (PARTITION BY property ORDER BY pos) AS place, CASE WHEN lag(grp) OVER (PARTITION BY property ORDER BY pos) IS DISTINCT FROM grp THEN 1 ELSE 0 END AS new FROM m)
  SELECT property, grp, pos, CAST(p_size AS VARCHAR) AS value, CAST(sum(new) OVER (PARTITION BY property ORDER BY pos) AS BIGINT) AS group_no FROM c""")
def _(t):
    from ..operators.sequence import adjacent_groups

    table = t.part.select(F.col("p_brand").alias("property"), F.col("p_type").alias("grp"), F.col("p_partkey").alias("pos"), "p_size", "p_retailprice")
    return adjacent_groups(tb.unpivot_column(table, "property", "grp", "pos", "p_size"), ["property"], ["pos"], "grp")


RANK = "CASE class WHEN 'ripe' THEN 0 WHEN 'ripening' THEN 1 WHEN 'unripe' THEN 2 ELSE 9 END"


@query("srt2_class_order", f"""WITH {CAT} SELECT source, "index", class, row_number() OVER (PARTITION BY source ORDER BY {RANK} DESC, "index") - 1 AS place FROM cat""")
def _(t):
    ranked = catalog(t).withColumn("_r", -class_rank(F.col("class")))
    return Ordered(ranked, ["source"], ["_r", "index"]).add(place=ordinal()).df.select("source", "index", "class", "place")


@query("rpt16_catalog_listing", f"""WITH {CAT} SELECT source, "index", class, reason, full_name, url, row_number() OVER (PARTITION BY source ORDER BY {RANK}, "index") - 1 AS place FROM cat
  WHERE contains(lower(source || ' ' || lang || ' ' || cell || ' ' || reason || ' ' || coalesce(full_name, '') || ' ' || coalesce(class, '')), 'ripe')""")
def _(t):
    hits = dc.catalog_search(catalog(t), ["source", "lang", "cell", "reason", "full_name", "class"], "Ripe")
    ranked = hits.withColumn("_r", class_rank(F.col("class")))
    return Ordered(ranked, ["source"], ["_r", "index"]).add(place=ordinal()).df.select("source", "index", "class", "reason", "full_name", "url", "place")


@query("rpt15_documentation_split", f"""WITH f AS {FLAGGED}, n AS (SELECT source, count(*) AS n, count(*) FILTER (glare = 'low') AS k, string_agg(CAST(doc_id AS VARCHAR), '; ' ORDER BY doc_id) FILTER (glare = 'low') AS ph FROM f GROUP BY source)
  SELECT source, CAST(k AS BIGINT) AS disagree, CAST(n - k AS BIGINT) AS agree, coalesce(ph, 'no disagreement found') AS phrase FROM n""")
def _(t):
    return ph.disagreement_phrase(flagged(t), "source", F.coalesce(F.col("glare") == "low", F.lit(False)), F.col("doc_id"))


@query("rpt15_documentation_rows", f"""WITH f AS {FLAGGED} SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, CAST(doc_id AS VARCHAR) AS item, NULL AS disagree, NULL AS agree FROM f WHERE glare = 'low'
  UNION ALL SELECT source, NULL, NULL, count(*) FILTER (glare = 'low'), count(*) - count(*) FILTER (glare = 'low') FROM f GROUP BY source""")
def _(t):
    return ph.disagreement_rows(flagged(t), "source", F.coalesce(F.col("glare") == "low", F.lit(False)), F.col("doc_id"))


@query("src12_page_cells", r"""WITH c AS (SELECT page_id, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS cells FROM pages)
  SELECT page_id, generate_subscripts(cells, 1) - 1 AS place, trim(regexp_replace(unnest(cells), '<[^>]*>', '', 'g')) AS cell FROM c""")
def _(t):
    return rd.page_cells(t.pages, "page_id", "html").select("page_id", F.col("place").cast("bigint").alias("place"), "cell")


@query("src12_markup_table", "SELECT n_regionkey, 1 AS group_no, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS row_no, n_name || '&' || n_nationkey AS cells FROM nation UNION ALL SELECT DISTINCT n_regionkey, 0, 1, 'Name&Key' FROM nation")
def _(t):
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", F.concat("n_name", F.lit(" & "), F.col("n_nationkey").cast("string")).alias("r"))))
    body = F.array_join(F.transform(rows, lambda s: s["r"]), " \\\\[2pt] \n")
    text = F.concat(F.lit("\\toprule\nName & Key \\\\\n\\midrule\n"), body, F.lit(" \\\\\n\\addlinespace[3pt]\\bottomrule"))
    tables = t.nation.groupBy("n_regionkey").agg(text.alias("text"))
    cells = rd.markup_rows(tables, "n_regionkey", "text")
    return cells.select("n_regionkey", F.col("group_no").cast("int").alias("group_no"), (F.col("row_no") + 1).cast("bigint").alias("row_no"), F.array_join("cells", "&").alias("cells"))


@query("src11_bibliography", "SELECT 'k' || page_id AS key, 'misc' AS type, 'Page {No {' || page_id || '}}' AS title, url FROM pages")
def _(t):
    k = F.col("page_id").cast("string")
    text = F.concat(F.lit("@Misc{k"), k, F.lit(",\n  title = {Page  {No {"), k, F.lit("}}},\n  URL = \""), F.col("url"), F.lit("\",\n year = 2024\n}\n"))
    out = rd.bibliography(t.pages.select(text.alias("value")), "value")
    return out.select("key", "type", F.col("fields")["title"].alias("title"), F.col("fields")["url"].alias("url"))



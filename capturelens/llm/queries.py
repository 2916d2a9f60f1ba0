"""The operators of this folder as named queries over the given tables, with SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_tree, decontaminate, exact, merkle, mixing, near_text, near_vectors, packing, quality, spelling, token_counts, token_store, warc
from .work import new_folder
from .wordpieces import public_path

TOKENIZER = "word_bpe_49k.json"
LOSSLESS_TOKENIZER = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


@query(r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-0-' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
), per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, source_size * 3 AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM per
), lefts AS (
  SELECT *, row_number() OVER o AS rank,
         CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
         CAST(sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest_w
  FROM weighed WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST)
), first_open AS (SELECT rank, rest, rest_w FROM lefts WHERE cap * rest_w > w * rest ORDER BY rank LIMIT 1
), targets AS (
  SELECT l.source, l.source_size,
         CASE WHEN f.rank IS NULL OR l.rank < f.rank THEN CAST(l.cap AS DOUBLE)
              ELSE CAST(l.w * f.rest AS DOUBLE) / CAST(f.rest_w AS DOUBLE) END AS target
  FROM lefts l LEFT JOIN first_open f ON true
), placed AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized
), cut AS (
  SELECT p.doc_id, p.size, t.source_size, t.target, p.before,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS passes
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(passes * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - passes * source_size - before)) AS BIGINT) AS taken
FROM cut
""")
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix by source weights takes."""
    return mixing.plan_mix(table(spark, sf_dir, "documents"))


@query("""
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of whole texts; the largest id of each stays."""
    marks = exact.mark_copies(table(spark, sf_dir, "documents"))
    return marks.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query()
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, counted through the digest cache."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_path(TOKENIZER))


@query(r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS shingles
  FROM w
), n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n FROM s
), u AS (SELECT doc_id, unnest(shingles) AS shingle FROM s
), both_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach AS (SELECT doc_id AS v, doc_id AS r FROM n UNION SELECT reach.v, e.b FROM reach JOIN e ON reach.r = e.a)
SELECT n.doc_id, n.n AS n_shingles, m.r AS component_id, n.doc_id = m.r AS kept
FROM n JOIN (SELECT v, min(r) AS r FROM reach GROUP BY v) m ON m.v = n.doc_id
""")
def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents by sets of four-word shingles."""
    return near_text.near_groups(table(spark, sf_dir, "documents"), words=4, similarity=0.8)


@query()
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by weighted rules over text statistics."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, written to compressed shards and read back."""
    folder = new_folder(spark, "token-store")
    token_store.write_tokens(table(spark, sf_dir, "documents"), folder, public_path(TOKENIZER))
    return token_store.read_tokens(spark, folder)


@query()
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of several permitted lengths, counted in tokens and an end id."""
    docs = token_counts.token_lengths(table(spark, sf_dir, "documents"), public_path(TOKENIZER))
    return packing.pack(docs, F.col("length"))


@query("""
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.98
), reach AS (SELECT vec_id AS v, vec_id AS r FROM embeddings UNION SELECT reach.v, e.b FROM reach JOIN e ON reach.r = e.a
), m AS (SELECT v, min(r) AS r FROM reach GROUP BY v
), d AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT v AS vec_id, coalesce(d.n, 0) AS n_links, m.r AS component_id, v = m.r AS kept FROM m LEFT JOIN d ON d.a = m.v
""")
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate embeddings of one label by cosine."""
    return near_vectors.vector_groups(table(spark, sf_dir, "embeddings"))


@query("""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, CAST(CAST(unhex(sha1(coalesce(html, ''))) AS BIT) AS VARCHAR) AS bits FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(5), lambda k: CAST(substr(bits, i * 5 + k + 1, 1) AS BIGINT) * (16 >> k)))::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
""")
def op7_warc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    folder = new_folder(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages"), folder)
    return warc.read_pages(spark, folder)


@query(r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, length(role) + length(text) + length(role || text) - length(replace(role || text, '\', '')) + length(role) - length(replace(role, chr(10), ''))
    + len(regexp_extract_all(role, '(?:<\|endoftext\|>|<\|im_start\|>|<\|im_end\|>|<</SYS>>|<<SYS>>|\[/INST\]|\[INST\]|</s>|<s>)')) + len(regexp_extract_all(text, '(?:<\|endoftext\|>|<\|im_start\|>|<\|im_end\|>|<</SYS>>|<<SYS>>|\[/INST\]|\[INST\]|</s>|<s>)'))
    + length('<|im_start|>') + length('<|im_end|>') + 2 AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
""")
def op5_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted into packs of a prefix tree and read back from them."""
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id bigint, turn bigint, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    folder = new_folder(spark, "chat-packs")
    chat_tree.write_packs(rows, folder, public_path(LOSSLESS_TOKENIZER))
    return chat_tree.read_conversations(spark, folder, public_path(LOSSLESS_TOKENIZER))


@query(r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda p: array_to_string(w[p:p + least(len(w), 10) - 1], ' '))) AS win
  FROM i WHERE len(w) > 0
), ks AS (SELECT DISTINCT k FROM iw
), places AS (SELECT r, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS p FROM d, ks
), dw AS (SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS win FROM places
), hits AS (SELECT dw.r, dw.k, dw.p, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.k = iw.k
), n AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + k)) AS q FROM hits) GROUP BY r
), its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN its ON its.r = d.r
""")
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in ten-word windows of benchmark items."""
    return decontaminate.mark_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# unsigned CRC-32, bit by bit over a list of byte values
CRC_SQL = """
crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i)) AS t
)
"""


def crc_sql(byte_list: str) -> str:
    return f"xor(4294967295, list_reduce({byte_list}, lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::BIGINT))"


@query(f"""
WITH RECURSIVE {CRC_SQL}, f AS (
  SELECT *, CAST(doc_id AS VARCHAR) AS id, CAST(n_chars AS VARCHAR) AS n, CAST(n_chars + 1 AS VARCHAR) AS n1 FROM documents
), h AS (
  SELECT doc_id, lang, list_transform([n, n1], lambda m: sha256(array_to_string(list_transform([id, source, lang, m, text],
      lambda v: coalesce(octet_length(encode(v)) || ':' || v, '-')), ''))) AS both_leaves,
    coalesce({crc_sql("list_transform(string_split(id, ''), lambda c: ascii(c)::BIGINT)")} % 7 = 0, false) AS tampered
  FROM f, crc_table
), l AS (
  SELECT doc_id, both_leaves[1] AS leaf, CASE WHEN tampered THEN both_leaves[2] ELSE both_leaves[1] END AS given,
    coalesce('=' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, both_leaves[1]) - 1 AS i
  FROM h
), tree AS (
  SELECT g, 0 AS lvl, i, leaf AS x, count(*) OVER (PARTITION BY g) AS n FROM l
  UNION ALL
  SELECT g, lvl + 1, i // 2, sha256(string_agg(x, '' ORDER BY i)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY g, lvl, i // 2, n
), subs AS (
  SELECT g, x AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS gi FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS lvl, gi AS i, subroot AS x, count(*) OVER () AS n FROM subs
  UNION ALL
  SELECT lvl + 1, i // 2, sha256(string_agg(x, '' ORDER BY i)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, i // 2, n
), up AS (
  SELECT g, i AS leaf_i, 0 AS lvl, i, given AS x, '' AS proof FROM l
  UNION ALL
  SELECT u.g, u.leaf_i, u.lvl + 1, u.i // 2,
    sha256(CASE WHEN s.x IS NULL THEN u.x WHEN u.i % 2 = 0 THEN u.x || s.x ELSE s.x || u.x END), u.proof || coalesce(s.x, '')
  FROM up u JOIN (SELECT DISTINCT g, lvl, n FROM tree WHERE n > 1) t ON t.g = u.g AND t.lvl = u.lvl
    LEFT JOIN tree s ON s.g = u.g AND s.lvl = u.lvl AND s.i = xor(u.i, 1)
), inner_end AS (
  SELECT u.g, u.leaf_i, u.x, u.proof, s.gi, s.subroot FROM up u JOIN tree t ON t.g = u.g AND t.lvl = u.lvl AND t.n = 1 JOIN subs s ON s.g = u.g
), up2 AS (
  SELECT g, leaf_i, subroot, 0 AS lvl, gi AS i, x, proof FROM inner_end
  UNION ALL
  SELECT u.g, u.leaf_i, u.subroot, u.lvl + 1, u.i // 2,
    sha256(CASE WHEN s.x IS NULL THEN u.x WHEN u.i % 2 = 0 THEN u.x || s.x ELSE s.x || u.x END), u.proof || coalesce(s.x, '')
  FROM up2 u JOIN (SELECT DISTINCT lvl FROM top WHERE n > 1) t ON t.lvl = u.lvl
    LEFT JOIN top s ON s.lvl = u.lvl AND s.i = xor(u.i, 1)
)
SELECT l.doc_id, l.leaf, u.subroot, r.x AS root, sha256(u.proof) AS proof_sha256, u.x AS folded_root, u.x = r.x AS verified
FROM l JOIN up2 u ON u.g = l.g AND u.leaf_i = l.i JOIN top r ON r.n = 1 AND r.lvl = u.lvl
""")
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf folded to the root of the dataset, some with a changed length."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.check_documents(docs, tampered)


@query(f"""
WITH RECURSIVE {CRC_SQL}, runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents
), seen AS (SELECT doc_id, w, count(*) AS c, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS s FROM runs GROUP BY doc_id, w
), hashed AS (
  SELECT w, c, {crc_sql("flatten(list_transform(string_split(s, ''), lambda a: CASE WHEN unicode(a) < 128 THEN [unicode(a)::BIGINT] ELSE [192 + (unicode(a) >> 6), 128 + (unicode(a) & 63)]::BIGINT[] END))")} AS h
  FROM seen, crc_table
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, c FROM hashed
), v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), cuts AS (
  SELECT word, length(word) AS len, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM v)
), pairs AS (
  SELECT x.word AS a, y.word AS b FROM cuts x JOIN cuts y ON x.rest = y.rest AND x.p = y.p AND x.len = y.len AND x.word <> y.word
  UNION SELECT c.word, v.word FROM cuts c JOIN v ON v.word = c.rest
  UNION SELECT v.word, c.word FROM cuts c JOIN v ON v.word = c.rest
), best AS (
  SELECT a, count(*) AS n_near, arg_min(b, (-n, encode(b))) AS form, max(n) AS form_n FROM pairs JOIN v ON v.word = b GROUP BY a
), forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n
  FROM v LEFT JOIN best ON best.a = v.word
), follow AS (
  SELECT word, word AS here, 0 AS step FROM forms
  UNION ALL SELECT f.word, g.form, f.step + 1 FROM follow f JOIN forms g ON g.word = f.here WHERE g.form IS NOT NULL
), roots AS (SELECT word, arg_max(here, step) AS root FROM follow GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
""")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form each word of the corpus is a spelling of, some occurrences having lost a letter."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), slips=True)

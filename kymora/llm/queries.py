"""Queries of the pipeline operators over the given tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kymora.llm import bit_sliced, decontaminate, fill_middle, hidden_markov, line_dedup, lsh_forest, packing, prefix_trie, quality, rollups, toxicity, url_filter, vector_packing
from kymora.llm.common import stored
from kymora.session import own_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Vocabulary that the packing query uses.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle.strip()
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op9_benchmark_decontamination",
    f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    win AS (
        SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT size FROM win),
    g AS (
        SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS g
        FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
    hit AS (SELECT doc_id, i, g.size, item_id FROM g JOIN win USING (size, g)),
    n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
    it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h
           FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("print")


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"), "offending")


@query("op10_ngram_jaccard_join")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


@query("op5_line_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "deleted_bytes")


@query("op2_hidden_markov_scores")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.hmm_scores(table(spark, sf_dir, "documents"))


_CANON = """
    WITH RECURSIVE after_scheme AS (
        SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    tags AS (
        SELECT url, rest,
               regexp_extract(regexp_extract(coalesce(html, ''), '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>'), '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS c,
               regexp_extract(regexp_extract(coalesce(html, ''), '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>'), '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS m
        FROM after_scheme WHERE url IS NOT NULL),
    said AS (
        SELECT DISTINCT url AS a,
               CASE WHEN instr(t, '://') > 0 THEN t
                    WHEN starts_with(t, '//') THEN scheme || ':' || t
                    WHEN starts_with(t, '/') THEN scheme || '://' || host || t
                    ELSE scheme || '://' || host || CASE WHEN folder = '' THEN '/' ELSE folder END || t END AS b
        FROM (SELECT url, unnest([c, m]) AS t, regexp_extract(url, '^([^:/?#]*)://', 1) AS scheme,
                     translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_replace(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '[^/]*$', '') AS folder FROM tags) x
        WHERE t <> ''),
    ends AS (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT b FROM said),
    parts AS (
        SELECT url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
               regexp_replace(regexp_replace(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '(^|&)utm_[^&]*', '', 'g'), '^&', '') AS asked
        FROM (SELECT url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM ends) x),
    edge AS (
        SELECT '0' || a AS a, '0' || b AS b FROM said
        UNION SELECT '0' || url, '1' || regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/$', '') || CASE WHEN asked <> '' THEN '?' || asked ELSE '' END
        FROM parts WHERE regexp_replace(host, '^www\\.', '') <> ''),
    walk AS (
        SELECT a AS node, a AS seen FROM edge UNION SELECT b, b FROM edge
        UNION SELECT w.node, CASE WHEN e.a = w.seen THEN e.b ELSE e.a END FROM walk w JOIN edge e ON e.a = w.seen OR e.b = w.seen),
    class AS (SELECT node, min(seen) AS alias FROM walk GROUP BY node),
    rules(action, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
    fit AS (
        SELECT p.url, r.action, r.host || r.path AS rule,
               row_number() OVER (PARTITION BY p.url ORDER BY length(r.host || r.path) DESC, r.action, r.host || r.path DESC) AS k
        FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)),
    ruled AS (SELECT url, action, rule FROM fit WHERE k = 1),
    taint AS (SELECT alias FROM class JOIN ruled ON '0' || url = node GROUP BY alias HAVING bool_or(action = 'block') AND NOT bool_or(action = 'allow'))
    SELECT page_id, coalesce(parts.host, '') AS host, coalesce(parts.path, '') AS path, rule,
           coalesce(action, CASE WHEN taint.alias IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, coalesce(substr(class.alias, 2), pages.url) AS alias
    FROM pages LEFT JOIN parts USING (url) LEFT JOIN ruled USING (url) LEFT JOIN class ON class.node = '0' || pages.url LEFT JOIN taint ON taint.alias = class.alias
"""


@query("op1_url_equivalence_filter", _CANON)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(url_filter.RULES, "action string, host string, path string"))


@query(
    "op3_bit_sliced_top_k",
    """
    WITH v AS (
        SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(c.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
        FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.r <> c.r)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) x WHERE rank <= 5
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op8_token_count_rollup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert all documents under two tokenizer versions, count an end token more in one of them, delete
    the later copies of texts from both, and commit the last batch again."""
    counts = stored(rollups.token_counts(table(spark, sf_dir, "documents"), {"white_space-1": None, "word_bpe_49k-1": VOCABULARY}))
    revised = F.when(F.col("tokenizer") == "word_bpe_49k-1", F.col("n_tokens") + 1).otherwise(F.col("n_tokens"))
    rollup = rollups.Rollup(spark, own_path(spark, "rollup"))
    rollup.commit("insert", rollups.inserts(counts))
    now = counts.withColumn("revised", revised)
    rollup.commit("revise", rollups.revisions(now.where("tokenizer = 'word_bpe_49k-1'"), "revised"))
    gone = rollups.deletes(rollups.repeated_texts(now).withColumn("n_tokens", F.col("revised")))
    rollup.commit("delete", gone)
    rollup.commit("delete", gone)
    return rollup.totals()


@query(
    "op11_fill_in_middle",
    """
    WITH h AS (
        SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS x FROM documents),
    p AS (
        SELECT *, CAST('0x' || substr(x, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(x, 9, 8) AS BIGINT) % (n + 1) AS b,
               CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(x, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
                    WHEN CAST('0x' || substr(x, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
    c AS (
        SELECT *, substring(t, 1, least(a, b)) AS pre, substring(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS mid, substring(t, greatest(a, b) + 1) AS suf FROM p)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(a, b) - least(a, b) END AS middle_chars,
           sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM c
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fill_middle.restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


_CRC = """xor(list_reduce(flatten(list_transform(range(1, length(s) + 1), lambda i: [CAST(ascii(s[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
                lambda a, v: CASE WHEN v < 0 THEN xor(a >> 1, 3988292384 * (a & 1)) ELSE xor(a, v) END, CAST(4294967295 AS BIGINT)), 4294967295)"""


@query(
    "op12_conversation_prefix_trie",
    f"""
    WITH t AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
        FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t) x),
    made AS (
        SELECT c.conv_id, 0 AS part, k, role, text FROM c JOIN t ON t.conv_id = base AND k <= h
        UNION ALL SELECT c.conv_id, 1, k, role, text FROM c JOIN t USING (conv_id) WHERE k > h),
    whole AS (
        SELECT conv_id, coalesce(w, []) AS w
        FROM c LEFT JOIN (SELECT conv_id, list([role, text] ORDER BY part, k) AS w FROM made GROUP BY conv_id) x USING (conv_id)),
    node AS (
        SELECT depth, w[1 : depth] AS p, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(w) = depth) AS ends
        FROM (SELECT conv_id, w, unnest(range(0, len(w) + 1)) AS depth FROM whole) x GROUP BY ALL),
    tree AS (
        SELECT n.*, up.conv_id AS parent_conv_id, (SELECT count(*) FROM node AS b WHERE b.depth = n.depth + 1 AND b.p[1 : n.depth] = n.p) AS n_children
        FROM node AS n LEFT JOIN node AS up ON up.depth = n.depth - 1 AND up.p = n.p[1 : n.depth - 1] AND n.depth > 0),
    sums AS (
        SELECT d AS depth, p[1 : d] AS p, sum((n_convs - 1) * coalesce(length(p[depth][2]), 0)) AS saved, count(*) FILTER (n_children = 0) AS leaves
        FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM tree) x GROUP BY ALL)
    SELECT conv_id, depth, parent_conv_id, n_convs, n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
    FROM tree JOIN sums USING (depth, p)
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.numbered_turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(*prefix_trie.with_shared_heads(turns))


@query("op13_vector_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY).drop("n_loss")

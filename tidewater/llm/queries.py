"""The registered query of each operator: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import (html_text, packing, pii, piece_viterbi, pq_links, prefix_trie, quality_model, quality_rules, sharding,
                           simhash, syncmers, token_counts, walsh_clusters)
from tidewater.llm.common import read
from tidewater.llm.registry import ORACLES, QUERIES, query

__all__ = ["QUERIES", "ORACLES", "tokenizer_path"]

TOKEN_LIMIT = 4096
SIMHASH_WORDS, SIMHASH_BITS = 4, 4
SEQUENCE_TOKENS, END_ID = 4096, 2
SHARDS = 40


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; every worker has the files at the same path."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), TOKEN_LIMIT)


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), SIMHASH_WORDS, SIMHASH_BITS)


QUALITY_RULES_SQL = r"""
WITH d AS (SELECT doc_id, source, COALESCE(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT *, row_number() OVER () AS rid FROM w),
win AS (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM g)),
rep AS (SELECT rid, i, COUNT(*) OVER (PARTITION BY rid, a, b, c) AS k FROM win),
cov AS (SELECT rid, COUNT(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep WHERE k > 1) GROUP BY rid),
f AS (SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
  CAST(COALESCE(cov.n, 0) AS BIGINT) AS n_repeat_words FROM g LEFT JOIN cov USING (rid)),
r AS (SELECT *, n_words < 50 AS r1, 100 * n_repeat_words > 50 * n_words AS r2, 100 * n_symbols > 10 * word_chars AS r3,
  100 * n_dup_lines > 30 * n_lines AS r4 FROM f),
h AS (SELECT source, COUNT(*) AS n, SUM(CAST(r1 OR r2 OR r3 OR r4 AS INT)) AS f FROM r WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT AVG(f / n) AS m, VAR_POP(f / n) AS v, AVG(1.0 / n) AS inv FROM h),
p AS (SELECT m, CASE WHEN v - m * (1 - m) * inv > 1e-12 THEN GREATEST(m * (1 - m) / (v - m * (1 - m) * inv) - 1, 0) ELSE 1e9 END AS s FROM m),
hv AS (SELECT source, (f + m * s) / (n + s) AS rate FROM h, p),
v AS (SELECT r.*, COALESCE(hv.rate, (SELECT m FROM m), 0) AS host_rate,
  CASE WHEN r3 OR r4 THEN (CASE WHEN r3 THEN 200.0 ELSE 1.0 END) * (CASE WHEN r4 THEN 3.0 ELSE 1.0 END) ELSE 0.05 END AS odds
  FROM r LEFT JOIN hv USING (source))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (r1 OR r2) AS base_failed, host_rate,
  host_rate * 0.05 <= 1 - host_rate AS host_ok, NOT (r1 OR r2) AND host_rate * odds <= 1 - host_rate AS kept
FROM v
"""


@query("op3_quality_rules", QUALITY_RULES_SQL)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"))


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), SEQUENCE_TOKENS, END_ID)


@query("op5_syncmers")
def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edit_fingerprints(read(spark, sf_dir, "documents"))


@query("op6_pii")
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(read(spark, sf_dir, "documents"))


@query("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(read(spark, sf_dir, "documents"), SHARDS)


@query("op8_html_text")
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read(spark, sf_dir, "pages"))


@query("op9_quality_model")
def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_model.quality_scores(docs, quality_model.train(docs, read(spark, sf_dir, "labels")))


@query("op10_sentencepiece")
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_viterbi.piece_digest(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """Clustering with one pair of CTEs a round: a{i} assigns to the centroids c{i}, c{i+1} holds the floors of the means."""
    ctes = ["""k AS (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))""",
            f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS c, v FROM k QUALIFY c < {k})"]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := d, c := c)) AS m FROM (
  SELECT k.rid, k.vec_id, k.v, z.c, CAST(list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - z.v[i]) * (k.v[i] - z.v[i]))) AS BIGINT) AS d
  FROM k, c{i} z) GROUP BY rid)""")
        if i < rounds:
            ctes.append(f"""s{i} AS (SELECT c, i, CAST(SUM(x) AS BIGINT) AS s, COUNT(*) AS n FROM (
  SELECT m.c AS c, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{i}) GROUP BY c, i)""")
            ctes.append(f"""c{i + 1} AS (SELECT z.c, COALESCE(w.v, z.v) AS v FROM c{i} z LEFT JOIN (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{i} GROUP BY c) w ON z.c = w.c)""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(SUM(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
  CAST(SUM(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} z ON z.c = m.c
"""


@query("op11_walsh_clusters", _clusters_sql())
def op11_walsh_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walsh_clusters.centroid_clusters(read(spark, sf_dir, "embeddings"))


# crc32 of the decimal id, byte by byte and bit by bit; then every rebuilt conversation's prefixes (m), the distinct ones (n),
# and subtree sums by crediting a node's saving and leaf to its least member
PREFIX_TRIE_SQL = r"""
WITH t AS (SELECT conv_id AS c, COALESCE(role, '') AS r, COALESCE(text, '') AS x,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations WHERE conv_id IS NOT NULL),
k0 AS (SELECT c, MAX(p) AS len, c - c % 5 AS b, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT],
  flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
  lambda acc, s: xor(xor(acc, s) >> 1, 3988292384::BIGINT * (xor(acc, s) & 1)))) % 9 AS h FROM t GROUP BY c),
k AS (SELECT a.*, LEAST(a.h, COALESCE(b.len, 0)) AS lead FROM k0 a LEFT JOIN k0 b ON b.c = a.b),
s AS (SELECT k.c, t.p AS d, t.r, t.x FROM k JOIN t ON t.c = k.b AND t.p <= k.h
  UNION ALL SELECT k.c, t.p - k.h + k.lead, t.r, t.x FROM k JOIN t ON t.c = k.c AND t.p > k.h),
q AS (SELECT k.c, COALESCE(z.l, []) AS l, COALESCE(len(z.l), 0) AS n FROM k LEFT JOIN (
  SELECT c, list(struct_pack(r := r, x := x) ORDER BY d) AS l FROM s GROUP BY c) z ON z.c = k.c),
m AS (SELECT c, n, d, sha256(CAST(to_json(l[1:d]) AS VARCHAR)) AS key, CASE WHEN d > 0 THEN strlen(l[d].x) ELSE 0 END AS bytes
  FROM (SELECT c, l, n, unnest(range(0, n + 1)) AS d FROM q)),
w AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS up FROM m),
n AS (SELECT d, key, any_value(up) AS up, any_value(bytes) AS bytes, COUNT(*) AS n, MIN(c) AS c,
  sha256(COALESCE(string_agg(CASE WHEN d = n THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends FROM w GROUP BY d, key),
f AS (SELECT n.*, COALESCE(z.kids, 0) AS kids, p.c AS parent FROM n
  LEFT JOIN (SELECT d - 1 AS d, up AS key, COUNT(*) AS kids FROM n GROUP BY 1, 2) z ON z.d = n.d AND z.key = n.key
  LEFT JOIN n p ON p.d = n.d - 1 AND p.key = n.up),
credit AS (SELECT w.c, w.d, w.key, CASE WHEN f.c = w.c THEN (f.n - 1) * f.bytes ELSE 0 END AS s,
  CASE WHEN f.c = w.c AND f.kids = 0 THEN 1 ELSE 0 END AS leaf FROM w JOIN f ON f.d = w.d AND f.key = w.key),
below AS (SELECT d, key, SUM(s) AS s, SUM(leaf) AS leaf FROM (
  SELECT d, key, SUM(s) OVER z AS s, SUM(leaf) OVER z AS leaf FROM credit
  WINDOW z AS (PARTITION BY c ORDER BY d DESC ROWS UNBOUNDED PRECEDING)) GROUP BY d, key)
SELECT f.c AS conv_id, f.d AS depth, f.parent AS parent_conv_id, f.n AS n_convs, f.kids AS n_children,
  CAST(below.leaf AS BIGINT) AS n_leaves, CAST(below.s AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN below ON below.d = f.d AND below.key = f.key
"""


@query("op12_prefix_trie", PREFIX_TRIE_SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


@query("op13_pq_links")
def op13_pq_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_links.near_vectors(read(spark, sf_dir, "embeddings"))

"""The registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, clustering, decontamination, html_extract, language_id, line_dedup, mixing, near_dedup, packing, quality_rules, toxicity, warc, whitening
from .common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    counts = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, "base_failed", "kept")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit("</s>[INST] ok [/INST]"))
    back = chat_format.loss_spans(chat_format.parse_chats(chat_format.format_chats(rows.union(trap))))
    turns = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t: F.concat(b["role"], F.lit("\n"), t, F.lit("\n")))))
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=1)
    n_items = [F.size(c).cast("long").alias(f"n_{c}") for c in ("items", "near_items")]
    return found.select("doc_id", "n_words", "n_hit", *n_items, F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = language_id.fit(docs.where(~held_out(4, 2)))
    return language_id.identify(docs, field).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def held_out(mod: int, rest: int):
    """Whether the CRC-32 of the id as text leaves this remainder: rows kept back from learning."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == rest, F.lit(False))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels.where(~held_out(5, 0))))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.kmeans(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", *[F.col(c).try_cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], "centroid_sha256")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM t, (VALUES (0), (1), (2)) v(k) WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: list_contains([STOPS], rtrim(lower(x), '.,;:!?')))) AS stops,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-•*‣·][\x20\x09-\x0D]'))) AS bullets,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS dots, len(l) AS n_lines
  FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND n_words BETWEEN 50 AND 1000000 AND word_chars / n_words BETWEEN 2 AND 15
         AND n_symbols / n_words <= 0.1 AND stops / n_words >= 0.04 AND n_dup_lines / n_lines <= 0.5
         AND bullets / n_lines <= 0.9 AND dots / n_lines <= 0.3 AS kept
FROM b
""".replace("STOPS", ", ".join(f"'{x}'" for x in quality_rules.STOP_WORDS))

OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (SELECT *, coalesce(lag(role) OVER w <> role, true) AS first FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
e AS (SELECT *, length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) AS tl, length(replace(replace(role, '&', '&amp;'), '<|', '&lt;|')) AS rl FROM m)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(tl + CASE WHEN first THEN 23 + rl ELSE 8 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS digest FROM p),
f AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) END AS first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < first THEN first END AS refers_to
FROM f
"""

OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g FROM b, unnest(range(1, len(w) - least(len(w), 13) + 2)) u(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, ks, unnest(range(1, len(w) - k + 2)) u(i)),
h AS (SELECT r, item, i, bw.k FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
n AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM h, unnest(range(0, k)) u(j) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r),
p AS (SELECT r, i, w[i] AS x FROM d, unnest(range(1, len(w) + 1)) u(i)),
f AS (SELECT x, count(*) AS n FROM p GROUP BY x),
bv AS (SELECT item, k, g, string_split(g, ' ') AS v FROM bw),
a AS (SELECT item, k, v, j, row_number() OVER (PARTITION BY item, k, g ORDER BY coalesce(n, 0), v[j], j) AS first FROM bv, unnest(range(1, k + 1)) u(j) LEFT JOIN f ON f.x = v[j]),
c AS (SELECT p.r, item, k, v, i - j AS s, w FROM a JOIN p ON p.x = v[j] JOIN d ON d.r = p.r WHERE first = 1),
q AS (SELECT r, item, list_bool_and(list_transform(range(1, k + 1), lambda t: coalesce((s + t - 1 > 0 AND w[greatest(s + t - 1, 1)] = v[t]) OR (s + t > 0 AND w[greatest(s + t, 1)] = v[t]) OR (s + t + 1 > 0 AND w[greatest(s + t + 1, 1)] = v[t]), false))) AS near FROM c),
y AS (SELECT r, count(DISTINCT item) AS n_near_items FROM q WHERE near AND NOT EXISTS (SELECT 1 FROM h WHERE h.r = q.r AND h.item = q.item) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_near_items, 0)::BIGINT AS n_near_items, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r) LEFT JOIN y USING (r)
"""


def op13_sql() -> str:
    """The rounds one after the other: assignment, sums, centroids."""
    steps = [
        "v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64)",
        "c0 AS (SELECT k, x FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR) NULLS LAST, x) - 1 AS k, x FROM v) WHERE k < 40)",
    ]
    for t in range(6):
        steps.append(f"d{t} AS MATERIALIZED (SELECT r, vec_id, v.x AS x, k, list_sum(list_transform(list_zip(v.x, c{t}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{t})")
        steps.append(f"a{t} AS MATERIALIZED (SELECT r, min(vec_id) AS vec_id, arg_min(x, [d, k]) AS x, arg_min(k, [d, k]) AS k, min(d) AS d FROM d{t} GROUP BY r)")
        if t < 5:
            steps.append(f"e{t} AS (SELECT k, list(floor_ ORDER BY j) AS x FROM (SELECT k, j, CASE WHEN s % n < 0 THEN (s - s % n) // n - 1 ELSE s // n END::BIGINT AS floor_ FROM (SELECT k, j, sum(x[j]) AS s, count(*) AS n FROM a{t}, unnest(range(1, 65)) u(j) GROUP BY k, j)) GROUP BY k)")
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT c{t}.k, coalesce(e{t}.x, c{t}.x) AS x FROM c{t} LEFT JOIN e{t} USING (k))")
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, "
        "sha256(array_to_string(c5.x, ',')) AS centroid_sha256 FROM a5 JOIN c5 USING (k)"
    )


def queries() -> dict:
    return {f.__name__: f for f in (op1_warc, op2_quality_rules, op3_html_extraction, op4_chat_formatting, op5_benchmark_decontamination, op6_language_id, op7_best_fit_packing, op8_toxicity, op9_minhash_near_dedup, op10_line_dedup, op11_mixing, op12_whitening, op13_clustering)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op2_quality_rules": OP2_SQL, "op4_chat_formatting": OP4_SQL, "op5_benchmark_decontamination": OP5_SQL, "op13_clustering": op13_sql()}

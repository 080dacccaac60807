"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import ann, bpe, conversations, language, minhash, mixing, part_codes, quality, sharding, simhash, token_counts, token_orc, warc
from callweave.plans.scratch import materialise, new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op2_warc_chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    pages = warc.with_roles(_table(spark, sf_dir, "pages"))
    warc.write_archives(warc.record_text(warc.chunk_rows(pages)), path)
    return warc.record_heads(warc.read_archives(spark, path)).drop("n_chunks")


def op3_cross_polytope_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, path, decoded_col="decoded")
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_orc_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    rows = token_orc.encode_sorted(_table(spark, sf_dir, "documents"), *map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")), end_id=2)
    token_orc.write_tokens(rows, path)
    # the checksums are written, so that the totals of the parts do not read all ids again
    return token_orc.with_starts(materialise(token_orc.checksums(token_orc.read_tokens(spark, path)), "checksums"))


def op6_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), minhash.Params(words=2))


def op7_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.with_prefix_table(docs, public_tokenizers.path("word_bpe_49k.json"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op8_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), sharding.even_tree(40))


def op9_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language.fit(docs.where(language.in_training()))
    predicted = language.predict(docs.select("doc_id", "text"), profiles)
    return predicted.select("doc_id", (~language.in_training()).alias("held_out"), "lang_pred", "score")


def op10_ngram_log_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ratio = quality.fit(docs, quality.trusted_ids(_table(spark, sf_dir, "labels")))
    return quality.score(docs, ratio).select("doc_id", *quality.OUT)


def op11_deletion_variant_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_hirschberg_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(*conversations.damage(_table(spark, sf_dir, "conversations")))


def op13_hilbert_block_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = part_codes.fit(_table(spark, sf_dir, "embeddings"))
    rows = part_codes.with_label_error(fitted.rows)
    return rows.select("vec_id", "code", "error", "label_error", F.lit(fitted.digest).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_temperature_mixing, op2_warc_chunk_table, op3_cross_polytope_search, op4_pair_index_bpe, op5_orc_token_files, op6_minhash_near_duplicates, op7_prefix_token_counts, op8_weighted_hash_tree, op9_hyperdimensional_language, op10_ngram_log_ratio, op11_deletion_variant_simhash, op12_hirschberg_repair, op13_hilbert_block_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_chunk_table": OP2, "op6_minhash_near_duplicates": OP6, "op12_hirschberg_repair": OP12, "op13_hilbert_block_codes": OP13}


OP2 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY html) AS kept,
    array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST((('0x' || substr(h, CAST(k // 8 * 10 + 1 AS BIGINT), 10))::BIGINT >> CAST(35 - k % 8 * 5 AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM d
"""

OP6 = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w
), sets AS (SELECT min(doc_id) AS doc_id, sh, len(sh) AS n FROM (SELECT doc_id, list_sort(sh) AS sh FROM s) GROUP BY sh),
u AS (SELECT doc_id, n, unnest(sh) AS g FROM sets WHERE n > 0),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
  UNION SELECT m.doc_id, s.doc_id FROM s JOIN sets m ON list_sort(s.sh) = m.sh WHERE m.n > 0
), sides AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, b.y FROM reach r JOIN sides b ON r.y = b.x)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(r.y) AS component_id, min(r.y) = s.doc_id AS kept
FROM s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, len(s.sh)
"""


def _op13_round(k: int) -> str:
    """Assigns all parts to the entries of codebook ``k``, and makes codebook ``k + 1``."""
    return f"""a{k} AS MATERIALIZED (
  SELECT rid, part, unnest(min({{'d': list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))), 'entry': entry}}))
  FROM p JOIN b{k} USING (part) GROUP BY rid, part
), s{k} AS (
  SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
    SELECT part, entry, i, sum(x[i]) AS s, count(*) AS n FROM a{k} JOIN (SELECT rid, part, x, unnest(range(1, len(x) + 1)) AS i FROM p) USING (rid, part) GROUP BY part, entry, i
  ) GROUP BY part, entry
), b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(s{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN s{k} USING (part, entry))"""


OP13 = f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, v) AS rid, * FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), p AS MATERIALIZED (
  SELECT rid, vec_id, CAST(part AS INT) AS part, v[part * len(v) // 8 + 1 : (part + 1) * len(v) // 8] AS x FROM k, range(8) t(part)
), b0 AS MATERIALIZED (SELECT part, CAST(rid - 1 AS INT) AS entry, x AS c FROM p WHERE rid <= 16),
{", ".join(_op13_round(k) for k in range(6))},
f AS (
  SELECT rid, part, unnest(min({{'d': list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))), 'entry': entry}}))
  FROM p JOIN b6 USING (part) GROUP BY rid, part
), e AS (SELECT rid, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b6) AS codebooks_sha256
FROM k JOIN e USING (rid)
"""

#: The damage, then all cheapest ways row by row: each state keeps its least (cost, edits) and what they make.
OP12 = """
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc
), key AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), kinds AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(k) + 1), lambda i: CAST(ord(substr(k, i, 1)) AS BIGINT))),
    lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind FROM key, tab
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 256), copy) AS rn FROM damaged
), f AS (
  SELECT conv_id, turn, role, text, rn, substr(role, 1, 1) AS i, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY rn) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'B' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'D'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'T' ELSE '' END AS fault
  FROM o
), ins(s, here, letters, made) AS (
  VALUES (0, 0, '', CAST([] AS VARCHAR[])), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 1, '', []), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']),
    (2, 2, '', []), (2, 3, 'I', ['assistant:']), (2, 2, 'II', ['assistant:', 'user:']), (3, 3, '', []), (3, 2, 'I', ['user:']), (3, 3, 'II', ['user:', 'assistant:'])
), own(here, t, edit, price, i, role) AS (
  SELECT here, here, 'D', 4, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM range(4) r(here)
  UNION ALL VALUES (0, 2, 'R', 3, NULL, 'user'), (1, 2, 'R', 3, NULL, 'user'), (2, 3, 'R', 3, NULL, 'assistant'), (3, 2, 'R', 3, NULL, 'user'),
    (0, 1, 'K', 0, 's', NULL), (0, 2, 'K', 0, 'u', NULL), (1, 2, 'K', 0, 'u', NULL), (2, 3, 'K', 0, 'a', NULL), (3, 2, 'K', 0, 'u', NULL)
), ways AS (SELECT s, t, edit, letters || edit AS word, price + 3 * len(letters) AS price, made, own.i AS need, role AS given FROM ins JOIN own USING (here)),
z AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS rn, 0 AS s, {'cost': CAST(0 AS BIGINT), 'audit': '', 'body': CAST([] AS VARCHAR[])} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, rn, t, best FROM (
    SELECT z.conv_id, f.rn, w.t, min({'cost': CAST(best.cost + w.price + CASE WHEN f.fault = 'T' AND w.edit <> 'D' THEN 3 ELSE 0 END AS BIGINT), 'audit': best.audit || w.word,
      'body': best.body || w.made || CASE WHEN w.edit = 'D' THEN CAST([] AS VARCHAR[]) ELSE [coalesce(w.given, f.role) || ':' || f.text] END}) AS best
    FROM z JOIN f ON f.conv_id IS NOT DISTINCT FROM z.conv_id AND f.rn = z.rn + 1 JOIN ways w ON w.s = z.s
    WHERE (w.edit = 'D' OR f.fault NOT IN ('B', 'D')) AND (w.need IS NULL OR w.need = f.i)
    GROUP BY z.conv_id, f.rn, w.t)
), closing(s, letters, made) AS (VALUES (0, '', CAST([] AS VARCHAR[])), (1, 'II', ['user:', 'assistant:']), (2, 'I', ['assistant:']), (3, '', [])),
n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'B') AS blank, count(*) FILTER (fault = 'D') AS duplicate,
    count(*) FILTER (fault = 'T') AS truncated, count(*) FILTER (rn > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
), done AS (
  SELECT z.conv_id, any_value(n.gaps) AS gaps, any_value(n.blank) AS blank, any_value(n.duplicate) AS duplicate, any_value(n.truncated) AS truncated, any_value(n.illegal) AS illegal,
    min({'cost': best.cost + 3 * len(c.letters), 'audit': best.audit || c.letters, 'body': best.body || c.made}) AS best
  FROM z JOIN closing c USING (s) LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM z.conv_id WHERE z.rn = coalesce(n.n, 0) GROUP BY z.conv_id
)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.cost AS cost, best.audit AS audit, sha256(array_to_string(best.body, chr(10))) AS repaired_sha256
FROM done
"""

"""The registered queries of the corpus operators, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, exact_dedup, hard_negatives, language, licenses, mixing, packing, quality_rules, rule_ensemble, sharding, simhash, token_counts, url_cascade
from .shared import crc_of_id, stored

#: URL rules of query 2: verdict, host and path.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/labels.parquet")


def op1_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    plan = mixing.plan_mix(stored(mixing.sized(_documents(spark, sf), seed=11), "sized"), max_epochs=3.0)
    rows = plan.rows.join(plan.cuts, "source")
    return rows.withColumn("repeats", plan.repeats(rows)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats")


def op2_filter_urls(spark: SparkSession, sf: str) -> DataFrame:
    return url_cascade.judge(spark.read.parquet(f"{sf}/pages.parquet"), URL_RULES)


def op3_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    stats = stored(quality_rules.base_statistics(docs, stratum=quality_rules.language_stratum(docs)), "statistics")
    return quality_rules.judge(stats, quality_rules.good_labels(_labels(spark, sf))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_identify_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    out = language.held_out(crc_of_id(docs["doc_id"]))
    model = language.fit(docs.filter(~out & docs["lang"].isNotNull()))
    return language.predict(docs, model).withColumn("held_out", language.held_out(crc_of_id(F.col("doc_id"))))


def op5_shuffle_shards(spark: SparkSession, sf: str) -> DataFrame:
    placed = sharding.write_shards(_documents(spark, sf).select("doc_id", "text"), 24)
    text = F.coalesce("doc.text", F.lit(""))
    return placed.select(F.col("doc.doc_id").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                         F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_score_quality(spark: SparkSession, sf: str) -> DataFrame:
    stats = stored(rule_ensemble.statistics(_documents(spark, sf)), "statistics")
    held_out = F.pmod(crc_of_id(F.col("doc_id")), F.lit(3)) == 1
    labels = _labels(spark, sf).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label"))
    labels = labels.filter("label IN (0.0, 1.0)").filter(~held_out)
    model = rule_ensemble.fit(stored(stats.join(labels, "doc_id"), "labelled"))
    return stats.select("doc_id", held_out.alias("held_out"), model.score().alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_simhash_groups(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_groups(_documents(spark, sf)).select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op8_count_tokens(spark: SparkSession, sf: str) -> DataFrame:
    counts = token_counts.prefix_counts(_documents(spark, sf), public_tokenizers.path("piece_bpe_32k.model"), budget=4096)
    return counts.select("doc_id", "n_bytes", "n_tokens", token_counts.over(F.col("n_tokens"), 4096).alias("over_limit"), F.col("cut").alias("chars_in_limit"))


def op9_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf)).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op10_pack_sequences(spark: SparkSession, sf: str) -> DataFrame:
    pieces = stored(packing.token_pieces(_documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"), 2048, keep_ids=False), "pieces")
    return packing.pack(pieces.drop("ids"), 2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_mine_negatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.whole_vectors(rows, F.col("vec_id"), label, F.col("embedding")), F.col("vec_id") % 50 == 0)


def op12_repair_conversations(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    return conversation_repair.repair(conversation_repair.damaged(rows), rows.select("conv_id"))


def op13_scan_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf)).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_mix_sources, op2_filter_urls, op3_quality_rules, op4_identify_language, op5_shuffle_shards, op6_score_quality,
    op7_simhash_groups, op8_count_tokens, op9_exact_dedup, op10_pack_sequences, op11_mine_negatives, op12_repair_conversations, op13_scan_licenses)}

SQL: dict[str, str] = {
    "op2_filter_urls": r"""
WITH rules(rule, verdict) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
named AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rule_host, substr(rule, strpos(rule, '/')) AS rule_path FROM rules),
parsed AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
best AS (SELECT page_id, host, path, arg_max(rule, length(rule) * 1000 + length(rule_host)) AS rule, arg_max(verdict, length(rule) * 1000 + length(rule_host)) AS verdict
  FROM parsed LEFT JOIN named ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best""",
    "op9_exact_dedup": r"""
WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM texts""",
    "op11_mine_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
near AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
unlike AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INT) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
  FROM near JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM unlike WHERE rank <= 3""",
    # the states of the pattern: 0 nothing yet, 1 after s, 2 after u, 3 after a
    "op12_repair_conversations": r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, xor(list_reduce([4294967295] || list_transform(range(1, length(k) + 1), lambda i: CAST(ord(k[i]) AS BIGINT)),
  lambda c, b: xor(crc_table[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind FROM keyed, crc),
turns AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
  trim(text, E' \t\n\x0b\f\r') AS bare FROM turns),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM placed),
judged AS (SELECT conv_id, i, turn, role, text, left(role, 1) AS initial, bare = '' AS blank, bare <> '' AND again AS duplicate,
  bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM seen),
faults AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate,
  count_if(truncated) AS truncated, count_if(illegal) AS illegal, max(i) AS n FROM judged GROUP BY conv_id),
next_state(state, after, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
put_in AS (SELECT state, state AS after, '' AS letters, 0 AS cost, CAST([] AS VARCHAR[]) AS lines FROM next_state
  UNION ALL SELECT state, after, 'I', 5, [role || ':'] FROM next_state
  UNION ALL SELECT a.state, b.after, 'II', 10, [a.role || ':', b.role || ':'] FROM next_state a JOIN next_state b ON b.state = a.after),
keeps(state, initial, after) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edits AS (SELECT conv_id, i, state, state AS after, 'D' AS letter, 2 AS cost, CAST([] AS VARCHAR[]) AS lines FROM judged, next_state
  UNION ALL SELECT conv_id, i, state, after, 'K', CASE WHEN truncated THEN 5 ELSE 0 END, [role || ':' || text] FROM judged JOIN keeps USING (initial) WHERE NOT blank AND NOT duplicate
  UNION ALL SELECT conv_id, i, state, after, 'R', CASE WHEN truncated THEN 6 ELSE 1 END, [next_state.role || ':' || text] FROM judged, next_state WHERE NOT blank AND NOT duplicate),
best AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, {'cost': 0, 'audit': '', 'lines': CAST([] AS VARCHAR[])} AS way FROM faults
  UNION ALL SELECT b.conv_id, e.i, e.after, min({'cost': b.way.cost + p.cost + e.cost, 'audit': b.way.audit || p.letters || e.letter, 'lines': b.way.lines || p.lines || e.lines})
  FROM best b JOIN put_in p ON p.state = b.state JOIN edits e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.i = b.i + 1 AND e.state = p.after GROUP BY ALL),
ended AS (SELECT b.conv_id, min({'cost': b.way.cost + p.cost, 'audit': b.way.audit || p.letters, 'lines': b.way.lines || p.lines}) AS way
  FROM best b JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.n = b.i JOIN put_in p ON p.state = b.state WHERE p.after IN (0, 3) GROUP BY b.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(way.cost, 0) AS BIGINT) AS cost, coalesce(way.audit, '') AS audit,
  sha256(coalesce(array_to_string(way.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id""",
}

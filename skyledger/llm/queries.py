"""The queries of the corpus operators, with production parameters, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.ann import nearest
from skyledger.llm.chat import digest, format_chats
from skyledger.llm.common import crc_bucket, cut, table
from skyledger.llm.decontaminate import decontaminate
from skyledger.llm.html import extract_text
from skyledger.llm.jaccard import jaccard_components
from skyledger.llm.katz import encode, fit_katz, score_katz
from skyledger.llm.langid import fit_language_model, predict_language
from skyledger.llm.licenses import scan_licenses
from skyledger.llm.packing import pack_examples
from skyledger.llm.toxicity import ToxicityModel, fit_toxicity, score_toxicity
from skyledger.llm.trie import prefix_trie, turn_paths, with_openings
from skyledger.llm.urls import Rule, domain_rule, judge_urls
from skyledger.llm.variants import one_deleted, spelling_variants, word_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_examples(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


#: The base rules are fixed values.
BASE_RULES = [
    domain_rule("com", "/en/", "block"),
    domain_rule("example.com", "/en/7", "allow"),
    domain_rule("net", "/de/", "allow"),
    domain_rule("example.net", "/de/8", "block"),
    domain_rule("org", "/es/", "block"),
]
#: Hosts and files that a text corpus avoids.
EXTRA_RULES = [
    *(Rule(f"*{word}**", "block", word) for word in ("spam", "pills", "casino", "porn")),
    *(Rule(f"**.{kind}", "block", f".{kind}") for kind in ("exe", "zip", "jpg", "png")),
    Rule("**/wp-login**", "block", "wp-login"),
]


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), BASE_RULES, EXTRA_RULES)


SQL["op4_url_filter"] = r"""
WITH parts AS (
  SELECT page_id,
    translate(CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1) ELSE '' END,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
extras(pattern, extra_name, extra_verdict) AS (
  VALUES ('^[^/]*spam', 'spam', 'block'), ('^[^/]*pills', 'pills', 'block'), ('^[^/]*casino', 'casino', 'block'), ('^[^/]*porn', 'porn', 'block'),
    ('[.]exe$', '.exe', 'block'), ('[.]zip$', '.zip', 'block'), ('[.]jpg$', '.jpg', 'block'), ('[.]png$', '.png', 'block'), ('/wp-login', 'wp-login', 'block')),
own AS (
  SELECT p.page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM parts p JOIN rules r ON ends_with('.' || p.host, '.' || r.rule_host) AND starts_with(p.path, r.rule_path) GROUP BY p.page_id),
other AS (
  SELECT p.page_id, arg_max(extra_name, length(extra_name)) AS extra_rule, arg_max(extra_verdict, length(extra_name)) AS extra_verdict
  FROM parts p JOIN extras e ON regexp_matches('.' || p.host || p.path, e.pattern) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, o.rule, coalesce(o.rule_verdict, x.extra_verdict, 'allow') AS verdict, x.extra_rule
FROM parts p LEFT JOIN own o ON o.page_id = p.page_id LEFT JOIN other x ON x.page_id = p.page_id
"""


@query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], rows.schema)
    return digest(format_chats(rows.unionByName(extra)))


SQL["op10_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, length(regexp_replace(replace(text, '\', '\\'), '(</?s>|\[/?INST\]|<</?SYS>>|<</?ROLE)', 'x\1', 'g'))
    + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 WHEN 'system' THEN 18 END AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, false AS rewrites
FROM sized GROUP BY conv_id, alone
"""


def toxicity_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> ToxicityModel:
    """Fitted on labels outside the held-out fold, over the texts of docs."""
    labels = table(spark, sf_dir, "labels").where(crc_bucket(F.col("doc_id"), 4) != 2)
    return fit_toxicity(docs, labels)


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, toxicity_model(docs, spark, sf_dir))
    return scored.select("doc_id", F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs.where(crc_bucket(F.col("doc_id"), 5) != 0))
    predicted = predict_language(docs, model)
    return predicted.select("doc_id", F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


SQL["op2_license_scan"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
phrases(t, label, base, phrase) AS (VALUES
  (1, 'cc-by', true, 'cc by'), (2, 'gpl', true, 'general public license'), (3, 'reserved', true, 'all rights reserved'), (4, 'mit', false, 'released under the mit license'),
  (5, 'mit', false, 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files'),
  (6, 'apache-2.0', false, 'licensed under the apache license version 2 0'), (7, 'apache-2.0', false, 'you may not use this file except in compliance with the license'),
  (8, 'gpl-3.0', false, 'this work is licensed under the gnu general public license version 3'),
  (9, 'gpl-3.0', false, 'this program is free software you can redistribute it and or modify it under the terms of the gnu general public license'),
  (10, 'cc-by-nc-4.0', false, 'licensed under cc by nc 4 0'), (11, 'cc-by-sa-4.0', false, 'licensed under cc by sa 4 0'),
  (12, 'bsd', false, 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met'),
  (13, 'mpl-2.0', false, 'this source code form is subject to the terms of the mozilla public license')),
templates AS (SELECT *, string_split(phrase, ' ') AS p FROM phrases),
needed AS (SELECT *, len(p) AS n, CASE WHEN len(p) <= 12 THEN 1.0e0 ELSE 0.75e0 END AS enough FROM templates),
grams AS (SELECT t, label, base, n, enough, unnest(range(1, n)) AS q, p FROM needed),
words AS (SELECT r, w, unnest(range(1, len(w))) AS s FROM d),
bigrams AS (SELECT r, s - 1 AS pos, w[s] AS a, w[s + 1] AS b FROM words),
diagonals AS (
  SELECT r, t, label, base, n, enough, pos - (q - 1) AS diag, list(DISTINCT q - 1) AS hits FROM bigrams JOIN grams ON a = p[q] AND b = p[q + 1] GROUP BY ALL
  HAVING CASE WHEN base THEN count(DISTINCT q) = n - 1 ELSE count(DISTINCT q) > 1 OR n <= 6 END),
places AS (SELECT r, label, diag FROM diagonals WHERE base),
other AS (SELECT *, diag + list_min(hits) AS first, diag + list_max(hits) + 2 AS last FROM diagonals WHERE NOT base),
marked AS (SELECT *, CASE WHEN diag - lag(diag) OVER o <= 3 THEN 0 ELSE 1 END AS fresh FROM other WINDOW o AS (PARTITION BY r, t ORDER BY diag)),
chained AS (SELECT *, sum(fresh) OVER (PARTITION BY r, t ORDER BY diag) AS chain FROM marked),
near AS (SELECT x.r, x.t, x.label, x.n, x.enough, x.chain, flatten(list(y.hits)) AS hits, min(y.first) AS first, max(y.last) AS last FROM chained x JOIN chained y ON y.r = x.r AND y.t = x.t AND y.diag BETWEEN x.diag AND x.diag + 3 GROUP BY x.r, x.t, x.label, x.n, x.enough, x.chain, x.diag),
candidates AS (
  SELECT r, t, label, n, enough, chain, true AS alone, hits, first, last FROM chained UNION ALL SELECT r, t, label, n, enough, chain, false, hits, first, last FROM near
  UNION ALL SELECT r, t, label, n, enough, chain, false, flatten(list(hits)), min(first), max(last) FROM chained GROUP BY ALL),
spans AS (SELECT *, len(list_distinct(list_concat(hits, list_transform(hits, lambda x: x + 1)))) / n AS covered FROM candidates),
passing AS (SELECT r, label, chain, t, coalesce(max(covered) FILTER (alone), max(covered)) AS covered FROM spans WHERE covered >= enough AND last - first <= 1.5 * n + 3 GROUP BY ALL),
found AS (SELECT r, label, 1.0e0 AS covered FROM places UNION ALL SELECT r, label, covered FROM passing),
labelled AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(covered) AS score FROM found GROUP BY r),
based AS (SELECT r, count(*) AS n_base, min(diag) AS first_word, max(diag) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(b.n_base, 0) AS n_base, CAST(b.first_word AS BIGINT) AS first_word, CAST(b.last_word AS BIGINT) AS last_word, coalesce(b.base_labels, '') AS base_labels, coalesce(l.labels, '') AS labels, coalesce(l.score, 0) AS score
FROM d LEFT JOIN based b ON b.r = d.r LEFT JOIN labelled l ON l.r = d.r
"""


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL["op6_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS ws FROM starts),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths WHERE len(w) >= n),
texts AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS ws FROM places),
hits AS (SELECT t.r, t.s, t.n, x.item_id FROM texts t JOIN windows x ON x.n = t.n AND x.ws = t.ws),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.names, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON c.r = d.r LEFT JOIN items i ON i.r = d.r
"""


@query
def op8_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


@query
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


SQL["op9_ngram_jaccard"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT r, w, unnest(CASE WHEN len(w) >= 4 THEN range(1, len(w) - 2) WHEN len(w) > 0 THEN [1] ELSE [] END) AS s FROM d),
grams AS (SELECT DISTINCT r, array_to_string(w[s:s + 3], ' ') AS g FROM starts),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS same FROM grams a JOIN grams b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.r = x JOIN sizes q ON q.r = y WHERE 100 * same >= 85 * (p.n + q.n - same)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(r, t) AS (SELECT r, r FROM d UNION SELECT reached.r, edges.y FROM reached JOIN edges ON edges.x = reached.t)
SELECT own.doc_id, coalesce(sizes.n, 0) AS n_shingles, c.component_id FROM d own LEFT JOIN sizes ON sizes.r = own.r
JOIN (SELECT reached.r, min(d.doc_id) AS component_id FROM reached JOIN d ON d.r = reached.t GROUP BY reached.r) c ON c.r = own.r
"""


@query
def packing_with_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with the turn before as their prompt, which bears no loss: all three limits of the packing bind.

    Of rows that share a conversation's turn the one that is first by role and text is the prompt of what follows, so that
    every answer is packed once. Answers without a turn before, or without an id or turn, have no prompt.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    first = F.min(F.struct("role", "text"))["text"].alias("prompt")
    before = turns.groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(first)
    pairs = turns.where("role = 'assistant'").join(before, ["conv_id", "turn"], "left")
    pairs = pairs.withColumn("example", F.concat_ws("/", "conv_id", "turn"))
    return pack_examples(pairs, public_tokenizers.path("word_bpe_49k.json"), id_col="example", prompt_col="prompt", capacity=2048, max_segments=48, max_loss=1024)


#: crc32 in SQL: its table by rule, and the fold over the bytes of a string, given as hex digits x.
CRC_TABLE = """
bits(i, k, v) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8)"""
CRC_OF_X = """xor(list_reduce(list_transform(range(1, len(x), 2), lambda i: CAST('0x' || x[i:i + 1] AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"""

@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    paths = turn_paths(table(spark, sf_dir, "conversations"))
    return prefix_trie(with_openings(paths, conv - conv % 5, crc_bucket(conv, 9)))


SQL["op11_prefix_trie"] = rf"""
WITH RECURSIVE {CRC_TABLE},
own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hexed AS (SELECT conv_id, s, hex(encode(CAST(conv_id AS VARCHAR))) AS x FROM own),
hashed AS (SELECT conv_id, s, {CRC_OF_X} % 9 AS h FROM hexed, crc),
rebuilt AS (SELECT o.conv_id, list_concat(coalesce(b.s[1:o.h], []), o.s[o.h + 1:]) AS s FROM hashed o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
prefixes AS (SELECT conv_id, d, s[1:d] AS path, len(s) = d AS ends FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, CASE WHEN d = 0 THEN 0 ELSE strlen(path[d].text) END AS size,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY path, d),
kids AS (SELECT path[1:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
tops AS (SELECT *, unnest(range(0, d + 1)) AS k FROM nodes),
subtrees AS (SELECT t.path[1:k] AS path, sum((t.n - 1) * t.size) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves FROM tops t LEFT JOIN kids ON kids.path = t.path GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.n, 0) AS n_children, u.leaves AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees u ON u.path = n.path LEFT JOIN kids k ON k.path = n.path LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]
"""


@query
def op12_katz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    blocks = cut(encode(docs, crc_bucket(F.col("doc_id"), 7) != 2))
    scored = score_katz(blocks, fit_katz(blocks)).withColumn("doc_id", F.col("id").cast(docs.schema["doc_id"].dataType))
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), 7) == 2, F.lit(False)).alias("held_out")
    rounded = [F.round(c, 6).alias(c) for c in ("base_score", "score")]
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", *rounded)


SQL["op12_katz_score"] = rf"""
WITH RECURSIVE {CRC_TABLE},
hexed AS (SELECT row_number() OVER () AS r, doc_id, text, hex(encode(CAST(doc_id AS VARCHAR))) AS x FROM documents),
d AS (
  SELECT r, doc_id, {CRC_OF_X} % 7 = 2 AS held_out,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') AS w
  FROM hexed, crc),
tokens AS (SELECT r, held_out, unnest(w) AS w, unnest(list_prepend(' ', w[1:-2])) AS v FROM d),
singles AS (SELECT w, count(*) FILTER (NOT held_out) AS c FROM tokens GROUP BY w),
pairs AS (SELECT v, w, count(*) FILTER (NOT held_out) AS n FROM tokens GROUP BY v, w),
having_n AS (SELECT 1 AS o, c AS r, count(*) AS m FROM singles WHERE c BETWEEN 1 AND 6 GROUP BY c UNION ALL SELECT 2, n, count(*) FROM pairs WHERE n BETWEEN 1 AND 6 GROUP BY n),
rests AS (SELECT a.o, a.r - 1 AS k, a.r * a.m / CAST(b.m AS DOUBLE) AS rest FROM having_n a JOIN having_n b ON b.o = a.o AND b.r = 1 WHERE a.r > 1),
tried AS (
  SELECT s.o, s.k, a.r, ((a.r + 1) * b.m / CAST(a.r * a.m AS DOUBLE) - s.rest) / (1 - s.rest) AS x
  FROM rests s JOIN having_n a ON a.o = s.o AND a.r <= s.k JOIN having_n b ON b.o = s.o AND b.r = a.r + 1 WHERE s.rest < 1),
fits AS (SELECT o, max(k) AS k FROM (SELECT o, k FROM tried GROUP BY o, k HAVING count(*) = k AND min(x) > 0 AND max(x) <= 1) GROUP BY o),
disc AS (SELECT t.o, t.r, t.x FROM tried t JOIN fits f ON f.o = t.o AND f.k = t.k),
sizes AS (SELECT sum(c) AS n, count(*) FILTER (c > 0) AS v, sum(c * coalesce(x, 1)) AS kept FROM singles LEFT JOIN disc ON o = 1 AND r = c),
shares AS (SELECT n, v, CASE WHEN kept < n * (1 - 1e-12) THEN n ELSE n + 1 END AS over, CASE WHEN kept < n * (1 - 1e-12) THEN n - kept ELSE 1 END AS unseen FROM sizes),
unigrams AS (SELECT w, c, CASE WHEN c > 0 THEN c * coalesce(x, 1) ELSE unseen END / over AS p FROM singles LEFT JOIN disc ON o = 1 AND r = c, shares),
bigrams AS (SELECT b.v, b.w, b.n, b.n * coalesce(d.x, 1) AS kept, u.p FROM pairs b JOIN unigrams u ON u.w = b.w LEFT JOIN disc d ON d.o = 2 AND d.r = b.n WHERE b.n > 0),
contexts AS (SELECT v, sum(n) AS total, sum(kept) AS kept, sum(p) AS low FROM bigrams GROUP BY v),
weights AS (
  SELECT v, CASE WHEN kept < total * (1 - 1e-12) THEN total ELSE total + 1 END AS over, CASE WHEN kept < total * (1 - 1e-12) THEN total - kept ELSE 1 END / (1 - low) AS unseen FROM contexts)
SELECT d.doc_id, d.held_out, count(*) AS n_tokens, count(*) FILTER (u.c > 0) AS n_known, CAST(min(s.n) AS BIGINT) AS train_tokens,
  round(sum(log10((u.c + 1) / CAST(s.n + s.v + 1 AS DOUBLE))), 6) AS base_score,
  round(sum(log10(CASE WHEN b.n > 0 THEN b.kept / k.over ELSE coalesce(k.unseen / k.over, 1) * u.p END)), 6) AS score
FROM d JOIN tokens t ON t.r = d.r JOIN unigrams u ON u.w = t.w LEFT JOIN bigrams b ON b.v = t.v AND b.w = t.w LEFT JOIN weights k ON k.v = t.v, shares s
GROUP BY d.r, d.doc_id, d.held_out
"""


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spelling_variants(word_counts(docs, one_deleted(F.col("doc_id"), 199), least_letters=6, least=5), ratio=5)


SQL["op13_spelling_variants"] = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents),
hexed AS (SELECT id, run, count(*) AS times, hex(encode(id || ':' || run)) AS x FROM runs WHERE length(run) >= 6 GROUP BY id, run),
hashed AS (SELECT run, times, {CRC_OF_X} AS h FROM hexed, crc),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, times FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
places AS (SELECT word, n, unnest(range(0, length(word))) AS p FROM words),
less AS (SELECT word, n, p, word[1:p] || word[p + 2:] AS rest FROM places),
pairs AS (
  SELECT a.word AS a, b.word AS b, b.n AS m FROM less a JOIN less b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON b.word = a.rest
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON b.word = a.rest),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY m DESC, b) AS k, count(*) OVER (PARTITION BY a) AS n_near FROM pairs),
formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.m >= 5 * w.n THEN r.b END AS form, CASE WHEN r.m >= 5 * w.n THEN r.m END AS form_n
  FROM words w LEFT JOIN ranked r ON r.a = w.word AND r.k = 1),
chain(word, root, next) AS (SELECT word, word, form FROM formed UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""

"""Queries of this subpackage over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, idfile, lm_score, minhash, packing, quality, quality_rules, repair, tokens, url_rules, whitening
from .shared import new_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), TOKENIZER)


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ids")
    idfile.write_ids(_table(spark, sf_dir, "documents"), TOKENIZER, path)
    return idfile.read_ids(spark, path, with_ids=False)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated_spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_items = F.size("items").cast("long").alias("n_items")
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", n_items, digest, (F.col("n_hit") > 0).alias("contaminated"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.cross_entropy_difference(lm_score.with_target(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")), TOKENIZER)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER).drop("ids")


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), TOKENIZER)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents stand for those of the pages with the same number: bad is not good, or toxic."""
    pages, labels = _table(spark, sf_dir, "pages").select("page_id", "url"), _table(spark, sf_dir, "labels")
    labelled = pages.join(labels, F.col("page_id") == F.col("doc_id")).select("url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_rules.judge_urls(pages, labelled)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damaged_and_repaired(_table(spark, sf_dir, "conversations"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality_classifier, op2_token_file, op3_decontamination, op4_lm_scoring, op5_packing, op6_chat_rotation, op7_near_dedup, op8_token_counts, op9_url_filter, op10_exact_dedup, op11_quality_rules, op12_conversation_repair, op13_embedding_whitening)
    return {f.__name__: f for f in own}


_OP3 = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, runs.n, item_id FROM runs JOIN win ON runs.n = win.n AND runs.k = win.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

_OP6 = """
WITH base AS (SELECT conv_id, turn, regexp_replace(coalesce(role, 'unknown'), '<\\|(im_start|im_end)\\|>', '<\\1>', 'g') AS speaker, regexp_replace(coalesce(text, ''), '<\\|(im_start|im_end)\\|>', '<\\1>', 'g') AS text FROM conversations),
voices AS (SELECT DISTINCT conv_id, speaker AS perspective FROM base WHERE speaker <> 'system'),
seen AS (SELECT b.*, perspective, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS as_role FROM base b JOIN voices v ON b.conv_id IS NOT DISTINCT FROM v.conv_id),
named AS (SELECT *, CASE WHEN as_role = 'user' THEN speaker END AS name FROM seen),
headed AS (SELECT *, '<|im_start|>' || as_role || CASE WHEN name IS NULL THEN '' ELSE ' name=' || name END || chr(10) AS head FROM named),
rendered AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS rendered FROM headed),
placed AS (SELECT *, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM rendered)
SELECT conv_id, perspective, turn, as_role, name, rendered, start,
  CAST(start + CASE WHEN as_role = 'assistant' THEN length(head) ELSE length(rendered) END AS BIGINT) AS mask_start,
  CAST(start + length(rendered) - CASE WHEN as_role = 'assistant' THEN 1 ELSE 0 END AS BIGINT) AS mask_end FROM placed
"""

_OP7 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = d.doc_id
"""

_OP10 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM t
"""


_STOP = ", ".join(f"'{x}'" for w in quality_rules.STOP_WORDS for x in dict.fromkeys((w, w[:1].upper() + w[1:])))
_OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
runs AS (SELECT id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM w WHERE len(w) >= 8)),
twice AS (SELECT id, i FROM runs QUALIFY count(*) OVER (PARTITION BY id, k) > 1),
again AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(generate_series(i, i + 7)) AS p FROM twice) GROUP BY id),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
  len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop_words, len(regexp_extract_all(t, '\p{{L}}[^\x20\x09-\x0D]*')) AS n_lettered_words,
  len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*(?:[-*+•][\x20\x09]|[0-9]+[.)])'))) AS n_listed_lines, len(list_filter(l, lambda x: regexp_matches(x, '(?:\.\.\.|…)[\x20\x09-\x0D]*\z'))) AS n_cut_lines
  FROM w LEFT JOIN again ON w.id = again.id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {quality_rules.rules_sql()} AS kept,
  list_filter([{", ".join(f"CASE WHEN NOT ({quality_rules.rule_sql(r)}) THEN '{r.name}' END" for r in quality_rules.RULES)}], lambda x: x IS NOT NULL) AS broken_rules FROM c
"""


def oracle_sql() -> dict[str, str]:
    """Operators 1, 2, 4, 5, 8, 9, 12 and 13 have none: models, coders, tokenizers, shortest paths and directions aren't SQL; tests hold them against brute force."""
    return {"op3_decontamination": _OP3, "op6_chat_rotation": _OP6, "op7_near_dedup": _OP7, "op10_exact_dedup": _OP10, "op11_quality_rules": _OP11}

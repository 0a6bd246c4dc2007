"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, language_id, line_dedup, near_dedup, packing, prefix_trie, substring_dedup, token_counts, tokens, topk_search, toxicity, url_filter, whitening
from lodestone.llm.scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def _op2_sql() -> str:
    quoted = lambda terms: ", ".join(f"('{t}', {w})" for t, w in terms)
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)
    return rf"""
WITH split AS (
  SELECT page_id, url,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, url, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM split),
parts AS (
  SELECT page_id, coalesce(url, '') AS url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
rules(rule_host, rule_path, verdict) AS (VALUES {rules}),
fits AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id),
terms(term, weight) AS (VALUES {quoted([*((t, 0) for t in url_filter.vocabulary()[0]), *url_filter.vocabulary()[1]])}),
hits AS (
  SELECT page_id, count(*) FILTER (weight = 0) AS n_strict, count(*) FILTER (weight > 0) AS n_soft, coalesce(sum(weight), 0) AS soft_weight
  FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\p{{L}}\p{{N}}]+')) AS term FROM parts)
  JOIN terms USING (term) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(h.n_strict, 0)::BIGINT AS n_strict, coalesce(h.n_soft, 0)::BIGINT AS n_soft, coalesce(h.soft_weight, 0)::BIGINT AS soft_weight,
       coalesce(f.verdict, CASE WHEN h.n_strict > 0 OR (h.n_soft >= {url_filter.SOFT_HITS} AND h.soft_weight >= {url_filter.SOFT_LIMIT}) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fits f USING (page_id) LEFT JOIN hits h USING (page_id)
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.drop_repeated_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_chunks", "n_dropped_bytes", "dropped", "copy_of", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeated AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.first AS dropped
  FROM keyed k LEFT JOIN repeated r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return topk_search.top_k(docs, docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text"), k=10)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), capacity=4096, end_id=1)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Scratch(spark, "token-store").path("ids")
    manifest = tokens.write_token_files(_table(spark, sf_dir, "documents"), root, end_id=2)
    return tokens.crc_of_ids(tokens.read_token_files(spark, root, manifest))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identified(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("segments").cast("long").alias("n_segments"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"), components=4, scale=256)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_near_dedup, op2_url_filter, op3_substring_dedup, op4_toxicity, op5_line_dedup, op6_topk_search, op7_best_fit_packing, op8_decontamination, op9_token_files, op10_token_counts, op11_language_id, op12_whitening, op13_prefix_trie)
}

SQL: dict[str, str] = {"op2_url_filter": _op2_sql(), "op5_line_dedup": OP5_SQL}

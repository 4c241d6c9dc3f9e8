"""Registered queries of the training-data operators, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import public_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_mix_min_cost_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_documents

    mixed = mix_documents(_table(spark, sf_dir, "documents"), F.array("source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op3_gru_log_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .gru_lm import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op4_nearest_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vptree import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import quality_rules

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules(_table(spark, sf_dir, "documents")).select(*names)


def op6_shard_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"), 24)


def op7_toxicity_char_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_pack_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))


def op9_jaccard_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tgm_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), 4, 85)


def op10_token_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wavelet import token_files

    return token_files(_table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_quality_nbsvm, op2_mix_min_cost_flow, op3_gru_log_likelihood, op4_nearest_vp_tree, op5_quality_rules, op6_shard_histogram_sort, op7_toxicity_char_nb, op8_pack_bin_slack, op9_jaccard_token_groups, op10_token_wavelet)}

_W = r"[^\x20\x09-\x0D]+"

#: The rules of rules.RULES restated in SQL over whole texts; same counts, same verdict.
_OP5 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), tri AS (
  SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri) WHERE n > 1
), cov AS (
  SELECT rid, count(DISTINCT p) AS n_repeat FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid
), m AS (
  SELECT w.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, len(l) AS n_lines,
         length(regexp_replace(t, '[^!]+', '', 'g')) AS n_excl,
         length(regexp_replace(t, '[\x00-@\x5B-`{-\x7F]+', '', 'g')) AS n_letters,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ell,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bul,
         len(list_filter(w, lambda x: list_contains([{stop}], lower(x)))) AS n_stop
  FROM w LEFT JOIN cov USING (rid)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         greatest(n_words, 1) AS g, greatest(n_lines, 1) AS h FROM m
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars / g >= 2.0 AND word_chars / g <= 15.0 AND n_symbols / g <= 0.1
       AND n_excl / g <= 0.3 AND n_letters / greatest(word_chars, 1) >= 0.6 AND n_dup_lines / h <= 0.5
       AND n_ell / h <= 0.3 AND n_bul / h <= 0.9 AND n_repeat_words / g <= 0.5 AND n_stop / g >= 0.02 AS kept
FROM f
"""


def _op5_sql() -> str:
    from .rules import STOP_WORDS

    return _OP5.replace("{stop}", ", ".join("'" + w + "'" for w in dict.fromkeys(STOP_WORDS)))


#: Shared shingles by an equality join, links, and the documents that links reach.
_OP9 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, there) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.there = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(there) AS component_id FROM r GROUP BY 1) c ON c.doc_id = d.doc_id
"""

ORACLE_SQL = {"op5_quality_rules": _op5_sql(), "op9_jaccard_token_groups": _OP9}

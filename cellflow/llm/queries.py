"""The queries of the text preparation operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellflow.llm import chat_format, decontamination, embedding_dedup, language_id, licenses, ngram_join, oracles, packing, repeat_removal, token_counts, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.deduplicate(table(spark, sf_dir, "embeddings"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return chat_format.format_preferences(turns, chat_format.neighbour_pairs(turns))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_removal.measure_repeats(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


OP8_SQL = """
WITH turns AS (
  SELECT conv_id, conv_id // 2 AS pair_id, conv_id % 2 AS side, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
         replace(coalesce(text, ''), '<|', '< |') AS body
  FROM conversations WHERE conv_id IS NOT NULL
), pairs AS (
  SELECT pair_id FROM turns GROUP BY pair_id HAVING count(DISTINCT side) = 2
), common AS (
  SELECT p.pair_id, coalesce(min(s.pos) - 1, 0) AS prompt_turns
  FROM pairs p LEFT JOIN (
    SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.pos, r.pos) AS pos
    FROM (SELECT * FROM turns WHERE side = 0) c FULL JOIN (SELECT * FROM turns WHERE side = 1) r
      ON c.pair_id = r.pair_id AND c.pos = r.pos
    WHERE c.pos IS NULL OR r.pos IS NULL OR c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text
  ) s ON s.pair_id = p.pair_id GROUP BY p.pair_id
), sized AS (
  SELECT p.pair_id, p.prompt_turns FROM common p
), shown AS (
  SELECT t.*, s.prompt_turns, '<|' || coalesce(t.role, '') || '|>' || chr(10) || t.body || '<|end|>' || chr(10) AS line,
         t.pos > s.prompt_turns AS later
  FROM turns t JOIN sized s ON s.pair_id = t.pair_id
), placed AS (
  SELECT *, sum(length(line)) OVER (PARTITION BY conv_id, later ORDER BY pos) AS stop FROM shown
)
SELECT pair_id, pair_id * 2 AS chosen_id, pair_id * 2 + 1 AS rejected_id, prompt_turns,
  coalesce(string_agg(line, '' ORDER BY pos) FILTER (WHERE side = 0 AND NOT later), '') AS prompt,
  coalesce(string_agg(line, '' ORDER BY pos) FILTER (WHERE side = 0 AND later), '') AS chosen,
  coalesce(string_agg(line, '' ORDER BY pos) FILTER (WHERE side = 1 AND later), '') AS rejected,
  coalesce(string_agg((stop - length(body) - 8) || '-' || stop, ',' ORDER BY pos) FILTER (WHERE side = 0 AND later AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((stop - length(body) - 8) || '-' || stop, ',' ORDER BY pos) FILTER (WHERE side = 1 AND later AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY pair_id, prompt_turns
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_license_scan": oracles.OP3,
        "op5_embedding_dedup": oracles.OP5,
        "op6_ngram_jaccard_join": oracles.OP6,
        "op8_chat_preferences": OP8_SQL,
        "op10_suffix_array_dedup": oracles.OP10,
    }

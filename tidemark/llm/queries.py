"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import alignment, chat, decontaminate, licences, near, packing, pii, pitman_yor, prefix_trie, quality_rules, ranking, token_counts, warc
from tidemark.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"))


def op3_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    trial = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return chat.digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(trial))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(quality_rules.ledger(table(spark, sf_dir, "documents")))


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align_documents(table(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.regrown(table(spark, sf_dir, "conversations")))


def queries() -> dict:
    return {f.__name__: f for f in (op1_license_scan, op2_pitman_yor, op3_bradley_terry, op4_contextual_pii, op5_lsh_forest, op6_chat_format, op7_best_fit_packing, op8_quality_ledger, op9_warc_round_trip, op10_template_decontamination, op11_cross_tokenizer_alignment, op12_token_counts, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licences.ORACLE_SQL, "op6_chat_format": chat.ORACLE_SQL, "op8_quality_ledger": quality_rules.ORACLE_SQL, "op9_warc_round_trip": WARC_SQL, "op13_prefix_trie": prefix_trie.ORACLE_SQL}


WARC_SQL = """
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN newest END AS refers_to FROM m"""

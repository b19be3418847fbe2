"""The registered queries opN_<name>: each operator with production parameters on its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerstone.llm import bpe, chat, embedding_dups, mixing, quality, secrets, sharding, simhash, substring, toxicity

#: The tokenizer's file, at the same place on all executors.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source")


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op5_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), WORD_BPE, give_ids=False)


def op6_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(_table(spark, sf_dir, "conversations"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"))


def op8_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.link_embeddings(_table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.assess(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_mix_sources, op3_hilbert_shards, op4_toxicity, op5_bpe_chunks, op6_chat_perspectives, op7_substring_dedup, op8_embedding_links, op9_quality, op10_simhash_components)}

ORACLES = {
    "op6_chat_perspectives": r"""
        WITH said AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
        sides AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
        seen AS (
            SELECT s.conv_id, p.perspective, s.turn, s.speaker, s.text, s.speaker = p.perspective AS trained,
                   '<|' || CASE WHEN s.speaker = p.perspective THEN 'assistant' WHEN s.speaker = 'system' THEN 'system' ELSE 'user name=' || s.speaker END || '|>' || chr(10) || s.text || chr(10) AS rendered
            FROM said s JOIN sides p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
        placed AS (
            SELECT *, row_number() OVER w - 1 AS position, CAST(sum(length(rendered)) OVER w AS BIGINT) AS char_end
            FROM seen WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING))
        SELECT conv_id, perspective, position, turn, speaker, rendered, trained, CAST(char_end - length(rendered) AS BIGINT) AS char_start, char_end FROM placed
    """,
}

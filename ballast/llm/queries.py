"""The registered queries of the training-data operators and the SQL that must agree with them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ballast.llm import oracles
from ballast.llm.centroids import centroid_clusters
from ballast.llm.common import table
from ballast.llm.conversations import repair_conversations
from ballast.llm.fingerprints import fingerprints
from ballast.llm.html_text import extract
from ballast.llm.lattice import near_vectors
from ballast.llm.minhash import near_duplicates
from ballast.llm.mixing import mix
from ballast.llm.phrase_dedup import phrase_dedup
from ballast.llm.sharding import shard_documents
from ballast.llm.suffix_dedup import suffix_dedup
from ballast.llm.token_counts import count_tokens
from ballast.llm.toxicity import toxicity
from ballast.llm.vector_packing import pack_documents


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup(table(spark, sf_dir, "documents"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings")).drop("fetched")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


def op13_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_phrase_dedup, op3_html_extraction, op4_minhash_dedup, op5_vector_packing, op6_fingerprints, op7_token_counts, op8_lattice_dedup, op9_toxicity, op10_suffix_dedup, op11_centroid_clustering, op12_conversation_repair, op13_feistel_sharding)}
ORACLES = {"op2_phrase_dedup": oracles.PHRASES, "op4_minhash_dedup": oracles.NEAR, "op8_lattice_dedup": oracles.VECTORS, "op10_suffix_dedup": oracles.BYTES, "op11_centroid_clustering": oracles.CENTROIDS, "op12_conversation_repair": oracles.REPAIR, "op13_feistel_sharding": oracles.SHARDS}

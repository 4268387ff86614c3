"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, jaccard, topk, vector_join
from .alignment import align_tokens
from .bpe import bpe_digests
from .common import read_table
from .lm import score_texts
from .packing import pack_documents
from .secrets import secret_scan
from .simhash import document_fingerprints
from .token_files import token_round_trip
from .toxicity import toxicity
from .whitening import whiten


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read_table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(read_table(spark, sf_dir, "conversations"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read_table(spark, sf_dir, "documents"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(read_table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.embedding_links(read_table(spark, sf_dir, "embeddings"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(read_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(read_table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_scans, op2_chat_formatting, op3_bpe_round_trip, op4_exact_topk, op5_packing, op6_embedding_near_dedup, op7_lm_scoring, op8_ngram_jaccard, op9_token_files, op10_toxicity, op11_document_fingerprints, op12_embedding_whitening, op13_token_alignment)}
ORACLES: dict[str, str] = {"op2_chat_formatting": chat.ORACLE, "op4_exact_topk": topk.ORACLE, "op6_embedding_near_dedup": vector_join.ORACLE, "op8_ngram_jaccard": jaccard.ORACLE}

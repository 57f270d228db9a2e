"""Registered queries of the corpus operators, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, chat, decontaminate, mixing, negatives, ranked
from .common import documents, table
from .jaccard import jaccard_components
from .phrases import repeated_phrases
from .pieces import encode_digests, read_model
from .pii import KINDS, counted, find_personal_data, listed
from .pivots import near_duplicates
from .quality import QualityModel
from .stages import MODEL, POWER, SEED
from .toxicity import toxicity

SPAN, SHINGLE, SIMILARITY, COSINE = 50, 5, 80, 0.93
QUERY_EVERY, NEIGHBOURS = 50, 5
ITEM_SPAN, RANKED = 10, 10


def op1_chat_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, folder, "conversations"))


def op2_bayes_quality(spark: SparkSession, folder: str) -> DataFrame:
    return QualityModel(documents(spark, folder), table(spark, folder, "labels"), F.col("source"), F.col("lang")).table()


def op3_piece_encoding(spark: SparkSession, folder: str) -> DataFrame:
    return encode_digests(documents(spark, folder), read_model(public_tokenizers.path(MODEL)))


def op4_recurrent_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(documents(spark, folder), table(spark, folder, "labels"))


def op5_poisson_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, folder), seed=SEED, power=POWER)


def op6_repeated_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_phrases(documents(spark, folder), SPAN).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_contextual_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = find_personal_data(documents(spark, folder).select("doc_id", "text"))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), *[counted(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op8_pivot_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "embeddings"), COSINE)


def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(documents(spark, folder), SHINGLE, SIMILARITY)


def op10_projected_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), QUERY_EVERY, NEIGHBOURS)


def op11_wu_manber_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contaminated(documents(spark, folder), table(spark, folder, "benchmark"), ITEM_SPAN)
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array("items")), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def op12_limited_accumulators(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.ranked_search(documents(spark, folder), table(spark, folder, "benchmark"), RANKED)


def op13_strassen_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, folder, "embeddings"), label, QUERY_EVERY)


QUERIES = {f.__name__: f for f in (op1_chat_perspectives, op2_bayes_quality, op3_piece_encoding, op4_recurrent_toxicity, op5_poisson_mixing, op6_repeated_phrases, op7_contextual_pii,
                                op8_pivot_near_duplicates, op9_jaccard_join, op10_projected_neighbours, op11_wu_manber_decontamination, op12_limited_accumulators, op13_strassen_negatives)}
ORACLES = {"op1_chat_perspectives": chat.ORACLE, "op5_poisson_mixing": mixing.oracle(SEED, POWER), "op11_wu_manber_decontamination": decontaminate.oracle(ITEM_SPAN),
           "op12_limited_accumulators": ranked.oracle(RANKED), "op13_strassen_negatives": negatives.oracle(QUERY_EVERY)}

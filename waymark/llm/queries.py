"""The queries of the corpus operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import bpe, decontaminate, lm_scoring, media, merkle, mixing, ngram_join, oracles, phrases, pii, quality, suffix_dedup, url_filter, vector_codes
from waymark.llm.common import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score_documents(_table(spark, sf_dir, "documents"))
    return scored.withColumn("log_score", F.round("log_score", 4))


def lm_scoring_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name under which order 3 was first registered; op1_lm_scoring is of order 3 too now."""
    return op1_lm_scoring(spark, sf_dir)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(_table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = pii.find(docs, ["doc_id"], pii.learn(docs))
    n_spans = F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long").alias("n_spans")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", n_spans)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("m_domain").alias("domain"), "lang", "source", F.col("m_tokens").alias("n_tokens"), F.col("m_copies").alias("n_copies"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = media.media_columns(_table(spark, sf_dir, "documents"), ["doc_id"])
    return made.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("cosine_hash")).alias("feature"),
    )


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), "n_links")


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(_table(spark, sf_dir, "documents"))


def merkle_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name under which leaves by content were first registered; op7_merkle has them too now."""
    return op7_merkle(spark, sf_dir)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", F.col("q_ratio").alias("log_ratio"), "q_weight", F.col("q_kept").alias("kept"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.dedup(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.compress(_table(spark, sf_dir, "embeddings"))
    return coded.select("row.vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_url_filter": op2_url_filter,
    "op3_pii": op3_pii,
    "op4_mixing": op4_mixing,
    "op5_media": op5_media,
    "op6_ngram_join": op6_ngram_join,
    "op7_merkle": op7_merkle,
    "op8_bpe": op8_bpe,
    "op9_quality": op9_quality,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_vector_codes": op12_vector_codes,
    "op13_decontamination": op13_decontamination,
    "lm_scoring_order3": lm_scoring_order3,
    "merkle_content": merkle_content,
}

ORACLES = {"op1_lm_scoring": lm_scoring.ORACLE, "lm_scoring_order3": lm_scoring.ORACLE, "op2_url_filter": oracles.URL_FILTER, "op4_mixing": oracles.MIXING, "op6_ngram_join": oracles.NGRAM_JOIN, "op7_merkle": oracles.MERKLE, "merkle_content": oracles.MERKLE, "op10_suffix_dedup": oracles.SUFFIX_DEDUP,
           "op11_phrase_mining": oracles.PHRASES, "op12_vector_codes": oracles.VECTOR_CODES, "op13_decontamination": oracles.DECONTAMINATION}

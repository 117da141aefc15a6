"""The queries of this package, each over its whole tables, and their DuckDB counterparts where SQL can say them."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestlake.llm import merkle, oracles, secrets
from digestlake.llm import quality as knn
from digestlake.llm.decontaminate import contamination
from digestlake.llm.encoding import encoding_digests
from digestlake.llm.labelled import fold, labels_of
from digestlake.llm.lm import lm_scores
from digestlake.llm.near_dup import near_duplicates
from digestlake.llm.substring_dedup import kept_digests
from digestlake.llm.tables import documents, table
from digestlake.llm.token_counts import token_counts
from digestlake.llm.toxicity import toxicity, train

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), TOKENIZER)


def op8_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(documents(spark, sf_dir), TOKENIZER)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = labels_of(table(spark, sf_dir, "labels"), "toxic").where(fold(4) != 2)
    scored = toxicity(docs, train(docs, labels))
    return scored.select("doc_id", (F.coalesce(fold(4), F.lit(0)) == 2).alias("held_out"), "score", "predicted")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = labels_of(table(spark, sf_dir, "labels"), "quality").where(fold(5) != 0)
    scored = knn.quality(docs, knn.train(docs, labels))
    return scored.select("doc_id", (F.coalesce(fold(5), F.lit(1)) == 0).alias("held_out"), "score", "predicted")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(documents(spark, sf_dir))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to three decimals, so that the order of summation does not show."""
    scored = lm_scores(documents(spark, sf_dir))
    return scored.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 3).alias("mean_log_score"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compared(documents(spark, sf_dir))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=4, percent=80)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_digests(documents(spark, sf_dir))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_lm_scores": op2_lm_scores,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_quality": op5_quality,
    "op6_secret_scans": op6_secret_scans,
    "op7_fingerprints": op7_fingerprints,
    "op8_bpe_encode_decode": op8_bpe_encode_decode,
    "op9_decontaminate": op9_decontaminate,
    "op10_toxicity": op10_toxicity,
}
ORACLES: dict[str, str] = {
    "op2_lm_scores": oracles.LM_SCORES,
    "op3_substring_dedup": oracles.REPEATS,
    "op4_near_duplicates": oracles.NEAR_DUPLICATES,
    "op6_secret_scans": secrets.ORACLE,
    "op9_decontaminate": oracles.DECONTAMINATION,
}

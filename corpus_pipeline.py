"""A corpus pipeline: toxicity, near duplicates, benchmark decontamination, secrets, encoding.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; docs are what its predecessor kept. All but the last give the columns
of documents. run() applies them in turn to the whole documents table, each stage's rows written once under the shared
folder and read again by the next.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from digestlake.llm import decontaminate, encoding, near_dup, secrets
from digestlake.llm import toxicity as toxic
from digestlake.llm.labelled import fold, labels_of
from digestlake.llm.tables import documents, table
from digestlake.session import code_on_workers, stash

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.3 or more, as learnt from the labels of documents among docs outside of the held-out fold."""
    labels = labels_of(table(spark, sf_dir, "labels"), "toxic").where(fold(4) != 2)
    return toxic.without_toxic(docs, toxic.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least doc_id, of each group linked at a similarity of 0.8 on five-word shingles."""
    return near_dup.representatives(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window of a benchmark item."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, with every secret in their texts masked."""
    return secrets.masked(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), and decoded_sha256 (of the decoded text) of every document."""
    return encoding.encoded_ids(docs, TOKENIZER)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_masking", secret_masking),
    ("bpe_encoding", bpe_encoding),
]

#: SQL cannot express a learnt score or byte-pair merges; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    code_on_workers(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

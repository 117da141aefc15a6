"""Bounded samples of labelled rows, and which rows are held out."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """doc_id and label 0/1. Rows without either are dropped; of several labels of one document the largest holds."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, balanced: bool = False) -> DataFrame:
    """turn, doc_id, label, text of at most rows labelled documents; balanced: half of either label where there are as many.

    Which ones, and in which turn, is by a hash of doc_id. The ids, bounded by rows, are broadcast. A document whose
    rows repeat counts with its smallest text.
    """
    turned = labels.withColumn("turn", F.xxhash64("doc_id"))
    first = lambda df, n: df.orderBy("turn", "doc_id").limit(n)
    if balanced:
        chosen = first(turned.where("label = 0"), rows // 2).unionByName(first(turned.where("label = 1"), rows // 2))
    else:
        chosen = first(turned, rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("turn").alias("turn"), F.min("label").alias("label"), F.min("text").alias("text")).select("turn", "doc_id", "label", "text")

"""Reading the corpus tables, and what the operators agree on about rows.

Operators take any DataFrame with a doc_id and a text column, ignore every other column whatever its
name, read a null text as an empty one, and keep repeated rows as rows of their own unless they say otherwise.
"""

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestlake.session import small_batches


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def slices(items: list, weight: Callable, most: int = 2 << 20) -> Iterator[list]:
    """Consecutive items of at most that weight together; an item above it comes alone."""
    some, total = [], 0
    for x in items:
        w = weight(x)
        if some and total + w > most:
            yield some
            some, total = [], 0
        some.append(x)
        total += w
    if some:
        yield some

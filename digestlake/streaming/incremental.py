"""Rescans and answers as streams: files as they arrive, misses that expire by event time."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestlake.operators.observations import MISS_SECONDS


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of files with their digests; empty files are left out."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(folder)
    return files.where("length > 0").select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha1("content").alias("sha1"), F.sha2("content", 256).alias("sha256"))


def into_state(files: DataFrame, state: str, checkpoint: str):
    """Appends each batch to the state table, a batch in a folder of its own, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, state: str) -> DataFrame:
    """The newest row of each path."""
    rows = spark.read.parquet(state)
    newest = F.max_by(F.struct("size", "mtime", "sha1", "sha256"), F.struct("batch", "mtime"))
    return rows.groupBy("path").agg(newest.alias("x")).select("path", "x.*")


def believed_misses(answers: DataFrame) -> DataFrame:
    """A stream of answers (backend, coordinate, hit, fetched_at): how many misses of each backend fall in each span of belief, each
    coordinate counted once; late ones are dropped after it. It is written in append mode."""
    span = f"{MISS_SECONDS} seconds"
    misses = answers.where("not hit").withWatermark("fetched_at", span).select(F.window("fetched_at", span).alias("window"), "backend", "coordinate")
    return misses.dropDuplicates(["window", "backend", "coordinate"]).groupBy("window", "backend").agg(F.count("coordinate").alias("misses"))

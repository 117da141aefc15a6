"""Settings that every operator shares: where workers find the code, where intermediate tables go."""

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROOT = str(Path(__file__).resolve().parent.parent)


def code_on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package when the session did not start with it on PYTHONPATH.

    A cluster ships the package with --py-files; this covers sessions started from another folder.
    """
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)


def small_batches(spark: SparkSession, rows: int = 2000, megabytes: int = 8) -> None:
    """Bound what one Arrow batch holds, so that a run of very long texts cannot fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. A local session without the setting gets a
    folder of its own; on a cluster, whose machines see different ones, that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = os.path.join(tempfile.gettempdir(), "digestlake-shared")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet under the shared folder and read it back: lineage ends here.

    A lost executor costs nothing that is already written. The shuffle files of the writing query, which nothing reads
    again, go when it ends. discard() removes the table once what was made of it is written; else it belongs to the run, as the shared folder does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    made = spark.read.schema(df.schema).parquet(path)
    made.stash_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Remove stashed tables that nothing will read again."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stash_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

"""Key-sorted tables: written in shards by the first nibble of the key, read with pruning by shard and key, complete once marked."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestlake.functions.digests import shard

REVISION = "_revision"


def write_sorted(rows: DataFrame, path: str, key: str, partitions: int = 16) -> None:
    """Sorted by key within its shard: a reader's statistics then prune row groups and pages. Null keys lie in a last shard."""
    placed = rows.withColumn("shard", shard(F.col(key)))
    placed.repartitionByRange(partitions, "shard", key).sortWithinPartitions("shard", key).write.partitionBy("shard").parquet(path)


def write_weak_map(rows: DataFrame, path: str, weak: str, strong: str) -> None:
    from digestlake.operators.etl import weak_map

    pairs = weak_map(rows, weak, strong)
    pairs.repartitionByRange(weak).sortWithinPartitions(weak, strong).write.parquet(path)


def mark(spark: SparkSession, path: str, revision: str, files: int) -> None:
    """The marker is written last: a table without one is not complete."""
    spark.createDataFrame([(revision, files)], "revision string, files long").coalesce(1).write.mode("overwrite").json(f"{path}/{REVISION}")


def revision(spark: SparkSession, path: str) -> str | None:
    """The revision of a complete table; none where the marker is not there. Other errors of the store are raised."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{REVISION}")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        return None
    row = spark.read.schema("revision string, files long").json(f"{path}/{REVISION}").first()
    return row["revision"] if row else None


def opened(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a complete table; one that is not there has none to give, one without its marker is an error."""
    if revision(spark, path) is None:
        raise ValueError(f"{path} has no {REVISION}: it is not there, or was not written to the end")
    return spark.read.parquet(path)


def read_keys(spark: SparkSession, path: str, key: str, digests: list[str]) -> DataFrame:
    """Rows of a complete table for a few keys: a filter on shard and key that Spark pushes into the scan."""
    rows = opened(spark, path)
    shards = sorted({d[:1] for d in digests})
    return rows.where(F.col("shard").isin(shards) & F.col(key).isin(list(digests))).drop("shard")


def join_keys(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows for many keys (a column named as the key): joined on shard and key, so that dynamic pruning drops shards that nobody asks for."""
    asked = wanted.select(key).distinct().withColumn("shard", shard(F.col(key)))
    return table.join(asked, ["shard", key]).drop("shard")


def folder(spark: SparkSession, path: str):
    """The store's file system and its own form of a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def published(spark: SparkSession, staged: str, target: str) -> None:
    """Puts a complete staged table in the place of the target. The one before goes aside first, and comes back if the swap fails."""
    if revision(spark, staged) is None:
        raise ValueError(f"{staged} has no {REVISION}: it was not written to the end")
    fs, new = folder(spark, staged)
    here, aside = folder(spark, target)[1], folder(spark, target + ".before")[1]
    if fs.exists(here):
        fs.delete(aside, True)
        if not fs.rename(here, aside):
            raise OSError(f"{target} cannot be put aside")
    if not fs.rename(new, here):
        if fs.exists(aside):
            fs.rename(aside, here)
        raise OSError(f"{staged} cannot be moved to {target}")
    fs.delete(aside, True)


def listed(spark: SparkSession, root: str) -> list[dict]:
    """name, revision (none if not complete), files and bytes of each table in a folder, by name; none where there is no folder."""
    fs, at = folder(spark, root)
    found = []
    for entry in fs.listStatus(at) if fs.exists(at) else []:
        if entry.isDirectory():
            name, whole = entry.getPath().getName(), fs.getContentSummary(entry.getPath())
            found.append({"name": name, "revision": revision(spark, f"{root}/{name}"), "files": whole.getFileCount(), "bytes": whole.getLength()})
    return sorted(found, key=lambda f: f["name"])


def dropped(spark: SparkSession, root: str, name: str) -> bool:
    """Removes one table of a folder, its marker first; whether it was there. A name that leads elsewhere is refused."""
    if not name or "/" in name or name.startswith("."):
        raise ValueError(f"{name!r} names no table")
    fs, at = folder(spark, f"{root}/{name}")
    fs.delete(folder(spark, f"{root}/{name}/{REVISION}")[1], True)
    return fs.delete(at, True)


def columns_of(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A few columns, such as digests, of a columnar dump in ORC; the others are not read."""
    return spark.read.orc(path).select(*columns)


#: Datasets by the schemes that can be looked up in them.
DATASETS = {
    "scholarly": ["md5", "sha1", "sha256"], "tarballs": ["md5", "sha256"], "census": ["md5", "sha1"], "debs": ["md5", "sha1", "sha256"],
    "media": ["md5", "sha1", "sha256", "sha512"], "rpm-files": ["md5", "sha1", "sha256", "sha512"],
}


def datasets_for(scheme: str) -> list[str]:
    return [name for name, schemes in DATASETS.items() if scheme in schemes]


def gate(asked: DataFrame, filters: dict[str, tuple]) -> DataFrame:
    """asked (dataset, scheme, digest) without the keys that their dataset's own filter denies; without a filter all pass.

    filters: dataset -> (words DataFrame, k, m), each built with the dataset it gates.
    """
    from digestlake.functions import bloom
    from digestlake.functions.digests import bloom_key

    kept = asked.where(~F.col("dataset").isin(list(filters))) if filters else asked
    for name, (words, k, m) in filters.items():
        keyed = asked.where(F.col("dataset") == name).withColumn("_key", bloom_key(F.col("scheme"), F.col("digest")))
        kept = kept.unionByName(bloom.probed(keyed, "_key", words, k, m, "_hit").where("_hit or _key is null").drop("_key", "_hit"))
    return kept


def findings_json(rows: DataFrame) -> DataFrame:
    """One JSON object a row, for line-delimited output."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def parsed_findings(text: str) -> list:
    """A stored answer: a list of findings, or a single one."""
    value = json.loads(text)
    return value if isinstance(value, list) else [value]

"""What has been asked and answered: hits that stay, misses that expire, and answers found by any digest they state."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: a miss is believed for three days.
MISS_SECONDS = 3 * 24 * 3600


def freshness(hit: Column, fetched_at: Column, now: Column, ttl: int = MISS_SECONDS) -> Column:
    """hit, miss while it is believed, absent once it has expired."""
    return F.when(hit, "hit").when(F.unix_timestamp(now) - F.unix_timestamp(fetched_at) < ttl, "miss").otherwise("absent")


def probe(asked: DataFrame, store: DataFrame, now: Column, ttl: int = MISS_SECONDS) -> DataFrame:
    """asked (backend, coordinate) with state: hit, miss or absent."""
    met = asked.join(store.select("backend", "coordinate", "hit", "fetched_at"), ["backend", "coordinate"], "left")
    return met.select("backend", "coordinate", F.coalesce(F.when(F.col("hit").isNotNull(), freshness(F.col("hit"), F.col("fetched_at"), now, ttl)), F.lit("absent")).alias("state"))


def upserted(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """The store after fresh answers: each (backend, coordinate) once, with its newest answer. An empty answer is a definite miss."""
    newest = Window.partitionBy("backend", "coordinate").orderBy(F.desc("fetched_at"), F.desc("_new"))
    both = store.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "_new")


def coordinate_index(store: DataFrame) -> DataFrame:
    """scheme, digest, backend, coordinate: every digest that a hit states, beside the coordinate that was asked."""
    return store.where("hit").select("backend", "coordinate", F.explode("coords").alias("c")).select("c.scheme", "c.digest", "backend", "coordinate").distinct()


def findings_for(asked: DataFrame, index: DataFrame, store: DataFrame) -> DataFrame:
    """Distinct findings that state any of the asked digests (scheme, digest)."""
    met = index.join(asked, ["scheme", "digest"]).select("scheme", "digest", "backend", "coordinate")
    return met.join(store.where("hit").select("backend", "coordinate", "finding"), ["backend", "coordinate"]).select("scheme", "digest", "backend", "finding").distinct()


def rescanned(listing: DataFrame, state: DataFrame, rehash: bool = False) -> DataFrame:
    """listing with action: hash for new or changed files, reuse for those of equal size and time; empty files are left out."""
    known = state.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    same = (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime"))
    met = listing.where("size > 0").join(known, "path", "left")
    return met.withColumn("action", F.when(F.coalesce(same, F.lit(False)) & F.lit(not rehash), "reuse").otherwise("hash")).drop("_size", "_mtime")


def stale(state: DataFrame, seen: DataFrame, complete: bool = True) -> DataFrame:
    """Indexed paths that a complete walk did not see; an incomplete one says nothing."""
    return state.join(seen.select("path"), "path", "left_anti") if complete else state.limit(0)


def committed(state: DataFrame, fresh: DataFrame, gone: DataFrame) -> DataFrame:
    """The state after a scan: fresh rows replace theirs, gone ones go."""
    kept = state.join(fresh.select("path"), "path", "left_anti").join(gone.select("path"), "path", "left_anti")
    return kept.unionByName(fresh.select(*state.columns))


def stats(state: DataFrame) -> DataFrame:
    """files, bytes: how much the index holds; an empty one holds nothing of both."""
    return state.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def located(state: DataFrame, digest: str) -> DataFrame:
    """Files with this sha1 or sha256."""
    return state.where((F.col("sha1") == digest) | (F.col("sha256") == digest))


def under(state: DataFrame, root: str) -> DataFrame:
    """Files below a directory, as a range of paths, so that a table sorted by path is pruned."""
    low = root.rstrip("/") + "/"
    return state.where((F.col("path") >= low) & (F.col("path") < low[:-1] + "0"))


def replayable(done: DataFrame, members: DataFrame, version: int) -> DataFrame:
    """Containers whose stored members can stand for a walk: of this version, and as many as their marker says.

    done: csha256, descent, members, schema_version. members: csha256, descent, idx.
    """
    there = members.groupBy("csha256", "descent").agg(F.count("*").alias("there"))
    met = done.where(F.col("schema_version") == version).join(there, ["csha256", "descent"], "left")
    return met.where(F.coalesce("there", F.lit(0)) == F.col("members")).drop("there")


def verified(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """path, status of each file of a manifest (path, size, sha256) against what is there: ok, missing, size, hash, extra."""
    there = listing.select("path", F.col("size").alias("t_size"), F.col("sha256").alias("t_sha256"))
    both = manifest.select("path", F.col("size").alias("m_size"), F.col("sha256").alias("m_sha256")).join(there, "path", "full_outer")
    status = F.when(F.col("m_size").isNull(), "extra").when(F.col("t_size").isNull(), "missing").when(F.col("m_size") != F.col("t_size"), "size").when(F.col("m_sha256") != F.col("t_sha256"), "hash").otherwise("ok")
    return both.select("path", status.alias("status"))

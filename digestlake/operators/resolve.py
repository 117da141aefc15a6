"""The two calls that a user makes: what is known of some digests, and what is known of some files."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestlake.functions import bloom
from digestlake.functions.digests import bloom_key, parse_coord
from digestlake.operators import identity, verdicts
from digestlake.session import stash
from digestlake.sources import descent


def resolve(asked: DataFrame, findings: DataFrame, hops: int = identity.MAX_HOPS, cap: int | None = identity.MAX_EVIDENCE) -> tuple[DataFrame, DataFrame]:
    """What findings say of written digests.

    asked: query_id, text (a digest in any spelling). findings: finding_id, coords (array of struct<scheme, digest>). Gives two tables:
    one row a query (query_id, scheme, digest, error, clusters, collision, truncated), those that cannot be read included,
    with their error; and the clusters of each query (see identity.clusters).
    """
    read = stash(asked.select("query_id", parse_coord(F.col("text")).alias("c")).select("query_id", "c.scheme", "c.digest", "c.error"), "asked")
    queried = read.where("error is null").select("query_id", "scheme", "digest")
    evidence = stash(identity.walk(queried, findings, hops, cap), "evidence")
    found = stash(identity.clusters(evidence, findings, queried), "clusters")
    status = identity.statuses(found, evidence, queried, cap)
    told = read.join(status, "query_id", "left")
    return told.select("query_id", "scheme", "digest", "error", F.coalesce("clusters", F.lit(0)).alias("clusters"), F.coalesce("collision", F.lit(False)).alias("collision"), F.coalesce("truncated", F.lit(False)).alias("truncated")), found


def scan(files: DataFrame, witnesses: DataFrame, filters: dict[str, tuple] | None = None, policy: str = "full") -> DataFrame:
    """Every file and every member below it, with its class, and for containers the counts of what they hold.

    files: path, content. witnesses: row_id, sha1, sha256 (either may be null) as key-sorted tables or findings state them. filters:
    name -> (words, k, m), see functions.bloom. Gives root, member_id, parent_id, depth, path, kind, size, sha256, identified, consistent, matched
    (names of filters that probably hold it), class, note, and total, known, unknown, floor (null for leaves). verdicts.summary sums it up.
    """
    key = F.concat_ws("#", "root", F.col("member_id").cast("string"))
    members = stash(descent.descend(files, policy).withColumns({"file_id": key, "up_id": F.when(F.col("parent_id").isNotNull(), F.concat_ws("#", "root", F.col("parent_id").cast("string")))}), "members")
    told = verdicts.tiers(members, witnesses)
    matched = []
    for n, (name, (words, k, m)) in enumerate(sorted((filters or {}).items())):
        told = told.withColumn(f"key{n}", bloom_key(F.lit("sha256"), F.col("sha256")))
        told = bloom.probed(told, f"key{n}", words, k, m, f"hit{n}").drop(f"key{n}")
        matched.append(F.when(F.col(f"hit{n}"), F.lit(name)))
    names = F.filter(F.array(*matched), lambda x: x.isNotNull()) if matched else F.array().cast("array<string>")
    classed = told.withColumn("matched", names)
    classed = stash(classed.withColumn("class", verdicts.classify(F.col("sha256").isNotNull(), F.col("size"), F.col("identified") > 0, F.col("consistent") > 0, F.size("matched") > 0)), "classed")
    held = verdicts.rollups(classed.select(F.col("file_id").alias("member_id"), F.col("up_id").alias("parent_id"), "class"))
    whole = classed.join(held.withColumnRenamed("container_id", "file_id"), "file_id", "left")
    return whole.select("root", "member_id", "parent_id", "depth", "path", "kind", "size", "sha256", "identified", "consistent", "matched", "class", "note", "total", "known", "unknown", "floor")

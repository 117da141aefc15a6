"""Verdicts on files and members, what containers hold by them, tree order, summaries."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from digestlake.functions.digests import IDENTITY_FLOOR
from digestlake.session import stash

#: Fixed value: containers lie within containers so deep at most.
MAX_DEPTH = 16


def classify(has_digests: Column, size: Column, identified: Column, consistent: Column, matched: Column) -> Column:
    """The first that holds: node, floor, identified, consistent, membership, unknown."""
    return F.when(~has_digests, "node").when(size < IDENTITY_FLOOR, "floor").when(identified, "identified").when(consistent, "consistent").when(matched, "membership").otherwise("unknown")


def tiers(files: DataFrame, rows: DataFrame) -> DataFrame:
    """file columns with identified and consistent: how many witness rows say so.

    files: file_id, sha1, sha256. rows: row_id, sha1, sha256, either may be null. A row that states the file's sha256 identifies
    it; one that states its sha1 and no other sha256 is consistent with it; one that contradicts it says nothing.
    """
    strong = files.join(rows.where("sha256 is not null").select("row_id", "sha256"), "sha256").groupBy("file_id").agg(F.countDistinct("row_id").alias("identified"))
    weak = files.select("file_id", "sha1", F.col("sha256").alias("own")).join(rows.where("sha1 is not null").select("row_id", "sha1", "sha256"), "sha1")
    weak = weak.where("sha256 is null").groupBy("file_id").agg(F.countDistinct("row_id").alias("consistent"))
    told = files.join(strong, "file_id", "left").join(weak, "file_id", "left")
    return told.withColumns({"identified": F.coalesce("identified", F.lit(0)), "consistent": F.coalesce("consistent", F.lit(0))})


def ancestors(members: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """member_id, ancestor_id for every ancestor of every member: one join for each level that is there, written before the next."""
    parents = stash(members.where("parent_id is not null").select("member_id", F.col("parent_id").alias("ancestor_id")), "parents")
    up = parents.select(F.col("member_id").alias("ancestor_id"), F.col("ancestor_id").alias("next"))
    step, every = parents, parents
    for _ in range(depth - 1):
        step = stash(step.join(up, "ancestor_id").select("member_id", F.col("next").alias("ancestor_id")), "ancestors")
        if step.isEmpty():
            break
        every = every.unionByName(step)
    return every


def rollups(members: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """container_id, total, known, unknown, floor over all leaves below, at any depth.

    members: member_id, parent_id, class. Members with members of their own, and nodes, are no leaves.
    """
    inner = members.where("parent_id is not null").select(F.col("parent_id").alias("member_id")).distinct()
    leaves = members.where("class <> 'node'").join(inner, "member_id", "left_anti").select("member_id", "class")
    met = ancestors(members, depth).join(leaves, "member_id")
    known = F.col("class").isin("identified", "consistent", "membership")
    told = met.groupBy(F.col("ancestor_id").alias("container_id")).agg(
        F.count("*").alias("total"), F.count_if(known).alias("known"), F.count_if(F.col("class") == "unknown").alias("unknown"), F.count_if(F.col("class") == "floor").alias("floor")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return inner.withColumnRenamed("member_id", "container_id").join(told, "container_id", "left").select("container_id", *map(zero, ("total", "known", "unknown", "floor")))


def tree_paths(members: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """member_id, path: ordinals from the root, of fixed width, so that the order of paths is that of a walk into depth first.

    members: member_id, parent_id, ord. One join for each level that is there, written before the next.
    """
    own = lambda c: F.lpad(c.cast("string"), 10, "0")
    level = members.where("parent_id is null").select("member_id", own(F.col("ord")).alias("path"))
    every = level = stash(level, "paths")
    for _ in range(depth):
        below = members.select("member_id", F.col("parent_id"), "ord").join(level.select(F.col("member_id").alias("parent_id"), F.col("path").alias("up")), "parent_id")
        level = stash(below.select("member_id", F.concat_ws("/", "up", own(F.col("ord"))).alias("path")), "paths")
        if level.isEmpty():
            break
        every = every.unionByName(level)
    return every


def sibling_ordinals(rows: DataFrame, parent: str, *order: str) -> DataFrame:
    return rows.withColumn("ord", (F.row_number().over(Window.partitionBy(parent).orderBy(*order)) - 1).cast("long"))


def summary(files: DataFrame) -> DataFrame:
    """One row: files, bytes and counts by verdict. files: size, class, matched (names of filters)."""
    count = lambda *classes: F.count_if(F.col("class").isin(*classes))
    return files.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"), count("identified").alias("attributed"), count("consistent").alias("consistent"),
        F.count_if((F.col("class") == "membership")).alias("membership_only"), F.count_if((F.size("matched") > 0) | F.col("class").isin("identified", "consistent")).alias("known"),
        count("unknown").alias("unknown"), count("floor").alias("floor"),
    )


def by_filter(files: DataFrame) -> DataFrame:
    return files.select(F.explode("matched").alias("filter")).groupBy("filter").agg(F.count("*").alias("hits"))


def listed(files: DataFrame, mode: str) -> DataFrame:
    """The rows that a listing shows: none, unknown, known (by filters), all or attributed; by path."""
    tests = {"none": F.lit(False), "unknown": (F.size("matched") == 0) & F.col("class").isin("unknown", "floor"), "known": F.size("matched") > 0, "all": F.lit(True), "attributed": F.col("class") == "identified"}
    return files.where(tests[mode]).orderBy("path")


def best_claims(claims: DataFrame, group: list[str], first_wins: bool = True) -> DataFrame:
    """Of each group the claim with a link, then the longest statement; ties go to the first or the last by ord.

    claims: group columns, ord, statement, url.
    """
    tie = -F.col("ord") if first_wins else F.col("ord")
    return claims.groupBy(*group).agg(F.max_by(F.struct("statement", "url"), F.struct(F.col("url").isNotNull(), F.length("statement"), tie, "statement", "url")).alias("c")).select(*group, "c.statement", "c.url")


def probe_routes(matches: DataFrame, routes: DataFrame, cap: int, schemes: list[str]) -> DataFrame:
    """Which digests to ask which backend: file_id, backend, scheme.

    matches: file_id, filter, scheme; routes: filter, backend. One digest a file and backend, that of the strongest scheme; a
    backend with more than cap of them is left out whole.
    """
    rank = F.array_position(F.lit(schemes), F.col("scheme"))
    routed = matches.join(F.broadcast(routes), "filter").groupBy("file_id", "backend").agg(F.min_by("scheme", rank).alias("scheme"))
    small = routed.groupBy("backend").count().where(F.col("count") <= cap).select("backend")
    return routed.join(F.broadcast(small), "backend")

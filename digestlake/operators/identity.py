"""From a digest to what is known of its content: the crosswalk walk, and clusters of findings about the same bytes."""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from digestlake.functions.digests import IDENTITY_GRADE
from digestlake.operators.grouped import on_whole_groups
from digestlake.session import stash

#: How far a walk goes, and how many findings it gathers.
MAX_HOPS, MAX_EVIDENCE = 5, 1000


def finding_key(columns: list[str]) -> Column:
    """Findings are the same if all that they say is."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def walk(seeds: DataFrame, findings: DataFrame, hops: int = MAX_HOPS, cap: int | None = MAX_EVIDENCE) -> DataFrame:
    """query_id, hop, scheme, digest (found_at), finding_id for all findings within reach of each query's coordinates.

    seeds: query_id, scheme, digest. findings: finding_id, coords (array of struct<scheme, digest>). A finding is kept once a
    query, at the coordinate that met it first. At most cap findings a query are kept, in the order of hops, then
    coordinates and findings; all of them if cap is None. Each hop joins the new coordinates to an index and is cut from its lineage.

    The cap holds within each hop, and a query that has reached it goes no further. A digest that more than cap findings state is joined
    to the first cap of them, which are all that a walk can keep, so that no digest makes more than cap rows a query.
    """
    stated = findings.select("finding_id", F.explode("coords").alias("c")).select("finding_id", "c.scheme", "c.digest")
    index = stated
    if cap is not None:
        first = F.row_number().over(Window.partitionBy("scheme", "digest").orderBy("finding_id"))
        index = stash(stated.withColumn("_n", first).where(F.col("_n") <= cap).drop("_n"), "index")
    order = Window.partitionBy("query_id", "finding_id").orderBy("scheme", "digest")
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("scheme", "digest", "finding_id"))
    frontier = seeds.select("query_id", "scheme", "digest").distinct()
    visited, evidence = frontier, None
    for hop in range(hops):
        met = frontier.join(index, ["scheme", "digest"]).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
        if evidence is not None:
            met = met.join(evidence, ["query_id", "finding_id"], "left_anti")
        if cap is not None:
            met = met.withColumn("_n", turn).where(F.col("_n") <= cap)
            if evidence is not None:
                met = met.join(evidence.groupBy("query_id").agg(F.count("*").alias("_held")), "query_id").where(F.col("_n") + F.col("_held") <= cap)
        fresh = stash(met.select("query_id", F.lit(hop).cast("long").alias("hop"), "scheme", "digest", "finding_id"), "walk")
        evidence = fresh if evidence is None else evidence.unionByName(fresh)
        if fresh.isEmpty():
            break
        reached = fresh.select("query_id", "finding_id").join(stated, "finding_id").select("query_id", "scheme", "digest").distinct()
        if cap is not None:
            reached = reached.join(evidence.groupBy("query_id").count().where(F.col("count") >= cap), "query_id", "left_anti")
        frontier = stash(reached.join(visited, ["query_id", "scheme", "digest"], "left_anti"), "frontier")
        visited = visited.unionByName(frontier)
        if frontier.isEmpty():
            break
    return evidence


def coordinates(evidence: DataFrame, findings: DataFrame) -> DataFrame:
    """evidence with coords: what each finding states, and the coordinate that met it, unless it states another digest of that scheme."""
    met = evidence.join(findings.select("finding_id", "coords"), "finding_id")
    at = F.struct("scheme", "digest")
    contradicted = F.exists("coords", lambda c: (c["scheme"] == F.col("scheme")) & (c["digest"] != F.col("digest")))
    return met.withColumn("coords", F.array_sort(F.array_distinct(F.when(contradicted, F.col("coords")).otherwise(F.concat("coords", F.array(at))))))


CLUSTERS = "query_id long, cluster long, finding_ids array<long>, coords array<struct<scheme:string,digest:string>>, anchored boolean, primary boolean"


def clusters(evidence: DataFrame, findings: DataFrame, queried: DataFrame) -> DataFrame:
    """Clusters of each query's findings that share a digest of identity grade.

    queried: query_id, scheme, digest as asked. anchored: a digest of identity grade is known. primary: the queried
    coordinate is among the cluster's. All findings of one query are held by one group: at most the walk's cap, if it has one.
    Order: primary, anchored, more findings, then coordinates.
    """
    rows = coordinates(evidence, findings).join(queried.select("query_id", F.col("scheme").alias("q_scheme"), F.col("digest").alias("q_digest")), "query_id")

    def group(frame: pd.DataFrame) -> pd.DataFrame:
        sets = [{(c["scheme"], c["digest"]) for c in cs} for cs in frame["coords"]]
        parent = list(range(len(sets)))

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        owner: dict[tuple, int] = {}
        for k, cs in enumerate(sets):
            for c in cs:
                if c[0] in IDENTITY_GRADE:
                    parent[root(k)] = root(owner.setdefault(c, k))
        asked = (frame["q_scheme"].iloc[0], frame["q_digest"].iloc[0])
        members: dict[int, list[int]] = {}
        for k in range(len(sets)):
            members.setdefault(root(k), []).append(k)
        made = []
        for ks in members.values():
            coords = sorted(set().union(*(sets[k] for k in ks)))
            made.append((sorted(int(frame["finding_id"].iloc[k]) for k in ks), coords, any(c[0] in IDENTITY_GRADE for c in coords), asked in coords))
        made.sort(key=lambda m: (not m[3], not m[2], -len(m[0]), m[1]))
        out = [(int(frame["query_id"].iloc[0]), n, ids, [{"scheme": s, "digest": d} for s, d in coords], anchored, primary) for n, (ids, coords, anchored, primary) in enumerate(made)]
        return pd.DataFrame(out, columns=["query_id", "cluster", "finding_ids", "coords", "anchored", "primary"])

    def groups(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([group(part) for _, part in frame.groupby("query_id", sort=False, dropna=False)])

    return on_whole_groups(rows, "query_id", ["hop", "finding_id"], groups, CLUSTERS)


def statuses(found: DataFrame, evidence: DataFrame, queried: DataFrame, cap: int | None = MAX_EVIDENCE) -> DataFrame:
    """query_id, clusters, collision (a weak digest with two anchored primary clusters), truncated (cap reached, never without one) for every query."""
    primary = found.groupBy("query_id").agg(F.count("*").alias("clusters"), F.count_if(F.col("anchored") & F.col("primary")).alias("claims"))
    size = evidence.groupBy("query_id").agg(F.count("*").alias("n"))
    told = queried.join(primary, "query_id", "left").join(size, "query_id", "left")
    cut = F.lit(False) if cap is None else F.coalesce("n", F.lit(0)) >= cap
    weak = ~F.col("scheme").isin(*IDENTITY_GRADE)
    return told.select("query_id", F.coalesce("clusters", F.lit(0)).alias("clusters"), (weak & (F.coalesce("claims", F.lit(0)) >= 2)).alias("collision"), cut.alias("truncated"))

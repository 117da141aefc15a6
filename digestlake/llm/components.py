"""Connected components over edges that never leave the executors."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestlake.session import discard, stash


def components(links: DataFrame) -> DataFrame:
    """id, component (the least id reachable) for every id in links (a, b).

    Alternates two rounds until nothing changes: each id hands the least of its neighbours and itself to its larger
    neighbours, then to its smaller ones. The edges stay as many as the ids at most, and a long chain folds in a
    number of rounds that grows with its logarithm. Loops and repeated links do no harm; without links there are no rows.
    """
    ids = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    edges = stash(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        # The least neighbours are written before they are joined: a join of two plain exchanges is one whose hot keys Spark splits.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stash(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = stash(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        down = stash(large.groupBy("a").agg(F.min("b").alias("m")), "down")
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        old, edges = edges, stash(small, "edges")
        discard(old, least, large, down)
        before, state = state, _state(edges)
        if state == before:
            break
    found = stash(ids.join(edges.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component")), "components")
    discard(edges)
    return found


def united(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, component) with further links (a, b) taken in: the components that these touch are united, no others are gone over."""
    side = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}"))
    between = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    between = stash(between.distinct(), "between")
    above = components(between).select(F.col("id").alias("component"), F.col("component").alias("root"))
    every = labels.unionByName(between.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(labels.select("id"), "id", "left_anti").select("id", F.col("id").alias("component")))
    return stash(every.join(above, "component", "left").select("id", F.coalesce("root", "component").alias("component")), "components")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

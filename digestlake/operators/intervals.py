"""Byte ranges: mapping them onto one another, uniting them, admitting segments, tiling gaps, counting coverage."""

import bisect

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from digestlake.operators.grouped import on_whole_groups

#: Literal gaps up to so many bytes stand inline; a witness may name so many entries in a row.
INLINE_BYTES, LONGEST_RUN = 64, 8


def overlaps(left: DataFrame, right: DataFrame, key: str, bucket: int) -> DataFrame:
    """Pairs of ranges (key, a, b: from a to before b) of one key that overlap, with where: left, right ids and lo, hi.

    Every range lies in at most two cells of the first power of two that is no less than its length (and than bucket). It is dealt to
    those, and to its cells of the larger sizes that other ranges have; two ranges meet in cells of the larger of their sizes. So the join is
    on equal keys, and a range of any length makes two rows for each size there is, at most 64. A pair is kept in
    the first cell that both touch alone. left has lid, right has rid; a and b are not negative.
    """
    least = max(0, (bucket - 1).bit_length())
    size = F.greatest(F.length(F.bin(F.col("b") - F.col("a") - 1)), F.lit(least)).cast("int")
    own = lambda df: df.where("b > a").withColumn("_own", size)
    left, right = own(left), own(right)
    sizes = sorted(r["_own"] for r in left.select("_own").union(right.select("_own")).distinct().collect())  # at most 64 numbers

    def dealt(df: DataFrame) -> DataFrame:
        sized = df.withColumn("_size", F.explode(F.filter(F.lit(sizes) if sizes else F.array().cast("array<int>"), lambda x: x >= F.col("_own"))))
        return sized.withColumn("_cell", F.explode(F.expr("sequence(shiftright(a, _size), shiftright(b - 1, _size))")))

    one = dealt(left).select(key, "_size", "_cell", F.col("_own").alias("_l"), "lid", F.col("a").alias("la"), F.col("b").alias("lb"))
    other = dealt(right).select(key, "_size", "_cell", F.col("_own").alias("_r"), "rid", F.col("a").alias("ra"), F.col("b").alias("rb"))
    lo, hi = F.greatest("la", "ra"), F.least("lb", "rb")
    met = one.join(other, [key, "_size", "_cell"]).where((lo < hi) & (F.greatest("_l", "_r") == F.col("_size")))
    return met.withColumns({"lo": lo, "hi": hi}).where("shiftright(lo, _size) = _cell").select(key, "lid", "rid", "lo", "hi")


def united(ranges: DataFrame, key: str) -> DataFrame:
    """Maximal ranges that the given ones cover, and how many of them each holds. Ranges that touch become one."""
    order = Window.partitionBy(key).orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.where("b > a").withColumn("_new", F.when(F.col("a") <= before, 0).otherwise(1))
    island = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "_island").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count("*").alias("n")).drop("_island")


def admitted(segments: DataFrame, key: str) -> DataFrame:
    """segments (key, turn, a, b) with accepted: in turn, each that overlaps none accepted before it in its key.

    Greedy and in order by nature: a container's plan is made by one task.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema) + ", accepted boolean"

    def admit(frame: pd.DataFrame) -> pd.DataFrame:
        accepted, now = [], object()
        starts: list[int] = []
        ends: list[int] = []
        for group, a, b in zip(frame[key].tolist(), frame["a"].tolist(), frame["b"].tolist(), strict=True):
            if group != now:
                now, starts, ends = group, [], []
            k = bisect.bisect_right(starts, a)
            good = b > a and (k == 0 or ends[k - 1] <= a) and (k == len(starts) or starts[k] >= b)
            if good:
                starts.insert(k, a)
                ends.insert(k, b)
            accepted.append(good)
        return frame.assign(accepted=accepted)

    return on_whole_groups(segments, key, ["turn", "a", "b"], admit, schema)


def tiled(segments: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """key, a, b, kind: the segments as 'segment', and what they leave of 0 ... size as 'inline' or 'residue' by its length."""
    order = Window.partitionBy(key).orderBy("a")
    own = segments.where("b > a").select(key, "a", "b")
    joined = own.join(sizes, key)
    gap_before = joined.select(key, F.coalesce(F.lag("b").over(order), F.lit(0)).alias("a"), F.col("a").alias("b"))
    last = own.groupBy(key).agg(F.max("b").alias("a"))
    tail = sizes.join(last, key, "left").select(key, F.coalesce("a", F.lit(0)).alias("a"), F.col("size").alias("b"))
    gaps = gap_before.unionByName(tail).where("b > a").withColumn("kind", F.when(F.col("b") - F.col("a") <= INLINE_BYTES, "inline").otherwise("residue"))
    return own.withColumn("kind", F.lit("segment")).unionByName(gaps)


def coverage(tiles: DataFrame, group: list[str]) -> DataFrame:
    """Bytes that can be fetched, that stand inline and that are left over, and how many segments there are."""
    size = F.col("b") - F.col("a")
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, size)), F.lit(0)).cast("long")
    return tiles.groupBy(*group).agg(total("segment").alias("fetchable"), total("inline").alias("inline"), total("residue").alias("residue"), F.count_if(F.col("kind") == "segment").alias("segments"))


def longest_runs(entries: DataFrame, witnessed: DataFrame, key: str, longest: int = LONGEST_RUN) -> DataFrame:
    """key, start, length: from the left, the longest run of up to longest consecutive entries that a witness names, run after run.

    entries: key, ord, digest; witnessed: digests of runs, each the SHA-256 of its entries' digests joined by commas.
    """
    order = Window.partitionBy(key).orderBy("ord")
    runs = entries.withColumn("ahead", F.collect_list("digest").over(order.rowsBetween(0, longest - 1)))
    runs = runs.select(key, F.col("ord").alias("start"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size("ahead")), lambda n: F.sha2(F.array_join(F.slice("ahead", 1, n), ","), 256))).alias("k", "run"))
    met = runs.join(witnessed.select(F.col("digest").alias("run")).distinct(), "run").groupBy(key, "start").agg((F.max("k") + 1).cast("long").alias("length"))

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        kept, now, upto = [], object(), -1
        for group, start, length in zip(frame[key].tolist(), frame["start"].tolist(), frame["length"].tolist(), strict=True):
            if group != now:
                now, upto = group, -1
            kept.append(start >= upto)
            if kept[-1]:
                upto = start + length
        return frame[kept]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.schema)
    return on_whole_groups(met, key, ["start"], pick, schema)


def missing(refs: DataFrame, present: DataFrame) -> DataFrame:
    """Refs (node_id, parent_id, path, sha256) whose blobs are not there. A node that is there stands for all below it."""
    there = refs.join(present.select("sha256").distinct(), "sha256").select("path")
    above = refs.withColumn("up", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))))
    covered = above.join(there.withColumnRenamed("path", "up"), "up").select("node_id").distinct()
    inner = refs.where("parent_id is not null").select(F.col("parent_id").alias("node_id")).distinct()
    return refs.join(covered, "node_id", "left_anti").join(inner, "node_id", "left_anti")

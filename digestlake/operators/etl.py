"""Building published tables: joins of dumps, dedup, regrouping, checks of order and loss."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exploded_left_join(files: DataFrame, list_column: str, releases: DataFrame, key: str) -> DataFrame:
    """A row for each release a file lists; files without, or with unknown ones, keep a row of nulls."""
    each = files.withColumn(key, F.explode_outer(list_column)).drop(list_column)
    return each.join(releases, key, "left")


def zipped(left: DataFrame, right: DataFrame, line: str, same: list[str], keep_left: list[str], keep_right: list[str]) -> DataFrame:
    """Two dumps put together line by line: ok, mismatch where the shared columns differ, or short where one has ended."""
    a = left.select(line, *[F.col(c).alias(f"l_{c}") for c in same], *keep_left)
    b = right.select(line, *[F.col(c).alias(f"r_{c}") for c in same], *keep_right)
    both = a.join(b, line, "full_outer")
    short = F.col(f"l_{same[0]}").isNull() | F.col(f"r_{same[0]}").isNull()
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
    return both.withColumn("status", F.when(short, "short").when(equal, "ok").otherwise("mismatch"))


def require_aligned(zipped_rows: DataFrame) -> DataFrame:
    """The rows of two dumps that do not line up must not be published."""
    bad = zipped_rows.where("status <> 'ok'").limit(1).collect()
    if bad:
        raise ValueError(f"dumps do not line up: {bad[0].asDict()}")
    return zipped_rows


def first_by(rows: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in that order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def repeated(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys with several rows: how many, and their values in order."""
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(value)).alias("values")).where("n > 1")


def composite_join(files: DataFrame, packages: DataFrame, key: list[str]) -> DataFrame:
    """Distinct rows of files with their package by several columns."""
    return files.join(packages, key).distinct()


def require_no_loss(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Every key that was there must still be."""
    lost = before.select(*key).distinct().join(after.select(*key).distinct(), key, "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"rows were lost, first: {lost[0].asDict()}")
    return after


def regrouped(rows: DataFrame, key: list[str], schemes: list[str]) -> DataFrame:
    """One row for each document and version of its digests, a column for each scheme.

    rows: key columns, scheme, digest. Where a document states several digests of one scheme, the further ones, in their order,
    make further rows.
    """
    nth = F.dense_rank().over(Window.partitionBy(*key, "scheme").orderBy("digest"))
    return rows.withColumn("variant", nth.cast("long")).groupBy(*key, "variant").pivot("scheme", schemes).agg(F.min("digest"))


def weak_map(rows: DataFrame, weak: str, strong: str) -> DataFrame:
    """Distinct pairs of a weak and a strong digest."""
    return rows.where(F.col(weak).isNotNull() & F.col(strong).isNotNull()).select(weak, strong).distinct()


def key_union(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Distinct keys of two columns."""
    return left.select(F.col(left_key).alias("key")).union(right.select(F.col(right_key).alias("key"))).where("key is not null").distinct()


def signature(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Count and sums of 31-bit hashes by column: equal for equal rows in any order."""
    hashed = lambda c: F.conv(F.substring(F.md5(F.coalesce(F.col(c).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    return rows.agg(F.count("*").alias("rows"), *[F.sum(hashed(c)).cast("long").alias(f"sum_{c}") for c in columns])


def out_of_order(ranges: DataFrame, low: str, high: str) -> DataFrame:
    """How many ranges begin before the one in front of them ends. ranges is one row per file or row group: few."""
    return ranges.withColumn("_up", F.lag(high).over(Window.orderBy(low, high))).agg(F.count_if(F.col(low) < F.col("_up")).alias("overlapping"))


def counters(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """rows, and of how many of them each named condition holds, in one pass. Null is no."""
    return rows.agg(F.count("*").alias("rows"), *[F.count_if(c).alias(name) for name, c in conditions.items()])

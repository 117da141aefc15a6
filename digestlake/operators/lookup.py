"""Looking digests up in key-sorted tables: capped lists with honest totals, weak keys by way of strong ones, rows by number."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from digestlake.session import stash

#: Map rows that are read for a weak key, and the strong digests that are followed.
MAP_READ, MAP_KEPT = 8, 3


def capped(rows: DataFrame, key: list[str], order: list, cap: int, position: str = "pos", total: str = "total") -> DataFrame:
    """At most cap rows of each key, with their position and the number of all rows of the key."""
    window = Window.partitionBy(*key)
    counted = rows.withColumn(position, F.row_number().over(window.orderBy(*order)).cast("long"))
    totals = rows.groupBy(*key).agg(F.count("*").alias(total))
    return counted.where(F.col(position) <= cap).join(totals, key)


def point_lookup(table: DataFrame, key: str, wanted: DataFrame, order: list, cap: int) -> DataFrame:
    """Rows of table for the wanted keys (one column, named as the key), at most cap each, with totals.

    Spark prunes files, row groups and pages by the keys where the table is sorted by them.
    """
    return capped(table.join(wanted.select(key).distinct(), key), [key], order, cap)


def weak_to_strong(weak: DataFrame, pairs: DataFrame, data: DataFrame, strong: str, read: int = MAP_READ, kept: int = MAP_KEPT) -> DataFrame:
    """Data rows for weak keys. weak: weak_key; pairs: weak_key and the strong digest, distinct.

    The first read pairs of a key in digest order are looked at, and the first kept digests followed.
    """
    met = pairs.join(weak.select("weak_key").distinct(), "weak_key").dropDuplicates(["weak_key", strong])
    order = Window.partitionBy("weak_key").orderBy(strong)
    ranked = met.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= min(read, kept))
    return ranked.join(data, strong)


def unpivoted(table: DataFrame, schemes: list[str], keep: list[str]) -> DataFrame:
    """One row per stated digest: scheme, digest, and the kept columns."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("scheme"), F.col(s).alias("digest")) for s in schemes]))
    return table.select(*keep, each.alias("c")).select("c.scheme", "c.digest", *keep).where(F.col("digest").isNotNull())


def by_scheme(queries: DataFrame, table: DataFrame, schemes: list[str], keep: list[str]) -> DataFrame:
    """Rows of a table with a column per scheme for queries (scheme, digest)."""
    return queries.join(unpivoted(table, schemes, keep), ["scheme", "digest"])


def numbered(rows: DataFrame, order: list[str], column: str) -> DataFrame:
    """Dense numbers from 0 in the given order, without a window over all rows.

    The rows are written once in ranges of the order, which Spark samples whatever the types; a row's number is its place in its
    range and how many rows the ranges before hold, a number for each range.
    """
    columns = rows.columns
    placed = stash(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).count()
    before = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").select(*columns, (F.col("_before") + place).alias(column))


def rows_at(numbered_rows: DataFrame, number: str, wanted: DataFrame) -> DataFrame:
    """Rows by number, one for each wanted position (pos, number); positions out of range have null columns and found = false."""
    found = wanted.join(numbered_rows.withColumn("found", F.lit(True)), number, "left")
    return found.withColumn("found", F.coalesce("found", F.lit(False)))


def positional(files: DataFrame, packages: DataFrame, foreign: str, number: str, cap: int, key: list[str], order: list) -> DataFrame:
    """Files joined to the package that their row number names, at most cap files per key, with totals."""
    return capped(files, key, order, cap).join(packages, files[foreign] == packages[number]).drop(packages[number])


def strongest(rows: DataFrame, group: list[str], scheme: str, schemes: list[str]) -> DataFrame:
    """Of the rows of each group the one whose scheme comes first in schemes."""
    rank = F.array_position(F.lit(schemes), F.col(scheme))
    return rows.where(rank > 0).groupBy(*group).agg(F.min_by(F.struct(*rows.columns), rank).alias("row")).select("row.*")

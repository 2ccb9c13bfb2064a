"""Ordered neighbours over a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.shared import written

LEAST = -(1 << 63)


def quantile_bounds(df: DataFrame, key: str, buckets: int) -> list[float]:
    """At most buckets - 1 distinct bounds that deal the rows into about equal ranges of a numeric key."""
    if buckets < 2:
        return []
    found = df.approxQuantile(key, [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))
    return sorted(set(found))


def bucket_of(key: Column, bounds: list) -> Column:
    """Number of bounds at or below key, by binary search; null: 0."""
    if not bounds:
        return F.lit(0)
    table = F.array(*map(F.lit, bounds))
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(len(bounds).bit_length()))))

    def step(at: Column, jump: Column) -> Column:
        return F.when(F.get(table, at + jump - 1) <= key, at + jump).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def numbered(df: DataFrame, order: list[str], name: str = "numbered") -> DataFrame:
    """df with row (long): its number from 0 in ascending order of the columns named, nulls first.

    One exchange deals the rows into ranges; each is sorted, numbered and written once, and a table with one row for
    each range gives what lies before it. Rows equal in every column named are dealt out over ranges, too, so a third
    of all rows may be alike. What df holds moves with the rows: give it thin columns.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, "_tie"]
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    rows = written(ranged.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), name)
    rows = rows.select("*", F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_nth"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_range").select(*df.columns, (F.col("_before") + F.col("_nth")).alias("row"))

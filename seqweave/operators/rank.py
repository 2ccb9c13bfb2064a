"""Running sums in a global order, without one partition that holds the table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.ordering import bucket_of
from seqweave.functions.shared import written


def group_join(left: DataFrame, right: DataFrame, by: list[str], more: list[str] = (), how: str = "left") -> DataFrame:
    """left joined with right on the group columns, of which null is a value like any other, and on the columns more."""
    names = [*by, *more]
    renamed = right.select(*(F.col(c).alias(f"_on_{c}") for c in names), *(c for c in right.columns if c not in names))
    if not names:
        return left.crossJoin(renamed)  # one row of totals
    on = reduce(lambda a, b: a & b, (left[c].eqNullSafe(F.col(f"_on_{c}")) for c in names))
    return left.join(renamed, on, how).drop(*(f"_on_{c}" for c in names))


def dealt(df: DataFrame, key: str, ties: list[str], buckets: int) -> DataFrame:
    """df with _range: numbers of ranges of about equal size in the order of key.

    Ranges end at quantiles of key. Where one value of key fills more than a range, a quantile repeats; the ranges are
    then drawn over key and ties together, so that a group of ties is dealt out as well, and kept in a table.
    """
    found = df.approxQuantile(key, [i / buckets for i in range(1, buckets)], 1 / (4 * buckets)) if buckets > 1 else []
    if ties and len(set(found)) < len(found):
        return written(df.repartitionByRange(buckets, key, *ties).withColumn("_range", F.spark_partition_id()), "ranges")
    return df.withColumn("_range", bucket_of(F.col(key), sorted(set(found))))


def running(df: DataFrame, by: list[str], key: str, values: list[str], ties: list[str] = (), buckets: int | None = None) -> DataFrame:
    """df with cum_<value> for each value: its sum over the rows of the group up to this one, ordered by key, then ties.

    Rows are dealt by (group, range of key and ties). A small table of range totals gives each range what lies before
    it. A null group column is a group of its own.
    """
    rows = dealt(df, key, list(ties), buckets or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    inside = Window.partitionBy(*by, "_range").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*by, "_range").agg(*(F.sum(v).alias(f"_t_{v}") for v in values))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_range", *(F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_o_{v}") for v in values))
    local = rows.select("*", *(F.sum(v).over(inside).alias(f"_l_{v}") for v in values))
    joined = group_join(local, offsets, by, ["_range"], "inner")
    return joined.select(*df.columns, *((F.col(f"_l_{v}") + F.col(f"_o_{v}")).alias(f"cum_{v}") for v in values))

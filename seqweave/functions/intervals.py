"""Joins of positions and spans through bins of doubling widths.

A span goes into bins as wide as the next power of two at or above its length, so it lies in one or two of them
whatever its length; a position lies in one bin of each width in use. Equal bins join by equality, and rows that are
shuffled grow with spans and positions, not with the positions that spans cover.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(length: Column) -> Column:
    """Exponent of the smallest power of two at or above a length; 0 for lengths up to 1."""
    return F.when(length > 1, F.length(F.bin(length.cast("long") - 1))).otherwise(0).cast("int")


def levels_of(spans: DataFrame, start: str, end: str) -> list[int]:
    """The widths in use, as exponents: 64 at most, whatever the table."""
    return sorted(r["level"] for r in spans.select(_level(F.col(end) - F.col(start)).alias("level")).distinct().collect())


def _binned(spans: DataFrame, start: str, end: str, level: Column) -> DataFrame:
    """spans with _level and _bin: a row for each bin that the span [start, end) meets; empty spans have none."""
    own = spans.where(F.col(end) > F.col(start)).withColumn("_level", level)
    first, last = F.call_function("shiftright", F.col(start).cast("long"), F.col("_level")), F.call_function("shiftright", F.col(end).cast("long") - 1, F.col("_level"))
    return own.withColumn("_bin", F.explode(F.sequence(first, last)))


def points_in_spans(points: DataFrame, spans: DataFrame, by: list[str], position: Column, start: str, end: str, longest: int | None = None, how: str = "inner") -> DataFrame:
    """Every pair of a point and a span [start, end) of the same group that holds its position, once.

    A position is in one bin of each width, and a span's bins of that width differ, so no pair can be found twice. Rows
    with a null group, position or end pair with nothing. Columns of both are returned; beside those in by they must
    have different names. Where spans are known to be no longer than longest, one width serves for all (a span that
    is longer all the same meets more bins); else the widths in use are asked for first, so spans should be a table.
    With how="left" and longest given, points in no span are kept, with nulls.
    """
    if how == "left" and longest is None:
        raise ValueError("points in no span can be kept where one width serves for all spans")
    widths = levels_of(spans, start, end) if longest is None else [max(longest - 1, 0).bit_length()]
    level = _level(F.col(end) - F.col(start)) if longest is None else F.lit(widths[0])
    at = points.withColumn("_at", position.cast("long"))
    at = at.withColumn("_level", F.explode(F.array(*map(F.lit, widths)).cast("array<int>")))
    at = at.withColumn("_bin", F.call_function("shiftright", F.col("_at"), F.col("_level")))
    keys = [*by, "_level", "_bin"]
    right = _binned(spans, start, end, level)
    right = right.select(*(F.col(c).alias(f"_on_{c}" if c in keys else c) for c in right.columns))
    on = [F.col(c) == F.col(f"_on_{c}") for c in keys] + [F.col("_at") >= F.col(start), F.col("_at") < F.col(end)]
    return at.join(right, reduce(lambda x, y: x & y, on), how).drop("_level", "_bin", "_at", *(f"_on_{c}" for c in keys))


def overlapping(a: DataFrame, b: DataFrame, by: list[str], a_span: tuple[str, str], b_span: tuple[str, str]) -> DataFrame:
    """Every pair of a span of a and a span of b of the same group that share a position, once.

    The wider of the two widths decides: each span also goes into the bins of every greater width that is in use, one
    or two a width, and a pair is joined at the greater of both widths. Where it meets in two bins, only that bin
    reports it which holds the first position that both have. The bytes of a file say little of the rows in bins, so
    neither side is broadcast; a join by sorting can spill.
    """
    widths = F.array(*map(F.lit, sorted({*levels_of(a, *a_span), *levels_of(b, *b_span)}))).cast("array<int>")

    def dealt(df: DataFrame, span: tuple[str, str], tag: str) -> DataFrame:
        low, high = (F.col(c).cast("long") for c in span)
        own = df.where(high > low).withColumn(f"_own_{tag}", _level(high - low)).withColumn("_level", F.explode(F.filter(widths, lambda w: w >= F.col(f"_own_{tag}"))))
        bins = F.sequence(F.call_function("shiftright", low, F.col("_level")), F.call_function("shiftright", high - 1, F.col("_level")))
        return own.withColumn("_bin", F.explode(bins))

    pairs = dealt(a, a_span, "a").join(dealt(b, b_span, "b").hint("merge"), [*by, "_level", "_bin"])
    first = F.greatest(F.col(a_span[0]).cast("long"), F.col(b_span[0]).cast("long"))
    conditions = [
        F.col("_level") == F.greatest("_own_a", "_own_b"),
        F.col(a_span[0]) < F.col(b_span[1]),
        F.col(b_span[0]) < F.col(a_span[1]),
        F.call_function("shiftright", first, F.col("_level")) == F.col("_bin"),
    ]
    return pairs.where(reduce(lambda x, y: x & y, conditions)).drop("_level", "_bin", "_own_a", "_own_b")

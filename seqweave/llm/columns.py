"""Columns that an operator carries along, kept apart from its own."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def own_names(df: DataFrame, results: Iterable[str]) -> list[str]:
    """Columns of df that aren't called like a result; Spark's names don't differ by case, and neither do these."""
    taken = {r.lower() for r in results}
    return [c for c in df.columns if c.lower() not in taken]


def carried(df: DataFrame, results: Iterable[str] = ()) -> Column:
    """One struct with those columns: while they are in it, none of their names can meet a helper's."""
    names = own_names(df, results)
    return F.struct(*(named(c) for c in names)) if names else F.struct(F.lit(None).alias("none"))


def unpacked(df: DataFrame, results: Iterable[str], struct: str) -> list[Column]:
    """The columns that carried() took from df, out of the struct again."""
    return [F.col(struct).getField(c).alias(c) for c in own_names(df, results)]

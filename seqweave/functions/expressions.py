"""Scalar expressions on sequences, labels and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal symbols and labels, and the symbols of low-complexity segments.
ALPHABET = "ACDEFGHIKLMNPQRSTVWYBXZUO-"
LABELS = "01-"
LOW_COMPLEXITY = "PGSEDKRNQ"
#: White space of any script.
BLANK = "[\\s\\x1C-\\x1F\\x85\\p{Z}]"


def normalize(sequence: Column) -> Column:
    """Upper case; U, Z, O and B become X."""
    return F.translate(F.upper(sequence), "UZOB", "XXXX")


def sanitize(sequence: Column) -> Column:
    """normalize, and J becomes X."""
    return F.translate(F.upper(sequence), "UZOBJ", "XXXXX")


def bad_symbols(text: Column, alphabet: str) -> Column:
    """Distinct symbols outside the alphabet, sorted."""
    return F.array_sort(F.array_except(F.array_distinct(F.split(text, "")), F.array(F.lit(""), *map(F.lit, alphabet))))


def safe_key(name: Column) -> Column:
    """A name fit for storage: blanks at the ends go, slashes become underscores, and runs of anything but letters and
    numbers of any script, underscores, dots and hyphens become one underscore each."""
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, f"^{BLANK}+|{BLANK}+$", ""), "[/\\\\]", "_"), "[^\\p{L}\\p{N}_.\\-]+", "_")
    fit = F.rlike(name, F.lit("^[\\p{L}\\p{N}_.\\-]+\\z"))  # most names are as they should be
    return F.when(fit, name).when(flat == "", "empty_id").otherwise(flat)


def sigmoid(x: Column) -> Column:
    """Stable for large values of either sign."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def at_threshold(score: Column, threshold: float | Column) -> Column:
    return (score >= threshold).cast("int")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def low_complexity(segment: Column) -> Column:
    """0.7 x share of low-complexity symbols + 0.3 x share of the most frequent symbol; empty: 0."""
    n = F.length(segment)
    share = (n - F.length(F.translate(segment, LOW_COMPLEXITY, ""))) / n
    symbols = F.array_distinct(F.split(segment, ""))
    most = F.array_max(F.transform(symbols, lambda c: n - F.length(F.replace(segment, c, F.lit("")))))
    return F.when(n > 0, F.lit(0.7) * share + F.lit(0.3) * (most / n)).otherwise(F.lit(0.0))

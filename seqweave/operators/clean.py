"""Validation, filtering and conversion of sequence records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweave.functions.expressions import ALPHABET, LABELS, bad_symbols


def quality_report(records: DataFrame, labelled: bool = True) -> DataFrame:
    """protein_id, reason, symbols: one row for every rule that a record (protein_id, sequence[, labels]) breaks.

    Reasons: empty_id, duplicate_id, length_mismatch, bad_symbols, bad_labels. No rows: the table is clean.
    """
    none = F.array().cast("array<string>")
    rules = [F.struct(F.lit("empty_id").alias("reason"), (F.coalesce(F.trim("protein_id"), F.lit("")) == "").alias("broken"), none.alias("symbols"))]
    symbols = bad_symbols(F.upper("sequence"), ALPHABET)
    rules.append(F.struct(F.lit("bad_symbols").alias("reason"), (F.size(symbols) > 0).alias("broken"), symbols.alias("symbols")))
    if labelled:
        marks = bad_symbols(F.col("labels"), LABELS)
        rules.append(F.struct(F.lit("bad_labels").alias("reason"), (F.size(marks) > 0).alias("broken"), marks.alias("symbols")))
        rules.append(F.struct(F.lit("length_mismatch").alias("reason"), (~F.length("sequence").eqNullSafe(F.length("labels"))).alias("broken"), none.alias("symbols")))
    broken = records.select("protein_id", F.inline(F.array(*rules))).where("broken").select("protein_id", "reason", "symbols")
    twice = records.groupBy("protein_id").agg(F.count("*").alias("n")).where("n > 1").select("protein_id", F.lit("duplicate_id").alias("reason"), none.alias("symbols"))
    return broken.unionByName(twice)


def require_clean(records: DataFrame, labelled: bool = True) -> DataFrame:
    """records, if the quality report is empty; else an error that names the first reasons."""
    found = quality_report(records, labelled).limit(10).collect()
    if found:
        raise ValueError("; ".join(f"{r['protein_id']!r}: {r['reason']} {','.join(r['symbols'])}".strip() for r in found))
    return records


def to_positions(records: DataFrame) -> DataFrame:
    """protein_id, position (from 1), symbol, label (null where masked): one row per symbol; the shorter string decides."""
    n = F.least(F.length("sequence"), F.coalesce(F.length("labels"), F.length("sequence")))
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    rows = records.select("*", F.explode(at).alias("position"))
    mark = F.substring(F.col("labels"), F.col("position"), F.lit(1))
    return rows.select("protein_id", "position", F.substring(F.col("sequence"), F.col("position"), F.lit(1)).alias("symbol"), label_of(mark).alias("label"))


def label_of(mark: Column) -> Column:
    """1, 0, or null for a masked position."""
    return F.when(mark == "1", 1).when(mark == "0", 0).cast("int")


def with_positive(records: DataFrame) -> DataFrame:
    """Records with at least one positive label."""
    return records.where(F.contains("labels", F.lit("1")))


def with_positive_report(records: DataFrame) -> DataFrame:
    """stage (before, after), records, pos, neg, masked of with_positive; that nothing is left is an error."""
    n, labels = F.length("labels"), F.col("labels")
    count = lambda mark: n - F.length(F.replace(labels, F.lit(mark), F.lit("")))
    keeps = F.contains("labels", F.lit("1"))
    stages = F.explode(F.array_compact(F.array(F.lit("before"), F.when(keeps, F.lit("after")))))
    rows = records.select(stages.alias("stage"), *(count(m).cast("long").alias(c) for c, m in (("pos", "1"), ("neg", "0"), ("masked", "-"))))
    out = rows.groupBy("stage").agg(F.count("*").alias("records"), *(F.sum(c).alias(c) for c in ("pos", "neg", "masked")))
    if records.where(keeps).isEmpty():
        raise ValueError("no sequence has a positive label")
    return out


def removed_sample(records: DataFrame, limit: int = 50) -> DataFrame:
    """The first ids, in order, that with_positive removes: a report."""
    return records.where(~F.contains("labels", F.lit("1"))).select("protein_id").orderBy("protein_id").limit(limit)


def select_records(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids.select("protein_id").distinct(), "protein_id", "left_semi")


def missing_ids(records: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("protein_id").distinct().join(records.select("protein_id"), "protein_id", "left_anti")


def key_collisions(records: DataFrame, key: Column) -> DataFrame:
    """key, n: storage keys that more than one id maps to."""
    return records.select(key.alias("key"), "protein_id").groupBy("key").agg(F.countDistinct("protein_id").alias("n")).where("n > 1")

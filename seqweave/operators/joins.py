"""Joins of sequences, positions, predictions, features and alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_pairs(labelled: DataFrame, unlabelled: DataFrame) -> DataFrame:
    """labelled with status: ok, missing (no such id in unlabelled) or mismatch (another sequence); further ids are ignored."""
    right = unlabelled.select("protein_id", F.col("sequence").alias("_other"))
    status = F.when(F.col("_other").isNull(), "missing").when(F.col("_other") != F.col("sequence"), "mismatch").otherwise("ok")
    return labelled.join(right, "protein_id", "left").withColumn("status", status).drop("_other")


def aligned_predictions(predictions: DataFrame, residues: DataFrame) -> DataFrame:
    """predictions (protein_id, position string, score) with label and status: used, missing_pid, bad_pos or skipped_masked.

    Where residues has a column mark, the label as it stands in the file, a prediction that meets a mark other than 0, 1
    and the hyphen raises.
    """
    n = residues.groupBy("protein_id").agg(F.max("position").alias("_n"))
    at = F.col("position").try_cast("double").try_cast("int")
    rows = predictions.withColumn("_at", at).join(n, "protein_id", "left")
    marks = ["mark"] if "mark" in residues.columns else []
    rows = rows.join(residues.select("protein_id", F.col("position").alias("_at"), "label", *marks), ["protein_id", "_at"], "left")
    if marks:
        odd = F.raise_error(F.concat(F.lit("unexpected label "), "mark", F.lit(" of "), "protein_id", F.lit(" at position "), "position")).cast("int")
        rows = rows.withColumn("label", F.when(F.col("mark").isNull() | F.col("mark").isin("0", "1", "-"), F.col("label")).otherwise(odd)).drop("mark")
    status = F.when(F.col("_n").isNull(), "missing_pid").when(F.col("_at").isNull() | (F.col("_at") < 1) | (F.col("_at") > F.col("_n")), "bad_pos").when(F.col("label").isNull(), "skipped_masked").otherwise("used")
    return rows.withColumn("status", status).drop("_n", "_at")


def require_aligned(rows: DataFrame) -> DataFrame:
    """rows of aligned_predictions, if any is used; else an error with the counts and some ids that have no labels."""
    counts = {r["status"]: r["n"] for r in rows.groupBy("status").agg(F.count("*").alias("n")).collect()}
    if not counts.get("used"):
        lost = [r["protein_id"] for r in rows.where("status = 'missing_pid'").select("protein_id").distinct().orderBy("protein_id").limit(5).collect()]
        raise ValueError(f"no prediction meets a label: {counts}; ids without labels: {lost}")
    return rows


def feature_gaps(records: DataFrame, features: DataFrame) -> DataFrame:
    """protein_id, length, rows, status: ok, missing (no features) or mismatch (another number of rows)."""
    rows = features.groupBy("protein_id").agg(F.count("*").alias("rows"))
    out = records.select("protein_id", F.length("sequence").alias("length")).join(rows, "protein_id", "left")
    return out.withColumn("status", F.when(F.col("rows").isNull(), "missing").when(F.col("rows") != F.col("length"), "mismatch").otherwise("ok"))


def chunk_groups(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """protein_id, indices (distinct, sorted), known: chunk keys <id>_<number> by sequence, and whether the id exists."""
    parsed = chunks.select(F.regexp_extract("chunk_id", "^(.+)_(\\d+)$", 1).alias("protein_id"), F.regexp_extract("chunk_id", "^(.+)_(\\d+)$", 2).try_cast("int").alias("ix")).where("protein_id <> ''")
    groups = parsed.groupBy("protein_id").agg(F.array_sort(F.collect_set("ix")).alias("indices"))
    known = records.select("protein_id").distinct().withColumn("known", F.lit(True))
    return groups.join(known, "protein_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def fused(a: DataFrame, b: DataFrame, weight_a: float = 0.5, weight_b: float = 0.5) -> DataFrame:
    """protein_id, position, score = weighted sum of two score tables that must cover the same positions."""
    if weight_a < 0 or weight_b < 0 or abs(weight_a + weight_b - 1) > 1e-9:
        raise ValueError("the weights must be positive and add up to 1")
    both = a.select("protein_id", "position", F.col("score").alias("_a")).join(b.select("protein_id", "position", F.col("score").alias("_b")), ["protein_id", "position"], "full_outer")
    check = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("the score tables differ in length")).cast("double"))
    return both.select("protein_id", "position", F.coalesce(check, weight_a * F.col("_a") + weight_b * F.col("_b")).alias("score"))


def through_alignment(alignment: DataFrame, residues: DataFrame, scores: DataFrame) -> DataFrame:
    """Structure residues (pair_id, subject_pos, ..) with the score of the target position that is aligned to them."""
    return residues.join(alignment, ["pair_id", "subject_pos"], "left").join(scores.select("protein_id", F.col("position").alias("query_pos"), "score"), ["protein_id", "query_pos"], "left")

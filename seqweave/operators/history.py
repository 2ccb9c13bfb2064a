"""Run histories: loss windows, best evaluation, early stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def print_windows(steps: DataFrame, every: int) -> DataFrame:
    """epoch, window_ix, first_step, steps, loss: mean loss over windows of every steps; windows start anew with an epoch."""
    return steps.groupBy("epoch", F.floor((F.col("step") - 1) / every).alias("window_ix")).agg(F.min("step").alias("first_step"), F.count("*").alias("steps"), F.avg("loss").alias("loss"))


def epoch_summary(steps: DataFrame) -> DataFrame:
    return steps.groupBy("epoch").agg(F.avg("loss").alias("loss"), F.count("*").alias("steps"))


def best_evaluation(evals: DataFrame, patience: int, run: str = "run") -> DataFrame:
    """run, best_step, best_auroc, stop_step: a strictly greater AUROC resets patience; the run stops at the first
    ``patience`` evaluations in a row without one (null: it never does). Null AUROCs don't improve."""
    along = Window.partitionBy(run).orderBy("step")
    before = F.max("auroc").over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = evals.withColumn("improved", F.col("auroc").isNotNull() & (before.isNull() | (F.col("auroc") > before)))
    rows = rows.withColumn("island", F.sum(F.col("improved").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    idle = F.sum((~F.col("improved")).cast("int")).over(Window.partitionBy(run, "island").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("idle", idle)
    stop = rows.groupBy(run).agg(F.min(F.when(F.col("idle") >= patience, F.col("step"))).alias("stop_step"))
    lived = rows.join(stop, run).where("improved and (stop_step is null or step <= stop_step)")
    return lived.groupBy(run, "stop_step").agg(F.max("step").alias("best_step"), F.max("auroc").alias("best_auroc")).select(run, "best_step", "best_auroc", "stop_step")

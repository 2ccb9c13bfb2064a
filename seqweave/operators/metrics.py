"""Ranking and threshold metrics of scored positions, per group of columns ``by``.

Inputs have label (1, 0; null is masked and never scored) and score. Rows with a null score are not scored. A null in
a column of ``by`` is a group of its own.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.expressions import ratio
from seqweave.functions.shared import written
from seqweave.operators.rank import group_join, running

GRID = (0.05, 0.95, 0.05)
#: Distinct scores up to which a group's running sums are one window.
FEW = 10_000


def scored(df: DataFrame) -> DataFrame:
    """Positions that count: labelled 0 or 1."""
    return df.where(F.col("label").isin(0, 1))


def class_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """pos, neg, total, pos_ratio (null if empty), pos_weight = neg / pos (null without positives)."""
    pos, neg = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return df.groupBy(*by).agg(pos.alias("pos"), neg.alias("neg"), (pos + neg).alias("total")).select(
        *by, "pos", "neg", "total", F.try_divide(F.col("pos").cast("double"), F.col("total").cast("double")).alias("pos_ratio"), F.try_divide(F.col("neg").cast("double"), F.col("pos").cast("double")).alias("pos_weight")
    )


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def mcc_of(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Matthews correlation, 0 where undefined; in doubles, since the product of the four margins outgrows a long."""
    tp, fp, fn, tn = (x.cast("double") for x in (tp, fp, fn, tn))
    return ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def confusion(df: DataFrame, by: list[str], threshold: float | Column = 0.5) -> DataFrame:
    """tp, fp, fn, tn, unknown (masked) at score >= threshold."""
    hit, label = F.col("score") >= threshold, F.col("label")
    return df.groupBy(*by).agg(
        F.count_if(hit & (label == 1)).alias("tp"), F.count_if(hit & (label == 0)).alias("fp"), F.count_if(~hit & (label == 1)).alias("fn"),
        F.count_if(~hit & (label == 0)).alias("tn"), F.count_if(label.isNull()).alias("unknown"),
    )


def threshold_report(df: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """accuracy (NaN if nothing is scored), precision, recall, f1 (harmonic), mcc, counts as doubles, positive_ratio."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    report = confusion(df, by, threshold).withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    return report.select(
        *by, F.lit(threshold).alias("threshold"), F.when(total > 0, (tp + tn) / total).otherwise(float("nan")).alias("accuracy"), "precision", "recall",
        ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), mcc_of(tp, fp, fn, tn).alias("mcc"),
        *(x.cast("double").alias(n) for x, n in ((tp, "tp"), (fp, "fp"), (fn, "fn"), (tn, "tn"))), ratio(tp + fn, total).alias("positive_ratio"),
    )


def _distinct(df: DataFrame, by: list[str], sign: int = 1) -> DataFrame:
    rows = scored(df).where(F.col("score").isNotNull()).groupBy(*by, "score").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    # A table, since the range bounds and the running sums both read it, and what is below may be costly.
    return written(rows.withColumn("neg", F.col("n") - F.col("pos")).withColumn("_key", sign * F.col("score")), "distinct-scores")


def _summed(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """running() over a table of distinct scores; where that has few rows, one window a group gives the same."""
    if rows.count() > FEW:
        return running(rows, by, "_key", values)
    along = Window.partitionBy(*by).orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("*", *(F.sum(v).over(along).alias(f"cum_{v}") for v in values))


def auroc(df: DataFrame, by: list[str]) -> DataFrame:
    """auroc, ties counted half; null where a class is missing. Sorting is over distinct scores only."""
    rows = _summed(_distinct(df, by), by, ["neg"])
    below = F.col("cum_neg") - F.col("neg")
    u = rows.groupBy(*by).agg(F.sum(F.col("pos") * (below + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    return u.select(*by, F.try_divide(F.col("u"), F.col("p").cast("double") * F.col("q")).alias("auroc"))


def average_precision(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """average_precision: mean of tp / rank over the positives by falling score, ties in the given input order; 0 without positives.

    Each range of (score, order) is one window, so ties are dealt out, too; order must be a total order.
    """
    rows = scored(df).where(F.col("score").isNotNull()).withColumns({"_key": -F.col("score"), "one": F.lit(1)})
    ranked = running(rows.select(*by, "_key", *order, "label", "one"), by, "_key", ["one", "label"], order)
    total = ranked.groupBy(*by).agg(F.sum(F.when(F.col("label") == 1, F.col("cum_label") / F.col("cum_one"))).alias("s"), F.sum("label").alias("p"))
    return total.select(*by, ratio(F.coalesce("s", F.lit(0.0)), F.col("p")).alias("average_precision"))


def pr_auc(df: DataFrame, by: list[str]) -> DataFrame:
    """pr_auc: trapezoid over one point per distinct score, from recall 0 and precision 1; NaN without positives."""
    rows = _summed(_distinct(df, by, -1), by, ["pos", "n"])
    total = rows.groupBy(*by).agg(F.sum("pos").alias("p"))
    before_n, before_pos = F.col("cum_n") - F.col("n"), F.col("cum_pos") - F.col("pos")
    precision, earlier = F.col("cum_pos") / F.col("cum_n"), F.when(before_n > 0, F.try_divide(before_pos.cast("double"), before_n.cast("double"))).otherwise(1.0)
    area = group_join(rows, total, by, how="inner")
    area = area.groupBy(*by).agg(F.sum(F.try_divide(F.col("pos").cast("double"), F.col("p").cast("double")) * (precision + earlier) / 2).alias("pr_auc"), F.max("p").alias("p"))
    return area.select(*by, F.when(F.col("p") > 0, F.col("pr_auc")).otherwise(float("nan")).alias("pr_auc"))


def threshold_grid(low: float, high: float, step: float) -> list[float]:
    """Thresholds by repeated addition, as long as they are at most high (within 1e-12)."""
    if step <= 0:
        raise ValueError("the step must be positive")
    out, t = [], low
    while t <= high + 1e-12:
        out.append(t)
        t += step
    return out


def best_threshold(df: DataFrame, by: list[str], grid: tuple[float, float, float] = GRID) -> DataFrame:
    """threshold, f1, mcc: the first threshold with the largest F1, or within 1e-12 of it and a larger MCC.

    One pass counts the positions between neighbouring thresholds; the rest works on that histogram.
    """
    steps = threshold_grid(*grid)
    table = F.array(*map(F.lit, steps))
    reached = F.coalesce(reduce(operator.add, ((F.col("score") >= t).cast("int") for t in steps), F.lit(0)), F.lit(0))
    histogram = scored(df).groupBy(*by, reached.alias("reached")).agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    cells = histogram.groupBy(*by).agg(F.collect_list(F.struct("reached", "pos", "n")).alias("cells"))

    def above(i: Column, field: str) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(c["reached"] > i, c[field]).otherwise(0))

    def point(t: Column, i: Column) -> Column:
        tp, called = above(i, "pos"), above(i, "n")
        every, p = above(F.lit(-1), "n"), above(F.lit(-1), "pos")
        fp, fn = called - tp, p - tp
        return F.struct(t.alias("t"), f1_of(tp, fp, fn).alias("f1"), mcc_of(tp, fp, fn, every - p - fp).alias("mcc"))

    first = F.struct(F.lit(steps[0] if steps else grid[0]).alias("t"), F.lit(-1.0).alias("f1"), F.lit(-1.0).alias("mcc"))

    def better(best: Column, x: Column) -> Column:
        return F.when((x["f1"] > best["f1"]) | ((F.abs(x["f1"] - best["f1"]) < 1e-12) & (x["mcc"] > best["mcc"])), x).otherwise(best)

    found = cells.select(*by, F.aggregate(F.transform(table, point), first, better).alias("best"))
    return found.select(*by, F.col("best.t").alias("threshold"), F.greatest("best.f1", F.lit(0.0)).alias("f1"), F.greatest("best.mcc", F.lit(0.0)).alias("mcc"))


def evaluation_summary(df: DataFrame, by: list[str], order: list[str], threshold: float | None = None) -> DataFrame:
    """records, residues, average_precision, auroc, threshold, f1, mcc of every group, from one pass over the input.

    Without a threshold the sweep chooses it and gives F1 and MCC; with one, they are computed at it. A null group is
    a group like any other. A group without any scored position has average precision, F1 and MCC 0 and threshold 0.5.
    """
    df = written(df.select(*dict.fromkeys([*by, "protein_id", *order, "label", "score"])), "scored-positions")
    base = df.groupBy(*by).agg(F.countDistinct("protein_id").alias("records"), F.count_if(F.col("label").isin(0, 1)).alias("residues"))
    if threshold is None:
        cut = best_threshold(df, by)
    else:
        c = confusion(df, by, threshold)
        cut = c.select(*by, F.lit(threshold).alias("threshold"), f1_of(c.tp, c.fp, c.fn).alias("f1"), mcc_of(c.tp, c.fp, c.fn, c.tn).alias("mcc"))
    out = group_join(group_join(group_join(base, average_precision(df, by, order), by), auroc(df, by), by), cut, by)
    return out.withColumns({"threshold": F.coalesce("threshold", F.lit(0.5)), "f1": F.coalesce("f1", F.lit(0.0)), "mcc": F.coalesce("mcc", F.lit(0.0)), "average_precision": F.coalesce("average_precision", F.lit(0.0))})

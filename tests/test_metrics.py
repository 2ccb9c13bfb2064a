import itertools
import random

import pytest
from pyspark.sql import functions as F

from seqweave.operators import metrics, rank

TIES = list(zip([1, 0, 1, 0, 1, 0, 0], [0.9, 0.9, 0.8, 0.6, 0.6, 0.6, 0.1], strict=True))


def frame(spark, rows, group="g"):
    return spark.createDataFrame([(group, "p", i + 1, y, float(p)) for i, (y, p) in enumerate(rows)], "grp string, protein_id string, position int, label int, score double")


def value(df, name):
    return df.first()[name]


def test_auroc(spark):
    assert value(metrics.auroc(frame(spark, [(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)]), ["grp"]), "auroc") == 1.0
    assert value(metrics.auroc(frame(spark, TIES), ["grp"]), "auroc") == pytest.approx(0.7083333333)
    assert value(metrics.auroc(frame(spark, [(1, 0.5), (1, 0.7)]), ["grp"]), "auroc") is None
    assert metrics.auroc(frame(spark, TIES).limit(0), ["grp"]).count() == 0


def test_auroc_against_pairs(spark):
    draw = random.Random(3)
    rows = [(draw.randint(0, 1), draw.choice([0.1, 0.2, 0.5, draw.random()])) for _ in range(300)]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    wanted = sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)) / (len(pos) * len(neg))
    assert value(metrics.auroc(frame(spark, rows), ["grp"]), "auroc") == pytest.approx(wanted)


def test_average_precision_depends_on_tie_order(spark):
    assert value(metrics.average_precision(frame(spark, TIES), ["grp"], ["position"]), "average_precision") == pytest.approx(0.7555555556)
    other = list(zip([0, 1, 1, 0, 0, 1, 0], [0.9, 0.9, 0.8, 0.6, 0.6, 0.6, 0.1], strict=True))
    assert value(metrics.average_precision(frame(spark, other), ["grp"], ["position"]), "average_precision") == pytest.approx(0.5555555556)
    for rows in (TIES, other):
        assert value(metrics.pr_auc(frame(spark, rows), ["grp"]), "pr_auc") == pytest.approx(0.6388888889)


def test_sweep(spark):
    best = metrics.best_threshold(frame(spark, TIES), ["grp"]).first()
    assert (best["threshold"], best["f1"], best["mcc"]) == pytest.approx((0.65, 0.6666666667, 0.4166666667))
    grid = metrics.threshold_grid(0.05, 0.95, 0.05)
    assert len(grid) == 19 and grid[-1] == 0.9500000000000003
    with pytest.raises(ValueError):
        metrics.threshold_grid(0, 1, 0)


def test_masked_and_null_scores_are_not_scored(spark):
    rows = frame(spark, TIES).unionByName(spark.createDataFrame([("g", "p", 9, None, 0.99), ("g", "p", 10, None, None)], "grp string, protein_id string, position int, label int, score double"))
    assert value(metrics.auroc(rows, ["grp"]), "auroc") == pytest.approx(0.7083333333)
    assert metrics.confusion(rows, ["grp"]).first()["unknown"] == 2


def test_class_stats_and_report(spark):
    stats = metrics.class_stats(frame(spark, TIES), ["grp"]).first()
    assert (stats["pos"], stats["neg"], stats["total"]) == (3, 4, 7) and stats["pos_weight"] == pytest.approx(4 / 3)
    report = metrics.threshold_report(frame(spark, TIES), ["grp"], 0.65).first()
    assert (report["tp"], report["fp"], report["fn"], report["tn"]) == (2.0, 1.0, 1.0, 3.0) and report["f1"] == pytest.approx(2 / 3)
    assert metrics.confusion(frame(spark, TIES), ["grp"], F.lit(2.0)).first()["fn"] == 3


def test_no_single_partition_and_no_embedding(spark):
    rows = frame(spark, TIES * 50)
    plan = metrics.average_precision(rows, ["grp"], ["position"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_a_null_group_is_a_group(spark):
    rows = frame(spark, TIES, None).unionByName(frame(spark, TIES, "g"))
    for found in (
        metrics.auroc(rows, ["grp"]), metrics.average_precision(rows, ["grp"], ["position"]), metrics.pr_auc(rows, ["grp"]), metrics.best_threshold(rows, ["grp"]),
        metrics.evaluation_summary(rows, ["grp"], ["protein_id", "position"]), metrics.evaluation_summary(rows, ["grp"], ["protein_id", "position"], 0.5),
    ):
        both = {r["grp"]: r.asDict() | {"grp": 0} for r in found.collect()}
        assert both.keys() == {None, "g"} and both[None] == both["g"] and None not in both["g"].values()


@pytest.mark.parametrize("by", [["grp"], []])
def test_a_group_of_ties_is_dealt_into_ranges(spark, by):
    draw = random.Random(1)
    rows = [(draw.randint(0, 1), 0.5 if draw.random() < 0.9 else draw.random()) for _ in range(1200)]
    df = frame(spark, rows)
    ranges = rank.dealt(df.withColumn("k", -F.col("score")), "k", ["position"], 16).groupBy("_range").count().collect()
    assert len(ranges) > 8 and max(r["count"] for r in ranges) < 300
    order = sorted(range(len(rows)), key=lambda i: (-rows[i][1], i))
    hits, total = 0, 0.0
    for rank_, i in enumerate(order, 1):
        hits += rows[i][0]
        total += hits / rank_ if rows[i][0] else 0
    assert value(metrics.average_precision(df, by, ["position"]), "average_precision") == pytest.approx(total / hits)

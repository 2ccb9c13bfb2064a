"""Metrics over the event and order-line positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.functions.expressions import at_threshold, ratio, sigmoid
from seqweave.operators import metrics
from seqweave.plans.registry import query
from seqweave.sources.adapters import EVENT_RESIDUES, LINEITEM_PREDICTIONS, event_residues, lineitem_predictions

EV, LI = "WITH " + EVENT_RESIDUES, "WITH " + LINEITEM_PREDICTIONS
COUNTS = """c AS (SELECT split, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp,
  count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn, count(*) FILTER (label IS NULL) AS unknown FROM ev GROUP BY split)"""
MCC = "coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0.0)"
F1 = "coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0.0)"


def rounded(df, *names, places=9):
    return df.withColumns({n: F.round(n, places) for n in names})


@query("p5_scored_residues", f"{EV} SELECT protein_id, position, label, score FROM ev WHERE label IN (0, 1)")
def p5(spark, sf):
    return metrics.scored(event_residues(spark, sf)).select("protein_id", "position", "label", "score")


@query("p10_threshold", f"{EV} SELECT protein_id, position, (score >= 0.5)::INT AS pred_label FROM ev")
def p10(spark, sf):
    return event_residues(spark, sf).select("protein_id", "position", at_threshold(F.col("score"), 0.5).alias("pred_label"))


@query("p11_sigmoid", "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(l_quantity - 25) / 5)), 9) AS p FROM lineitem")
def p11(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", F.round(sigmoid((F.col("l_quantity") - 25) / 5), 9).alias("p"))


@query("p12_safe_ratio", f"{EV} SELECT protein_id, round(coalesce(count(*) FILTER (label = 1)::DOUBLE / nullif(count(*) FILTER (score >= 0.95), 0), 0.0), 9) AS r FROM ev GROUP BY protein_id")
def p12(spark, sf):
    rows = event_residues(spark, sf).groupBy("protein_id").agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("score") >= 0.95).alias("b"))
    return rows.select("protein_id", F.round(ratio(F.col("a"), F.col("b")), 9).alias("r"))


@query("a1_class_stats", f"""{EV}, c AS (SELECT split, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM ev GROUP BY split)
SELECT split, pos, neg, pos + neg AS total, round(pos::DOUBLE / nullif(pos + neg, 0), 9) AS pos_ratio, round(neg::DOUBLE / nullif(pos, 0), 9) AS pos_weight FROM c""")
def a1(spark, sf):
    return rounded(metrics.class_stats(event_residues(spark, sf), ["split"]), "pos_ratio", "pos_weight")


@query("a2_confusion", f"{EV}, {COUNTS} SELECT * FROM c")
def a2(spark, sf):
    return metrics.confusion(event_residues(spark, sf), ["split"])


@query("a3_f1", f"{EV}, {COUNTS} SELECT split, round({F1}, 9) AS f1 FROM c")
def a3(spark, sf):
    c = metrics.confusion(event_residues(spark, sf), ["split"])
    return c.select("split", F.round(metrics.f1_of(c.tp, c.fp, c.fn), 9).alias("f1"))


@query("a4_mcc", f"{EV}, {COUNTS} SELECT split, round({MCC}, 9) AS mcc FROM c")
def a4(spark, sf):
    c = metrics.confusion(event_residues(spark, sf), ["split"])
    return c.select("split", F.round(metrics.mcc_of(c.tp, c.fp, c.fn, c.tn), 9).alias("mcc"))


AUROC = """d AS (SELECT {by}, score, sum(label) AS pos, count(*) - sum(label) AS neg FROM {rows} WHERE label IN (0, 1) GROUP BY {by}, score),
r AS (SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY score) - neg AS below FROM d)"""


@query("a5_auroc", f"{EV}, {AUROC.format(by='split', rows='ev')} SELECT split, round(sum(pos * (below + neg / 2.0))::DOUBLE / nullif(sum(pos)::DOUBLE * sum(neg), 0), 9) AS auroc FROM r GROUP BY split")
def a5(spark, sf):
    return rounded(metrics.auroc(event_residues(spark, sf), ["split"]), "auroc")


def _by_price(spark, sf):
    """Order lines with a nearly unique score: the price, in one group per discount."""
    return lineitem_predictions(spark, sf).select(F.col("score").alias("grp"), F.col("price").alias("score"), "label", "protein_id", "position")


PRICED = LI + ", pr AS (SELECT score AS grp, price AS score, label, protein_id, position FROM li)"


@query("a5_auroc_unique_scores", f"{PRICED}, {AUROC.format(by='grp', rows='pr')} SELECT grp, round(sum(pos * (below + neg / 2.0))::DOUBLE / nullif(sum(pos)::DOUBLE * sum(neg), 0), 9) AS auroc FROM r GROUP BY grp")
def a5_unique(spark, sf):
    return rounded(metrics.auroc(_by_price(spark, sf), ["grp"]), "auroc")


AP = """o AS (SELECT {by}, label, row_number() OVER w AS i, sum(label) OVER w AS tp FROM {rows} WHERE label IN (0, 1)
  WINDOW w AS (PARTITION BY {by} ORDER BY -score, {order} ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT {by}, coalesce(sum(CASE WHEN label = 1 THEN tp::DOUBLE / i END) / nullif(sum(label), 0), 0.0) AS average_precision FROM o GROUP BY {by})"""


@query("a6_average_precision", f"{EV}, {AP.format(by='split', rows='ev', order='protein_id, position')} SELECT split, round(average_precision, 9) AS average_precision FROM ap")
def a6(spark, sf):
    return rounded(metrics.average_precision(event_residues(spark, sf), ["split"], ["protein_id", "position"]), "average_precision")


PR = """d AS (SELECT {by}, score, sum(label) AS pos, count(*) AS n FROM {rows} WHERE label IN (0, 1) GROUP BY {by}, score),
c AS (SELECT {by}, pos, n, sum(pos) OVER (PARTITION BY {by} ORDER BY score DESC) AS cp, sum(n) OVER (PARTITION BY {by} ORDER BY score DESC) AS cn, sum(pos) OVER (PARTITION BY {by}) AS p FROM d)"""


@query("a7_pr_auc", f"""{EV}, {PR.format(by='split', rows='ev')}
SELECT split, round(sum(pos::DOUBLE / p * (cp::DOUBLE / cn + CASE WHEN cn > n THEN (cp - pos)::DOUBLE / (cn - n) ELSE 1.0 END) / 2), 9) AS pr_auc FROM c GROUP BY split""")
def a7(spark, sf):
    return rounded(metrics.pr_auc(event_residues(spark, sf), ["split"]), "pr_auc")


SWEEP = f"""grid(i, t) AS (SELECT 0, 0.05::DOUBLE UNION ALL SELECT i + 1, t + 0.05::DOUBLE FROM grid WHERE t + 0.05::DOUBLE <= 0.95::DOUBLE + 1e-12::DOUBLE),
pts AS (SELECT split, i, t, count(*) FILTER (score >= t AND label = 1) AS tp, count(*) FILTER (score >= t AND label = 0) AS fp,
        count(*) FILTER (score < t AND label = 1) AS fn, count(*) FILTER (score < t AND label = 0) AS tn FROM ev, grid WHERE label IN (0, 1) GROUP BY split, i, t),
vals AS (SELECT split, i, t, {F1} AS f1, {MCC} AS mcc FROM pts),
walk AS (SELECT split, i, t AS bt, f1 AS bf, mcc AS bm FROM vals WHERE i = 0
  UNION ALL SELECT v.split, v.i, CASE WHEN v.f1 > bf OR (abs(v.f1 - bf) < 1e-12 AND v.mcc > bm) THEN v.t ELSE bt END,
    CASE WHEN v.f1 > bf OR (abs(v.f1 - bf) < 1e-12 AND v.mcc > bm) THEN v.f1 ELSE bf END, CASE WHEN v.f1 > bf OR (abs(v.f1 - bf) < 1e-12 AND v.mcc > bm) THEN v.mcc ELSE bm END
  FROM walk w JOIN vals v ON v.split = w.split AND v.i = w.i + 1),
best AS (SELECT split, bt AS threshold, greatest(bf, 0.0) AS f1, greatest(bm, 0.0) AS mcc FROM walk WHERE i = (SELECT max(i) FROM grid))"""
REC = "WITH RECURSIVE " + EVENT_RESIDUES


@query("a8_best_threshold", f"{REC}, {SWEEP} SELECT split, threshold, round(f1, 9) AS f1, round(mcc, 9) AS mcc FROM best")
def a8(spark, sf):
    return rounded(metrics.best_threshold(event_residues(spark, sf), ["split"]), "f1", "mcc")


@query("a9_threshold_report", f"""{EV}, {COUNTS}, x AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0) AS recall, tp + fp + fn + tn AS n FROM c)
SELECT split, 0.5::DOUBLE AS threshold, round((tp + tn)::DOUBLE / n, 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall,
  round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0), 9) AS f1, round({MCC}, 9) AS mcc, tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tn::DOUBLE AS tn,
  round((tp + fn)::DOUBLE / n, 9) AS positive_ratio FROM x""")
def a9(spark, sf):
    return rounded(metrics.threshold_report(event_residues(spark, sf), ["split"]), "accuracy", "precision", "recall", "f1", "mcc", "positive_ratio")


@query("a10_evaluation_summary", f"""{REC}, {SWEEP}, {AP.format(by='split', rows='ev', order='protein_id, position')}, {AUROC.format(by='split', rows='ev')},
au AS (SELECT split, sum(pos * (below + neg / 2.0))::DOUBLE / nullif(sum(pos)::DOUBLE * sum(neg), 0) AS auroc FROM r GROUP BY split)
SELECT e.split, records, residues, round(average_precision, 9) AS average_precision, round(auroc, 9) AS auroc, threshold, round(f1, 9) AS f1, round(mcc, 9) AS mcc
FROM (SELECT split, count(DISTINCT protein_id) AS records, count(*) FILTER (label IN (0, 1)) AS residues FROM ev GROUP BY split) e
JOIN ap ON ap.split = e.split JOIN au ON au.split = e.split JOIN best ON best.split = e.split""")
def a10(spark, sf):
    return rounded(metrics.evaluation_summary(event_residues(spark, sf), ["split"], ["protein_id", "position"]), "average_precision", "auroc", "f1", "mcc")


NULLABLE = EVENT_RESIDUES + """, evn AS (SELECT protein_id, position, label, CASE WHEN score < 0.6 THEN 0.3::DOUBLE ELSE score END AS score,
  CASE WHEN protein_id::BIGINT % 5 = 1 THEN 'none' ELSE split END AS split FROM ev)"""
EVN, RECN, NAMED = "WITH " + NULLABLE, "WITH RECURSIVE " + NULLABLE, "nullif({}.split, 'none') AS split"


def _nullable(spark, sf):
    """Event positions where a fifth of the sequences is in no split, and most positions have the same score."""
    rows = event_residues(spark, sf)
    split = F.when(F.col("protein_id").cast("long") % 5 != 1, F.col("split"))
    return rows.withColumns({"split": split, "score": F.when(F.col("score") < 0.6, 0.3).otherwise(F.col("score"))})


@query("a5_auroc_null_group", f"{EVN}, {AUROC.format(by='split', rows='evn')} SELECT {NAMED.format('r')}, round(sum(pos * (below + neg / 2.0))::DOUBLE / nullif(sum(pos)::DOUBLE * sum(neg), 0), 9) AS auroc FROM r GROUP BY r.split")
def a5_null(spark, sf):
    return rounded(metrics.auroc(_nullable(spark, sf), ["split"]), "auroc")


@query("a6_average_precision_null_group", f"{EVN}, {AP.format(by='split', rows='evn', order='protein_id, position')} SELECT {NAMED.format('ap')}, round(average_precision, 9) AS average_precision FROM ap")
def a6_null(spark, sf):
    return rounded(metrics.average_precision(_nullable(spark, sf), ["split"], ["protein_id", "position"]), "average_precision")


@query("a7_pr_auc_null_group", f"""{EVN}, {PR.format(by='split', rows='evn')}
SELECT {NAMED.format('c')}, round(sum(pos::DOUBLE / p * (cp::DOUBLE / cn + CASE WHEN cn > n THEN (cp - pos)::DOUBLE / (cn - n) ELSE 1.0 END) / 2), 9) AS pr_auc FROM c GROUP BY c.split""")
def a7_null(spark, sf):
    return rounded(metrics.pr_auc(_nullable(spark, sf), ["split"]), "pr_auc")


@query("a10_evaluation_summary_null_group", f"""{RECN}, {SWEEP.replace('FROM ev, grid', 'FROM evn, grid')}, {AP.format(by='split', rows='evn', order='protein_id, position')}, {AUROC.format(by='split', rows='evn')},
au AS (SELECT split, sum(pos * (below + neg / 2.0))::DOUBLE / nullif(sum(pos)::DOUBLE * sum(neg), 0) AS auroc FROM r GROUP BY split)
SELECT {NAMED.format('e')}, records, residues, round(average_precision, 9) AS average_precision, round(auroc, 9) AS auroc, threshold, round(f1, 9) AS f1, round(mcc, 9) AS mcc
FROM (SELECT split, count(DISTINCT protein_id) AS records, count(*) FILTER (label IN (0, 1)) AS residues FROM evn GROUP BY split) e
JOIN ap ON ap.split = e.split JOIN au ON au.split = e.split JOIN best ON best.split = e.split""")
def a10_null(spark, sf):
    return rounded(metrics.evaluation_summary(_nullable(spark, sf), ["split"], ["protein_id", "position"]), "average_precision", "auroc", "f1", "mcc")

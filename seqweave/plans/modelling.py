"""Losses, samples, histories, scoring, structures and joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from seqweave.functions.expressions import sigmoid
from seqweave.functions.shared import shared_folder
from seqweave.operators import fitting, history, joins, losses, scoring, splits, structure, windows
from seqweave.plans.registry import query
from seqweave.sources import sinks
from seqweave.sources.adapters import EMBEDDING_POSITIONS, EVENT_RESIDUES, EVENT_SEQUENCES, LINEITEM_PREDICTIONS, embedding_positions, event_residues, event_sequences, lineitem_predictions
from seqweave.sources.scans import contiguous_last

EV, EM = "WITH " + EVENT_RESIDUES, "WITH " + EMBEDDING_POSITIONS
ES = f"WITH {EVENT_RESIDUES}, {EVENT_SEQUENCES}"
WEIGHTS = [((i * 7) % 13 - 6) / 10 for i in range(64)]
DOT = "list_dot_product(embedding::DOUBLE[], [" + ", ".join(f"{w}::DOUBLE" for w in WEIGHTS) + "]) + 0.1"


@query("a11_weighted_bce", f"""{EV}, l AS (SELECT split, label, 4 * score - 2 AS x FROM ev WHERE label IS NOT NULL)
SELECT split, round(avg((1 - label) * x + (1 + (3.0::DOUBLE - 1) * label) * (ln(1 + exp(-abs(x))) + greatest(-x, 0))), 8) AS loss FROM l GROUP BY split""")
def a11(spark, sf):
    return losses.mean_loss(event_residues(spark, sf).withColumn("logit", 4 * F.col("score") - 2), ["split"], 3.0).withColumn("loss", F.round("loss", 8))


@query("a12_capped_sample", f"""{EV}, r AS (SELECT *, row_number() OVER (PARTITION BY split, label ORDER BY md5(protein_id || '/' || position || ':0')) AS i FROM ev WHERE label IS NOT NULL)
SELECT split, label, protein_id, position FROM r WHERE i <= 50""")
def a12(spark, sf):
    key = F.concat_ws("/", "protein_id", F.col("position").cast("string"))
    return losses.capped_sample(event_residues(spark, sf), ["split"], key, 50).select("split", "label", "protein_id", "position")


@query("a13_contrastive_loss", f"""{EM}, b AS (SELECT *, protein_id::BIGINT % 4 AS batch FROM em), r AS (SELECT *, row_number() OVER (PARTITION BY batch, label ORDER BY md5(protein_id || '/' || position || ':0')) AS i FROM b),
s AS (SELECT batch, label, protein_id || '/' || position AS k, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM r WHERE i <= 16),
p AS (SELECT a.batch, a.k, a.label = c.label AS same, a.k <> c.k AS apart, list_dot_product(a.e, c.e) / (a.norm * c.norm) / 0.1 AS l FROM s a JOIN s c ON a.batch = c.batch),
m AS (SELECT *, l - max(l) OVER (PARTITION BY batch, k) AS z FROM p), d AS (SELECT *, z - ln(sum(CASE WHEN apart THEN exp(z) ELSE 0 END) OVER (PARTITION BY batch, k) + 1e-12) AS lp FROM m),
q AS (SELECT batch, k, avg(lp) AS v FROM d WHERE same AND apart GROUP BY ALL)
SELECT batch, (SELECT count(*) FROM s WHERE s.batch = q.batch) AS n, round(-avg(v), 6) AS loss FROM q GROUP BY batch""")
def a13(spark, sf):
    key = F.concat_ws("/", "protein_id", F.col("position").cast("string"))
    rows = embedding_positions(spark, sf).withColumn("batch", F.col("protein_id").cast("long") % 4)
    return losses.contrastive_loss(losses.capped_sample(rows, ["batch"], key, 16), ["batch"], block=8).withColumn("loss", F.round("loss", 6))


STEPS = f"{EV}, st AS (SELECT protein_id AS epoch, position AS step, score AS loss FROM ev)"


def _steps(spark, sf):
    return event_residues(spark, sf).select(F.col("protein_id").alias("epoch"), F.col("position").alias("step"), F.col("score").alias("loss"))


@query("a15_print_windows", f"{STEPS} SELECT epoch, (step - 1) // 10 AS window_ix, min(step) AS first_step, count(*) AS steps, round(avg(loss), 9) AS loss FROM st GROUP BY ALL")
def a15(spark, sf):
    return history.print_windows(_steps(spark, sf), 10).withColumn("loss", F.round("loss", 9))


@query("a15_epoch_summary", f"{STEPS} SELECT epoch, round(avg(loss), 9) AS loss, count(*) AS steps FROM st GROUP BY epoch")
def a15_epochs(spark, sf):
    return history.epoch_summary(_steps(spark, sf)).withColumn("loss", F.round("loss", 9))


@query("a16_best_evaluation", f"""{STEPS}, i AS (SELECT *, coalesce(loss > max(loss) OVER (PARTITION BY epoch ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM st),
g AS (SELECT *, sum(improved::INT) OVER (PARTITION BY epoch ORDER BY step) AS isl FROM i), d AS (SELECT *, row_number() OVER (PARTITION BY epoch, isl ORDER BY step) - 1 AS idle FROM g),
s AS (SELECT epoch, min(step) FILTER (idle >= 8) AS stop_step FROM d GROUP BY epoch)
SELECT d.epoch AS run, max(step)::INT AS best_step, max(loss) AS best_auroc, stop_step FROM d JOIN s ON s.epoch = d.epoch WHERE improved AND (stop_step IS NULL OR step <= stop_step) GROUP BY ALL""")
def a16(spark, sf):
    evals = _steps(spark, sf).select(F.col("epoch").alias("run"), "step", F.col("loss").alias("auroc"))
    return history.best_evaluation(evals, 8)


@query("a17_feature_audit", f"{EM} SELECT protein_id, count(*) AS length, 64 AS width, 192 AS actual_dim, 192 AS expected_dim, count(*) * 192 AS cells, true AS matches FROM em GROUP BY protein_id")
def a17(spark, sf):
    rows = embedding_positions(spark, sf)
    return scoring.feature_audit(rows, windows.context_concat(rows, 1, 64), 3)


@query("a18_extraction_report", f"{ES} SELECT count(*) FILTER (protein_id::BIGINT % 3 <> 0) AS written, count(*) FILTER (protein_id::BIGINT % 3 = 0) AS skipped, count(*) FILTER (length(sequence) <= 64) AS short, count(*) FILTER (length(sequence) > 64) AS long FROM es")
def a18(spark, sf):
    rows = event_sequences(spark, sf)
    return scoring.extraction_report(rows, rows.where(F.col("protein_id").cast("long") % 3 == 0), 64)


@query("l1_linear_scores", f"{EM} SELECT protein_id, position, round({DOT}, 6) AS logit FROM em")
def l1(spark, sf):
    rows = embedding_positions(spark, sf)
    return rows.select("protein_id", "position", F.round(scoring.linear_logit(F.col("embedding"), WEIGHTS, 0.1), 6).alias("logit"))


def _layers(width: int):
    draw = np.random.default_rng(5)
    return [{"weight": draw.normal(size=(16, width)) * 0.2, "bias": draw.normal(size=16) * 0.1, "scale": np.ones(16), "shift": np.zeros(16)}, {"weight": draw.normal(size=(1, 16)), "bias": np.zeros(1)}]


def _mlp_sql(layers) -> str:
    """The two layers as SQL: dot products of the hidden units, their normalisation, and the output's dot product."""
    numbers = lambda row: "[" + ", ".join(f"{w:.17e}" for w in row) + "]"
    units = ", ".join(f"list_dot_product(e, {numbers(w)}) + {b:.17e}" for w, b in zip(layers[0]["weight"], layers[0]["bias"], strict=True))
    return f"""{EM}, u AS (SELECT protein_id, position, [{units}] AS u FROM (SELECT protein_id, position, embedding::DOUBLE[] AS e FROM em)),
m AS (SELECT *, list_avg(u) AS mean FROM u), v AS (SELECT *, sqrt(list_avg(list_transform(u, lambda x: (x - mean) * (x - mean))) + 1e-5::DOUBLE) AS spread FROM m)
SELECT protein_id, position, round(list_dot_product(list_transform(u, lambda x: greatest(0.0::DOUBLE, (x - mean) / spread)), {numbers(layers[1]["weight"][0])}), 6) AS logit FROM v"""


@query("l1_mlp_scores", _mlp_sql(_layers(64)))
def l1_mlp(spark, sf):
    rows = embedding_positions(spark, sf).select("protein_id", "position", "embedding")
    return scoring.mlp_logits(rows, _layers(64)).withColumn("logit", F.round("logit", 6))


def _convolutions():
    draw = np.random.default_rng(6)
    return [{"weight": draw.normal(size=(8, 64, 3)) * 0.2, "bias": np.zeros(8), "dilation": 2}, {"weight": draw.normal(size=(1, 8, 1)), "bias": np.zeros(1)}]


def _cnn_sql(layers) -> str:
    """The convolution as three dot products, with the vectors two positions before and behind."""
    numbers = lambda row: "[" + ", ".join(f"{w:.17e}" for w in row) + "]"
    unit = lambda w: " + ".join(f"coalesce(list_dot_product({e}, {numbers(w[:, k])}), 0.0)" for k, e in enumerate(("before", "e", "behind")))
    hidden = ", ".join(f"greatest(0.0::DOUBLE, {unit(w)})" for w in layers[0]["weight"])
    return f"""{EM}, v AS (SELECT protein_id, position, embedding::DOUBLE[] AS e FROM em), n AS (SELECT *, lag(e, 2) OVER o AS before, lead(e, 2) OVER o AS behind FROM v WINDOW o AS (PARTITION BY protein_id ORDER BY position))
SELECT protein_id, position, round(list_dot_product([{hidden}], {numbers(layers[1]["weight"][0][:, 0])}), 6) AS logit FROM n"""


@query("l1_cnn_scores", _cnn_sql(_convolutions()))
def l1_cnn(spark, sf):
    return scoring.cnn_logits(embedding_positions(spark, sf), _convolutions(), tile=8).withColumn("logit", F.round("logit", 6))


@query("l2_fit_linear")
def l2(spark, sf):
    rows = embedding_positions(spark, sf)
    return scoring.predicted(rows.select("protein_id", "position", "embedding", "label"), scoring.fit_linear(rows, 2.0)).select("protein_id", "position", F.round("score", 4).alias("score"))


@query("l2_fit_heads")
def l2_heads(spark, sf):
    """Scores of a dense and of a convolutional head after some steps of the weighted fit over all positions."""
    rows = embedding_positions(spark, sf).select("protein_id", "position", "embedding", "label")
    dense, _ = fitting.fit_head(rows, _layers(64), steps=4)
    wide, _ = fitting.fit_head(rows, _convolutions(), steps=4, tile=16)
    one = scoring.mlp_logits(rows.drop("label"), dense).withColumn("head", F.lit("dense"))
    other = scoring.cnn_logits(rows, wide).withColumn("head", F.lit("convolutional"))
    return one.unionByName(other).select("head", "protein_id", "position", F.round(sigmoid(F.col("logit")), 4).alias("score"))


@query("l3_checked_width", f"{EM} SELECT protein_id, position, len(embedding)::INT AS width FROM em")
def l3(spark, sf):
    return scoring.check_width(embedding_positions(spark, sf), 64).select("protein_id", "position", F.size("embedding").alias("width"))


@query("s9_contiguous_predictions", f"""WITH {LINEITEM_PREDICTIONS}, l AS (SELECT protein_id, position, arg_max(score, price) AS score FROM li GROUP BY ALL),
c AS (SELECT protein_id, min(position) = 1 AND max(position) = count(*) AS contiguous FROM l GROUP BY protein_id) SELECT protein_id, position, score, contiguous FROM l JOIN c USING (protein_id)""")
def s9(spark, sf):
    return contiguous_last(lineitem_predictions(spark, sf), "price")


@query("j6_aligned_predictions", f"""{EV}, n AS (SELECT protein_id, max(position) AS n FROM ev GROUP BY protein_id),
p AS (SELECT o_custkey::VARCHAR AS protein_id, o_orderkey % 100 AS pos FROM orders),
s AS (SELECT CASE WHEN n IS NULL THEN 'missing_pid' WHEN pos < 1 OR pos > n THEN 'bad_pos' WHEN label IS NULL THEN 'skipped_masked' ELSE 'used' END AS status
  FROM p LEFT JOIN n USING (protein_id) LEFT JOIN ev e ON e.protein_id = p.protein_id AND e.position = p.pos) SELECT status, count(*) AS n FROM s GROUP BY status""")
def j6(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").cast("string").alias("protein_id"), (F.col("o_orderkey") % 100).cast("string").alias("position"), F.lit(0.5).alias("score"))
    return joins.aligned_predictions(rows, event_residues(spark, sf)).groupBy("status").agg(F.count("*").alias("n"))


@query("j7_feature_gaps", f"""{ES}, f AS (SELECT protein_id, count(*) AS rows FROM ev WHERE protein_id::BIGINT % 9 <> 0 AND position <= 70 GROUP BY protein_id)
SELECT e.protein_id, length(sequence)::INT AS length, rows, CASE WHEN rows IS NULL THEN 'missing' WHEN rows <> length(sequence) THEN 'mismatch' ELSE 'ok' END AS status FROM es e LEFT JOIN f USING (protein_id)""")
def j7(spark, sf):
    have = event_residues(spark, sf).where((F.col("protein_id").cast("long") % 9 != 0) & (F.col("position") <= 70))
    return joins.feature_gaps(event_sequences(spark, sf), have)


SPLIT = "sp AS (SELECT DISTINCT protein_id, CASE WHEN protein_id::BIGINT % 4 = 0 THEN 'val' ELSE 'train' END AS split FROM em WHERE protein_id::BIGINT % 5 <> 0)"


def _split(rows):
    n = F.col("protein_id").cast("long")
    return rows.where(n % 5 != 0).select("protein_id", F.when(n % 4 == 0, "val").otherwise("train").alias("split")).distinct()


@query("j8_feature_split", f"{EM}, {SPLIT} SELECT split, protein_id, position FROM em JOIN sp USING (protein_id)")
def j8(spark, sf):
    rows = embedding_positions(spark, sf)
    return splits.split_features(rows, _split(rows))[0].select("split", "protein_id", "position")


@query("j8_split_report", f"""{EM}, {SPLIT} SELECT split, count(*) FILTER (split IS NOT NULL) AS copied, 0::BIGINT AS missing, count(*) FILTER (split IS NULL) AS extra FROM (SELECT DISTINCT protein_id FROM em) LEFT JOIN sp USING (protein_id) GROUP BY split""")
def j8_report(spark, sf):
    rows = embedding_positions(spark, sf)
    return splits.split_features(rows, _split(rows))[1]


@query("j11_fusion", f"{EV} SELECT protein_id, position, round(0.25 * score + 0.75 * (1 - score), 9) AS score FROM ev")
def j11(spark, sf):
    rows = event_residues(spark, sf).select("protein_id", "position", "score")
    return joins.fused(rows, rows.withColumn("score", 1 - F.col("score")), 0.25, 0.75).withColumn("score", F.round("score", 9))


def _pairs(spark, sf):
    rows = event_sequences(spark, sf).select("protein_id", "sequence")
    other = rows.select((F.col("protein_id").cast("long") - 1).cast("string").alias("protein_id"), F.col("sequence").alias("subject"), F.col("protein_id").alias("other"))
    return rows.join(other, "protein_id").select(F.concat_ws("-", "protein_id", "other").alias("pair_id"), "protein_id", F.col("sequence").alias("query"), "subject")


@query("x1_local_alignment", f"""{ES.replace('WITH', 'WITH RECURSIVE', 1)}, pr AS (SELECT a.protein_id || '-' || b.protein_id AS pair_id, string_split(a.sequence, '') AS q, string_split(b.sequence, '') AS s FROM es a JOIN es b ON a.protein_id = (b.protein_id::BIGINT - 1)::VARCHAR),
dp AS (SELECT pair_id, q, s, 0 AS i, list_transform(range(0, len(s) + 1), lambda j: 0::BIGINT) AS h, []::BIGINT[][] AS moves, 0::BIGINT AS best, 0 AS bi, 0::BIGINT AS bj FROM pr
  UNION ALL SELECT pair_id, q, s, i + 1, row, list_append(moves, list_transform(range(1, len(row)), lambda j: CASE WHEN d[j] > 0 AND d[j] >= h[j + 1] - 2 AND d[j] >= row[j] - 2 THEN 1 WHEN h[j + 1] > 2 AND h[j + 1] >= row[j] THEN 2 WHEN row[j] > 2 THEN 3 ELSE 0 END::BIGINT)),
    greatest(best, list_max(row)), CASE WHEN list_max(row) > best THEN i + 1 ELSE bi END, CASE WHEN list_max(row) > best THEN list_position(row, list_max(row)) - 1 ELSE bj END FROM (
    SELECT pair_id, q, s, i, h, moves, d, best, bi, bj, list_transform(range(0, len(c)), lambda j: list_max(c[1:j + 1]) - 2 * j) AS row FROM (
      SELECT *, list_transform(range(0, len(s) + 1), lambda j: 2 * j + CASE WHEN j = 0 THEN 0 ELSE greatest(0, d[j], h[j + 1] - 2) END) AS c FROM (
        SELECT *, list_transform(range(1, len(s) + 1), lambda j: h[j] + CASE WHEN s[j] = q[i + 1] THEN 2 ELSE -1 END) AS d FROM dp WHERE i < len(q))))),
tr AS (SELECT pair_id, q, s, moves, best, bi AS i, bj AS j, []::VARCHAR[] AS pairs, 0 AS same FROM dp WHERE i = len(q)
  UNION ALL SELECT pair_id, q, s, moves, best, CASE WHEN m = 3 THEN i ELSE i - 1 END, CASE WHEN m = 2 THEN j ELSE j - 1 END, CASE WHEN m = 1 THEN list_prepend('{{"query_pos":' || i || ',"subject_pos":' || j || '}}', pairs) ELSE pairs END, same + CASE WHEN m = 1 AND q[i] = s[j] THEN 1 ELSE 0 END
    FROM (SELECT *, moves[i][j] AS m FROM tr WHERE i > 0 AND j > 0) WHERE m > 0),
en AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY i + j) AS k FROM tr)
SELECT pair_id, best::INT AS score, round(CASE WHEN len(pairs) > 0 THEN same / len(pairs)::DOUBLE ELSE 0 END, 9) AS identity, len(pairs)::INT AS mapped, '[' || array_to_string(pairs, ',') || ']' AS pairs FROM en WHERE k = 1""")
def x1(spark, sf):
    return structure.align_pairs(_pairs(spark, sf)).select("pair_id", "score", F.round("identity", 9).alias("identity"), "mapped", F.to_json("pairs").alias("pairs"))


@query("x1_alignment_scores", f"""{ES.replace('WITH', 'WITH RECURSIVE', 1)}, pr AS (SELECT a.protein_id || '-' || b.protein_id AS pair_id, string_split(a.sequence, '') AS q, string_split(b.sequence, '') AS s FROM es a JOIN es b ON a.protein_id = (b.protein_id::BIGINT - 1)::VARCHAR),
dp AS (SELECT pair_id, q, s, 0 AS i, list_transform(range(0, len(s) + 1), lambda j: 0::BIGINT) AS h, 0::BIGINT AS best FROM pr
  UNION ALL SELECT pair_id, q, s, i + 1, row, greatest(best, list_max(row)) FROM (
    SELECT pair_id, q, s, i, best, list_transform(range(0, len(c)), lambda j: list_max(c[1:j + 1]) - 2 * j) AS row FROM (
      SELECT pair_id, q, s, i, best, list_transform(range(0, len(s) + 1), lambda j: 2 * j + CASE WHEN j = 0 THEN 0 ELSE greatest(0, h[j] + CASE WHEN s[j] = q[i + 1] THEN 2 ELSE -1 END, h[j + 1] - 2) END) AS c FROM dp WHERE i < len(q))))
SELECT pair_id, best::INT AS score FROM dp WHERE i = len(q)""")
def x1_scores(spark, sf):
    return structure.align_pairs(_pairs(spark, sf)).select("pair_id", "score")


@query("x2_best_structure", f"""WITH {LINEITEM_PREDICTIONS}, c AS (SELECT protein_id, position AS source_order, l_q AS mapped, 50 AS query_length, score AS identity FROM (SELECT li.*, (price / 2500)::INT AS l_q FROM li)),
r AS (SELECT *, row_number() OVER (PARTITION BY protein_id ORDER BY mapped / 50.0 DESC, mapped DESC, identity DESC, source_order) AS i FROM c WHERE mapped > 0) SELECT protein_id, source_order, mapped, identity FROM r WHERE i = 1""")
def x2(spark, sf):
    rows = lineitem_predictions(spark, sf).select("protein_id", F.col("position").alias("source_order"), F.rint(F.col("price") / 2500).cast("int").alias("mapped"), F.lit(50).alias("query_length"), F.col("score").alias("identity"))
    return structure.best_structure(rows).select("protein_id", "source_order", "mapped", "identity")


CHAINS = "ch AS (SELECT (protein_id::BIGINT - 1)::VARCHAR AS protein_id, CASE WHEN position % 2 = 0 THEN 'A' ELSE 'B' END AS chain, row_number() OVER (PARTITION BY protein_id, position % 2 ORDER BY position)::INT AS subject_pos, symbol FROM ev)"


def _chains(spark, sf):
    rows = event_residues(spark, sf)
    nth = F.row_number().over(Window.partitionBy("protein_id", F.col("position") % 2).orderBy("position"))
    return rows.select((F.col("protein_id").cast("long") - 1).cast("string").alias("protein_id"), F.when(F.col("position") % 2 == 0, "A").otherwise("B").alias("chain"), nth.alias("subject_pos"), "symbol")


FALLBACK = f"""{CHAINS}, fb AS (SELECT c.protein_id, chain, subject_pos AS query_pos, subject_pos, substr(sequence, subject_pos, 1) = symbol AS same FROM ch c JOIN es e ON e.protein_id = c.protein_id WHERE chain = 'A' AND subject_pos <= length(sequence))"""


@query("x3_positional_fallback", f"{ES}, {FALLBACK} SELECT * FROM fb")
def x3(spark, sf):
    return structure.positional_fallback(event_sequences(spark, sf), _chains(spark, sf))


@query("x4_source_choice", f"""{ES}, {FALLBACK}, b AS (SELECT protein_id, length(sequence) / 100.0 AS coverage FROM es WHERE protein_id::BIGINT % 3 <> 0), h AS (SELECT DISTINCT protein_id FROM fb)
SELECT e.protein_id, CASE WHEN coverage >= 0.65 THEN 'RCSB' WHEN h.protein_id IS NOT NULL THEN 'AlphaFold' ELSE 'Failed' END AS source,
  CASE WHEN coverage IS NULL THEN 'no structure' WHEN coverage < 0.65 THEN 'low coverage' ELSE '' END AS reason FROM es e LEFT JOIN b USING (protein_id) LEFT JOIN h ON h.protein_id = e.protein_id""")
def x4(spark, sf):
    rows = event_sequences(spark, sf)
    best = rows.where(F.col("protein_id").cast("long") % 3 != 0).select("protein_id", (F.length("sequence") / 100.0).alias("coverage"))
    return structure.choose_source(rows, best, structure.positional_fallback(rows, _chains(spark, sf)), 0.65)


CASES = f"""{ES}, {FALLBACK}, cs AS (SELECT f.protein_id, CASE WHEN f.query_pos IS NULL THEN 'unmapped' WHEN label IS NULL THEN 'unknown' WHEN score >= 0.5 AND label = 1 THEN 'tp' WHEN score >= 0.5 THEN 'fp' WHEN label = 1 THEN 'fn' ELSE 'tn' END AS status
  FROM (SELECT protein_id, CASE WHEN subject_pos % 6 = 0 THEN NULL ELSE query_pos END AS query_pos FROM fb) f LEFT JOIN ev e ON e.protein_id = f.protein_id AND e.position = f.query_pos)"""


def _cases(spark, sf):
    mapped = structure.positional_fallback(event_sequences(spark, sf), _chains(spark, sf)).withColumn("query_pos", F.when(F.col("subject_pos") % 6 != 0, F.col("query_pos")))
    positions = event_residues(spark, sf).select("protein_id", "position", "label", (F.col("score") >= 0.5).cast("int").alias("pred_label"))
    return structure.compared(mapped, positions)


@query("j12_alignment_map", f"""{ES}, {FALLBACK}, r AS (SELECT protein_id || '/' || chain AS pair_id, protein_id, subject_pos FROM ch)
SELECT r.pair_id, r.protein_id, r.subject_pos, f.query_pos, score FROM r LEFT JOIN fb f ON f.protein_id = r.protein_id AND f.chain = 'A' AND r.pair_id = f.protein_id || '/A' AND f.subject_pos = r.subject_pos AND f.same
LEFT JOIN ev e ON e.protein_id = r.protein_id AND e.position = f.query_pos""")
def j12(spark, sf):
    """Every residue of both chains, with the score of the position aligned to it; only equal symbols are aligned."""
    chains = _chains(spark, sf)
    pair = F.concat_ws("/", "protein_id", "chain").alias("pair_id")
    alignment = structure.positional_fallback(event_sequences(spark, sf), chains).where("same").select(pair, "subject_pos", "query_pos")
    scores = event_residues(spark, sf).select("protein_id", "position", "score")
    return joins.through_alignment(alignment, chains.select(pair, "protein_id", "subject_pos"), scores).select("pair_id", "protein_id", "subject_pos", "query_pos", "score")


@query("a14_status_counts", f"{CASES} SELECT protein_id, status, count(*) AS n FROM cs GROUP BY ALL")
def a14_status(spark, sf):
    return _cases(spark, sf).groupBy("protein_id", "status").agg(F.count("*").alias("n"))


@query("a14_structure_comparison", f"""{CASES}, c AS (SELECT protein_id, count(*) FILTER (status = 'tp') AS tp, count(*) FILTER (status = 'fp') AS fp, count(*) FILTER (status = 'fn') AS fn, count(*) FILTER (status = 'tn') AS tn,
  count(*) FILTER (status = 'unknown') AS unknown, count(*) FILTER (status = 'unmapped') AS unmapped FROM cs GROUP BY ROLLUP (protein_id)),
p AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0) AS recall FROM c)
SELECT protein_id, tp, fp, fn, tn, unknown, unmapped, round(precision, 9) AS precision, round(recall, 9) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0), 9) AS f1 FROM p""")
def a14(spark, sf):
    return structure.comparison_totals(_cases(spark, sf)).withColumns({n: F.round(n, 9) for n in ("precision", "recall", "f1")})


CHOICES = f"""{CASES}, b AS (SELECT protein_id, length(sequence) AS mapped, length(sequence) / 100.0 AS coverage FROM es WHERE protein_id::BIGINT % 3 <> 0), h AS (SELECT DISTINCT protein_id FROM fb),
ct AS (SELECT protein_id, count(*) FILTER (status = 'tp') AS tp, count(*) FILTER (status = 'fp') AS fp, count(*) FILTER (status = 'fn') AS fn, count(*) FILTER (status = 'tn') AS tn, count(*) FILTER (status = 'unknown') AS unknown FROM cs GROUP BY protein_id),
mf AS (SELECT e.protein_id, CASE WHEN coverage >= 0.65 THEN 'RCSB' WHEN h.protein_id IS NOT NULL THEN 'AlphaFold' ELSE 'Failed' END AS source_type, coalesce(mapped, 0)::INT AS mapped_count, coalesce(coverage, 0.0)::DOUBLE AS coverage,
  CASE WHEN coverage IS NULL THEN 'no structure' WHEN coverage < 0.65 THEN 'low coverage' ELSE '' END AS fallback_reason,
  coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(tn, 0) AS tn, coalesce(unknown, 0) AS unknown
  FROM es e LEFT JOIN b USING (protein_id) LEFT JOIN h ON h.protein_id = e.protein_id LEFT JOIN ct ON ct.protein_id = e.protein_id),
mr AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0) AS recall FROM mf)"""
F1 = "coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0)"


def _manifest(spark, sf):
    rows = event_sequences(spark, sf)
    best = rows.where(F.col("protein_id").cast("long") % 3 != 0).select("protein_id", F.length("sequence").alias("mapped_count"), (F.length("sequence") / 100.0).alias("coverage"))
    choice = structure.choose_source(rows, best, structure.positional_fallback(rows, _chains(spark, sf)), 0.65)
    choices = choice.join(best, "protein_id", "left").select(
        "protein_id", F.concat(F.lit("U"), "protein_id").alias("uniprot"), F.col("source").alias("source_type"), F.concat(F.lit("S"), "protein_id").alias("structure_id"), F.lit("A").alias("chain"),
        F.coalesce("mapped_count", F.lit(0)).alias("mapped_count"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.col("reason").alias("fallback_reason"),
    )
    return structure.manifest(choices, structure.comparison_totals(_cases(spark, sf)))


@query("k9_structure_manifest", f"""{CHOICES} SELECT protein_id, 'U' || protein_id AS uniprot, source_type, 'S' || protein_id AS structure_id, 'A' AS chain, mapped_count, printf('%.6f', coverage) AS coverage, nullif(fallback_reason, '') AS fallback_reason,
  tp, fp, fn, tn, unknown, printf('%.6f', precision) AS precision, printf('%.6f', recall) AS recall, printf('%.6f', {F1}) AS f1 FROM mr""")
def k9(spark, sf):
    path = shared_folder(spark, "structures")
    sinks.structure_manifest(_manifest(spark, sf), path)
    schema = "protein_id string, uniprot string, source_type string, structure_id string, chain string, mapped_count int, coverage string, fallback_reason string, tp long, fp long, fn long, tn long, unknown long, precision string, recall string, f1 string"
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


@query("a14_structure_summary", f"""{CHOICES}, t AS (SELECT count(*) AS num_total, count(*) FILTER (source_type = 'RCSB') AS num_rcsb, count(*) FILTER (source_type = 'AlphaFold') AS num_alphafold, count(*) FILTER (source_type = 'Failed') AS num_failed,
  sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn, sum(unknown)::BIGINT AS unknown FROM mr),
u AS (SELECT *, num_total - num_failed AS num_success, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0) AS recall FROM t)
SELECT num_total, num_rcsb, num_alphafold, num_failed, num_success, tp, fp, fn, tn, unknown, round(precision, 9) AS precision, round(recall, 9) AS recall, round({F1}, 9) AS f1 FROM u""")
def a14_summary(spark, sf):
    """The summary, written as one JSON object and read again."""
    path = shared_folder(spark, "summary")
    sinks.metrics_json(structure.manifest_summary(_manifest(spark, sf)), path)
    counts = ("num_total", "num_rcsb", "num_alphafold", "num_failed", "num_success", "tp", "fp", "fn", "tn", "unknown")
    rows = spark.read.schema(", ".join(f"{c} long" for c in counts) + ", precision double, recall double, f1 double").json(path)
    return rows.select(*counts, *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))

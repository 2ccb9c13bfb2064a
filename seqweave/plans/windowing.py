"""Window plans, crops and merging over the event sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.operators import joins, windows
from seqweave.plans.registry import query
from seqweave.sources.adapters import DOCUMENT_SEQUENCES, EMBEDDING_POSITIONS, EVENT_RESIDUES, EVENT_SEQUENCES, document_sequences, embedding_positions, event_residues, event_sequences

ES = f"WITH {EVENT_RESIDUES}, {EVENT_SEQUENCES}"
WIDTH, STRIDE = 24, 16
N = "length(sequence)"
SLIDING = f"""sw AS (SELECT protein_id, sequence, labels, unnest(CASE WHEN {N} <= {WIDTH} THEN [0] ELSE list_sort(list_distinct(list_append(range(0, {N} - {WIDTH} + 1, {STRIDE}), {N} - {WIDTH}))) END)::INT AS start FROM es)"""
SPANS = f"{SLIDING}, sp AS (SELECT protein_id, start, least(start + {WIDTH}, {N})::INT AS end_exclusive, labels FROM sw)"


def _spans(spark, sf):
    rows = event_sequences(spark, sf)
    return windows.windows(rows, windows.sliding_starts(F.length("sequence"), WIDTH, STRIDE), WIDTH)


@query("w1_evaluation_windows", f"""{ES}, cand AS (SELECT protein_id, sequence, unnest(range(12, {N} - 12 + 1, 8)) AS centre FROM es WHERE {N} > 24),
seg AS (SELECT protein_id, {N} AS n, centre, substr(sequence, centre - 12 + 1, 24) AS s FROM cand),
rated AS (SELECT protein_id, n, centre, 0.7 * ((length(s) - length(translate(s, 'PGSEDKRNQ', ''))) / length(s)::DOUBLE)
  + 0.3 * (list_max(list_transform(list_distinct(string_split(s, '')), lambda c: length(s) - length(replace(s, c, '')))) / length(s)::DOUBLE) AS score FROM seg),
top AS (SELECT *, row_number() OVER (PARTITION BY protein_id ORDER BY score DESC, centre DESC) AS i FROM rated),
cover AS (SELECT protein_id, unnest(CASE WHEN {N} <= 24 THEN [0] ELSE list_append(range(0, {N} - 24 + 1, 12), {N} - 24) END) AS start FROM es),
u AS (SELECT protein_id, start FROM cover UNION SELECT protein_id, greatest(0, least(centre - 12, n - 24)) FROM top WHERE i <= 4)
SELECT protein_id, start::INT AS start FROM u""")
def w1(spark, sf):
    return windows.evaluation_starts(event_sequences(spark, sf), 24).select("protein_id", F.explode("starts").alias("start"))


@query("w2_sliding_windows", f"WITH {DOCUMENT_SEQUENCES}, es AS (SELECT *, '' AS labels FROM ds), {SPANS} SELECT protein_id, start, end_exclusive FROM sp")
def w2(spark, sf):
    rows = document_sequences(spark, sf)
    return windows.windows(rows, windows.sliding_starts(F.length("sequence"), WIDTH, STRIDE), WIDTH).select("protein_id", "start", "end_exclusive")


@query("w3_tumbling_windows", f"{ES} SELECT protein_id, unnest(range(0, {N}, 20))::INT AS start FROM es")
def w3(spark, sf):
    return event_sequences(spark, sf).select("protein_id", F.explode(windows.tumbling_starts(F.length("sequence"), 20)).alias("start"))


@query("w4_training_crop", f"""{ES}, p AS (SELECT *, {N} AS n, strpos(labels, '1') - 1 AS a, {N} - strpos(reverse(labels), '1') AS b FROM es),
s AS (SELECT *, CASE WHEN n <= 24 THEN 0 WHEN contains(labels, '1') THEN greatest(0, least((a + b) // 2 - 12, n - 24)) ELSE ('0x' || substr(md5(protein_id || ':0'), 1, 8))::BIGINT % (n - 23) END AS start FROM p)
SELECT protein_id, start::INT AS start, substr(sequence, start + 1, 24) AS sequence, substr(labels, start + 1, 24) AS labels FROM s""")
def w4(spark, sf):
    return windows.training_crop(event_sequences(spark, sf), 24)


RUNS = """isl AS (SELECT protein_id, position, position - row_number() OVER (PARTITION BY protein_id ORDER BY position) AS g FROM ev WHERE label = 1),
runs AS (SELECT protein_id, min(position)::INT AS run_start, max(position)::INT AS run_end FROM isl GROUP BY protein_id, g)"""
SCORED = f"""{RUNS}, {SPANS}, cuts AS (SELECT s.protein_id, s.start, count(*) AS cuts FROM sp s JOIN runs r ON r.protein_id = s.protein_id AND run_start <= end_exclusive AND run_end > start
  AND NOT (run_start > start AND run_end <= end_exclusive) GROUP BY ALL),
sc AS (SELECT s.protein_id, s.start, s.end_exclusive, (length(substr(labels, s.start + 1, {WIDTH})) - length(replace(substr(labels, s.start + 1, {WIDTH}), '1', '')))::BIGINT AS positives, coalesce(cuts, 0) AS cuts
  FROM sp s LEFT JOIN cuts c ON c.protein_id = s.protein_id AND c.start = s.start),
tw AS (SELECT *, positives - 3.0::DOUBLE * cuts AS score FROM sc)"""


@query("w5_positive_runs", f"WITH {EVENT_RESIDUES}, {RUNS} SELECT * FROM runs")
def w5(spark, sf):
    return windows.positive_runs(event_residues(spark, sf))


@query("w5_window_scores", f"{ES}, {SCORED} SELECT protein_id, start, positives, cuts, score FROM tw")
def w5_scores(spark, sf):
    return windows.window_scores(event_residues(spark, sf), _spans(spark, sf)).select("protein_id", "start", "positives", F.col("cuts").cast("long").alias("cuts"), "score")


@query("w6_best_training_window", f"""{ES}, {SCORED}, b AS (SELECT *, max(score) OVER (PARTITION BY protein_id) AS best FROM tw),
k AS (SELECT *, row_number() OVER (PARTITION BY protein_id ORDER BY md5(protein_id || ':' || start || ':0'), start) AS i FROM b WHERE score >= best - 1e-9)
SELECT protein_id, start, score FROM k WHERE i = 1""")
def w6(spark, sf):
    return windows.best_training_window(windows.window_scores(event_residues(spark, sf), _spans(spark, sf))).select("protein_id", "start", "score")


@query("w7_context_concat", f"""WITH {EMBEDDING_POSITIONS}, c AS (SELECT protein_id, position, list_concat(list_concat(coalesce(lag(embedding) OVER w, list_transform(range(64), lambda i: 0.0::FLOAT)), embedding),
  coalesce(lead(embedding) OVER w, list_transform(range(64), lambda i: 0.0::FLOAT))) AS ctx FROM em WINDOW w AS (PARTITION BY protein_id ORDER BY position))
SELECT protein_id, position, len(ctx)::INT AS width, ctx[1]::DOUBLE AS first, ctx[100]::DOUBLE AS middle, ctx[192]::DOUBLE AS last FROM c""")
def w7(spark, sf):
    rows = windows.context_concat(embedding_positions(spark, sf), 1, 64)
    return rows.select("protein_id", "position", F.size("context").alias("width"), *(F.get("context", F.lit(i)).cast("double").alias(n) for i, n in ((0, "first"), (99, "middle"), (191, "last"))))


@query("w8_context_mean", f"""WITH {EMBEDDING_POSITIONS}, n AS (SELECT a.protein_id, a.position, any_value(a.embedding[1])::DOUBLE AS own, avg(b.embedding[1]::DOUBLE) AS mean FROM em a JOIN em b ON a.protein_id = b.protein_id
  AND abs(a.position - b.position) <= 2 AND a.position <> b.position GROUP BY ALL)
SELECT e.protein_id, e.position, e.embedding[1]::DOUBLE AS own, round(coalesce(mean, e.embedding[1]::DOUBLE), 5) AS mean FROM em e LEFT JOIN n USING (protein_id, position)""")
def w8(spark, sf):
    rows = windows.context_mean(embedding_positions(spark, sf), 2)
    return rows.select("protein_id", "position", F.get("context", F.lit(0)).cast("double").alias("own"), F.round(F.get("context", F.lit(64)).cast("double"), 5).alias("mean"))


@query("w9_chunk_index", f"""{ES}, {SPANS}, k AS (SELECT *, row_number() OVER (PARTITION BY protein_id ORDER BY start) AS ix FROM sp)
SELECT protein_id || '_' || ix AS chunk_id, protein_id, ix::INT AS chunk_index_1based, start, end_exclusive, end_exclusive - start AS length, CASE WHEN ix = 1 THEN 'skipped' ELSE 'written' END AS status FROM k""")
def w9(spark, sf):
    rows = event_sequences(spark, sf)
    stored = rows.select(F.concat("protein_id", F.lit("_1")).alias("chunk_id"))
    return windows.chunk_index(rows, WIDTH, WIDTH - STRIDE, stored)


@query("j9_chunk_groups", f"""{ES}, {SPANS}, k AS (SELECT protein_id, row_number() OVER (PARTITION BY protein_id ORDER BY start) AS ix FROM sp) SELECT protein_id, array_to_string(list_sort(list(ix)), ',') AS indices, true AS known FROM k GROUP BY protein_id""")
def j9(spark, sf):
    rows = event_sequences(spark, sf)
    return joins.chunk_groups(windows.chunk_index(rows, WIDTH, WIDTH - STRIDE), rows).withColumn("indices", F.array_join(F.transform("indices", lambda i: i.cast("string")), ","))


@query("j10_window_slices", f"{ES}, {SPANS} SELECT s.protein_id, s.start, e.position, e.symbol, e.score FROM sp s JOIN ev e ON e.protein_id = s.protein_id AND e.position BETWEEN s.start + 1 AND s.end_exclusive")
def j10(spark, sf):
    return windows.window_slices(event_residues(spark, sf), _spans(spark, sf), WIDTH).select("protein_id", "start", "position", "symbol", "score")


@query("w10_overlap_merge", f"""{ES}, {SPANS}, l AS (SELECT s.protein_id, e.position, e.score + s.start * 0.01::DOUBLE AS logit FROM sp s JOIN ev e ON e.protein_id = s.protein_id AND e.position BETWEEN s.start + 1 AND s.end_exclusive WHERE s.start > 0)
SELECT e.protein_id, e.position, round(coalesce(avg(logit), 0.0), 9) AS logit FROM ev e LEFT JOIN l USING (protein_id, position) GROUP BY ALL""")
def w10(spark, sf):
    residues = event_residues(spark, sf)
    scores = windows.window_slices(residues, _spans(spark, sf).where("start > 0"), WIDTH).select("protein_id", "position", (F.col("score") + F.col("start") * 0.01).alias("logit"))
    return windows.merge_windows(residues.select("protein_id", "position"), scores).withColumn("logit", F.round("logit", 9))


@query("w11_chunk_concat", f"WITH {EMBEDDING_POSITIONS} SELECT protein_id, position, embedding[1]::DOUBLE AS x FROM em")
def w11(spark, sf):
    rows = embedding_positions(spark, sf)
    chunks = rows.select("protein_id", (F.floor((F.col("position") - 1) / 10) * 10).cast("int").alias("start"), ((F.col("position") - 1) % 10).alias("offset"), "embedding")
    records = rows.groupBy("protein_id").agg(F.expr("repeat('X', cast(count(*) as int))").alias("sequence"))
    return windows.concat_chunks(chunks, records).select("protein_id", "position", F.get("embedding", F.lit(0)).cast("double").alias("x"))

import itertools
import re

import pytest
from pyspark.sql import functions as F

from seqweave.functions import expressions as X
from seqweave.operators import clean, history, joins, losses, motifs, scoring, splits, structure, windows


def records(spark, rows):
    return spark.createDataFrame(rows, "protein_id string, sequence string, labels string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "protein_id string")


def test_expressions(spark):
    row = spark.range(1).select(X.sanitize(F.lit("acbzxJ")).alias("s"), X.safe_key(F.lit("a/b c\\d")).alias("k"), X.safe_key(F.lit("")).alias("e"), X.sigmoid(F.lit(-800.0)).alias("g"), X.low_complexity(F.lit("")).alias("l")).first()
    assert tuple(row) == ("ACXXXX", "a_b_c_d", "empty_id", 0.0, 0.0)


def test_quality_report(spark):
    rows = records(spark, [("P1", "ACDE", "010"), ("P2", "AC?", "01x"), ("", "A", "1"), ("P3", "AC", "11"), ("P3", "AC", "11"), ("P4", None, None)])
    found = {(r["protein_id"], r["reason"]): r["symbols"] for r in clean.quality_report(rows).collect()}
    assert ("P1", "length_mismatch") in found and found[("P2", "bad_symbols")] == ["?"] and found[("P2", "bad_labels")] == ["x"]
    assert ("", "empty_id") in found and ("P3", "duplicate_id") in found and ("P4", "length_mismatch") not in found
    with pytest.raises(ValueError, match="length_mismatch"):
        clean.require_clean(rows)
    assert clean.require_clean(rows.limit(0)).count() == 0


def test_positions(spark):
    got = [tuple(r) for r in clean.to_positions(records(spark, [("a", "ACD", "1-"), ("b", "", ""), ("c", None, None)])).collect()]
    assert got == [("a", 1, "A", 1), ("a", 2, "C", None)]


def test_seeded_split(spark):
    left = ids(spark, *"ABCDE")
    out = {r["protein_id"]: r["split"] for r in splits.seeded_split(left, ids(spark, "B"), ids(spark, "E"), 0.4).collect()}
    assert set(out) == {"A", "C", "D"} and sorted(out.values()) == ["train", "train", "val"]
    again = {r["protein_id"]: r["split"] for r in splits.seeded_split(left.repartition(3), ids(spark, "B"), ids(spark, "E"), 0.4).collect()}
    assert out == again
    assert splits.validation_size(3, 0.4) == 1 and splits.validation_size(10, 0.25) == 2
    with pytest.raises(ValueError):
        splits.validation_size(1, 0.2)
    with pytest.raises(ValueError):
        splits.fixed_split(ids(spark, "A"), ids(spark, "A"), ids(spark), ids(spark))


def test_windows(spark):
    def starts(length, width, stride):
        return spark.range(1).select(windows.sliding_starts(F.lit(length), width, stride).alias("s")).first()["s"]

    assert starts(400, 128, 64) == [0, 64, 128, 192, 256, 272] and starts(5, 8, 2) == [0] and starts(19, 8, 6) == [0, 6, 11]
    long = windows.evaluation_starts(records(spark, [("a", "ACDEFGHIKLMNPQRSTVWY" * 20, ""), ("b", "A" * 50 + "PGSE" * 10 + "V" * 45, "")]), 128, 64, 3)
    assert {r["protein_id"]: r["starts"] for r in long.collect()}["a"] == [0, 32, 64, 128, 192, 256, 272]
    odd = windows.evaluation_starts(records(spark, [("b", "A" * 50 + "PGSE" * 10 + "V" * 45, "")]), 33, None, 2)
    assert odd.first()["starts"] == [0, 16, 32, 48, 56, 64, 80, 96, 102]


def test_training_window(spark):
    rows = records(spark, [("a", "A" * 19, "0011100111110000110")])
    spans = windows.windows(rows, windows.sliding_starts(F.length("sequence"), 8, 6), 8)
    scored = windows.window_scores(clean.to_positions(rows), spans)
    assert [(r["start"], r["positives"], r["cuts"], r["score"]) for r in scored.orderBy("start").collect()] == [(0, 4, 1, 1.0), (6, 5, 0, 5.0), (11, 3, 1, 0.0)]
    assert windows.best_training_window(scored).first()["start"] == 6


def test_merge(spark):
    residues = spark.createDataFrame([("a", i) for i in (1, 2, 3)], "protein_id string, position int")
    scores = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 2, 4.0), ("a", 9, 7.0)], "protein_id string, position int, logit double")
    assert [r["logit"] for r in windows.merge_windows(residues, scores).orderBy("position").collect()] == [1.0, 3.0, 0.0]


def test_motifs(spark):
    assert motifs.prosite_regex("<A-x(2,3)-[ST>]-{P}.") == r"^A(?:.){2,3}[ST>][^P]"
    with pytest.raises(ValueError):
        motifs.prosite_regex("A-[BC")
    library = motifs.library(spark, [{"id": "SHORT", "ac": "PS00001", "pa": "A-C"}, {"id": "LONG", "ac": "PS00002", "pa": "A-C-D"}])
    rows = records(spark, [("p", "MACDG", ""), ("q", "", ""), ("r", None, None)])
    spans = motifs.greedy_spans(motifs.matches(rows, library))
    assert [(r["motif_id"], r["start"], r["end"]) for r in spans.collect()] == [("LONG", 1, 4)]
    got = motifs.tokens(rows, spans).orderBy("token_ix").collect()
    assert [r["token"] for r in got] == ["M", "<PROSITE:PS00002>", "G"] and [r["span_length"] for r in got] == [1, 3, 1]


def test_fusion(spark):
    one = spark.createDataFrame([("a", 1, 2.0)], "protein_id string, position int, score double")
    assert joins.fused(one, one.withColumn("score", F.lit(6.0))).first()["score"] == 4.0
    with pytest.raises(Exception, match="differ in length"):
        joins.fused(one, one.limit(0)).collect()
    with pytest.raises(ValueError):
        joins.fused(one, one, 0.5, 0.6)


def test_contrastive_loss(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0], 0), (0, [0.9, 0.1], 0), (0, [0.0, 1.0], 1), (0, [0.1, 0.9], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.1], 1)], "batch long, embedding array<float>, label int")
    got = {r["batch"]: (r["n"], r["loss"]) for r in losses.contrastive_loss(rows, ["batch"]).collect()}
    assert got[1] == (2, 0.0) and got[0][0] == 4 and got[0][1] >= 0


def test_best_evaluation(spark):
    rows = [("r", i, a) for i, a in enumerate([0.5, 0.6, 0.6, 0.55, 0.7, 0.1, 0.2, 0.3, 0.9])]
    out = history.best_evaluation(spark.createDataFrame(rows, "run string, step int, auroc double"), 3).first()
    assert (out["best_step"], out["best_auroc"], out["stop_step"]) == (4, 0.7, 7)


def test_alignment():
    pairs, score, identity = structure.local_alignment("ABCDE", "XXABCDEYY")
    assert score == 10 and identity == 1.0 and dict(pairs)[1] == 3 and dict(pairs)[5] == 7
    assert structure.local_alignment("", "A") == ([], 0, 0.0)


def test_alignment_against_cell_by_cell():
    import random

    def slow(q, s):
        best, rows = 0, [[0] * (len(s) + 1)]
        for a in q:
            row = [0]
            for j, b in enumerate(s):
                row.append(max(0, rows[-1][j] + (2 if a == b else -1), rows[-1][j + 1] - 2, row[j] - 2))
            rows.append(row)
            best = max(best, *row)
        return best

    draw = random.Random(1)
    for _ in range(60):
        q, s = ("".join(draw.choices("ABC", k=draw.randint(1, 14))) for _ in range(2))
        assert structure.local_alignment(q, s)[1] == slow(q, s)


def test_comparison(spark):
    residues = spark.createDataFrame([("p", "A", 1), ("p", "A", 2), ("p", "A", 3), ("p", "A", 4), ("p", "A", None)], "protein_id string, chain string, query_pos int")
    positions = spark.createDataFrame([("p", 1, 1, 1), ("p", 2, 0, 1), ("p", 3, 1, 0), ("p", 4, 0, 0)], "protein_id string, position int, label int, pred_label int")
    total = structure.comparison_totals(structure.compared(residues, positions)).where("protein_id is null").first()
    assert (total["tp"], total["fp"], total["fn"], total["tn"], total["unmapped"]) == (1, 1, 1, 1, 1)


def test_cnn_is_zero_padded(spark):
    rows = spark.createDataFrame([("a", i, [float(i)]) for i in (1, 2, 3)], "protein_id string, position int, embedding array<float>")
    layers = [{"weight": [[[1.0, 1.0, 1.0]]], "bias": [0.0]}, {"weight": [[[1.0]]], "bias": [0.5]}]
    assert [r["logit"] for r in scoring.cnn_logits(rows, layers).orderBy("position").collect()] == [3.5, 6.5, 5.5]
    with pytest.raises(ValueError):
        scoring.check_width(rows, 2)


def test_safe_key_keeps_letters_of_any_script(spark):
    names = [" Ünïcode/ß 漢字\u00a0", "\u2003 \t", "a\\b//c", "x²½-1.5_é", "a\u0301b"]
    want = []
    for name in names:
        stem = re.sub(r"[^\w.\-]+", "_", name.strip().replace("\\", "_").replace("/", "_"), flags=re.UNICODE)
        want.append(stem or "empty_id")
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", X.safe_key(F.col("n")).alias("k")).orderBy("i")
    assert [r["k"] for r in rows.collect()] == want


def test_sliding_starts(spark):
    for n, width, stride in itertools.product((0, 1, 5, 24, 25, 40, 41), (5, 24), (1, 3, 8)):
        got = spark.range(1).select(windows.sliding_starts(F.lit(n), width, stride).alias("s")).first()["s"]
        assert got == (sorted({*range(0, n - width + 1, stride), n - width}) if n > width else [0])


def test_use_or_rebuild(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "protein_id string")
    manifest = spark.createDataFrame([("a", "train"), ("b", "val"), ("c", "train")], "protein_id string, split string")
    split, status, report = splits.use_or_rebuild(ids("a", "b", "c", "d"), manifest, ids().limit(0), ids().limit(0))
    assert status == "used" and split.count() == 3 and {(r["split"], r["listed"], r["missing"], tuple(r["sample"])) for r in report.collect()} == {("train", 2, 0, ()), ("val", 1, 0, ())}
    split, status, report = splits.use_or_rebuild(ids("a", "b", "d", "e"), manifest, ids("e"), ids().limit(0))
    assert status == "rebuilt" and {r[0] for r in split.collect()} == {"a", "b", "d"} and {r["split"]: r["sample"] for r in report.collect()} == {"train": ["c"], "val": []}
    assert splits.use_or_rebuild(ids("a", "b"), None, ids().limit(0), ids().limit(0))[1] == "rebuilt"
    for known in (manifest, None):
        with pytest.raises(ValueError, match="doesn't fit"):
            splits.use_or_rebuild(ids("a", "b"), known, ids().limit(0), ids().limit(0), rebuild=False)


def test_positive_report(spark):
    rows = spark.createDataFrame([("a", "01-"), ("b", "00-"), ("c", "11")], "protein_id string, labels string")
    assert {tuple(r) for r in clean.with_positive_report(rows).collect()} == {("before", 3, 3, 3, 2), ("after", 2, 3, 1, 1)}
    with pytest.raises(ValueError, match="positive"):
        clean.with_positive_report(rows.where("protein_id = 'b'"))


def test_long_alignments_take_little_memory():
    import random
    import tracemalloc

    rng = random.Random(8)
    q = "".join(rng.choices("ACDE", k=6000))
    s = "".join(c for c in q if rng.random() > 0.1)
    tracemalloc.start()
    pairs, score, identity = structure.local_alignment(q, s)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pairs) > 5000 and score > 6000 and identity > 0.9
    assert peak < 25_000_000


@pytest.mark.parametrize("kept, cells", [(2, 1), (3, 40), (48, 4_000_000)])
def test_alignment_in_sections_is_that_of_one_matrix(monkeypatch, kept, cells):
    import random

    def plain(q, s):
        h, trace, best = [[0] * (len(s) + 1) for _ in range(len(q) + 1)], {}, (0, 0, 0)
        for i in range(1, len(q) + 1):
            for j in range(1, len(s) + 1):
                d, u, left = h[i - 1][j - 1] + (2 if q[i - 1] == s[j - 1] else -1), h[i - 1][j] - 2, h[i][j - 1] - 2
                v = max(d, u, left, 0)
                h[i][j], trace[i, j] = v, 0 if v == 0 else 1 if d == v else 2 if u == v else 3
                if v > best[0]:
                    best = (v, i, j)
        score, i, j = best
        pairs = []
        while i and j and trace[i, j]:
            move = trace[i, j]
            if move == 1:
                pairs.append((i, j))
            i, j = i - (move != 3), j - (move != 2)
        return pairs[::-1], score

    monkeypatch.setattr(structure, "KEPT", kept)
    monkeypatch.setattr(structure, "CELLS", cells)
    rng = random.Random(9)
    for _ in range(60):
        q, s = ("".join(rng.choices("AC" if rng.random() < 0.5 else "ACDE", k=rng.randint(1, 40))) for _ in range(2))
        assert structure.local_alignment(q, s)[:2] == plain(q, s)


def test_cnn_tiles_give_the_logits_of_the_whole(spark):
    import numpy as np

    draw = np.random.default_rng(1)
    layers = [{"weight": draw.normal(size=(4, 3, 5)), "bias": draw.normal(size=4), "dilation": 2}, {"weight": draw.normal(size=(4, 4, 3)), "bias": draw.normal(size=4), "dilation": 3}, {"weight": draw.normal(size=(1, 4, 1)), "bias": draw.normal(size=1)}]
    rows = spark.createDataFrame([(p, i + 1, draw.normal(size=3).tolist()) for p, n in (("a", 53), ("b", 1), ("c", 16)) for i in range(n)], "protein_id string, position int, embedding array<float>")
    whole = {(r["protein_id"], r["position"]): r["logit"] for r in scoring.cnn_logits(rows, layers).collect()}
    for tile in (1, 3, 16):
        tiled = {(r["protein_id"], r["position"]): r["logit"] for r in scoring.cnn_logits(rows, layers, tile=tile).collect()}
        assert tiled.keys() == whole.keys() and len(whole) == 70 and all(abs(tiled[k] - v) < 1e-9 for k, v in whole.items())
    with pytest.raises(Exception, match="gap or repeat"):
        scoring.cnn_logits(rows.where("position <> 7"), layers).collect()

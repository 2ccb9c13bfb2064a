"""Registered queries on small tables of the cases that the given ones rarely hold."""

import re

from pyspark.sql import functions as F

from seqweave.functions.intervals import overlapping
from seqweave.operators import windows
from seqweave.plans import modelling
from seqweave.plans import motifs as plans_motifs
from seqweave.sources import structures


def test_best_structure_rounds_halves_to_even(spark, tmp_path):
    rows = [(1, 1, "N", 0.04, 61250.0), (1, 2, "N", 0.01, 62500.0), (2, 1, "N", 0.07, 61250.0), (2, 2, "N", 0.04, 60000.0), (3, 1, "N", 0.07, 1250.0), (4, 1, "N", 0.02, 8750.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_discount double, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = {tuple(r) for r in modelling.x2(spark, str(tmp_path)).collect()}
    assert found == {("1", 2, 25, 0.01), ("2", 1, 24, 0.07), ("4", 1, 4, 0.02)}  # 24.5 and 0.5 go down, 3.5 goes up


def test_lines_of_structures_part_without_a_shuffle(spark):
    atom = "ATOM      1  CA  SER A%4d      11.000"
    texts = [
        ("plain", "\n".join([atom % 1, "ENDMDL", atom % 2, "MODEL 1", atom % 3, "ENDMDL", atom % 4]) + "\n"),
        ("second", "\r\n".join(["MODEL 1", atom % 1, "MODEL 2", atom % 2]) + "\r\n"),
        ("rare", " ".join(["x", "", atom % 1]) + "\n\n"), ("empty", ""), ("none", None),
    ]
    rows = structures.atom_lines(spark.createDataFrame(texts, "structure_id string, text string"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
    found = {name: [(r["line"], r["is_atom"]) for r in sorted(rows.where(rows.structure_id == name).collect(), key=lambda r: r["line_ix"])] for name, _ in texts}
    assert [a for _, a in found["plain"]] == [True, False, True, False, True, False, False] and [a for _, a in found["second"]] == [False, True, False, False]
    assert found["rare"] == [("x", False), ("", False), (atom % 1, True)] and found["empty"] == [("", False)] and not found["none"]


def test_windows_of_matches_follow_from_places_without_a_join(spark, tmp_path):
    letters = {1: "S" * 3 + "E", 2: "SEC" * 20 + "P", 3: "CVSP" * 6, 4: "E" * 30 + "SE" + "E" * 33}
    rows = [(100 * u + i, u, i, kind, 50.0) for u, text in letters.items() for i, kind in enumerate(text)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, at int, event_type string, value double")
    events.selectExpr("event_id", "timestamp_seconds(at) AS ts", "user_id", "event_type", "value", "'{\"k\": 1}' AS props").write.parquet(str(tmp_path / "events.parquet"))
    out = plans_motifs.j10_motifs(spark, str(tmp_path))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    want = []
    for u, text in letters.items():
        n = len(text)
        starts = [0] if n <= 24 else sorted({*range(0, n - 23, 16), n - 24})
        for k, regex in enumerate(plans_motifs.REGEXES):
            found = [(i, i + len(m[0])) for i in range(n) if (m := re.compile(regex).match(text, i)) and m[0]]
            want += [(str(u), s, a, b, f"M{k + 1}") for a, b in found for s in starts if a < min(s + 24, n) and b > s]
    assert sorted(map(tuple, out.collect())) == sorted(want) and len(want) > 100


def test_met_starts_are_the_sliding_starts_that_a_span_meets(spark):
    cases = [(n, w, t, a, b) for n in (0, 1, 7, 8, 9, 20, 23) for w, t in ((8, 6), (8, 8), (3, 5), (5, 1), (8, 0)) for a, b in ((-2, 0), (-2, 1), (0, 0), (0, 1), (0, 30), (3, 5), (6, 8), (7, 20), (8, 9), (9, 9), (12, 13), (19, 20), (22, 23), (23, 25))]
    for w, t in {c[1:3] for c in cases}:
        own = spark.createDataFrame([(n, a, b) for n, x, y, a, b in cases if (x, y) == (w, t)], "n int, a int, b int")
        every = windows.sliding_starts(F.col("n"), w, t)
        met = F.filter(every, lambda s: (s < F.col("b")) & (F.least(s + w, F.col("n")) > F.col("a")) & (F.col("a") < F.col("b")))  # noqa: B023
        for r in own.select("*", met.alias("want"), windows.met_starts(F.col("a"), F.col("b"), F.col("n"), w, t).alias("found")).collect():
            assert r["found"] == r["want"], (w, t, r)


def test_overlapping_spans_are_joined_by_sorting(spark, tmp_path):
    spark.createDataFrame([("a", 0, 5)], "g string, s int, e int").write.parquet(str(tmp_path / "spans"))
    spans = spark.read.parquet(str(tmp_path / "spans"))
    out = overlapping(spans, spans.toDF("g", "t", "f"), ["g"], ("s", "e"), ("t", "f"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan

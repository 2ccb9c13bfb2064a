"""Named text files, snapshots of feature stores, manifests and the evaluator's errors."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from seqweave.operators import joins, windows
from seqweave.sources import named_texts, scans, sinks
from seqweave.sources.snapshots import FeatureStore


def test_splits_of_any_size_give_the_records_of_the_whole(spark, tmp_path):
    rng = random.Random(1)
    for k in range(3):
        records = [f">p{k}.{i}\n" + "".join(rng.choices("ACDE", k=rng.randint(1, 60))) + "\n" + "é01-" * rng.randint(0, 3) + "\n" * rng.randint(1, 3) for i in range(8)]
        (tmp_path / f"{k}.fasta").write_text(("\n\n" if k == 1 else "") + "".join(records).rstrip("\n"))
    (tmp_path / "empty.fasta").write_text("")
    want = sorted(map(tuple, scans.labelled_fasta(spark, str(tmp_path)).select("protein_id", "sequence", "labels", "broken").collect()), key=str)
    for size in (97, 500, 1 << 20):
        raw = spark.createDataFrame(named_texts.read(spark, str(tmp_path), ">", size).collect())
        assert raw.where("value like '>%'").count() == 24 and raw.select("record_ix").distinct().count() == raw.count()
    assert sorted(map(tuple, scans.labelled_fasta(spark, str(tmp_path), named=True).select("protein_id", "sequence", "labels", "broken").collect()), key=str) == want


def test_one_file_a_name_and_none_of_a_failed_write(spark, tmp_path):
    path = str(tmp_path / "out")
    lines = spark.createDataFrame([(f"n{i % 4}.txt", i, f"line {i}") for i in range(40)], "name string, ix int, value string")
    named_texts.write(lines.where("name <> 'n3.txt'"), path, "ix")
    assert sorted(os.listdir(path)) == ["n0.txt", "n1.txt", "n2.txt"]
    assert (tmp_path / "out" / "n1.txt").read_text() == "".join(f"line {i}\n" for i in range(1, 40, 4))
    with pytest.raises(Exception, match="taken"):
        named_texts.write(lines, path, "ix")
    bad = lines.withColumn("value", F.when((F.col("ix") == 39), F.raise_error(F.lit("broken row"))).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="broken row"):
        named_texts.write(bad, path, "ix", overwrite=True)
    with pytest.raises(Exception, match="can't be a file's name"):
        named_texts.write(lines.withColumn("name", F.concat(F.lit("../"), "name")), path, "ix", overwrite=True)
    assert sorted(os.listdir(path)) == ["n0.txt", "n1.txt", "n2.txt"] and "new" not in (tmp_path / "out" / "n1.txt").read_text()
    named_texts.write(lines.where("name in ('n1.txt', 'n3.txt')").withColumn("value", F.lit("new")), path, "ix", overwrite=True)
    assert sorted(os.listdir(path)) == ["n0.txt", "n1.txt", "n2.txt", "n3.txt"] and (tmp_path / "out" / "n1.txt").read_text() == "new\n" * 10


def test_score_files_have_the_ids_names(spark, tmp_path):
    scores = spark.createDataFrame([("a/b", 2, "C", 0.25), ("a/b", 1, "A", 0.5), ("x y", 1, "D", 1.0)], "protein_id string, position int, symbol string, score double")
    sinks.score_files(scores, str(tmp_path / "s"))
    assert (tmp_path / "s" / "a_b.txt").read_text() == ">a/b\n1\tA\t0.500\t1\n2\tC\t0.250\t0\n" and sorted(os.listdir(tmp_path / "s")) == ["a_b.txt", "x y.txt"]
    with pytest.raises(ValueError, match="share"):
        sinks.score_files(scores.unionByName(scores.where("protein_id = 'a/b'").withColumn("protein_id", F.lit("a_b"))), str(tmp_path / "t"))


def test_text_features_have_eight_digits_and_one_width(spark, tmp_path):
    rows = spark.createDataFrame([("p", 1, [0.1, 1e-9, 123456792.0]), ("p", 2, [1.0, -0.5, 0.0])], "protein_id string, position int, embedding array<float>")
    sinks.feature_files(rows, str(tmp_path / "f"))
    assert (tmp_path / "f" / "p.resfeat.txt").read_text() == "0.1 9.9999997e-10 1.2345679e+08\n1 -0.5 0\n"
    assert [(r["position"], len(r["embedding"])) for r in scans.text_features(spark, str(tmp_path / "f")).orderBy("position").collect()] == [(1, 3), (2, 3)]
    (tmp_path / "f" / "q.resfeat.txt").write_text("1 2\n3\n")
    with pytest.raises(Exception, match="different width"):
        scans.text_features(spark, str(tmp_path / "f")).collect()
    sinks.feature_manifest(spark, str(tmp_path / "m"), 3, "none", window_size=9)
    found = scans.feature_manifest(spark, str(tmp_path / "m")).first()
    assert (found["hidden_size"], found["format"], found["window_size"]) == (3, "one_file_per_protein", 9)


def test_snapshots_replace_ids_at_once(spark, tmp_path, monkeypatch):
    make = lambda ids, x: spark.createDataFrame([(str(i), p, [float(x)]) for i in ids for p in (1, 2)], "protein_id string, position int, embedding array<float>")
    store = FeatureStore(spark, str(tmp_path / "store"), 4)
    values = lambda version=None: {(r["protein_id"], r["position"]): r["embedding"][0] for r in FeatureStore(spark, str(tmp_path / "store")).read(version).collect()}
    assert store.read().count() == 0 and store.write(make([], 0)) is None
    assert store.write(make(range(10), 1)) == 0 and store.write(make(range(5, 12), 2)) == 1
    assert values() == {(str(i), p): 1.0 if i < 10 else 2.0 for i in range(12) for p in (1, 2)}
    assert store.write(make([3, 20], 7), overwrite=True) == 2
    assert values()["3", 1] == 7.0 and values()["20", 2] == 7.0 and values()["4", 1] == 1.0 and len(values()) == 26
    assert values(1)["3", 1] == 1.0 and len(values(0)) == 20  # older versions stay as they were
    assert store.write(make([3], 9)) == 2  # nothing to add
    with pytest.raises(Exception, match="half a write"):
        store.write(make([4, 5], 8).withColumn("position", F.when(F.col("position") < 2, 1).otherwise(F.raise_error(F.lit("half a write")).cast("int"))), overwrite=True)
    assert values()["4", 1] == 1.0
    late = FeatureStore(spark, str(tmp_path / "store"))
    version = late.version
    monkeypatch.setattr(late, "version", lambda: version() - 1)
    with pytest.raises(RuntimeError, match="another write"):
        late.write(make([4], 8), overwrite=True)
    store.clear_old()
    assert store.versions() == [2] and len(values()) == 26 and values()["3", 1] == 7.0


def test_manifest_and_report_of_what_a_split_leaves_out(spark, tmp_path):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "protein_id string")
    split = spark.createDataFrame([("d", "train"), ("c", "train"), ("e", "val")], "protein_id string, split string")
    known, error, holdout = ids(*"abcdef"), ids("a", "b", "zz"), ids("b", "f", "h")
    one = lambda path: json.loads("".join(p.read_text() for p in path.glob("*.json")))
    sinks.split_manifest(split, str(tmp_path / "m"), 42, 0.2, 100, "all.fasta", known, error, holdout)
    assert one(tmp_path / "m") == {
        "source_fasta": "all.fasta", "seed": 42, "val_ratio": 0.2, "train_ids": ["c", "d"], "val_ids": ["e"], "excluded_error_ids": ["a", "b"], "excluded_holdout_overlap_ids": ["b", "f"], "caid_holdout_ids": ["b", "f", "h"],
        "counts": {"source_records": 6, "eligible_records": 3, "train_records": 2, "val_records": 1, "excluded_error_records": 2, "excluded_holdout_overlap_records": 2},
    }
    sinks.exclusion_report(known, error, holdout, str(tmp_path / "r"), "all.fasta")
    assert one(tmp_path / "r") == {"source_fasta": "all.fasta", "error_id_count_in_file": 3, "error_ids_present_in_source": ["a", "b"], "error_ids_missing_from_source": ["zz"], "holdout_overlap_ids": ["b", "f"], "excluded_total": 4}
    with pytest.raises(ValueError, match="at most 1 ids"):
        sinks.exclusion_report(known, error, holdout, str(tmp_path / "x"), bound=1)


def test_evaluator_refuses_what_it_cannot_align(spark):
    residues = spark.createDataFrame([("a", 1, 1, "1"), ("a", 2, None, "-"), ("a", 3, None, "2")], "protein_id string, position int, label int, mark string")
    asked = lambda *rows: spark.createDataFrame(rows, "protein_id string, position string, score double")
    good = joins.require_aligned(joins.aligned_predictions(asked(("a", "1.0", 0.5), ("a", "2", 0.5), ("b", "1", 0.5), ("a", "x", 0.5)), residues))
    assert sorted(r["status"] for r in good.collect()) == ["bad_pos", "missing_pid", "skipped_masked", "used"]
    with pytest.raises(ValueError, match=r"no prediction meets a label.*'b', 'c'"):
        joins.require_aligned(joins.aligned_predictions(asked(("c", "1", 0.5), ("b", "1", 0.5)), residues))
    with pytest.raises(Exception, match="unexpected label 2 of a at position 3"):
        joins.aligned_predictions(asked(("a", "1", 0.5), ("a", "3", 0.5)), residues).collect()


def test_merge_report_of_chunks(spark):
    records = spark.createDataFrame([("p/1", "A" * 50), ("q", "A" * 5)], "protein_id string, sequence string")
    chunks = spark.createDataFrame([("p/1_2",), ("p/1_1",), ("q_1",), ("no number",)], "chunk_id string")
    rows = {r["protein_id"]: tuple(r)[1:] for r in windows.merge_report(chunks, records, 20).collect()}
    assert rows == {"p/1": (50, 3, [1, 2], "p_1.resfeat.txt", False), "q": (5, 1, [1], "q.resfeat.txt", False)}
    assert tuple(windows.merge_summary(windows.merge_report(chunks, records, 20)).first()) == (2, 3, 2)
    assert tuple(windows.merge_summary(windows.merge_report(chunks, records, 20, dry_run=True)).first()) == (0, 0, 2)
    with pytest.raises(Exception, match="unknown sequence: r"):
        windows.merge_report(spark.createDataFrame([("r_1",)], "chunk_id string"), records, 20).collect()


def test_many_small_files_are_read_by_few_tasks(spark, tmp_path):
    lines = spark.range(6000).select(F.format_string("%04d.txt", F.col("id") % 2000).alias("name"), F.col("id").alias("ix"), F.concat(F.lit(">"), F.col("id").cast("string")).alias("value"))
    named_texts.write(lines, str(tmp_path / "s"), "ix")
    for mark, records in (("", 2000), (">", 6000)):
        read = named_texts.read(spark, str(tmp_path / "s"), mark)
        assert read.rdd.getNumPartitions() <= 3
        rows = sorted((r["record_ix"], r["name"], r["value"]) for r in read.collect())
        assert len(rows) == records == len({r[0] for r in rows}) and [r[1] for r in rows] == sorted(r[1] for r in rows)
        assert "".join(r[2] for r in rows) == "".join(f">{i + k}\n" for i in range(2000) for k in (0, 2000, 4000))
    (tmp_path / "s" / "0000.txt").write_bytes(b"x" * (20 << 20))
    assert named_texts.read(spark, str(tmp_path / "s")).rdd.getNumPartitions() == 1 + 2  # a large one is read alone

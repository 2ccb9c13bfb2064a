import numpy as np
import pytest
from pyspark.sql import functions as F

from seqweave.sources import scans, sinks, structures


def test_fasta_layouts(spark, tmp_path):
    (tmp_path / "l.fasta").write_text(">P1\nacde\n0101\n\n>P2\r\nAC\r\n0-\r\n>P3\nAC\n")
    rows = {r["protein_id"]: r for r in scans.labelled_fasta(spark, str(tmp_path / "l.fasta")).collect()}
    assert (rows["P1"]["sequence"], rows["P1"]["labels"], rows["P1"]["broken"]) == ("ACDE", "0101", None)
    assert rows["P2"]["labels"] == "0-" and rows["P3"]["broken"] == "line_count"
    (tmp_path / "w.fasta").write_text(">Q one\nACB\nZXJ\n>empty\n")
    rows = {r["protein_id"]: r for r in scans.wrapped_fasta(spark, str(tmp_path / "w.fasta")).collect()}
    assert rows["Q one"]["sequence"] == "ACXXXX" and rows["empty"]["broken"] == "no_sequence"
    assert {r[0] for r in scans.id_list(spark, str(tmp_path / "l.fasta")).collect()} == {"P1", "P2", "P3"}
    assert scans.id_list(spark, str(tmp_path / "none"), required=False).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scans.id_list(spark, str(tmp_path / "none"))


def test_features(spark, tmp_path):
    (tmp_path / "a.resfeat.txt").write_text("1 2\n3 4\n")
    (tmp_path / "b.resfeat.txt").write_text("1 2\n3\n")
    rows = scans.text_features(spark, str(tmp_path), refuse_ragged=False)
    assert sorted((r["protein_id"], r["position"], r["embedding"]) for r in rows.collect())[1] == ("a", 2, [3.0, 4.0])
    assert [r["protein_id"] for r in scans.ragged(rows).collect()] == ["b"]
    np.save(tmp_path / "c.npy", np.ones((3, 2)))
    assert scans.array_features(spark, str(tmp_path)).count() == 3


def test_prosite_flat(spark, tmp_path):
    (tmp_path / "p.dat").write_text("ID   ONE; PATTERN.\nAC   PS00001;\nDE   A site.\nPA   A-C-\nPA   x(2).\n//\nID   TWO; MATRIX.\nAC   PS00002;\n//\n")
    rows = scans.prosite_flat(spark, str(tmp_path / "p.dat")).collect()
    assert [(r["id"], r["pa"], r["token"]) for r in rows] == [("ONE", "A-C-x(2)", "<PROSITE:PS00001>")]


def test_predictions(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("﻿ID\t Pos \tProb\na\t1\t0.5\na\t2\tnan\n")
    rows = scans.predictions_tsv(spark, str(tmp_path / "p.tsv"))
    assert rows.columns == ["score", "protein_id", "position"]
    with pytest.raises(Exception, match="finite"):
        rows.collect()


def pdb(kind, n, atom, alternate, residue, chain, number, end="      11.000  12.000  13.000  1.00 20.00"):
    return f"{kind}{n:5d}  {atom:3}{alternate}{residue} {chain}{number:4d}{end}"


def residues_of(spark, *lines):
    atoms = structures.atom_lines(spark.createDataFrame([("s", "\n".join(lines) + "\n")], "structure_id string, text string"))
    return atoms, [(r["chain"], r["subject_pos"], r["resseq"], r["symbol"]) for r in structures.chain_residues(atoms).orderBy("chain", "subject_pos").collect()]


ALA, GLY, VAL = (pdb("ATOM  ", i, "CA", " ", r, "A", i) for i, r in ((1, "ALA"), (2, "gly"), (3, "VAL")))


def test_structure_models(spark):
    assert [r[3] for r in residues_of(spark, ALA, "ENDMDL", GLY, "ENDMDL", VAL)[1]] == ["A", "G", "V"]  # no MODEL line: ENDMDL ends nothing
    assert [r[3] for r in residues_of(spark, "MODEL        1", ALA, GLY, "ENDMDL", VAL)[1]] == ["A", "G"]
    assert [r[3] for r in residues_of(spark, "MODEL        1", ALA, "MODEL        2", GLY)[1]] == ["A"]
    assert residues_of(spark, pdb("ATOM  ", 1, "CA", " ", "ALA", " ", 7), pdb("ATOM  ", 2, "CB", " ", "ALA", " ", 7), pdb("ATOM  ", 3, "CA", "B", "GLY", " ", 8), "ATOM  short", pdb("ATOMS ", 4, "CA", " ", "GLY", " ", 9))[1] == [("", 1, 7, "A")]


def test_structure_annotation(spark):
    water, long_ = pdb("HETATM", 9, "O", " ", "HOH", "A", 9), VAL + " " * 14 + "tail"
    atoms, found = residues_of(spark, "HEADER", ALA, GLY, water, pdb("HETATM", 4, "SE", " ", "MSE", "A", 4), long_, "END")
    assert [r[3] for r in found] == ["A", "G", "M", "V"]
    scores = spark.createDataFrame([("s", "A", 1, "", 0.12), ("s", "A", 9, "", 0.5)], "structure_id string, chain string, resseq int, icode string, score double")
    lines = [r["line"] for r in structures.annotated_lines(atoms, scores).orderBy("line_ix").collect()]
    assert len(lines) == 7 and lines[0] == "HEADER" and lines[3] == water and lines[6] == "END"
    assert lines[1] == ALA[:60] + "  0.12" + " " * 14 and lines[2][60:66] == " -1.00" and len(lines[2]) == 80
    assert lines[5] == VAL[:60] + " -1.00" + long_[66:]
    assert structures.chain_sequences(structures.chain_residues(atoms)).first()["sequence"] == "AGMV"


def test_feature_folders_and_empty_matrices(spark, tmp_path):
    rows = spark.createDataFrame([("a/b", 2, [3.0, 4.0]), ("a/b", 1, [1.0, 2.0]), ("é", 1, [5.0])], "protein_id string, position int, embedding array<float>")
    sinks.text_features(rows, str(tmp_path / "f"))
    got = scans.text_feature_folders(spark, str(tmp_path / "f"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "x.resfeat.txt").write_text("\n \n")
    with pytest.raises(Exception, match="no rows"):
        scans.text_features(spark, str(tmp_path / "g")).collect()


def test_labels_of_predictions(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("id\tprob\tlabel\na\t0.5\t1.0\na\t0.4\t\na\t0.4\t2\n")
    with pytest.raises(Exception, match="neither 0 nor 1"):
        scans.predictions_tsv(spark, str(tmp_path / "p.tsv")).collect()


def test_manifests(spark, tmp_path):
    split = spark.createDataFrame([("a", "train"), ("b", "val"), ("c", "train")], "protein_id string, split string")
    sinks.split_table(split, str(tmp_path / "t"))
    assert sorted(map(tuple, scans.split_table(spark, str(tmp_path / "t")).collect())) == [("a", "train"), ("b", "val"), ("c", "train")]
    sinks.split_manifest(split, str(tmp_path / "m"), 42, 0.2)
    assert sorted(map(tuple, scans.split_manifest(spark, str(tmp_path / "m")).collect())) == [("a", "train"), ("b", "val"), ("c", "train")]
    with pytest.raises(ValueError, match="at most 2"):
        sinks.split_manifest(split, str(tmp_path / "n"), 42, 0.2, bound=2)
    (tmp_path / "f.json").write_text('{"hidden_size": null}')
    with pytest.raises(ValueError, match="hidden_size"):
        scans.feature_manifest(spark, str(tmp_path / "f.json"))


def test_cross_references(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"acc": "X", "regions": [{"cross_refs": [{"db": "PDB", "id": "1abc"}, {"db": "GO", "id": "9"}]}, {"cross_refs": [{"db": "pdb", "id": "1ABC"}]}]}')
    assert structures.cross_references(spark, str(tmp_path / "a.json")).first()["structure_ids"] == ["1ABC"]


def test_feature_sink_adds_what_is_missing(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, [1.0]), ("b", 1, [2.0])], "protein_id string, position int, embedding array<float>")
    sinks.features(rows.where(F.col("protein_id") == "a"), str(tmp_path / "f"))
    assert [r["protein_id"] for r in sinks.features(rows, str(tmp_path / "f")).collect()] in (["b"], [])
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2

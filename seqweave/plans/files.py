"""Round trips of the given tables through the text formats, by way of the shared folder."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from seqweave.functions.expressions import safe_key, sanitize
from seqweave.functions.shared import shared_folder, written
from seqweave.operators import metrics, splits, windows
from seqweave.plans.registry import query
from seqweave.sources import named_texts, scans, sinks, structures
from seqweave.sources.snapshots import FeatureStore
from seqweave.sources.adapters import EMBEDDING_POSITIONS, EVENT_RESIDUES, EVENT_SEQUENCES, embedding_positions, event_residues, event_sequences, table

ES = f"WITH {EVENT_RESIDUES}, {EVENT_SEQUENCES}"
EV = f"WITH {EVENT_RESIDUES}"


@query("s1_labelled_fasta", f"{ES} SELECT protein_id, sequence, labels FROM es")
def s1(spark, sf):
    path = shared_folder(spark, "fasta")
    sinks.labelled_fasta(event_sequences(spark, sf), path)
    return scans.labelled_fasta(spark, path).where("broken is null").select("protein_id", "sequence", "labels")


@query("s1_labelled_fasta_splits", f"{ES} SELECT protein_id, sequence, labels FROM es")
def s1_splits(spark, sf):
    """The same records through the data source of named texts, in three files."""
    path = shared_folder(spark, "fasta")
    lines = event_sequences(spark, sf).select(F.concat(F.pmod(F.xxhash64("protein_id"), F.lit(3)).cast("string"), F.lit(".fasta")).alias("name"), "protein_id", F.concat(F.lit(">"), F.concat_ws("\n", "protein_id", "sequence", "labels")).alias("value"))
    named_texts.write(lines, path, "protein_id")
    return scans.labelled_fasta(spark, path, named=True).where("broken is null").select("protein_id", "sequence", "labels")


@query("s2_plain_fasta", f"{ES} SELECT protein_id, sequence FROM es")
def s2(spark, sf):
    path = shared_folder(spark, "fasta")
    sinks.plain_fasta(event_sequences(spark, sf), path)
    return scans.strict_fasta(spark, path).where("broken is null").select("protein_id", "sequence")


@query("s3_wrapped_fasta", f"{ES} SELECT protein_id, translate(sequence, 'UZOBJ', 'XXXXX') AS sequence FROM es")
def s3(spark, sf):
    path = shared_folder(spark, "fasta")
    wrapped = event_sequences(spark, sf).select(F.concat(F.lit(">"), "protein_id", F.lit("\n"), F.regexp_replace("sequence", "(.{30})", "$1\n")).alias("value"))
    wrapped.write.text(path)
    return scans.wrapped_fasta(spark, path).where("broken is null").select("protein_id", sanitize(F.col("sequence")).alias("sequence"))


@query("s4_id_list", f"{ES} SELECT protein_id FROM es")
def s4(spark, sf):
    path = shared_folder(spark, "fasta")
    sinks.labelled_fasta(event_sequences(spark, sf), path)
    return scans.id_list(spark, path)


@query("s12_any_fasta", f"{ES} SELECT protein_id, sequence, NULL::VARCHAR AS labels FROM es")
def s12(spark, sf):
    path = shared_folder(spark, "fasta")
    sinks.plain_fasta(event_sequences(spark, sf), path)
    return scans.any_fasta(spark, path).select("protein_id", "sequence", "labels")


@query("k1_predictions_tsv", f"{EV} SELECT protein_id, position, round(score, 8) AS score FROM ev")
def k1(spark, sf):
    path = shared_folder(spark, "predictions")
    sinks.predictions_tsv(event_residues(spark, sf), path)
    return scans.predictions_tsv(spark, path).select("protein_id", "position", "score")


@query("k2_score_files", f"{EV}, l AS (SELECT protein_id, position::VARCHAR || chr(9) || symbol || chr(9) || printf('%.3f', score) || chr(9) || (score >= 0.5)::INT AS line FROM ev) SELECT protein_id, line FROM l UNION ALL SELECT DISTINCT protein_id, '>' || protein_id FROM ev")
def k2(spark, sf):
    path = shared_folder(spark, "scores")
    sinks.score_files(event_residues(spark, sf), path)
    found = named_texts.read(spark, path).select(F.regexp_replace("name", "\\.txt$", "").alias("protein_id"), F.split(F.expr("rtrim('\n', value)"), "\n").alias("lines"))
    return found.select("protein_id", F.explode("lines").alias("line"))


@query("k3_timings", f"{ES} SELECT '# time per sequence' AS line UNION ALL SELECT 'sequence,milliseconds' UNION ALL SELECT protein_id || ',' || length(sequence) FROM es")
def k3(spark, sf):
    path = shared_folder(spark, "timings")
    sinks.timings_csv(event_sequences(spark, sf).select("protein_id", F.length("sequence").alias("milliseconds")), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("k5_feature_table", f"WITH {EMBEDDING_POSITIONS} SELECT protein_id, position, embedding[1]::DOUBLE AS x FROM em")
def k5(spark, sf):
    path = shared_folder(spark, "features")
    rows = embedding_positions(spark, sf).select("protein_id", "position", "embedding")
    sinks.features(rows.where("position <= 25 and cast(protein_id as long) % 2 = 0"), path)
    sinks.features(rows, path)  # adds only the ids that aren't there
    return spark.read.parquet(path).select("protein_id", "position", F.get("embedding", F.lit(0)).cast("double").alias("x"))


@query("k5_feature_overwrite", f"WITH {EMBEDDING_POSITIONS} SELECT protein_id, position, CASE WHEN protein_id::BIGINT % 3 = 0 THEN -1.0 ELSE 1.0 END * embedding[1]::DOUBLE AS x FROM em")
def k5_overwrite(spark, sf):
    """All vectors, then those of every third sequence replaced by their negatives, as of the newest snapshot."""
    rows = embedding_positions(spark, sf).select("protein_id", "position", "embedding")
    store = FeatureStore(spark, shared_folder(spark, "feature-store"), 16)
    store.write(rows)
    store.write(rows.where(F.col("protein_id").cast("long") % 3 == 0).withColumn("embedding", F.transform("embedding", lambda x: -x)), overwrite=True)
    return store.read().select("protein_id", "position", F.get("embedding", F.lit(0)).cast("double").alias("x"))


@query("s5_text_features", f"WITH {EMBEDDING_POSITIONS} SELECT protein_id, position, len(embedding)::INT AS width, round(list_sum(embedding::DOUBLE[]), 2) AS total FROM em")
def s5(spark, sf):
    path = shared_folder(spark, "text-features")
    sinks.feature_files(embedding_positions(spark, sf), path)
    rows = scans.text_features(spark, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select("protein_id", "position", F.size("embedding").alias("width"), F.round(total, 2).alias("total"))


@query("s5b_feature_manifest", f"WITH {EMBEDDING_POSITIONS} SELECT protein_id, max(len(embedding))::BIGINT AS hidden_size, count(*) AS length FROM em GROUP BY protein_id")
def s5b(spark, sf):
    path = shared_folder(spark, "feature-manifests")
    rows = embedding_positions(spark, sf).groupBy("protein_id").agg(F.max(F.size("embedding")).alias("hidden_size"), F.count("*").alias("length"))
    rows.write.json(path)
    return scans.feature_manifest(spark, path, multi_line=False).select("protein_id", "hidden_size", "length")


@query("s6_array_features", f"WITH {EMBEDDING_POSITIONS} SELECT protein_id, position, len(embedding)::INT AS width, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM em")
def s6(spark, sf):
    """The vectors as NumPy files of 25 rows, kept in a table of (name, content)."""

    @F.pandas_udf("binary")
    def saved(matrices: pd.Series) -> pd.Series:
        def one(rows) -> bytes:
            held = io.BytesIO()
            np.save(held, np.stack([np.asarray(r["embedding"], dtype=np.float32) for r in rows]))
            return held.getvalue()

        return matrices.map(one)

    matrices = embedding_positions(spark, sf).groupBy("protein_id").agg(F.array_sort(F.collect_list(F.struct("position", "embedding"))).alias("rows"))
    files = written(matrices.select(F.concat("protein_id", F.lit(".npy")).alias("name"), saved("rows").alias("content")), "arrays")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return scans.array_rows(files).select("protein_id", "position", F.size("embedding").alias("width"), F.round(total, 4).alias("total"))


KINDS = """kd AS (SELECT DISTINCT p_brand, p_type FROM part), ml AS (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS i FROM kd)"""


@query("s7_motif_library", f"""WITH {KINDS} SELECT p_brand AS library, i::INT AS motif_order, CASE WHEN i % 2 = 0 THEN p_type ELSE 'M' || (i + 1) END AS id, CASE WHEN i % 3 = 0 THEN 'prosite' ELSE 'regex' END AS kind,
  CASE WHEN i % 3 = 0 THEN 'A-x(' || (i + 1) || ')' ELSE 'A.' END AS pattern, p_brand || '/' || i AS token FROM ml""")
def s7(spark, sf):
    """Part types as one motif library a brand; a library holds no more motifs than there are types."""
    kinds = table(spark, sf, "part").select("p_brand", "p_type").distinct()
    i = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_type")) - 1
    prosite = F.col("i") % 3 == 0
    motif = F.struct(
        "i", F.when(F.col("i") % 2 == 0, F.col("p_type")).alias("id"), F.when(prosite, "PROSITE").alias("kind"), F.when(prosite, F.concat(F.lit(" A-x("), F.col("i") + 1, F.lit(") "))).alias("pa"),
        F.lit("A.").alias("pattern"), F.concat_ws("/", "p_brand", "i").alias("token"),
    )
    path = shared_folder(spark, "motifs")
    kinds.withColumn("i", i).groupBy("p_brand").agg(F.array_sort(F.collect_list(motif)).alias("motifs")).repartition("p_brand").write.partitionBy("p_brand").json(path)
    library = F.split(F.element_at(F.split("token", "/"), 1), "/")[0]
    return scans.motif_json(spark, path).select(library.alias("library"), "motif_order", "id", "kind", "pattern", "token")


@query("s8_prosite_flat", """SELECT 'P' || p_partkey || '_SITE' AS id, 'PS' || p_partkey AS ac, p_name || ' ' || p_type AS de, 'A-x(' || p_size || ')-C' AS pa, '<PROSITE:PS' || p_partkey || '>' AS token FROM part WHERE p_partkey % 3 <> 0""")
def s8(spark, sf):
    """Parts as records of a flat file; every third is no pattern."""
    key = F.col("p_partkey").cast("string")
    kind = F.when(F.col("p_partkey") % 3 != 0, "PATTERN").otherwise("MATRIX")
    lines = (F.concat(F.lit("ID   P"), key, F.lit("_SITE; "), kind, F.lit(".")), F.concat(F.lit("AC   PS"), key, F.lit(";")), F.concat(F.lit("DE   "), "p_name"), F.concat(F.lit("DE   "), "p_type", F.lit(".")), F.concat(F.lit("PA   A-x("), "p_size", F.lit(")")), F.lit("PA   -C."))
    path = shared_folder(spark, "flat")
    table(spark, sf, "part").select(F.concat_ws("\n", *lines).alias("value")).write.option("lineSep", "\n//\n").text(path)
    return scans.prosite_flat(spark, path).select("id", "ac", "de", "pa", "token")


@query("x5_cross_references", """WITH r AS (SELECT DISTINCT l_orderkey, 'S' || l_suppkey AS id FROM lineitem WHERE l_linenumber % 2 = 1)
SELECT l_orderkey::VARCHAR AS protein_id, array_to_string(list_sort(list(id)), ',') AS ids FROM r GROUP BY l_orderkey""")
def x5(spark, sf):
    """Orders as annotations: a region for each line, with a reference to the structure bank in the odd ones."""
    ref = F.struct(F.when(F.col("l_linenumber") % 2 == 1, "pdb").otherwise("GO").alias("db"), F.concat(F.lit(" s"), "l_suppkey").alias("id"))
    region = F.struct(F.array(ref).alias("cross_refs"))
    key = F.col("l_orderkey").cast("string")
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(region).alias("regions"))
    path = shared_folder(spark, "annotations")
    rows.select(F.when(F.col("l_orderkey") % 2 == 0, key).alias("acc"), F.when(F.col("l_orderkey") % 2 == 1, key).alias("accession"), "regions").write.json(path)
    found = structures.cross_references(spark, path, multi_line=False)
    return found.where(F.size("structure_ids") > 0).select("protein_id", F.array_join("structure_ids", ",").alias("ids"))


@query("k6_split_manifest", """WITH o AS (SELECT doc_id::VARCHAR AS protein_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id::VARCHAR) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM documents))
SELECT protein_id, CASE WHEN i <= least(greatest(1, round_even(n * 0.2, 0)), n - 1) THEN 'val' ELSE 'train' END AS split FROM o""")
def k6(spark, sf):
    ids = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("protein_id"))
    none = ids.limit(0)
    path = shared_folder(spark, "split")
    sinks.split_table(splits.seeded_split(ids, none, none), path)
    return scans.split_table(spark, path)


@query("s10_split_manifest", """WITH d AS (SELECT DISTINCT p_brand || ' ' || p_type AS protein_id FROM part), o AS (SELECT protein_id, row_number() OVER (ORDER BY md5(protein_id || ':42'), protein_id) AS i, count(*) OVER () AS n FROM d)
SELECT protein_id, CASE WHEN i <= least(greatest(1, round_even(n * 0.2, 0)), n - 1) THEN 'val' ELSE 'train' END AS split FROM o""")
def s10(spark, sf):
    """The one-object manifest, of ids whose number doesn't grow with the table: kinds of parts."""
    ids = table(spark, sf, "part").select(F.concat_ws(" ", "p_brand", "p_type").alias("protein_id")).distinct()
    path = shared_folder(spark, "manifest")
    sinks.split_manifest(splits.seeded_split(ids, ids.limit(0), ids.limit(0)), path, 42, 0.2)
    return scans.split_manifest(spark, path)


@query("k7_chunk_index", f"""{ES}, w AS (SELECT protein_id, sequence, unnest(list_sort(list_distinct(list_append(range(0, length(sequence) - 24 + 1, 16), length(sequence) - 24)))) AS start FROM es),
k AS (SELECT *, row_number() OVER (PARTITION BY protein_id ORDER BY start) AS ix FROM w) SELECT protein_id || '_' || ix AS chunk_id, start, 24::BIGINT AS length FROM k""")
def k7(spark, sf):
    path = shared_folder(spark, "chunks")
    sinks.chunk_index(windows.chunk_index(event_sequences(spark, sf), 24, 8), path)
    return spark.read.schema("chunk_id string, start long, length long").json(path)


METRICS = """c AS (SELECT split, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn FROM ev GROUP BY split),
x AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0) AS recall FROM c)"""


@query("k8_metrics_json", f"""{EV}, {METRICS} SELECT split, 0.5::DOUBLE AS threshold, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall,
  round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0), 9) AS f1, tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tn::DOUBLE AS tn FROM x""")
def k8(spark, sf):
    path = shared_folder(spark, "metrics")
    sinks.metrics_json(metrics.threshold_report(event_residues(spark, sf), ["split"]), path)
    ratios, counts = ("accuracy", "precision", "recall", "f1"), ("tp", "fp", "fn", "tn")
    rows = spark.read.schema("split string, threshold double, " + ", ".join(f"{c} double" for c in (*ratios, *counts))).json(path)
    return rows.select("split", "threshold", *(F.round(c, 9).alias(c) for c in ratios), *counts)


@query("s13_run_history", f"{EV} SELECT protein_id AS run, position::BIGINT AS step, score AS auroc FROM ev")
def s13(spark, sf):
    path = shared_folder(spark, "history")
    rows = event_residues(spark, sf).groupBy("protein_id").agg(F.collect_list(F.struct(F.col("protein_id").alias("run"), F.col("position").alias("step"), F.col("score").alias("auroc"))).alias("eval_history"))
    rows.select("eval_history").write.json(path)
    return scans.run_history(spark, path, "eval_history", "run string, step long, auroc double", multi_line=False)


#: Residues of a structure text: its columns hold residue numbers of four digits.
MOST = 9_999


def _atoms(spark, sf):
    """The event sequences as structure text, and its lines.

    A structure has at most MOST residues of a sequence (structure_id is the sequence and the number of the part), two
    atoms to each, with an alternate location and a water line. Sequences with an even number have MODEL lines and a
    second model; in the others an ENDMDL line ends nothing, and codes are in lower case.
    """
    name = F.create_map(*(F.lit(x) for pair in (("S", "SER"), ("E", "GLU"), ("C", "CYS"), ("V", "VAL"), ("P", "PRO")) for x in pair))
    rows = event_residues(spark, sf).select("protein_id", ((F.col("position") - 1) % MOST + 1).cast("int").alias("n"), F.expr(f"(position - 1) div {MOST}").alias("part"), name[F.col("symbol")].alias("code"))
    models = F.col("protein_id").cast("long") % 2 == 0
    code = F.when(models, F.col("code")).otherwise(F.lower("code"))

    def line(kind: str, atom: str, alternate: str, x, residue) -> F.Column:
        return F.concat(F.lit(kind), F.lpad(x["number"], 5, " "), F.lit(f"  {atom} {alternate}"), residue, F.lit(" A"), F.lpad(x["number"], 4, " "), F.lit("      11.000  12.000  13.000  1.00 20.00"))

    def residue(x) -> F.Column:
        return F.concat_ws("\n", line("ATOM  ", "CA", " ", x, x["code"]), line("ATOM  ", "CB", " ", x, x["code"]), line("ATOM  ", "CB", "B", x, x["code"]), line("HETATM", " O", " ", x, F.lit("HOH")))

    # Numbers and codes are collected and not lines, which are longer by far.
    at = F.array_sort(F.collect_list(F.struct("n", F.col("n").cast("string").alias("number"), code.alias("code"))))
    texts = rows.groupBy("protein_id", "part").agg(at.alias("at")).select("protein_id", "part", F.array_join(F.transform("at", residue), "\n").alias("body"))
    body = F.col("body")
    whole = F.when(models, F.concat(F.lit("MODEL        1\n"), body, F.lit("\nENDMDL\nMODEL        2\n"), body, F.lit("\nENDMDL\n"))).otherwise(F.concat(F.lit("HEADER\nENDMDL\n"), body, F.lit("\nEND\n")))
    return structures.atom_lines(texts.select(F.concat_ws(".", "protein_id", "part").alias("structure_id"), whole.alias("text")))


def _place(structure: str, number: str) -> tuple[F.Column, F.Column]:
    """(protein_id, position) again."""
    parts = F.split(structure, "\\.")
    return parts[0], (parts[1].cast("int") * MOST + F.col(number)).cast("int")


@query("s11_structure_scan", f"{EV} SELECT protein_id, 'A' AS chain, position AS subject_pos, position AS residue, symbol FROM ev")
def s11(spark, sf):
    rows = structures.chain_residues(_atoms(spark, sf))
    protein, position = _place("structure_id", "subject_pos")
    return rows.select(protein.alias("protein_id"), "chain", position.alias("subject_pos"), _place("structure_id", "resseq")[1].alias("residue"), "symbol")


@query("k10_annotated_structure", f"""{EV}, k AS (SELECT ev.*, CASE WHEN position % 3 = 0 THEN -1.0 ELSE score END AS b, CASE WHEN protein_id::BIGINT % 2 = 0 THEN 2 ELSE 1 END AS models FROM ev),
l AS (SELECT protein_id, position, 'residue' AS kind, printf('%6.2f', b) AS b, 80::INT AS width, 2::BIGINT AS n FROM k UNION ALL
  SELECT protein_id, position, 'other', ' 20.00', 66, 2 * models FROM k UNION ALL SELECT protein_id, position, 'other', ' 20.00', 66, 2 FROM k WHERE models = 2)
SELECT protein_id, position, kind, b, width, sum(n)::BIGINT AS n FROM l GROUP BY ALL""")
def k10(spark, sf):
    """Lines of residues have their score and 80 columns; alternates, water and the second model stay as they are."""
    atoms = _atoms(spark, sf)
    part = F.expr(f"(position - 1) div {MOST}").cast("string")
    scores = event_residues(spark, sf).where("position % 3 <> 0").select(F.concat_ws(".", "protein_id", part).alias("structure_id"), F.lit("A").alias("chain"), ((F.col("position") - 1) % MOST + 1).cast("int").alias("resseq"), F.lit("").alias("icode"), "score")
    path = shared_folder(spark, "annotated")
    sinks.annotated_structures(structures.annotated_lines(atoms, scores), path)
    files = named_texts.read(spark, path).select(F.regexp_replace("name", "\\.pdb$", "").alias("structure_id"), F.explode_outer(F.split("value", "\n")).alias("value"))
    lines = files.where("value like 'ATOM%' or value like 'HETATM%'")
    lines = lines.select("structure_id", F.trim(F.substring("value", 23, 4)).cast("int").alias("number"), F.substring("value", 61, 6).alias("b"), F.length("value").alias("width"))
    protein, position = _place("structure_id", "number")
    rows = lines.select(protein.alias("protein_id"), position.alias("position"), F.when(F.col("width") == 80, "residue").otherwise("other").alias("kind"), "b", "width")
    return rows.groupBy("protein_id", "position", "kind", "b", "width").agg(F.count("*").alias("n"))


@query("s6b_source_resolution", f"""{ES}, n AS (SELECT protein_id, protein_id::BIGINT AS i FROM es)
SELECT protein_id, CASE WHEN i % 2 = 0 THEN '/f/' || protein_id || '.npy' ELSE '/f/' || protein_id || '.resfeat.txt' END AS path FROM n WHERE i % 2 = 0 OR i % 3 = 0""")
def s6b(spark, sf):
    ids = event_sequences(spark, sf).select("protein_id", safe_key(F.col("protein_id")).alias("key"))
    n = F.col("protein_id").cast("long")
    names = ids.where(n % 2 == 0).select(F.concat("protein_id", F.lit(".npy")).alias("name")).unionByName(ids.where(n % 3 == 0).select(F.concat("protein_id", F.lit(".resfeat.txt")).alias("name")))
    return scans.resolve_sources(ids, names.withColumn("path", F.concat(F.lit("/f/"), "name")))


@query("k6_exclusion_report", """WITH d AS (SELECT DISTINCT p_brand || ' ' || p_type AS id, p_brand FROM part), e AS (SELECT id FROM d WHERE p_brand = 'Brand#11' UNION SELECT 'lost ' || r_name FROM region), h AS (SELECT id FROM d WHERE p_brand IN ('Brand#11', 'Brand#22') UNION SELECT 'elsewhere')
SELECT (SELECT count(*) FROM e) AS error_id_count_in_file, (SELECT string_agg(id, ',' ORDER BY id) FROM e JOIN d USING (id)) AS present, (SELECT string_agg(id, ',' ORDER BY id) FROM e ANTI JOIN d USING (id)) AS missing,
  (SELECT string_agg(id, ',' ORDER BY id) FROM h JOIN d USING (id)) AS overlap, (SELECT count(*) FROM e JOIN d USING (id)) + (SELECT count(*) FROM h JOIN d USING (id)) AS excluded_total""")
def k6_report(spark, sf):
    """Kinds of parts, one brand in error, two in the holdout."""
    parts = table(spark, sf, "part").select(F.concat_ws(" ", "p_brand", "p_type").alias("protein_id"), "p_brand").distinct()
    error = parts.where("p_brand = 'Brand#11'").select("protein_id").unionByName(table(spark, sf, "region").select(F.concat(F.lit("lost "), "r_name").alias("protein_id")))
    holdout = parts.where("p_brand in ('Brand#11', 'Brand#22')").select("protein_id").unionByName(spark.createDataFrame([("elsewhere",)], "protein_id string"))
    path = shared_folder(spark, "exclusions")
    sinks.exclusion_report(parts.select("protein_id"), error, holdout, path, "parts")
    found = spark.read.json(path)
    joined = lambda c: F.array_join(c, ",")
    return found.select("error_id_count_in_file", joined("error_ids_present_in_source").alias("present"), joined("error_ids_missing_from_source").alias("missing"), joined("holdout_overlap_ids").alias("overlap"), "excluded_total")


@query("k7_merge_report", f"""{ES}, w AS (SELECT protein_id, length(sequence) AS n, unnest(list_sort(list_distinct(list_append(range(0, greatest(length(sequence) - 24, 0) + 1, 16), greatest(length(sequence) - 24, 0))))) AS start FROM es)
SELECT protein_id, n::INT AS seq_len, ceil(n / 24.0)::INT AS num_windows, array_to_string(range(1, count(*) + 1), ',') AS old_chunk_indices, protein_id || '.resfeat.txt' AS output, true AS dry_run FROM w GROUP BY protein_id, n""")
def k7_merge(spark, sf):
    """What merging every sequence's chunks would do."""
    rows = event_sequences(spark, sf)
    path = shared_folder(spark, "merge-report")
    sinks.chunk_index(windows.merge_report(windows.chunk_index(rows, 24, 8), rows, 24, dry_run=True), path)
    found = spark.read.schema("protein_id string, seq_len int, num_windows int, old_chunk_indices array<int>, output string, dry_run boolean").json(path)
    return found.withColumn("old_chunk_indices", F.array_join(F.transform("old_chunk_indices", lambda i: i.cast("string")), ","))

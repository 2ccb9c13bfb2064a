"""Text, JSON and array scans; each returns rows, and names broken records instead of stopping at the first."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.functions.expressions import sanitize
from seqweave.sources import named_texts

#: Column names that a prediction table may use, the first that occurs wins.
CANDIDATES = {
    "score": ("score", "prob", "probability", "positive_score", "logit", "pred_score"),
    "label": ("label", "y_true", "target", "gold", "residue_label", "true_label"),
    "protein_id": ("protein_id", "id", "protein", "seq_id"),
    "position": ("position_1based", "position", "pos", "residue_index"),
}
EDGE = "^[\\s\\uFEFF]+|[\\s\\uFEFF]+$"


def _records(spark: SparkSession, path: str, named: bool = False) -> DataFrame:
    """record_ix, lines: the stripped lines of each record that begins with >, blank lines left out; named: by the data
    source of named texts, else by Spark's own text scan."""
    if named:
        raw = named_texts.read(spark, path, ">").select("record_ix", "value")
    else:
        raw = spark.read.option("lineSep", "\n>").text(path).select(F.monotonically_increasing_id().alias("record_ix"), "value")
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.regexp_replace(x, EDGE, "")), lambda x: x != "")
    return raw.select("record_ix", lines.alias("lines")).where(F.size("lines") > 0)


def _header(lines: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.get(lines, F.lit(0)), "^>", ""), EDGE, "")


def labelled_fasta(spark: SparkSession, path: str, named: bool = False) -> DataFrame:
    """record_ix, protein_id, sequence (upper case), labels, broken: records of three lines; broken names what is wrong with the layout."""
    rows = _records(spark, path, named)
    broken = F.when(F.size("lines") != 3, "line_count").when(_header(F.col("lines")) == "", "empty_id")
    return rows.select("record_ix", _header(F.col("lines")).alias("protein_id"), F.upper(F.get("lines", F.lit(1))).alias("sequence"), F.get("lines", F.lit(2)).alias("labels"), broken.alias("broken"))


def strict_fasta(spark: SparkSession, path: str, named: bool = False) -> DataFrame:
    """record_ix, protein_id, sequence, broken: records of two lines."""
    rows = _records(spark, path, named)
    broken = F.when(F.size("lines") != 2, "line_count").when(_header(F.col("lines")) == "", "empty_id")
    return rows.select("record_ix", _header(F.col("lines")).alias("protein_id"), F.upper(F.get("lines", F.lit(1))).alias("sequence"), broken.alias("broken"))


def wrapped_fasta(spark: SparkSession, path: str, named: bool = False) -> DataFrame:
    """record_ix, protein_id, sequence, broken: any number of sequence lines, joined; ambiguous symbols become X."""
    rows = _records(spark, path, named)
    sequence = sanitize(F.array_join(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(1))), ""))
    broken = F.when(_header(F.col("lines")) == "", "empty_id").when(F.size("lines") < 2, "no_sequence")
    return rows.select("record_ix", _header(F.col("lines")).alias("protein_id"), sequence.alias("sequence"), broken.alias("broken"))


def any_fasta(spark: SparkSession, path: str) -> DataFrame:
    """labelled_fasta where every record has three lines, else strict_fasta with null labels."""
    three = labelled_fasta(spark, path)
    return three if three.where("broken is not null").isEmpty() else strict_fasta(spark, path).withColumn("labels", F.lit(None).cast("string"))


def id_list(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    """protein_id: what follows > on lines that begin with it; distinct. A missing file is an error unless required is False."""
    try:
        lines = spark.read.text(path)
    except Exception as error:
        if required or "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "protein_id string")
    return lines.where(F.startswith("value", F.lit(">"))).select(F.regexp_replace(F.expr("substring(value, 2)"), EDGE, "").alias("protein_id")).where("protein_id <> ''").distinct()


def _matrix_rows(files: DataFrame, refuse_ragged: bool = True) -> DataFrame:
    """protein_id, position, embedding of text matrices (protein_id, value): a line per position, numbers between blanks."""
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.regexp_replace(x, EDGE, "")), lambda x: x != "")
    widths = F.transform(lines, lambda x: F.size(F.split(x, "\\s+")))
    ragged = F.raise_error(F.concat(F.lit("rows of different width in the features of "), "protein_id")).cast("array<string>")
    if refuse_ragged:
        lines = F.when(F.coalesce(F.array_min(widths) != F.array_max(widths), F.lit(False)), ragged).otherwise(lines)
    rows = files.select("protein_id", F.posexplode_outer(lines).alias("ix", "line"))
    none = F.raise_error(F.concat(F.lit("no rows in the features of "), "protein_id")).cast("int")
    return rows.select("protein_id", F.when(F.col("ix").isNull(), none).otherwise(F.col("ix") + 1).alias("position"), F.transform(F.split("line", "\\s+"), lambda x: x.cast("float")).alias("embedding"))


def text_features(spark: SparkSession, path: str, suffix: str = ".resfeat.txt", refuse_ragged: bool = True) -> DataFrame:
    """protein_id, position, embedding of text matrices <id><suffix>; a file without rows is an error, as is one with rows of
    different width, unless ragged() is to name those."""
    files = spark.read.option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    return _matrix_rows(files.select(F.expr(f"substring(name, 1, length(name) - {len(suffix)})").alias("protein_id"), "value"), refuse_ragged)


def text_feature_folders(spark: SparkSession, path: str) -> DataFrame:
    """text_features where each id has a folder (protein_id=<id>) with one file."""
    return _matrix_rows(spark.read.text(path, wholetext=True).select(F.col("protein_id").cast("string").alias("protein_id"), "value"))


def ragged(features: DataFrame) -> DataFrame:
    """protein_id, low, high: matrices whose rows differ in width."""
    return features.groupBy("protein_id").agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).where("low <> high")


def array_rows(files: DataFrame) -> DataFrame:
    """protein_id, position, embedding of two-dimensional NumPy arrays (name, content), named <id>.npy."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                matrix = np.load(io.BytesIO(content), allow_pickle=False)
                if matrix.ndim != 2:
                    raise ValueError(f"{name} isn't two-dimensional")
                yield pd.DataFrame({"protein_id": name.removesuffix(".npy"), "position": np.arange(1, len(matrix) + 1, dtype=np.int32), "embedding": list(matrix.astype(np.float32))})

    return files.select("name", "content").mapInPandas(load, "protein_id string, position int, embedding array<float>")


def array_features(spark: SparkSession, path: str) -> DataFrame:
    """array_rows of the .npy files in path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    return array_rows(files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content"))


def resolve_sources(ids: DataFrame, files: DataFrame, suffixes: tuple[str, ...] = (".npy", ".h5", ".hdf5", ".resfeat.txt")) -> DataFrame:
    """protein_id, path: for each id the first file by (id before safe key, suffix order); ids: protein_id, key; files: name, path."""
    wanted = ids.select("protein_id", F.posexplode(F.array(F.struct(F.lit(0).alias("s"), F.col("protein_id").alias("stem")), F.struct(F.lit(1).alias("s"), F.col("key").alias("stem")))).alias("_", "x"))
    wanted = wanted.select("protein_id", "x.*", F.posexplode(F.array(*map(F.lit, suffixes))).alias("rank", "suffix")).withColumn("name", F.concat("stem", "suffix"))
    return wanted.join(files, "name").groupBy("protein_id").agg(F.min_by("path", F.struct("s", "rank")).alias("path"))


def motif_json(spark: SparkSession, path: str) -> DataFrame:
    """motif_order, id, kind, ac, de, pattern (pa before pattern), regex, token from {"motifs": [..]}."""
    item = "id string, kind string, ac string, de string, pa string, pattern string, regex string, token string"
    rows = spark.read.schema(f"motifs array<struct<{item.replace(' string', ':string')}>>").option("multiLine", True).json(path)
    return rows.select(F.posexplode("motifs").alias("motif_order", "m")).select("motif_order", F.coalesce("m.id", F.concat(F.lit("M"), (F.col("motif_order") + 1).cast("string"))).alias("id"), F.lower(F.coalesce("m.kind", F.lit("regex"))).alias("kind"), "m.ac", "m.de", F.trim(F.coalesce("m.pa", "m.pattern")).alias("pattern"), "m.regex", "m.token")


def prosite_flat(spark: SparkSession, path: str) -> DataFrame:
    """id, ac, de, pa, token of the PATTERN records of a flat file whose records end with //."""
    records = spark.read.option("lineSep", "\n//").text(path)
    field = lambda k: F.regexp_extract_all("value", F.lit(f"(?m)^{k}   (.*)$"), F.lit(1))
    head = F.get(field("ID"), F.lit(0))
    trimmed = lambda c: F.regexp_replace(F.trim(c), "[;.]+$", "")
    rows = records.where(F.contains(head, F.lit("PATTERN"))).select(
        F.trim(F.split(head, ";")[0]).alias("id"), trimmed(F.get(field("AC"), F.lit(0))).alias("ac"), trimmed(F.array_join(F.transform(field("DE"), lambda x: F.trim(x)), " ")).alias("de"),
        trimmed(F.array_join(F.transform(field("PA"), lambda x: F.trim(x)), "")).alias("pa"),
    )
    return rows.withColumn("token", F.concat(F.lit("<PROSITE:"), F.regexp_replace(F.when(F.col("ac") != "", F.col("ac")).otherwise(F.col("id")), "\\s", "_"), F.lit(">")))


def predictions_tsv(spark: SparkSession, path: str) -> DataFrame:
    """protein_id, position, score[, label] of a table with a header; names are matched without case, blanks or a byte-order mark."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    plain = {c.replace("﻿", "").strip().lower(): c for c in reversed(raw.columns)}
    out = []
    for name, options in CANDIDATES.items():
        found = next((plain[o] for o in options if o in plain), None)
        if found is None:
            if name == "score":
                raise ValueError(f"no score column among {raw.columns}")
            continue
        value = F.col(f"`{found}`")
        number = value.try_cast("double")
        if name == "score":
            number = F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), F.raise_error(F.lit("a score isn't a finite number")).cast("double")).otherwise(number)
        if name == "label":
            number = F.when(value.isNotNull() & ~F.coalesce(number.cast("int").isin(0, 1), F.lit(False)), F.raise_error(F.concat(F.lit("a label is neither 0 nor 1: "), value)).cast("double")).otherwise(number)
        out.append((value if name == "protein_id" else number.cast("int") if name in ("label", "position") else number).alias(name))
    return raw.select(*out)


def contiguous_last(predictions: DataFrame, order: str) -> DataFrame:
    """protein_id, position, score with the last row (by order) of a repeated position, and contiguous: positions are 1..n."""
    last = predictions.groupBy("protein_id", "position").agg(F.max_by("score", order).alias("score"))
    whole = last.groupBy("protein_id").agg(((F.min("position") == 1) & (F.max("position") == F.count("*"))).alias("contiguous"))
    return last.join(whole, "protein_id")


def split_manifest(spark: SparkSession, path: str) -> DataFrame:
    """protein_id, split of a manifest with train_ids and val_ids."""
    rows = spark.read.schema("train_ids array<string>, val_ids array<string>").option("multiLine", True).json(path)
    if not rows.where("train_ids is null or val_ids is null").isEmpty():
        raise ValueError("a manifest needs train_ids and val_ids")
    def named(split: str) -> Column:
        return F.transform(f"{split}_ids", lambda x: F.struct(x.alias("protein_id"), F.lit(split).alias("split")))

    return rows.select(F.inline(F.concat(named("train"), named("val"))))


def split_table(spark: SparkSession, path: str) -> DataFrame:
    """protein_id, split of what sinks.split_table wrote."""
    return spark.read.text(path).select(F.col("value").alias("protein_id"), F.col("split").cast("string").alias("split"))


def feature_manifest(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The manifests in path, a file (or with multi_line False a line) each; hidden_size is required."""
    rows = spark.read.option("multiLine", multi_line).json(path)
    if "hidden_size" not in rows.columns or not rows.where("hidden_size is null").isEmpty():
        raise ValueError("a feature manifest needs hidden_size")
    return rows


def run_history(spark: SparkSession, path: str, part: str, row_schema: str, multi_line: bool = True) -> DataFrame:
    """Rows of one list (epoch_history, print_history or eval_history) of history files, or with multi_line False of a
    history in each line; a malformed one gives none."""
    fields = ", ".join(f"{f.strip().replace(' ', ':', 1)}" for f in row_schema.split(","))
    rows = spark.read.schema(f"{part} array<struct<{fields}>>").option("multiLine", multi_line).option("mode", "DROPMALFORMED").json(path)
    return rows.select(F.inline(F.coalesce(part, F.array().cast(f"array<struct<{fields}>>"))))

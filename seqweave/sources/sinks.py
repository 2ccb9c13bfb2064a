"""Writers; each takes a folder and leaves Spark's part files there."""

from __future__ import annotations

import json
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweave.functions.expressions import at_threshold, safe_key
from seqweave.sources import named_texts


def predictions_tsv(scores: DataFrame, path: str, threshold: float = 0.5, names: tuple[str, str] = ("position_1based", "probability")) -> None:
    """protein_id, position, probability with eight decimals, label; ordered by id and position over the part files."""
    rows = scores.repartitionByRange("protein_id", "position").sortWithinPartitions("protein_id", "position")
    rows = rows.select("protein_id", F.col("position").alias(names[0]), F.format_string("%.8f", "score").alias(names[1]), at_threshold(F.col("score"), threshold).alias("pred_label"))
    rows.write.option("sep", "\t").option("header", True).csv(path)


def score_files(scores: DataFrame, path: str, threshold: float = 0.5, suffix: str = ".txt", overwrite: bool = False) -> None:
    """A file per sequence, named by its id (slashes become _): >id, then position, symbol, score with three decimals, and
    label between tabs. Ids that share a name are refused."""
    lines = scores.select("protein_id", "position", F.concat_ws("\t", F.col("position").cast("string"), "symbol", F.format_string("%.3f", "score"), at_threshold(F.col("score"), threshold).cast("string")).alias("value"))
    heads = scores.select("protein_id").distinct().select("protein_id", F.lit(0).alias("position"), F.concat(F.lit(">"), "protein_id").alias("value"))
    name = F.concat(F.regexp_replace("protein_id", "[/\\\\]", "_"), F.lit(suffix))
    if not heads.groupBy(name).count().where("count > 1").isEmpty():
        raise ValueError("several ids would share one file's name")
    named_texts.write(lines.unionByName(heads).withColumn("name", name), path, "position", overwrite)


def timings_csv(timings: DataFrame, path: str, comment: str = "# time per sequence") -> None:
    """sequence,milliseconds below a comment line; blanks and commas of an id become _."""
    rows = timings.select(F.lit(2).alias("k"), F.concat_ws(",", F.regexp_replace("protein_id", "[\\s,]+", "_"), F.col("milliseconds").cast("string")).alias("value"))
    head = timings.sparkSession.createDataFrame([(0, comment), (1, "sequence,milliseconds")], "k int, value string")
    head.unionByName(rows).repartitionByRange("k", "value").sortWithinPartitions("k", "value").select("value").write.text(path)


def labelled_fasta(records: DataFrame, path: str) -> None:
    records.select(F.concat(F.lit(">"), F.concat_ws("\n", "protein_id", "sequence", "labels")).alias("value")).write.text(path)


def plain_fasta(records: DataFrame, path: str) -> None:
    records.select(F.concat(F.lit(">"), F.concat_ws("\n", "protein_id", "sequence")).alias("value")).write.text(path)


def features(rows: DataFrame, path: str, buckets: int = 64) -> DataFrame:
    """Append the vectors of ids that path doesn't hold yet, as Parquet in buckets of ids; returns what was new."""
    spark = rows.sparkSession
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("protein_id"), F.lit(buckets)).cast("int"))
    try:
        held = spark.read.parquet(path).select("protein_id").distinct()
        rows = rows.join(held, "protein_id", "left_anti")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
    rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)
    return rows


def feature_files(rows: DataFrame, path: str, suffix: str = ".resfeat.txt", overwrite: bool = False) -> None:
    """A file <id><suffix> for each sequence, slashes as _: a line per position, numbers of eight significant digits between blanks."""

    @F.pandas_udf("string")
    def line(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda x: " ".join(f"{float(v):.8g}" for v in x))

    name = F.concat(F.regexp_replace("protein_id", "[/\\\\]", "_"), F.lit(suffix))
    named_texts.write(rows.select(name.alias("name"), "position", line("embedding").alias("value")), path, "position", overwrite)


def text_features(rows: DataFrame, path: str) -> None:
    """A folder per id with one file: a line per position, numbers between blanks."""
    line = F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")
    lines = rows.select("protein_id", "position", line.alias("value")).repartition("protein_id").sortWithinPartitions("protein_id", "position")
    lines.select("protein_id", "value").write.partitionBy("protein_id").text(path)


def feature_manifest(spark, path: str, hidden_size: int, backbone_name: str, suffix: str = ".resfeat.txt", **more) -> None:
    """What a folder of text features holds, as one JSON object: how its files are laid out, by which model, and more."""
    # How such a manifest describes its files.
    layout = {"format": "one_file_per_protein", "file_suffix": suffix, "lines_format": "whitespace_separated_float32", "row_axis": "residue_position"}
    one_json(spark, {"generated_at_utc": datetime.now(UTC).replace(microsecond=0).isoformat(), **layout, "hidden_size": int(hidden_size), "backbone_name": str(backbone_name), **more}, path)


def one_json(spark, values: dict, path: str) -> None:
    """One JSON object: a manifest, metrics or a summary."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.text(path)


#: Fixed value: the key under which a manifest lists the whole holdout.
HOLDOUT_KEY = "caid_holdout_ids"


def _few(counts: dict[str, int], bound: int) -> None:
    if (most := max(counts.values(), default=0)) > bound:
        raise ValueError(f"one object holds at most {bound} ids of a kind, not {most}; write a split table")


def _sorted_ids() -> Column:
    return F.array_sort(F.collect_set("protein_id"))


def split_manifest(split: DataFrame, path: str, seed: int, ratio: float, bound: int = 1_000_000, source: str = "", ids: DataFrame | None = None, error: DataFrame | None = None, holdout: DataFrame | None = None) -> None:
    """train_ids and val_ids, sorted, and their counts, as one JSON object; with ids, error and holdout also what was left out.

    More than bound ids don't belong in one object and are refused; split_table holds any number.
    """
    counts = {r["split"]: r["n"] for r in split.groupBy("split").agg(F.count("*").alias("n")).collect()}
    if sum(counts.values()) > bound:
        raise ValueError(f"a manifest of one object holds at most {bound} ids; write a split table")
    lists = split.groupBy().agg(*(F.array_sort(F.collect_list(F.when(F.col("split") == s, F.col("protein_id")))).alias(f"{s}_ids") for s in ("train", "val")))
    numbers = F.struct(*(F.size(f"{s}_ids").alias(s) for s in ("train", "val")))
    fields = [F.lit(seed).alias("seed"), F.lit(ratio).alias("val_ratio"), numbers.alias("counts"), "train_ids", "val_ids"]
    if ids is not None:
        parts = excluded(ids, error, holdout)
        _few({k: df.count() for k, df in parts.items()}, bound)
        for name, df in parts.items():
            lists = lists.crossJoin(df.agg(_sorted_ids().alias(name)))  # one row each
        more = {"source_records": ids.select("protein_id").distinct().count(), "eligible_records": sum(counts.values()), "train_records": counts.get("train", 0), "val_records": counts.get("val", 0)}
        sizes = {"excluded_error_records": "excluded_error_ids", "excluded_holdout_overlap_records": "excluded_holdout_overlap_ids"}
        numbers = F.struct(*(F.lit(v).cast("long").alias(k) for k, v in more.items()), *(F.size(c).cast("long").alias(k) for k, c in sizes.items()))
        fields = [F.lit(source).alias("source_fasta"), *fields[:2], numbers.alias("counts"), "train_ids", "val_ids", "excluded_error_ids", "excluded_holdout_overlap_ids", F.col("holdout_ids").alias(HOLDOUT_KEY)]
    lists.select(*fields).coalesce(1).write.json(path)


def excluded(ids: DataFrame, error: DataFrame, holdout: DataFrame) -> dict[str, DataFrame]:
    """protein_id of the ids that a split leaves out: those with an error, those of the holdout (an id may be both), error
    ids that no record has, and the holdout itself."""
    known, wrong, held = (df.select("protein_id").distinct() for df in (ids, error, holdout))
    return {
        "excluded_error_ids": known.join(wrong, "protein_id", "left_semi"),
        "excluded_holdout_overlap_ids": known.join(held, "protein_id", "left_semi"),
        "error_ids_missing_from_source": wrong.join(known, "protein_id", "left_anti"),
        "holdout_ids": held,
    }


def exclusion_report(ids: DataFrame, error: DataFrame, holdout: DataFrame, path: str, source: str = "", bound: int = 1_000_000) -> None:
    """What a split leaves out, as one JSON object; more than bound ids of a kind are refused."""
    parts = excluded(ids, error, holdout)
    sizes = {k: df.count() for k, df in parts.items()}
    _few({k: n for k, n in sizes.items() if k != "holdout_ids"}, bound)
    row = error.sparkSession.range(1).select(F.lit(source).alias("source_fasta"), F.lit(error.select("protein_id").distinct().count()).cast("long").alias("error_id_count_in_file"))
    for name, shown in (("excluded_error_ids", "error_ids_present_in_source"), ("error_ids_missing_from_source", "error_ids_missing_from_source"), ("excluded_holdout_overlap_ids", "holdout_overlap_ids")):
        row = row.crossJoin(parts[name].agg(_sorted_ids().alias(shown)))  # one row each
    total = sizes["excluded_error_ids"] + sizes["excluded_holdout_overlap_ids"]
    row.withColumn("excluded_total", F.lit(total).cast("long")).coalesce(1).write.json(path)


def split_table(split: DataFrame, path: str) -> None:
    """A line per id, in a folder for each split and in order over its files."""
    rows = split.repartitionByRange("split", "protein_id").sortWithinPartitions("split", "protein_id")
    rows.select("split", F.col("protein_id").alias("value")).write.partitionBy("split").text(path)


def chunk_index(chunks: DataFrame, path: str) -> None:
    chunks.write.json(path)


def metrics_json(summary: DataFrame, path: str) -> None:
    """A JSON object for each group of an evaluation; a metric that isn't a number is null."""
    doubles = {f.name for f in summary.schema.fields if f.dataType.typeName() in ("double", "float")}
    summary.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in doubles else F.col(c) for c in summary.columns)).write.option("ignoreNullFields", "false").json(path)


def structure_manifest(rows: DataFrame, path: str) -> None:
    """structure.manifest as a table with a header, shares and ratios with six decimals."""
    doubles = {f.name for f in rows.schema.fields if f.dataType.typeName() == "double"}
    texts = rows.select(*(F.format_string("%.6f", c).alias(c) if c in doubles else F.col(c) for c in rows.columns))
    texts.write.option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def annotated_structures(lines: DataFrame, path: str, suffix: str = ".pdb", overwrite: bool = False) -> None:
    """Structure text with scores, a file per structure."""
    named_texts.write(lines.select(F.concat(safe_key(F.col("structure_id")), F.lit(suffix)).alias("name"), "line_ix", F.col("line").alias("value")), path, "line_ix", overwrite)

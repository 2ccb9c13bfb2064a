"""The given tables as position tables (protein_id, position, symbol, label, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in time order as a sequence: the event type's letter, a label by value (null: masked), a score."""
    ev = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return ev.select(
        F.col("user_id").cast("string").alias("protein_id"),
        F.row_number().over(order).alias("position"),
        F.upper(F.substring("event_type", 1, 1)).alias("symbol"),
        F.when(F.col("value") >= 75, 1).when(F.col("value") < 5, F.lit(None)).otherwise(0).cast("int").alias("label"),
        (F.get_json_object("props", "$.k").cast("int") / 100.0).alias("score"),
        F.when(F.col("user_id") % 5 == 0, "val").otherwise("train").alias("split"),
    )


EVENT_RESIDUES = """ev AS (
  SELECT user_id::VARCHAR AS protein_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS position,
         upper(substr(event_type, 1, 1)) AS symbol, CASE WHEN value >= 75 THEN 1 WHEN value < 5 THEN NULL ELSE 0 END::INT AS label,
         (props::JSON ->> '$.k')::INT / 100.0::DOUBLE AS score, CASE WHEN user_id % 5 = 0 THEN 'val' ELSE 'train' END AS split
  FROM events)"""


def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """protein_id, sequence, labels (0, 1, - masked), split: the event sequences as strings."""
    at = F.array_sort(F.collect_list(F.struct("position", "symbol", F.coalesce(F.col("label").cast("string"), F.lit("-")).alias("label"))))
    rows = event_residues(spark, sf_dir).groupBy("protein_id", "split").agg(at.alias("at"))
    return rows.select("protein_id", F.array_join("at.symbol", "").alias("sequence"), F.array_join("at.label", "").alias("labels"), "split")


EVENT_SEQUENCES = """es AS (
  SELECT protein_id, string_agg(symbol, '' ORDER BY position) AS sequence, string_agg(coalesce(label::VARCHAR, '-'), '' ORDER BY position) AS labels, split
  FROM ev GROUP BY protein_id, split)"""


def lineitem_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as predictions: return flag as label (N: masked), discount as score."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("protein_id"), F.col("l_linenumber").alias("position"),
        F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0).cast("int").alias("label"), F.col("l_discount").alias("score"), F.col("l_extendedprice").alias("price"),
    )


LINEITEM_PREDICTIONS = """li AS (
  SELECT l_orderkey::VARCHAR AS protein_id, l_linenumber AS position, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END::INT AS label,
         l_discount AS score, l_extendedprice AS price FROM lineitem)"""


def document_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of a document's text as a sequence."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("protein_id"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence"))


DOCUMENT_SEQUENCES = """ds AS (SELECT doc_id::VARCHAR AS protein_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM documents)"""


def embedding_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as positions of sequences of 25; label: class 5 or above."""
    return table(spark, sf_dir, "embeddings").select(
        F.expr("cast(vec_id div 25 as string)").alias("protein_id"), (F.col("vec_id") % 25 + 1).cast("int").alias("position"), "embedding", (F.col("label") >= 5).cast("int").alias("label")
    )


EMBEDDING_POSITIONS = """em AS (SELECT (vec_id // 25)::VARCHAR AS protein_id, (vec_id % 25 + 1)::INT AS position, embedding, (label >= 5)::INT AS label FROM embeddings)"""

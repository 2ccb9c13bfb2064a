"""Confusion counts of predictions that keep arriving as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.operators.metrics import confusion


def ingest(spark: SparkSession, path: str, schema: str, registry: str, checkpoint: str, by: list[str], threshold: float = 0.5) -> None:
    """Take up the Parquet files that came since the last run with this checkpoint, and write the groups that changed
    to ``registry/batch=N``. A batch that is run again replaces its own folder, so counts stay exact after a failure."""
    rows = spark.readStream.schema(schema).parquet(path)

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{registry}/batch={batch:09d}")

    counts = confusion(rows, by, threshold).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    counts.trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def current(spark: SparkSession, registry: str, by: list[str]) -> DataFrame:
    """The newest counts of every group."""
    rows = spark.read.parquet(registry)
    counts = F.struct(*(c for c in rows.columns if c not in (*by, "batch")))
    return rows.groupBy(*by).agg(F.max_by(counts, "batch").alias("x")).select(*by, "x.*")

"""Exact deduplication as a stateful stream: keyed disk-backed state without expiry."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.functions.shared import shared_folder, written
from seqweave.llm.columns import carried, named, unpacked
from seqweave.llm.urls import BROADCAST_BLOCKS, blocks_for, bloom_filter, may_be_in

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: While the stream runs: disk-backed state, whose files aren't allocated ahead and whose buffers are small (an
#: executor holds a store for each of its partitions), and no trigger without data.
STREAM_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.rocksdb.blockCacheSizeMB": "2",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")
#: What a column of a table that is deduplicated gets behind its name while it is called like a result.
OWN = "__own"


def _digest() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)


def _located() -> Column:
    """Of equal texts the largest (doc_id, file, row) stays: a total order even over repeated rows."""
    return F.struct(F.col("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def exactly(path: str) -> str:
    """A glob that matches path and nothing beside it: a stream takes a single file only by a glob.

    One character of the name is written as a class of one. A path that is a glob already stays as it is.
    """
    path = path.rstrip("/")
    return path if re.search(r"[*?\[\]{}]", path) else re.sub(r"([A-Za-z0-9_])([^A-Za-z0-9_/]*)$", r"[\1]\2", path)


def ingest(spark: SparkSession, path: str, registry: str, checkpoint: str, files_per_trigger: int | None = None) -> None:
    """Stream every new Parquet file of path into the registry.

    The state is a RocksDB store keyed by (digest, length) that never expires; for each key it retains the stable
    identifier and content locator of the row that stays, and the number of rows seen. A trigger writes the keys that
    it changed to ``registry/batch=N``. Running it again with the same checkpoint takes up only files that came since.
    Nothing beside path is read. The stream runs in a session of its own, so its settings touch no other query.
    """
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    own = spark.newSession()
    for k, v in {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"), **STREAM_SETTINGS}.items():
        own.conf.set(k, v)
    reader = own.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.parquet(exactly(path))
    state = rows.groupBy(_digest().alias("digest"), F.length(F.coalesce("text", F.lit(""))).alias("length")).agg(F.max(_located()).alias("stays"), F.count("*").alias("group_size"))

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{registry}/batch={batch:09d}")

    state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def read_registry(spark: SparkSession, registry: str) -> DataFrame:
    """digest, length, stays, group_size: the newest state of every key."""
    schema = "digest string, length int, stays struct<doc_id:long,file:string,row:long>, group_size long, batch int"
    return spark.read.schema(schema).parquet(registry).groupBy("digest", "length").agg(F.max_by(F.struct("stays", "group_size"), "batch").alias("x")).select("digest", "length", "x.*")


def _clashes(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """digest, length of the keys under which different texts were seen, by the bytes of every hit.

    A blocked Bloom filter over the keys seen more than once keeps the texts of other rows out of the exchange; what
    it passes by mistake has one text and is no clash. Its size is bounded: with more keys it has fewer bits for each
    and passes more, up to every row.
    """
    hits = written(keys.where("group_size > 1").select(F.col("digest").alias("url")), "dedup-hits")
    blocks = min(blocks_for(hits.count()), BROADCAST_BLOCKS)
    texts = rows.select("digest", "length", F.coalesce("doc.text", F.lit("")).alias("bytes"))
    texts = may_be_in(texts, "digest", F.broadcast(bloom_filter(hits, blocks)), blocks, "maybe").where("maybe").drop("maybe")
    texts = texts.distinct().groupBy("digest", "length").agg(F.count("*").alias("texts"))
    return written(texts.where("texts > 1").select("digest", "length"), "dedup-clashes")


def mark_duplicates(spark: SparkSession, path: str) -> DataFrame:
    """Every row of the Parquet table at path, with keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty and equals an empty one. Of equal texts the row with
    the largest doc_id stays, of rows that repeat it the last by file and row; a null doc_id is below any other, and a
    group of null doc_ids has a null keep_id. An empty table gives an empty result. Very long texts move only where
    their digest was seen more than once. Columns of the table other than doc_id and text are carried along, whatever
    their names; those named like a result column (in any case) are replaced.

    A hit on a digest is checked in full: among rows whose key was seen more than once, the bytes themselves are
    grouped. Keys that turn out to hold different texts are decided by the text, all others by the key.
    """
    root = shared_folder(spark, "exact-dedup")
    table = spark.read.parquet(path)
    if not table.isEmpty():
        ingest(spark, path, f"{root}/registry", f"{root}/state")
        # A table, so that the join below reads two plain exchanges and AQE can split a hot digest's rows.
        keys = written(read_registry(spark, f"{root}/registry"), "dedup-registry")
    else:
        keys = spark.createDataFrame([], "digest string, length int, stays struct<doc_id:long,file:string,row:long>, group_size long")
    # The table's own columns travel in one struct, so that no name of theirs meets a helper's.
    rows = table.select(carried(table).alias("doc"), _digest().alias("digest"), F.length(F.coalesce("text", F.lit(""))).alias("length"), _located().alias("at"))

    joined = rows.join(keys, ["digest", "length"])
    clashes = _clashes(rows, keys)
    if not clashes.isEmpty():
        texts = rows.withColumn("bytes", F.coalesce("doc.text", F.lit("")))
        own = texts.join(clashes, ["digest", "length"], "left_semi").groupBy("digest", "length", "bytes").agg(F.max("at").alias("own"), F.count("*").alias("n"))
        joined = joined.withColumn("bytes", F.coalesce("doc.text", F.lit(""))).join(own, ["digest", "length", "bytes"], "left")
        joined = joined.withColumn("stays", F.coalesce("own", "stays")).withColumn("group_size", F.coalesce("n", "group_size"))
    return joined.select(
        *unpacked(table, RESULTS, "doc"),
        F.col("stays.doc_id").alias("keep_id"),
        "group_size",
        (F.col("stays") == F.col("at")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def table_path(docs: DataFrame) -> str | None:
    """The path of the table that docs is a plain scan of, or none if docs is anything else, or it can't be told."""
    files = docs.inputFiles()
    for path in (files[0], files[0].rpartition("/")[0]) if files else ():
        for written_as in (path, path.removeprefix("file://")):
            if docs.sparkSession.read.parquet(written_as).sameSemantics(docs):
                return written_as
    return None


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text another row keeps; same columns, otherwise as mark_duplicates.

    The stream reads files: where docs is a plain Parquet table its own, else those it is first written to.
    """
    spark, path = docs.sparkSession, table_path(docs)
    aside = {c: c if c.lower() not in RESULTS else f"{c}{OWN}" for c in docs.columns}
    if path is None or set(aside) != set(aside.values()):
        path = shared_folder(spark, "dedup-input")
        docs.select(*(named(c).alias(a) for c, a in aside.items())).write.parquet(path)
    kept = mark_duplicates(spark, path).where("kept")
    return kept.select(*(named(a).alias(c) for c, a in aside.items()))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of documents; see mark_duplicates."""
    return mark_duplicates(spark, f"{sf_dir}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

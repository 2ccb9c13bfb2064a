"""Token counts by separator scan over flat token files that have no index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqweave.functions.shared import written
from seqweave.llm.tokenizer import id_bytes

END = 50256
#: Ids in a block of a flat token file.
BLOCK = 1 << 18
#: Blocks whose sums one task of the prefix scan adds up.
SPAN = 4096
BLOCKS = "stream long, block long, payload binary"


def flat_token_blocks(docs: DataFrame, end: int = END, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(blocks, order): the ids of docs written one after another, each document closed by the end id.

    blocks has (stream, block, payload): payload is a run of little-endian unsigned 16-bit ids of a fixed size (the
    last of a stream is shorter); documents run on across blocks and nothing says where one begins. order has
    (stream, ordinal, doc_id), the order in which documents were written. A stream is what one task writes. Null and
    empty texts are empty documents, repeated rows are written each, and the end token's string in a text is ordinary
    text, so the end id closes documents only. No rows: no blocks. Extra columns are ignored.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, held, count, blocks, docs_seen = None, [], 0, 0, 0
        for batch in batches:
            payloads = []
            stream = batch["stream"][0].as_py() if stream is None and len(batch) else stream
            for text in batch["text"].to_pylist():
                ids = np.frombuffer(id_bytes(text, special=False), dtype="<u4").astype("<u2")
                held += [ids, np.array([end], dtype="<u2")]
                count += len(ids) + 1
                if count >= block:
                    flat = np.concatenate(held)
                    for at in range(0, count - block + 1, block):
                        payloads.append((blocks, flat[at : at + block].tobytes()))
                        blocks += 1
                    held = [flat[count - count % block :]]
                    count %= block
            yield frame(stream, docs_seen, batch["doc_id"], payloads)
            docs_seen += len(batch)
        if count:
            yield frame(stream, docs_seen, pa.array([], pa.int64()), [(blocks, np.concatenate(held).tobytes())])

    def frame(stream: int | None, first: int, docs: pa.Array, payloads: list) -> pa.RecordBatch:
        """A row for every document, then one for every payload. The ids stay Arrow values, exact beside nulls."""
        m, n = len(docs), len(payloads)
        columns = [
            pa.array([stream] * (m + n), pa.int64()),
            pa.array([None] * m + [b for b, _ in payloads], pa.int64()),
            pa.array([None] * m + [p for _, p in payloads], pa.binary()),
            pa.array([*range(first, first + m), *[None] * n], pa.int64()),
            pa.concat_arrays([docs.cast(pa.int64()), pa.nulls(n, pa.int64())]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["stream", "block", "payload", "ordinal", "doc_id"])

    if not 0 <= end < 1 << 16:
        raise ValueError("the end id must fit 16 bits")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().cast("long").alias("stream"))
    both = written(rows.mapInArrow(write, f"{BLOCKS}, ordinal long, doc_id long"), "flat-tokens", codec="zstd")
    return both.where("payload is not null").select("stream", "block", "payload"), both.where("payload is null").select("stream", "ordinal", "doc_id")


def _scan(end: int, width: str):
    """mapInPandas: of every block its separators (vectorised search) and its totals."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for stream, block, payload in zip(batch["stream"], batch["block"], batch["payload"], strict=True):
                ids = np.frombuffer(payload, dtype=width)
                ends = np.flatnonzero(ids == end)
                n = len(ends)
                yield pd.DataFrame(
                    {
                        "stream": np.full(n + 1, stream),
                        "block": np.full(n + 1, block),
                        "nth": np.r_[np.arange(n), -1],
                        "end": np.r_[ends, -1],
                        "start": np.r_[-1, ends[:-1] + 1, -1][: n + 1] if n else np.array([-1]),
                        "tokens": np.r_[np.full(n, -1), len(ids)],
                        "seps": np.r_[np.full(n, -1), n],
                        "tail": np.r_[np.full(n, -1), len(ids) - 1 - ends[-1] if n else -1],
                    }
                ).astype("int64")

    return scan


def block_offsets(totals: DataFrame) -> DataFrame:
    """(stream, block, at, ordinal, carry): a prefix scan over block totals (stream, block, tokens, seps, tail).

    at: ids of the stream before the block; ordinal: separators before it; carry: ids since the last of them.
    The scan has two levels, spans of SPAN blocks and then the spans, so one long stream isn't one task's work.
    """
    spans = totals.withColumn("span", F.expr(f"block div {SPAN}"))
    inside = Window.partitionBy("stream", "span").orderBy("block")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = spans.withColumn("at_in", F.coalesce(F.sum("tokens").over(before), F.lit(0))).withColumn("ord_in", F.coalesce(F.sum("seps").over(before), F.lit(0)))
    end_in = F.max(F.col("at_in") + F.col("tokens") - F.when(F.col("seps") > 0, F.col("tail"))).over(before)
    local = local.withColumn("sep_in", end_in)
    whole = spans.groupBy("stream", "span").agg(F.sum("tokens").alias("s_tokens"), F.sum("seps").alias("s_seps"))
    tail = local.groupBy("stream", "span").agg(F.max(F.col("at_in") + F.col("tokens") - F.when(F.col("seps") > 0, F.col("tail"))).alias("s_sep"))
    outer = Window.partitionBy("stream").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    top = whole.join(tail, ["stream", "span"]).withColumn("s_at", F.coalesce(F.sum("s_tokens").over(outer), F.lit(0))).withColumn("s_ord", F.coalesce(F.sum("s_seps").over(outer), F.lit(0)))
    top = top.withColumn("s_last", F.max(F.col("s_at") + F.col("s_sep")).over(outer)).select("stream", "span", "s_at", "s_ord", "s_last")
    at = F.col("s_at") + F.col("at_in")
    since = F.coalesce(F.col("s_at") + F.col("sep_in"), F.col("s_last"), F.lit(0))
    return local.join(top, ["stream", "span"]).select("stream", "block", at.alias("at"), (F.col("s_ord") + F.col("ord_in")).alias("ordinal"), (at - since).alias("carry"))


def separator_counts(blocks: DataFrame, end: int = END, width: str = "<u2") -> DataFrame:
    """(stream, ordinal, start, n_tokens) of every document in flat token blocks, its end id not counted.

    blocks: (stream, block, payload) with blocks numbered from 0 without gaps; payload holds ids of ``width``. Blocks
    may have any sizes, hold no separator or be empty; what follows a stream's last separator is no document. Two
    separators in a row close an empty document. Null payloads are empty. No blocks: no rows.
    """
    found = blocks.select("stream", "block", F.coalesce("payload", F.lit(b"")).alias("payload"))
    found = written(found.mapInPandas(_scan(end, width), "stream long, block long, nth long, end long, start long, tokens long, seps long, tail long"), "separators")
    offsets = block_offsets(found.where("nth = -1").select("stream", "block", "tokens", "seps", "tail"))
    ends = found.where("nth >= 0").select("stream", "block", "nth", "end", "start").join(offsets, ["stream", "block"])
    first = F.col("start") < 0
    start = F.when(first, F.col("at") - F.col("carry")).otherwise(F.col("at") + F.col("start"))
    return ends.select("stream", (F.col("ordinal") + F.col("nth")).alias("ordinal"), start.alias("start"), (F.col("at") + F.col("end") - start).alias("n_tokens"))


def op5_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, stream, ordinal, start, n_tokens of every document, read back from the flat token blocks."""
    blocks, order = flat_token_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return separator_counts(blocks).join(order, ["stream", "ordinal"]).select("doc_id", "stream", "ordinal", "start", "n_tokens")

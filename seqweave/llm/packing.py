"""Vector best-fit packing of token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from seqweave.functions.shared import written
from seqweave.llm.columns import carried, unpacked
from seqweave.llm.tokenizer import id_bytes

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RESULTS = ("sequence_id", "offset")


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds: tokens, documents, and attention cost (the sum of squared piece lengths).

    weights say how much a dimension counts when a bin is chosen, besides its scarcity (see best_fit).
    """

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rule: str = "norm"

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], dtype=np.float64)


def cut_pieces(docs: DataFrame, size: int = 2048, end: int = 0) -> DataFrame:
    """Pieces of every document: its ids, then the end id, cut only where longer than size; the first may be shorter.

    docs: doc_id, text; other columns are ignored. Null and empty texts give one piece, the end id; a very long text
    gives as many pieces as it needs, and is encoded whole in one task. Repeated rows give repeated pieces. A null
    doc_id stays null. No rows: no pieces.
    """
    tail = end.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, text in enumerate(batch["text"].to_pylist()):
                ids = id_bytes(text) + tail
                n = len(ids) // 4
                starts = [0, *range(n % size or size, n, size)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    rows.append((row, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            row, piece, start, length, crc = np.array(rows, dtype=np.int64).reshape(-1, 5).T
            # The ids are taken over as Arrow values: beside a null they are still exact.
            columns = [batch["doc_id"].take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every length, longest first.

    An item needs (length, 1, length squared). Of the open bins that have room under every constraint it takes the one
    whose residual vector afterwards has the smallest weighted norm (rule "norm"), or whose residual has the largest
    weighted dot product with the need (rule "dot"). Vectors are counted in shares of the capacity, and a dimension
    weighs its weight times its scarcity: what all items together need of it, in shares of the capacity, against the
    scarcest. If no bin has room the item opens one. Ties go to the bin opened first, equal lengths in their order.
    """
    full = capacity.vector()
    asked = np.array([lengths.sum(dtype=np.float64), len(lengths), (lengths.astype(np.float64) ** 2).sum()]) / full
    weights = np.array(capacity.weights) * asked / max(asked.max(), 1e-300)
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    rest = np.empty((len(lengths), 3))
    name = np.empty(len(lengths), dtype=np.int64)
    open_, made = 0, 0
    smallest = int(lengths.min()) if len(lengths) else 0
    for at, item in enumerate(order):
        length = float(lengths[item])
        need = np.array([length, 1.0, length * length])
        if (need > full).any():
            raise ValueError(f"a piece of {length:.0f} tokens exceeds the capacity of an empty sequence")
        if at % 2048 == 0 and open_:
            useful = (rest[:open_, 0] >= smallest) & (rest[:open_, 1] >= 1)
            kept = int(useful.sum())
            rest[:kept], name[:kept] = rest[:open_][useful], name[:open_][useful]
            open_ = kept
        room = np.flatnonzero(rest[:open_, 0] >= length)
        if len(room):
            left = rest[room]
            room = room[(left[:, 1] >= 1) & (left[:, 2] >= need[2])]
        if len(room):
            left = rest[room]
            if capacity.rule == "norm":
                best = int(np.argmin((((left - need) / full) ** 2 * weights).sum(axis=1)))
            else:
                best = int(np.argmax((left / full * (need / full) * weights).sum(axis=1)))
            slot = int(room[best])
        else:
            slot = open_
            rest[slot], name[slot] = full, made
            open_, made = open_ + 1, made + 1
        bins[item] = name[slot]
        offsets[item] = int(full[0] - rest[slot, 0])
        rest[slot] -= need
    return bins, offsets


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), per_group: int = 16384) -> DataFrame:
    """pieces (length, and any further columns) with sequence_id and offset.

    Every row is dealt by its own number into groups of about per_group, whatever it holds, so rows that repeat are
    dealt like any others; each group is packed on its own. A task holds one group, and a group leaves one sequence
    partly filled, so the loss is below one sequence in several thousand. Pieces as long as a sequence fill one alone.
    Ties: see best_fit. Columns called like a result (in any case) are replaced. No rows: no rows.
    """
    spark = pieces.sparkSession
    numbered = pieces.select(carried(pieces, RESULTS).alias("own"), F.col("length").cast("long").alias("size"), F.monotonically_increasing_id().alias("nth"))
    numbered = written(numbered, "pieces")  # the numbers are drawn once, whatever executors are lost later
    groups = max(1, -(-numbered.count() // per_group))
    dealt = numbered.withColumn("group", F.pmod(F.xxhash64("nth"), F.lit(groups)))
    shape = StructType([numbered.schema["own"], StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def fill(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("nth")
        bins, offsets = best_fit(rows["size"].to_numpy(), capacity)
        ids = (rows["group"][0].as_py() << 32) + bins
        return pa.table({"own": rows["own"], "sequence_id": pa.array(ids), "offset": pa.array(offsets)})

    parts = max(1, min(groups, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    packed = dealt.repartition(parts, "group").groupBy("group").applyInArrow(fill, shape)
    return packed.select(*unpacked(pieces, RESULTS, "own"), *RESULTS)


def pack_documents(docs: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """Pieces of docs and their places in sequences; see cut_pieces and pack for nulls, repeats, long texts and ties."""
    return pack(cut_pieces(docs, capacity.tokens), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every piece of documents; see pack_documents."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Hard-negative mining: exact integer scores of anchor-candidate tiles by Strassen's recursion, and heaps that merge."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqweave.functions.shared import written

#: Rows at most of a block of anchors and of a block of candidates, which one task holds at once, and of a tile's candidates.
ANCHOR_BLOCK, CANDIDATE_BLOCK, TILE = 2048, 65536, 1024
#: Blocks of candidates have at least so many rows, however many partitions there are to fill.
LEAST_BLOCK = 2048
#: A side of a tile at or below which Strassen's recursion ends.
LEAF = 32
#: The result must fit 64 bits, and so must a score times 100.
LIMIT = (1 << 63) // 100


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in int64, as a sum of outer products."""
    out = np.zeros((len(a), b.shape[1]), dtype=np.int64)
    for k in range(a.shape[1]):
        out += a[:, k, None] * b[k]
    return out


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices, exactly: seven products of half the size each, odd sides padded with zeros.

    Sums that leave 64 bits on the way wrap around and come back, so the result is exact wherever it fits itself.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return _product(a, b)
    m2, k2, n2 = (m + 1) // 2, (k + 1) // 2, (n + 1) // 2
    if (m | k | n) & 1:
        a, b = np.pad(a, ((0, 2 * m2 - m), (0, 2 * k2 - k))), np.pad(b, ((0, 2 * k2 - k), (0, 2 * n2 - n)))
    a11, a12, a21, a22 = a[:m2, :k2], a[:m2, k2:], a[m2:, :k2], a[m2:, k2:]
    b11, b12, b21, b22 = b[:k2, :n2], b[:k2, n2:], b[k2:, :n2], b[k2:, n2:]
    p1, p2, p3 = strassen(a11 + a22, b11 + b22, leaf), strassen(a21 + a22, b11, leaf), strassen(a11, b12 - b22, leaf)
    p4, p5 = strassen(a22, b21 - b11, leaf), strassen(a11 + a12, b22, leaf)
    p6, p7 = strassen(a21 - a11, b11 + b12, leaf), strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * m2, 2 * n2), dtype=np.int64)
    out[:m2, :n2], out[:m2, n2:] = p1 + p4 - p5 + p7, p3 + p5
    out[m2:, :n2], out[m2:, n2:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


class Heap:
    """The best k of what it has seen, by score (high first), id (small first), row (small first). Heaps merge by adding
    one's entries to the other."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.score, self.id, self.row = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(self.score) == self.k and len(score):
            hope = score >= self.score[-1]
            score, ids, rows = score[hope], ids[hope], rows[hope]
        if len(score) > self.k:  # those that are below the k-th best of them can't stay
            hope = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids, rows = score[hope], ids[hope], rows[hope]
        if len(score):
            score, ids, rows = np.r_[self.score, score], np.r_[self.id, ids], np.r_[self.row, rows]
            best = np.lexsort((rows, ids, -score))[: self.k]
            self.score, self.id, self.row = score[best], ids[best], rows[best]


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of one matrix, shorter ones padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, dtype=np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _width(*tables: pa.Table) -> int:
    return max((int(np.diff(chunk.offsets.to_numpy()).max()) for t in tables for chunk in t["vector"].chunks if len(chunk)), default=0)


def _scored(anchors: pa.Table, candidates: pa.Table, see: Callable[[int, np.ndarray, slice], None]) -> None:
    """see(anchor, its scores, which candidates) for every tile of a block of anchors and a block of candidates."""
    width = _width(anchors, candidates)
    left, right = _matrix(anchors["vector"], width), _matrix(candidates["vector"], width)
    for at in range(0, len(right), TILE):
        here = slice(at, min(at + TILE, len(right)))
        tile = strassen(left, np.ascontiguousarray(right[here].T))
        for one in range(len(left)):
            see(one, tile[one], here)


def _positives(k: int):
    def best(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        rows, ids, labels = (candidates[c].to_numpy() for c in ("row", "id", "label"))
        own, label = anchors["row"].to_numpy(), anchors["label"].to_numpy()
        heaps = [Heap(k) for _ in own]

        def see(one: int, scores: np.ndarray, here: slice) -> None:
            like = np.flatnonzero((labels[here] == label[one]) & (rows[here] != own[one]))
            heaps[one].add(scores[like], ids[here][like], rows[here][like])

        _scored(anchors, candidates, see)
        return _table(own, heaps, {"anchor": np.repeat(own, [len(h.score) for h in heaps])})

    return best


def _windows(k: int, low: int, high: int):
    def best(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        rows, ids, labels = (candidates[c].to_numpy() for c in ("row", "id", "label"))
        own, label = anchors["row"].to_numpy(), anchors["label"].to_numpy()
        wanted = [np.array(x, dtype=np.int64) for x in anchors["wanted"].to_pylist()]
        heaps = [[Heap(k) for _ in x] for x in wanted]

        def see(one: int, scores: np.ndarray, here: slice) -> None:
            if not len(wanted[one]):
                return
            hundred = 100 * scores
            other = np.flatnonzero((labels[here] != label[one]) & (hundred >= low * wanted[one].min()) & (hundred <= high * wanted[one].max()))
            if len(other):
                for heap, positive in zip(heaps[one], wanted[one], strict=True):
                    fits = other[(hundred[other] >= low * positive) & (hundred[other] <= high * positive)]
                    heap.add(scores[fits], ids[here][fits], rows[here][fits])

        _scored(anchors, candidates, see)
        flat = [h for one in heaps for h in one]
        at = [(own[i], p) for i, one in enumerate(heaps) for p, h in enumerate(one) for _ in h.score]
        anchor, nth = np.array(at, dtype=np.int64).reshape(len(at), 2).T
        return _table(own, flat, {"anchor": anchor, "nth": nth})

    return best


def _table(own: np.ndarray, heaps: list[Heap], first: dict[str, np.ndarray]) -> pa.Table:
    """The entries of heaps, an id that stands for none as null."""
    joined = lambda name: np.concatenate([getattr(h, name) for h in heaps] or [np.zeros(0, dtype=np.int64)])
    ids = joined("id")
    return pa.table({**{k: pa.array(v, pa.int64()) for k, v in first.items()}, "id": pa.array(ids, pa.int64(), mask=ids == NO_ID), "row": pa.array(joined("row"), pa.int64()), "score": pa.array(joined("score"), pa.int64())})


#: Orders a row without an id behind all others.
NO_ID = (1 << 63) - 1


def _merged(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The best k entries of each anchor's heaps, with rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(vectors: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """row, id, label, vector (floor of 256 times each component) of the rows that take part.

    Rows with a null label, a null vector or a component that is null, NaN or infinite take no part. Rows that repeat
    are rows of their own; a row without an id is kept and ordered behind the others. A component beyond 2^31 raises,
    since scores could leave 64 bits.
    """
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    parts = F.transform(vector, lambda x: F.floor(256 * x.cast("double")))
    fits = F.forall(vector, lambda x: F.abs(256 * x.cast("double")) < float(1 << 31))
    own = vectors.select(F.col(key).cast("long").alias("id"), label.cast("int").alias("label"), F.col(vector).alias("_v"), odd.alias("_odd"), parts.alias("_parts"), fits.alias("_fits"))
    own = own.where("label is not null and _v is not null and not _odd")
    whole = F.when(F.col("_fits"), F.col("_parts")).otherwise(F.raise_error(F.lit("a component is too large for scores of 64 bits")).cast("array<bigint>"))
    return own.select(F.monotonically_increasing_id().alias("row"), "id", "label", whole.alias("vector"))


def mine(vectors: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of the anchors.

    An anchor's positives are the other rows of its label with the highest scores (ties: smaller id). For each of
    them the negatives are the rows of other labels with the highest scores from low to high percent of the
    positive's. A score is the inner product of the vectors; of vectors of different length the shorter is filled up
    with zeros. anchor is a condition on id. See usable() for nulls and repeats; an empty table, or one without
    anchors, gives no rows. Other columns, whatever their names, are ignored.

    Anchors and candidates are dealt into blocks of bounded size, and every pair of blocks is one group, keyed by
    both. In it, tile by tile, scores go through heaps that keep the best; of each block only its heaps leave the
    task, and these are merged. A first pass finds positives, a second the windows that they open.
    """
    rows = written(usable(vectors, key, vector, F.col("label") if label is None else label), "vectors")
    chosen = rows.where(anchor)
    n, n_anchors = rows.count(), chosen.count()
    if not n_anchors:
        return _no_negatives(rows.sparkSession)
    a_blocks = -(-n_anchors // ANCHOR_BLOCK)
    # The fewer blocks, the fewer heaps are merged; but there should be groups for all partitions.
    groups = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c_blocks = max(-(-n // CANDIDATE_BLOCK), min(-(-n // LEAST_BLOCK), -(-groups // a_blocks)))
    # Round robin deals blocks evenly; once written, a block stays what it is.
    anchors = written(chosen.repartition(a_blocks).withColumn("a", F.spark_partition_id()), "anchors")
    candidates = written(rows.repartition(c_blocks).withColumn("c", F.spark_partition_id()), "candidates")
    n_a, n_c = (df.agg(F.max(c)).first()[0] for df, c in ((anchors, "a"), (candidates, "c")))
    filled = F.coalesce("id", F.lit(NO_ID)).alias("id")
    right = candidates.select("row", filled, "label", "vector", "c", F.explode(F.sequence(F.lit(0), F.lit(n_a))).alias("a"))

    def passed(left: DataFrame, function, schema: str) -> DataFrame:
        left = left.select("row", filled, "label", "vector", *(["wanted"] if "wanted" in left.columns else []), "a", F.explode(F.sequence(F.lit(0), F.lit(n_c))).alias("c"))
        return left.groupBy("a", "c").cogroup(right.groupBy("a", "c")).applyInArrow(function, schema)

    near = _merged(passed(anchors, _positives(positives), "anchor long, id long, row long, score long"), ["anchor"], positives)
    near = written(near.select("anchor", (F.col("rank") - 1).cast("long").alias("nth"), "id", "score"), "positives")
    per = near.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "score"))), lambda x: x["score"]).alias("wanted"))
    asking = anchors.join(per, anchors["row"] == per["anchor"]).select("row", "id", "label", "vector", "a", "wanted")
    far = _merged(passed(asking, _windows(negatives, low, high), "anchor long, nth long, id long, row long, score long"), ["anchor", "nth"], negatives)
    far = far.select("anchor", "nth", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    out = far.join(near.select("anchor", "nth", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor", "nth"]).join(named, "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _no_negatives(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns: anchors are the rows whose vec_id is divisible by 100; see mine()."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0, label=moved)


SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS alike, c.vec_id, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i]))::BIGINT AS score
  FROM e a JOIN e c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""

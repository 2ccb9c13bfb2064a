"""Sharding by a keyed permutation of global row numbers: a reproducible shuffle whose places can be computed."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.functions.ordering import numbered
from seqweave.functions.shared import cut, written
from seqweave.llm.checksums import REMAINDERS, crc32

SHARDS = 40
ROUNDS = 6
#: Bytes that a row takes beside its text.
OVERHEAD = 16


def _side(n: int) -> int:
    return isqrt(n - 1) + 1 if n > 0 else 0


def _pass(at: Column, side: int, seed: int, back: bool) -> Column:
    """One Feistel pass over the numbers below side * side.

    The two digits of a number to the base side are its halves. A round adds to one half a keyed function of the
    other: the first 60 bits of an MD5 over seed, round and half, modulo side.
    """

    def mixed(half: Column, nth: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), nth.cast("string"), half.cast("string")).cast("binary"))
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % side

    def split(x: Column) -> Column:
        right = x["left"] % side
        return F.struct(((x["left"] - right) / side).cast("long").alias("left"), right.alias("right"))

    def forth(x: Column, nth: Column) -> Column:
        return F.struct(x["right"].alias("left"), ((x["left"] + mixed(x["right"], nth)) % side).alias("right"))

    def undone(x: Column, nth: Column) -> Column:
        return F.struct(((x["right"] - mixed(x["left"], nth) + side) % side).alias("left"), x["left"].alias("right"))

    # The number itself stands once in the expression; step -1 takes it apart.
    whole = F.struct(at.cast("long").alias("left"), F.lit(0).cast("long").alias("right"))
    steps = F.array(F.lit(-1), *map(F.lit, reversed(range(ROUNDS)) if back else range(ROUNDS)))
    step = undone if back else forth
    return F.aggregate(steps, whole, lambda x, nth: F.when(nth < 0, split(x)).otherwise(step(x, nth)), lambda x: x["left"] * side + x["right"])


def longest_walk(spark: SparkSession, n: int, seed: int) -> int:
    """How many passes beyond the first the permutation of n numbers may need: the longest chain of numbers outside.

    The square that the passes permute has at most 2 * sqrt(n) + 1 numbers outside 0..n-1. Those that a number inside
    is sent to are followed until none is left outside; each comes back, since a permutation runs in cycles. (Cycles
    that lie outside altogether are never entered.) The inverse walks the same chains backwards.
    """
    side, steps, at = _side(n), 0, F.col("at")
    outside = cut(spark.range(n, side * side).select(F.col("id").alias("at"), _pass(F.col("id"), side, seed, True).alias("from")).where(F.col("from") < n).select("at"))
    while not outside.isEmpty():
        steps += 1
        outside = cut(outside.select(_pass(at, side, seed, False).alias("at")).where(at >= n))
    return steps


def permuted(at: Column, n: int, walk: int, seed: int = 0, back: bool = False) -> Column:
    """The image of a number of 0..n-1 under a keyed permutation of them; back gives the inverse.

    A Feistel network permutes the smallest square with n places or more; an image outside 0..n-1 is put through it
    again (cycle walking), as often as the longest chain of numbers outside needs (walk), so every number ends inside.
    """
    side = _side(n)
    first = _pass(at, side, seed, back)
    return F.aggregate(F.sequence(F.lit(1), F.lit(walk)), first, lambda x, _: F.when(x >= n, _pass(x, side, seed, back)).otherwise(x)) if walk else first


def sharded(rows: DataFrame, n: int, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """rows (row: 0..n-1) with shard and slot: place p of the permutation is slot p div shards of shard p mod shards.

    Shards differ by one row at most and their slots are gapless. Both follow from row, n, shards and seed alone, and
    rows_at() goes the other way, so a reader finds any place without an index.
    """
    if shards <= 0:
        raise ValueError("there must be a shard")
    if not n:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    place = F.col("_place")
    placed = rows.withColumn("_place", permuted(F.col("row"), n, longest_walk(rows.sparkSession, n, seed), seed))
    return placed.withColumns({"shard": (place % shards).cast("int"), "slot": ((place - place % shards) / shards).cast("long")}).drop("_place")


def rows_at(places: DataFrame, n: int, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """places (shard, slot) with row: the number of the row that stands there."""
    return places.withColumn("row", permuted(F.col("slot") * shards + F.col("shard"), n, longest_walk(places.sparkSession, n, seed), seed, back=True))


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, row, shard, slot of every document.

    Rows are numbered by doc_id, then checksum and size of the text; a null doc_id comes first. Rows equal in all of
    these are numbered in any order: their results differ only in place. The method deals single rows, so equal texts
    lie in whatever shards their numbers give. A null text has no bytes, as an empty one; a very long one costs its
    checksum. An empty table gives no rows. Other columns, whatever their names, are ignored.
    """
    data = F.col("text").cast("binary")
    thin = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.coalesce(F.crc32(data), F.lit(0)).alias("text_crc32"))
    # Once written the texts are read no more: finding the ranges to number by would read them all a second time.
    rows = numbered(written(thin, "shard-thin"), ["doc_id", "text_crc32", "size"], "shard-rows")
    return sharded(rows, rows.count(), shards, seed)


def op12_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of documents, under the law of rows; see shard_documents."""
    found = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _sql() -> str:
    """The same permutation as a recursive query: a row's rounds, and again while it is outside."""

    def rounds(source: str, at: str) -> str:
        source = f"(SELECT *, {at} // side AS l0, {at} % side AS r0 FROM {source})"
        for k in range(ROUNDS):
            source = f"(SELECT *, r{k} AS l{k + 1}, (l{k} + ('0x' || substr(md5('0:{k}:' || r{k}), 1, 15))::BIGINT % side) % side AS r{k + 1} FROM {source})"
        return source

    kept, place = "doc_id, size, text_crc32, n, side", f"l{ROUNDS} * side + r{ROUNDS} AS place"
    return f"""
WITH RECURSIVE {REMAINDERS},
d AS (SELECT doc_id, coalesce(strlen(text), 0) + {OVERHEAD} AS size, {crc32("coalesce(text, '')")} AS text_crc32 FROM documents, bits),
o AS (SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row, count(*) OVER () AS n, ceil(sqrt(count(*) OVER ()))::BIGINT AS side FROM d),
w AS (SELECT {kept}, {place} FROM {rounds("o", "row")}
  UNION ALL SELECT {kept}, {place} FROM {rounds("(SELECT * FROM w WHERE place >= n)", "place")})
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (place % {SHARDS})::INT AS shard, (place // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard FROM w WHERE place < n
"""


SQL = _sql()

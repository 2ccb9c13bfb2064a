"""Document fingerprints: weighted SimHash, and block tables that find all fingerprints within a radius."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqweave.functions.ordering import LEAST, bucket_of
from seqweave.functions.shared import written

SPACE = "[\\x00-\\x20]+"
SEEDS = (11, 23)
BITS = 64 * len(SEEDS)
LANES = 0x0000000100000001


def term_weight(word: Column) -> Column:
    """Weight of a word: its length less three, at least 1; long words say more than the short ones that every text
    has. Never more than its length, so a text's total stays below 2^31, and no 32-bit vote lane can overflow."""
    return F.when(F.coalesce(F.length(word), F.lit(0)) > 0, F.greatest(F.length(word) - 3, F.lit(1))).otherwise(0).cast("long")


def vote_sums(word: str = "word") -> list[Column]:
    """Aggregates of the votes: of each hash bit the weight of the words that set it, two bits to a long, and the total."""
    out = [F.sum(term_weight(F.col(word))).alias("total")]
    for k, seed in enumerate(SEEDS):
        for i in range(32):
            out.append(F.expr(f"sum(weight * (shiftrightunsigned(xxhash64({word}, {seed}), {i}) & {LANES}L))").alias(f"v{k}_{i}"))
    return out


def decided(k: int) -> Column:
    """64 bits of the fingerprint: set where the weight of the words that set the bit exceeds half of the total."""
    out = F.lit(0).cast("long")
    for i in range(32):
        low, high = F.expr(f"v{k}_{i} & 4294967295L"), F.expr(f"shiftrightunsigned(v{k}_{i}, 32)")
        for half, at in ((low, i), (high, i + 32)):
            bit = 1 << at
            out = out.bitwiseOR(F.when(half * 2 > F.col("total"), F.lit(bit - (1 << 64) if at == 63 else bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def likeness(a: str, b: str) -> Column:
    """Share of equal bits of two fingerprints, 0 to 1."""
    apart = F.lit(0)
    for k in range(len(SEEDS)):
        apart = apart + F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}")))
    return 1.0 - apart / float(BITS)


def as_hex(name: str) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(f"{name}{k}")), 16, "0") for k in range(len(SEEDS))))


def dealt_by_range(keyed: DataFrame, buckets: int) -> DataFrame:
    """keyed (_k, _h) with bucket: ranges of (_k, _h) of about equal size, numbered in order.

    Where one _k fills several ranges (a quantile that repeats), its rows are cut into as many by _h.
    """
    found = [int(x) for x in sorted(keyed.approxQuantile("_k", [i / buckets for i in range(1, buckets)], 1 / (4 * buckets)))] if buckets > 1 else []
    bounds = sorted(set(found))
    parts = [1, *(found.count(v) for v in bounds)]  # ranges of the rows from each bound on
    firsts = F.array(*(F.lit(sum(parts[:i])) for i in range(len(parts))))
    at = bucket_of(F.col("_k"), bounds)
    size, here = F.get(F.array(*map(F.lit, parts)), at), F.get(F.array(*map(F.lit, [LEAST, *bounds])), at)
    share = (F.col("_h").cast("double") + 2.0**63) / 2.0**64
    cut = F.when(F.col("_k") == here, F.least(F.floor(share * size).cast("int"), size - 1)).otherwise(size - 1)
    return keyed.withColumn("bucket", F.get(firsts, at) + cut)


def with_successor(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, guest, rn, doc_id, text, next_text): every document with the text of the next in doc_id order.

    Rows are dealt into ranges of doc_id; each range also gets the first document of the next one as a guest (the
    last range that of the first), so one exchange and no single task orders the whole table. A null doc_id comes
    first; rows of one doc_id are ordered by a hash of the text, then the text, and dealt into several ranges if they
    are many (only rows equal in both stay together). Guests must be dropped at the end.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.select("doc_id", "text", F.coalesce("doc_id", F.lit(LEAST)).alias("_k"), F.xxhash64("text").alias("_h"))
    dealt = dealt_by_range(keyed, buckets)
    firsts = sorted((r["bucket"], r["first"]) for r in dealt.groupBy("bucket").agg(F.min(F.struct("_k", "_h")).alias("first")).collect())
    hosts = [(*firsts[(i + 1) % len(firsts)][1], b) for i, (b, _) in enumerate(firsts)]
    guests = dealt.drop("bucket").join(F.broadcast(spark.createDataFrame(hosts, "_k long, _h long, bucket int")), ["_k", "_h"])
    guests = guests.groupBy("bucket").agg(F.min(F.struct("text", "doc_id", "_k", "_h")).alias("first")).select("bucket", "first.*").withColumn("guest", F.lit(1))
    every = dealt.withColumn("guest", F.lit(0)).unionByName(guests)
    along = Window.partitionBy("bucket").orderBy("guest", "_k", "_h", "text")
    return every.select("bucket", "guest", F.row_number().over(along).alias("rn"), "doc_id", "text", F.lead("text").over(along).alias("next_text"))


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, f0.., e0.. (fingerprint words of the text and of the edited text), near_edited, near_next.

    The edited text is the text whose last half (rounded down, in code points) is replaced by as much of the next
    document's beginning, or all of it if that is shorter. A word votes with its weight for the set bits of its hash
    and against the others, once for every time it occurs; words are what stands between ASCII white space and
    control characters. Null text is empty; an empty text has the zero fingerprint. A table of one row is its own
    next. Repeated rows are fingerprinted each; ties are ordered as in with_successor. No rows: no rows. Extra columns
    are ignored. A very long text is cut into words inside its task, and the votes are combined there.

    The votes are summed in the partitions that the ordering has already made: the texts are exchanged once.
    """
    spark = docs.sparkSession
    shape = "doc_id long, n_chars long, edited_sha256 string, f0 long, f1 long, e0 long, e1 long, near_edited double, near_next double"
    docs = docs.select("doc_id", "text")
    if docs.isEmpty():
        return spark.createDataFrame([], shape)
    rows = with_successor(docs, buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = rows.select("bucket", "guest", "rn", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    key = ["bucket", "guest", "rn", "doc_id", "n_chars", "edited_sha256"]
    both = rows.select(*key, F.inline(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body")))))
    words = both.select(*key, "kind", F.explode_outer(F.split("body", SPACE)).alias("word")).withColumn("weight", term_weight(F.col("word")))
    votes = words.groupBy(*key, "kind").agg(*vote_sums())
    prints = votes.select(*key, "kind", *(decided(k).alias(f"p{k}") for k in range(len(SEEDS))))
    wide = prints.groupBy(*key).agg(*(F.max(F.when(F.col("kind") == kind, F.col(f"p{k}"))).alias(f"{name}{k}") for kind, name in ((0, "f"), (1, "e")) for k in range(len(SEEDS))))
    along = Window.partitionBy("bucket").orderBy("rn")
    wide = wide.select("*", *(F.lead(f"f{k}").over(along).alias(f"n{k}") for k in range(len(SEEDS))))
    return wide.where("guest = 0").select("doc_id", "n_chars", "edited_sha256", "f0", "f1", "e0", "e1", likeness("f", "e").alias("near_edited"), likeness("f", "n").alias("near_next"))


def block_tables(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """prints (f0, f1, ..) with a row for each table: key is the bits of the blocks that the table's permutation puts
    first. Two fingerprints within the radius agree on blocks - radius blocks, and so share a key in some table."""
    size = BITS // blocks
    parts = []
    for b in range(blocks):
        k, at = divmod(b * size, 64)
        parts.append(F.expr(f"shiftrightunsigned(f{k}, {at}) & {(1 << size) - 1}L"))
    keys = [F.xxhash64(F.lit(t), *(parts[b] for b in chosen)) for t, chosen in enumerate(combinations(range(blocks), blocks - radius))]
    return prints.withColumn("key", F.explode(F.array(*keys)))


def search(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 4) -> DataFrame:
    """f0, f1, n_near: for every distinct query fingerprint the documents of prints within the radius of it.

    queries and prints: f0, f1 (repeats allowed). Equal fingerprints collapse to a count first; the block tables then
    give every pair that can be within the radius, and the exact distance decides.
    """
    distinct = prints.groupBy("f0", "f1").agg(F.count("*").alias("documents"))
    right = block_tables(distinct, radius, blocks).select("key", F.col("f0").alias("g0"), F.col("f1").alias("g1"), "documents")
    left = block_tables(queries.select("f0", "f1").distinct(), radius, blocks)
    apart = F.bit_count(F.col("f0").bitwiseXOR(F.col("g0"))) + F.bit_count(F.col("f1").bitwiseXOR(F.col("g1")))
    pairs = left.join(right, "key").where(apart <= radius).select("f0", "f1", "g0", "g1", "documents").distinct()
    return pairs.groupBy("f0", "f1").agg(F.sum("documents").alias("n_near"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_near for the query set (doc_id divisible by 100): documents within 3 bits, itself included."""
    prints = written(fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")), "document-fingerprints")
    asked = prints.where("doc_id % 100 = 0")
    found = search(asked, prints).select(F.col("f0").alias("q0"), F.col("f1").alias("q1"), "n_near")
    near = asked.join(found, (F.col("f0") == F.col("q0")) & (F.col("f1") == F.col("q1")), "left").drop("q0", "q1")
    rest = prints.where("doc_id % 100 <> 0 or doc_id is null").withColumn("n_near", F.lit(None).cast("long"))
    return near.unionByName(rest).select("doc_id", "n_chars", "edited_sha256", as_hex("f").alias("fingerprint"), as_hex("e").alias("edited_fingerprint"), "near_edited", "near_next", "n_near")

"""Merkle manifest of a dataset: a hash tree for each language, a tree over their roots, and proofs climbed by a recursive query.

Every group of leaves has a binary tree: two consecutive nodes become the hash of both, a last one alone the hash of
itself, until one is left. What is left of each group, in order of the groups, is hashed likewise to one root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.functions.ordering import numbered
from seqweave.functions.shared import shared_folder, written
from seqweave.llm.checksums import REMAINDERS, crc32
from seqweave.operators.rank import group_join

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels between the stored ones: a stored node links to its ancestor so many levels up and keeps the siblings between.
STRIDE = 10


@dataclass(frozen=True)
class Manifest:
    """A manifest stored in a folder, as three tables.

    leaves: tree, ix, doc_id, hash, claim, path, and the ancestor parent_ix, parent, parent_n that path leads to.
    nodes: tree, chunk, hop, ix, path: the stored levels above, a row for each chunk of leaves below.
    roots: tree, lang, n, subroot. root is the hash of the whole, null of an empty table; hops counts the stored levels
    above the leaves.
    """

    folder: str
    root: str | None
    hops: int

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{name}")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(**changed: Column) -> Column:
    """The hash of a row's values, each as its length in bytes, a colon and the value, or a hyphen for a null."""
    values = (changed.get(c, F.col(c)).cast("string") for c in FIELDS)
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)))


def _up(level: Column) -> Column:
    """The parents of a block's nodes: every two of them hashed together, a last one alone."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: digest(F.concat(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.lit("")))))


def build_level(nodes: DataFrame, stride: int) -> DataFrame:
    """nodes (tree, n, ix, hash, more: struct) with parent_ix, parent, parent_n and path; n: nodes of the tree at this level.

    Blocks of 2 ** stride consecutive nodes are folded in one array each, so far up as the tree goes. parent is the
    ancestor that this leads to; path holds the sibling at each step, null where a node is alone.
    """
    blocks = nodes.groupBy("tree", "n", F.shiftright("ix", stride).alias("parent_ix")).agg(F.array_sort(F.collect_list(F.struct("ix", "hash", "more"))).alias("own"))
    whole = F.col("n") > 1 << stride
    blocks = blocks.withColumn("height", F.when(whole, stride).when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)).withColumn("level0", F.col("own.hash"))
    for k in range(stride):
        blocks = blocks.withColumn(f"level{k + 1}", F.when(F.col("height") > k, _up(F.col(f"level{k}"))).otherwise(F.array().cast("array<string>")))
    blocks = blocks.select("tree", "n", "parent_ix", "own", "height", F.array(*(F.col(f"level{k}") for k in range(stride + 1))).alias("levels"))

    def sibling(place: Column, k: Column) -> Column:
        return F.unhex(F.get(F.get("levels", k), F.call_function("shiftright", place, k).bitwiseXOR(F.lit(1))))

    steps = F.when(F.col("height") > 0, F.sequence(F.lit(0), F.col("height") - 1)).otherwise(F.array().cast("array<int>"))
    paths = F.transform("own", lambda x, place: F.struct(x["ix"].alias("ix"), x["hash"].alias("hash"), x["more"].alias("more"), F.transform(steps, lambda k: sibling(place, k)).alias("path")))
    parent = F.get(F.get("levels", F.col("height")), F.lit(0))
    above = F.when(whole, F.ceil(F.col("n") / (1 << stride)).cast("long")).otherwise(F.lit(1).cast("long"))
    return blocks.select("tree", "parent_ix", parent.alias("parent"), above.alias("parent_n"), F.explode(paths).alias("x")).select("tree", "parent_ix", "parent", "parent_n", "x.*")


def parents(level: DataFrame) -> DataFrame:
    """tree, n, ix, hash, more: the ancestors that a stored level links to."""
    once = level.groupBy("tree", "parent_ix").agg(F.first("parent").alias("hash"), F.first("parent_n").alias("n"))
    return written(once.select("tree", "n", F.col("parent_ix").alias("ix"), "hash", F.struct(F.lit(None).cast("long").alias("none")).alias("more")), "merkle-parents")


def build(docs: DataFrame, claim: Column | None = None, stride: int = STRIDE) -> Manifest:
    """The manifest of docs; claim is the hash that a row will be held to have (where null or not given, its own leaf).

    Leaves are ordered by lang (null first, then by UTF-8 bytes), doc_id (null first) and hash; rows that repeat are
    leaves of their own. They are numbered over ranges, so a language may hold any share of the rows, and a block
    of 2 ** stride leaves is the most that one task folds at once. A null or empty text, or a very long one, is a leaf
    like any other. Columns beside FIELDS are ignored. An empty table has no leaves and no root.
    """
    spark, folder, block = docs.sparkSession, shared_folder(docs.sparkSession, "merkle"), 1 << stride
    thin = docs.select("doc_id", "lang", leaf().alias("hash"), (F.lit(None) if claim is None else claim).cast("string").alias("claim"))
    # Once written the texts are read no more: finding the ranges to number by would hash them all a second time.
    rows = numbered(written(thin, "merkle-thin"), ["lang", "doc_id", "hash"], "merkle-rows")
    groups = rows.groupBy("lang").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    groups = numbered(groups, ["lang"], "merkle-groups").withColumnRenamed("row", "tree")
    more = F.struct("doc_id", F.unhex(F.coalesce("claim", "hash")).alias("claim"))
    nodes = group_join(rows, groups, ["lang"], how="inner").select("tree", "n", (F.col("row") - F.col("first")).alias("ix"), "hash", more.alias("more"))
    build_level(nodes, stride).select("tree", "ix", "more.doc_id", "hash", "more.claim", "path", "parent_ix", "parent", "parent_n").write.parquet(f"{folder}/leaves")
    most, trees = groups.agg(F.max("n"), F.count("*")).first()

    def climbed(nodes: DataFrame, n: int) -> tuple[list[DataFrame], DataFrame]:
        """The stored levels from nodes up, and the roots; every tree goes through as many as the largest needs."""
        stored = []
        while n > 1:
            stored.append(written(build_level(nodes, stride), "merkle-level"))
            nodes, n = parents(stored[-1]), -(-n // block)
        return stored, nodes

    chunks = parents(spark.read.parquet(f"{folder}/leaves"))
    below, subroots = climbed(chunks, -(-(most or 0) // block))
    above, top = climbed(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), F.col("tree").alias("ix"), "hash", "more"), trees)
    stored = chunks.select("tree", F.col("ix").alias("chunk"), F.lit(0).alias("hop"), "ix", F.array().cast("array<binary>").alias("path")).limit(0)
    for hop, level in enumerate([*below, *above]):
        # Of its own tree the node above its chunk; in the tree of roots the node above its tree.
        inside = hop < len(below)
        at = F.shiftright("ix", stride * hop) if inside else F.shiftright("tree", stride * (hop - len(below)))
        keys = ["tree", "at"] if inside else ["at"]
        own = chunks.select("tree", F.col("ix").alias("chunk"), at.alias("at"))
        found = own.join(level.withColumn("at", F.col("ix")).select(*keys, "path"), keys)
        stored = stored.unionByName(found.select("tree", "chunk", F.lit(hop).alias("hop"), F.col("at").alias("ix"), "path"))
    stored.write.parquet(f"{folder}/nodes")
    groups.join(subroots.select(F.col("ix").alias("_ix"), F.col("tree").alias("tree"), F.col("hash").alias("subroot")), "tree").select("tree", "lang", "n", "subroot").write.parquet(f"{folder}/roots")
    root = top.select("hash").first()
    return Manifest(folder, root["hash"] if root else None, len(below) + len(above))


def _folded(path: str, ix: str, start: str) -> str:
    """SQL of the hash that start leads to along a path: a node with an odd number has its sibling at the left."""
    steps = f"transform({path}, (s, k) -> struct(lower(hex(s)) AS sibling, shiftright({ix}, k) % 2 = 1 AS odd))"
    return f"aggregate({steps}, {start}, (h, s) -> sha2(CAST(CASE WHEN s.sibling IS NULL THEN h WHEN s.odd THEN concat(s.sibling, h) ELSE concat(h, s.sibling) END AS BINARY), 256))"


def _digests(path: str) -> str:
    """SQL of a path's siblings one after another; where a node was alone there is none."""
    return f"unhex(array_join(transform({path}, s -> hex(s)), ''))"


def climb(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """doc_id, tree, hash, folded, siblings (their digests in hex, one after another): every leaf's way up to the root.

    A recursive query starts at every leaf's stored row. In each round it joins the stored node that the leaf has come
    to, folds that node's path into the leaf's claim and appends its siblings. A node that stands above many leaves
    is stored once for each chunk of them, so no key of the join has more rows than a chunk. The query runs in a
    session of its own, which sets Spark's limits of recursion: as many rounds as there are stored levels, any number
    of rows.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    own.conf.set("spark.sql.cteRecursionLevelLimit", str(manifest.hops + 2))
    leaves, nodes = manifest.table(own, "leaves"), manifest.table(own, "nodes")
    ways = own.sql(
        f"""
        WITH RECURSIVE climb (doc_id, tree, hash, chunk, hop, folded, siblings) AS (
          SELECT doc_id, tree, unhex(hash), parent_ix, 0, {_folded("path", "ix", "lower(hex(claim))")}, {_digests("path")} FROM {{leaves}}
          UNION ALL
          SELECT c.doc_id, c.tree, c.hash, c.chunk, c.hop + 1, {_folded("n.path", "n.ix", "c.folded")}, concat(c.siblings, {_digests("n.path")})
          FROM climb c JOIN {{nodes}} n ON n.tree = c.tree AND n.chunk = c.chunk AND n.hop = c.hop)
        SELECT doc_id, tree, lower(hex(hash)) AS hash, folded, lower(hex(siblings)) AS siblings FROM climb WHERE hop = {manifest.hops}""",
        leaves=leaves,
        nodes=nodes,
    )
    path = shared_folder(spark, "merkle-ways")
    ways.write.parquet(path)
    return spark.read.schema(ways.schema).parquet(path)


def verify(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every leaf: does its claim lead to the root?

    proof_sha256 is the hash of the siblings on its way, in hex, one after another.
    """
    roots = manifest.table(spark, "roots").select("tree", "subroot")
    found = climb(spark, manifest).join(roots, "tree")
    root = F.lit(manifest.root).cast("string")
    return found.select("doc_id", F.col("hash").alias("leaf"), "subroot", root.alias("root"), digest(F.col("siblings")).alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of documents. Where 7 divides the checksum of the decimal doc_id the row
    claims the leaf of n_chars + 1; a null n_chars (or doc_id) claims its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    altered = leaf(n_chars=F.try_add("n_chars", F.lit(1)))
    return verify(spark, build(docs, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, altered)))


def _sql() -> str:
    def field(name: str, value: str) -> str:
        return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}, '-')"

    plain = " || ".join(field(c, c) for c in FIELDS)
    other = " || ".join(field(c, "(n_chars + 1)" if c == "n_chars" else c) for c in FIELDS)
    rise = """SELECT {0}, level + 1, ix // 2, sha256(string_agg(hash, '' ORDER BY ix)), (n + 1) // 2 FROM {1} WHERE n > 1 GROUP BY {0}, level, ix // 2, n"""
    hashed = "sha256(CASE WHEN s.hash IS NULL THEN c.h WHEN c.ix % 2 = 1 THEN s.hash || c.h ELSE c.h || s.hash END)"
    return f"""
WITH RECURSIVE {REMAINDERS},
d AS (SELECT doc_id, lang, sha256({plain}) AS leaf, CASE WHEN {crc32("doc_id::VARCHAR")} % 7 = 0 THEN sha256({other}) END AS altered FROM documents, bits),
l AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS ix, count(*) OVER (PARTITION BY lang) AS n FROM d),
t AS (SELECT tree, 0 AS level, ix, leaf AS hash, n FROM l UNION ALL {rise.format("tree", "t")}),
r AS (SELECT 0 AS level, tree AS ix, hash, count(*) OVER () AS n FROM t WHERE n = 1 UNION ALL SELECT level + 1, ix // 2, sha256(string_agg(hash, '' ORDER BY ix)), (n + 1) // 2 FROM r WHERE n > 1 GROUP BY level, ix // 2, n),
c AS (SELECT doc_id, leaf, tree, 0 AS level, ix, n, coalesce(altered, leaf) AS h, '' AS siblings FROM l
  UNION ALL SELECT c.doc_id, c.leaf, c.tree, c.level + 1, c.ix // 2, (c.n + 1) // 2, {hashed}, c.siblings || coalesce(s.hash, '') FROM c LEFT JOIN t s ON s.tree = c.tree AND s.level = c.level AND s.ix = xor(c.ix, 1) WHERE c.n > 1),
u AS (SELECT doc_id, leaf, tree, 0 AS level, tree AS ix, (SELECT count(DISTINCT tree) FROM l) AS n, h, siblings FROM c WHERE n = 1
  UNION ALL SELECT c.doc_id, c.leaf, c.tree, c.level + 1, c.ix // 2, (c.n + 1) // 2, {hashed}, c.siblings || coalesce(s.hash, '') FROM u c LEFT JOIN r s ON s.level = c.level AND s.ix = xor(c.ix, 1) WHERE c.n > 1)
SELECT doc_id, leaf, t.hash AS subroot, r.hash AS root, sha256(siblings) AS proof_sha256, h AS folded_root, h = r.hash AS verified
FROM u JOIN t ON t.tree = u.tree AND t.n = 1 JOIN r ON r.n = 1 WHERE u.n = 1
"""


SQL = _sql()

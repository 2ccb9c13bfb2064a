"""SimHash near-duplicates found through pivot distance tables.

Every fingerprint x is described by its Hamming distances to many reference fingerprints (pivots). The pivots come in
families: those of one family differ from the base pivot only inside one block of bits, so the differences of their
distances depend on that block of x alone. If two fingerprints differ in at most ``radius`` bits, at least
``blocks - radius`` blocks agree, and with them all coordinates of those families. A pivot distance table holds the
fingerprints keyed by the coordinates of ``kept`` families, one table per choice of families, and so every pair within
the radius meets in a table. Within a key, a pair whose coordinates on spread pivots differ by more than the radius is
discarded (a Hamming distance obeys the triangle inequality), and the exact distance verifies what survives.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.functions.shared import written
from seqweave.llm.columns import carried, unpacked
from seqweave.llm.components import connected_components

#: Distinct fingerprints of one key that one task handles at once; larger keys are dealt out as pairs of chunks.
RUN_CAP = 8192
#: Keys of up to so many fingerprints are compared pair by pair, many keys at once; larger ones hub by hub.
SMALL = 12
FULL = (1 << 64) - 1
#: Near duplicates: fingerprints of samples of shingles, and shingles in each (the majority of five is spelled out).
SAMPLES, DRAWN = 24, 5
#: Texts of one loosely linked group that are compared by their shingles at once; larger groups are dealt out in chunks.
SET_CAP = 512
#: Texts of a larger group that each of its chunks has besides its own.
HUBS = 8
_ORDERS = np.random.default_rng(11).integers(0, FULL, size=(2, SAMPLES * DRAWN), dtype=np.uint64) | np.array([[0], [1]], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the unsigned 64-bit hashes; no hashes: zero."""
    n = len(hashes)
    if not n:
        return 0
    votes = np.zeros(2048, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        octets = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.bincount((octets + _LANES).ravel(), minlength=2048)
    bits = (votes.reshape(8, 256) @ _BITS) * 2 > n
    return int.from_bytes(np.packbits(bits.ravel(), bitorder="little").tobytes(), "little")


_LANES = (np.arange(8) * 256).astype(np.int64)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _hashed(pieces: list[bytes]) -> np.ndarray:
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(x, 42) for x in pieces), dtype=np.uint64, count=len(pieces))


def text_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; null: none."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of k words, joined by one space; fewer words: of the whole sequence; none: empty."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) <= k:
        return _hashed([b" ".join(words)])
    return _hashed([b" ".join(x) for x in zip(*(words[i:] for i in range(k)), strict=False)])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_fingerprint(k: int):
    """pandas UDF: text to SimHash (long) over its shingles of k words, repeats included."""

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(majority(shingle_hashes(text_words(t), k))) for t in texts], dtype="int64")

    return fingerprint


def sample_names() -> list[str]:
    return [f"m{i}" for i in range(SAMPLES)]


def near_duplicate_fingerprints(k: int):
    """pandas UDF: text to SimHashes over its distinct shingles of k words: s0 and s1 over all of them, m0, m1, ... over samples.

    A sample is DRAWN shingles, each the smallest under an order of its own (a keyed hash), so two texts of Jaccard
    similarity J draw the same sample, and have the same fingerprint of it, with probability J ** DRAWN at least,
    wherever in the text they differ.
    """

    @F.pandas_udf(", ".join(f"{c} long" for c in ("s0", "s1", *sample_names())))
    def fingerprint(texts: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(texts), 2 + SAMPLES), dtype=np.uint64)
        for row, text in zip(out, texts, strict=True):
            hashes = np.unique(shingle_hashes(text_words(text), k))
            row[0], row[1], row[2:] = majority(hashes), majority(_mixed(hashes)), sampled_fingerprints(hashes)
        return pd.DataFrame(out.view(np.int64), columns=["s0", "s1", *sample_names()])

    return fingerprint


def sampled_fingerprints(hashes: np.ndarray) -> np.ndarray:
    """SAMPLES fingerprints: bits set in over half of the DRAWN smallest hashes, each under another order; no hashes: zeros."""
    if not len(hashes):
        return np.zeros(SAMPLES, dtype=np.uint64)
    least = np.full(len(_ORDERS[0]), FULL, dtype=np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, ((hashes[at : at + 2048] ^ _ORDERS[0][:, None]) * _ORDERS[1][:, None]).min(axis=1), out=least)
    a, b, c, d, e = _mixed(least).reshape(DRAWN, SAMPLES)
    one, two = (a & b) | ((a ^ b) & c), ((a ^ b ^ c) & d) | ((a ^ b ^ c ^ d) & e)
    return (one & two) | ((one | two) & (a ^ b ^ c ^ d ^ e))


def shingle_set(k: int):
    """pandas UDF: text to the sorted distinct hashes of its shingles of k words, eight bytes each."""

    @F.pandas_udf("binary")
    def grams(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(text_words(t), k)).astype("<u8").tobytes() for t in texts], dtype=object)

    return grams


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Other 64-bit hashes of the same things: a finaliser of xor-shifts and odd multiplications."""
    x = hashes ^ (hashes >> np.uint64(32))
    x = x * np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(28)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class PivotTables:
    """Pivot families for 64-bit fingerprints: pairs within radius agree on at least ``kept`` of ``blocks`` families."""

    def __init__(self, radius: int = 3, blocks: int = 6, kept: int | None = None, per_block: int = 12, spread: int = 16, seed: int = 7):
        kept = blocks - radius if kept is None else kept
        if not 0 <= radius < blocks or not 0 < kept <= blocks - radius:
            raise ValueError("kept must be between 1 and blocks - radius")
        draw = random.Random(seed)
        self.radius, self.kept = radius, kept
        edges = [64 * i // blocks for i in range(blocks + 1)]
        self.masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
        self.base = draw.getrandbits(64)
        self.families = [[self.base ^ (draw.getrandbits(64) & m) for _ in range(per_block)] for m in self.masks]
        self.spread = np.array([draw.getrandbits(64) for _ in range(spread)], dtype=np.uint64)

    def signatures(self, fp: Column) -> list[Column]:
        """One long per family: the packed differences of its pivots' distances from the base pivot's distance."""

        def distance(pivot: int) -> Column:
            return F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot))))

        base, out = distance(self.base), []
        for mask, pivots in zip(self.masks, self.families, strict=True):
            size = mask.bit_count()
            packed = F.lit(0).cast("long")
            for p in pivots:
                packed = packed * (2 * size + 1) + (distance(p) - base + size)
            out.append(packed)
        return out

    def keyed(self, nodes: DataFrame, fp: str) -> DataFrame:
        """nodes with a row for each table: key (long) stands for the table and the coordinates it is keyed by.

        Rows with different values of a column ``at``, if there is one, are of different fingerprints and never share a key.
        """
        kind = [F.col("at")] if "at" in nodes.columns else []
        signed = nodes.select("*", *(s.alias(f"_s{i}") for i, s in enumerate(self.signatures(F.col(fp)))))
        keys = [F.xxhash64(F.lit(t), *kind, *(F.col(f"_s{i}") for i in chosen)) for t, chosen in enumerate(combinations(range(len(self.masks)), self.kept))]
        return signed.select(F.explode(F.array(*keys)).alias("key"), *nodes.columns)


def _linker(radius: int, spread: np.ndarray, checks: list[str], check_radius: int, cap: int | None):
    """mapInPandas function over rows sorted by (key, node): a spanning forest of each key's links, and keys over cap as they are."""

    def near(one: int, rest: np.ndarray, fp: np.ndarray, coordinates: np.ndarray, check: np.ndarray) -> np.ndarray:
        hits = rest[(np.abs(coordinates[rest] - coordinates[one]) <= radius).all(axis=1)]
        hits = hits[np.bitwise_count(fp[hits] ^ fp[one]) <= radius]
        return hits[np.bitwise_count(check[hits] ^ check[one]).sum(axis=1) <= check_radius] if checks else hits

    def forest(fp: np.ndarray, check: np.ndarray, coordinates: np.ndarray) -> list[tuple[int, int]]:
        rest, out = np.arange(len(fp)), []
        while len(rest) > 1:
            frontier, rest = [int(rest[0])], rest[1:]
            while frontier and len(rest):
                one = frontier.pop()
                hits = near(one, rest, fp, coordinates, check)
                if len(hits):
                    out += [(one, int(x)) for x in hits]
                    frontier += hits.tolist()
                    rest = np.setdiff1d(rest, hits, assume_unique=True)
        return out

    def frame(key: np.ndarray, node: np.ndarray, other: np.ndarray, over: int) -> pd.DataFrame:
        return pd.DataFrame({"key": key, "u": node, "v": other, "over": np.full(len(key), over, dtype=np.int32)})

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        passing = None  # the key whose rows go by because there are more than cap of them

        def done(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
            key, node = part["key"].to_numpy(), part["node"].to_numpy()
            fp = part["fp"].to_numpy().view(np.uint64)
            check = part[checks].to_numpy(dtype=np.int64).view(np.uint64)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            shared, small = np.repeat(sizes > 1, sizes), np.repeat(sizes <= SMALL, sizes)
            run = np.repeat(np.arange(len(sizes)), sizes)
            coordinates = np.zeros((len(fp), len(spread)), dtype=np.int16)
            coordinates[shared] = np.bitwise_count(fp[shared][:, None] ^ spread).astype(np.int16)
            for apart in range(1, min(SMALL, len(fp))):
                one = np.flatnonzero((run[apart:] == run[:-apart]) & small[:-apart])
                if not len(one):
                    break
                other = one + apart
                ok = np.abs(coordinates[one] - coordinates[other]).max(axis=1) <= radius
                one, other = one[ok], other[ok]
                ok = np.bitwise_count(fp[one] ^ fp[other]) <= radius
                if checks:
                    ok &= np.bitwise_count(check[one] ^ check[other]).sum(axis=1) <= check_radius
                if ok.any():
                    yield frame(key[one[ok]], node[one[ok]], node[other[ok]], 0)
            for at, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
                pairs = forest(fp[at : at + n], check[at : at + n], coordinates[at : at + n])
                if pairs:
                    a, b = np.array(pairs).T
                    yield frame(np.full(len(a), key[at]), node[at + a], node[at + b], 0)

        for batch in batches:
            part = batch if held is None else pd.concat([held, batch], ignore_index=True)
            held = None
            if not len(part):
                continue
            key = part["key"].to_numpy()
            if passing is not None:
                n = int(np.searchsorted(key != passing, True)) if (key != passing).any() else len(key)
                yield frame(key[:n], part["node"].to_numpy()[:n], part["node"].to_numpy()[:n], 1)
                part, key = part.iloc[n:], key[n:]
                if not len(part):
                    continue
                passing = None
            last = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])
            if cap is not None:
                starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                sizes = np.diff(np.r_[starts, len(key)])
                big = np.repeat(sizes > cap, sizes)
                if big.any():
                    over = part[big]
                    yield frame(key[big], over["node"].to_numpy(), over["node"].to_numpy(), 1)
                    passing = key[-1] if big[-1] else None
                    last = int((~big[:last]).sum())
                    part = part[~big]
            yield from done(part.iloc[:last])
            held = part.iloc[last:] if len(part) > last else None
        if held is not None and len(held):
            yield from done(held)

    return link


def near_links(nodes: DataFrame, tables: PivotTables, checks: list[str] = (), check_radius: int = 0, cap: int = RUN_CAP) -> DataFrame:
    """Links (u, v) between nodes that connect exactly what the pairs within the radius connect.

    nodes: node (long, unique), fp (long, distinct unless checks are given), and the columns of checks (long): a link
    then also needs these, taken as one fingerprint, within check_radius. A node may have several fingerprints, a row
    for each, told apart by a column ``at``; a link needs any of them within the radius. A key of more than SMALL rows gives a
    spanning forest of its links, at most its rows less one, never all pairs. A key with more than cap rows is split
    into chunks, and each pair of chunks is a group of its own, so no task holds a whole hot key and no link is lost.
    The smallest node of a key is its first hub, so that the tables agree on hubs and a large group of near copies
    gives few links more than it has nodes.
    """
    spark = nodes.sparkSession
    columns, checks = ["node", "fp", *checks], list(checks)
    out = "key long, u long, v long, over int"

    keyed = tables.keyed(nodes.select(*columns, *(c for c in nodes.columns if c == "at")), "fp").select("key", *columns)

    def linked(keyed: DataFrame, limit: int | None) -> DataFrame:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = keyed.repartition(n, "key").sortWithinPartitions("key", "node")
        return dealt.mapInPandas(_linker(tables.radius, tables.spread, checks, check_radius, limit), out)

    first = written(linked(keyed, cap), "pivot-links")
    links = first.where("over = 0").select("u", "v")
    over = first.where("over = 1").select("key")
    if not over.isEmpty():
        chunks = over.groupBy("key").agg(F.ceil(F.count("*") / F.lit(cap)).cast("long").alias("chunks"))
        chunk = F.pmod(F.xxhash64("node"), F.col("chunks"))
        paired = (
            keyed.join(F.broadcast(chunks), "key")  # a key has more than cap rows, so these are few
            .withColumn("mine", chunk)
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
            .withColumn("key", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
            .select("key", *columns)
        )
        links = links.unionByName(linked(paired, None).where("over = 0").select("u", "v"))
    return links.distinct()


def simhash_components(docs: DataFrame, shingle: int = 3, tables: PivotTables | None = None) -> DataFrame:
    """doc_id, fp (long), component_id: documents whose fingerprints link, directly or through others.

    docs: doc_id (long), text; other columns are ignored. Null text is empty and has fingerprint zero, linked like any
    other. component_id is the smallest non-null doc_id that can be reached; it is null only where every doc_id of the
    component is null. Repeated rows give repeated result rows; an empty table gives an empty result. Equal
    fingerprints collapse to one node before anything is paired, so a group of copies costs one row per task.
    """
    prints = written(docs.select("doc_id", shingle_fingerprint(shingle)("text").alias("fp")), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "fingerprint-nodes")
    links = near_links(nodes.select(F.col("fp").alias("node"), "fp"), tables or PivotTables())
    roots = connected_components(links)
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_doc")
    first = written(rooted.groupBy("root").agg(F.min("first_doc").alias("component_id")), "component-firsts")
    lookup = rooted.join(first, "root").select("fp", "component_id")
    return prints.join(lookup, "fp").select("doc_id", "fp", "component_id")


def _verifier(likeness: float):
    """mapInPandas function over rows sorted by (grp, node): links of pairs whose shingle sets have a Jaccard similarity of likeness.

    Rows of one group: a spanning forest of its links. Where known differs from null, it is the component that the node
    is in so far; then only rows with minor set look for partners, and give one link to each component they reach.
    """

    def near(one: int, codes: np.ndarray, ends: np.ndarray, flags: np.ndarray) -> np.ndarray:
        mine = codes[ends[one] : ends[one + 1]]
        flags[mine] = 1
        running = np.zeros(len(codes) + 1, dtype=np.int64)
        np.cumsum(flags[codes], out=running[1:])
        flags[mine] = 0
        shared, sizes = running[ends[1:]] - running[ends[:-1]], np.diff(ends)
        return shared >= likeness * (sizes + len(mine) - shared) - 1e-9

    def pairs(part: pd.DataFrame) -> list[tuple[int, int]]:
        sets = [np.frombuffer(x, dtype="<u8") for x in part["grams"]]
        ends = np.r_[0, np.cumsum([len(x) for x in sets])]
        values, codes = np.unique(np.concatenate(sets), return_inverse=True)
        flags, out = np.zeros(len(values), dtype=np.int64), []
        if part["known"].notna().all():
            known = part["known"].to_numpy(dtype=np.int64)
            for one in np.flatnonzero(part["minor"].to_numpy(dtype=bool)):
                hits = np.flatnonzero(near(one, codes, ends, flags) & (known != known[one]))
                out += [(int(one), int(hits[i])) for i in np.unique(known[hits], return_index=True)[1]]
            return out
        rest = np.ones(len(sets), dtype=bool)
        while rest.any():
            frontier = [int(np.argmax(rest))]
            rest[frontier] = False
            while frontier and rest.any():
                one = frontier.pop()
                hits = np.flatnonzero(near(one, codes, ends, flags) & rest).tolist()
                rest[hits] = False
                frontier += hits
                out += [(one, x) for x in hits]
        return out

    def done(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        grp, node = part["grp"].to_numpy(), part["node"].to_numpy()
        edges, found = np.r_[np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]]), len(grp)], []
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a > 1:
                found += [(node[a + x], node[a + y]) for x, y in pairs(part.iloc[a:b])]
        if found:
            yield pd.DataFrame(np.array(found, dtype=np.int64), columns=["u", "v"])

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows of the last group so far
        for batch in batches:
            if not len(batch):
                continue
            grp = batch["grp"].to_numpy()
            if held and grp[0] != held[0]["grp"].iloc[0]:
                yield from done(pd.concat(held, ignore_index=True))
                held = []
            last = int(np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]])[-1])
            if last:
                yield from done(pd.concat([*held, batch.iloc[:last]], ignore_index=True))
                held = []
            held.append(batch.iloc[last:])
        if held:
            yield from done(pd.concat(held, ignore_index=True))

    return link


def verified_components(sets: DataFrame, likeness: float, cap: int = SET_CAP) -> DataFrame:
    """(node, root), without the roots themselves: components of the pairs in one loose group that are alike enough.

    sets: node (long, unique), grp (long), grams (binary of shingle_set); pairs of different groups aren't looked at.
    A group of up to cap nodes is compared in one task. A larger one is dealt out in chunks which share some HUBS, and
    that usually connects it; what is then not in the group's largest component is compared with every node of the
    group, chunk by chunk, so no pair is left out.
    """
    spark, schema, none = sets.sparkSession, "u long, v long", F.lit(None).cast("long")
    chunk = lambda n: F.pmod(F.xxhash64("node"), n)

    def linked(rows: DataFrame) -> DataFrame:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.select("grp", "node", "grams", "known", "minor").repartition(n, "grp").sortWithinPartitions("grp", "node")
        return dealt.mapInPandas(_verifier(likeness), schema)

    big = written(sets.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > cap).withColumn("chunks", F.ceil(F.col("n") / F.lit(cap)).cast("long")), "large-groups")
    shared = sets.join(F.broadcast(big), "grp", "left")  # a large group has more than cap nodes, so these are few
    hub = F.pmod(F.xxhash64("node", F.lit(1)), F.col("n")) < HUBS
    at = F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).when(hub, F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array(chunk(F.col("chunks"))))
    rows = shared.withColumn("at", F.explode(at)).withColumn("grp", F.when(F.col("n").isNull(), F.col("grp")).otherwise(F.xxhash64("grp", "at")))
    links = written(linked(rows.withColumns({"known": none, "minor": F.lit(False)})), "verified-links")
    roots = connected_components(links)
    if big.isEmpty():
        return roots
    known = sets.join(F.broadcast(big), "grp").select("grp", "node", "chunks").join(roots, "node", "left").select("grp", "node", "chunks", F.coalesce("root", "node").alias("known"))
    known = written(known, "known-components")
    parts = known.groupBy("grp", "known").agg(F.count("*").alias("size")).groupBy("grp").agg(F.max_by("known", F.struct("size", "known")).alias("most"), F.count("*").alias("parts"), F.sum("size").alias("n"), F.max("size").alias("largest"))
    open_groups = parts.where("parts > 1").select("grp", "most", F.ceil((F.col("n") - F.col("largest")) / F.lit(cap)).cast("long").alias("heaps"))
    left = known.join(F.broadcast(open_groups), "grp").withColumn("minor", F.col("known") != F.col("most")).join(sets.select("node", "grams"), "node")
    zero = F.lit(0).cast("long")
    asking = left.where("minor").select("*", chunk(F.col("heaps")).alias("heap"), F.explode(F.sequence(zero, F.col("chunks") - 1)).alias("at"))
    asked = left.select("*", F.explode(F.sequence(zero, F.col("heaps") - 1)).alias("heap"), chunk(F.col("chunks")).alias("at")).withColumn("minor", F.lit(False))
    more = asking.unionByName(asked).withColumn("grp", F.xxhash64("grp", "heap", "at"))
    return connected_components(links.unionByName(linked(more)))


def near_duplicates(docs: DataFrame, shingle: int = 5, likeness: float = 0.8, tables: PivotTables | None = None) -> DataFrame:
    """doc_id, component_id: near-duplicate groups by a Jaccard similarity of at least ``likeness`` on distinct shingles of ``shingle`` words.

    At that similarity fingerprints over whole texts differ in more bits than any block scheme can guarantee, so
    candidates come from SAMPLES independent fingerprints over samples of shingles: a pair needs to be within the
    tables' radius on any of them, which 1 - (1 - likeness ** DRAWN) ** SAMPLES of the pairs at ``likeness`` are at
    least (0.9999), wherever they differ. At the default radius of 0 that is what MinHash bands do: all coordinates
    of a sampled fingerprint key its table, and neither the coordinate difference nor the exact distance discards
    more; tables of a greater radius may be given. 128 bits over all shingles, with five standard deviations to
    spare, drop most of the pairs that are less alike. What these connect are only candidates: inside each such
    group the shingle sets are compared, and only pairs that are alike enough link. Texts are told apart by their
    SHA-256 and numbered for the links, so no two of them are taken for one. Nulls, empty texts, repeats and empty tables are as in simhash_components.
    """
    tables = tables or PivotTables(radius=0, blocks=4, per_block=8)
    apart, checks = float(np.arccos(2 * likeness / (1 + likeness)) / np.pi), ["s0", "s1"]
    reach = int(np.ceil(128 * apart + 5 * np.sqrt(128 * apart * (1 - apart))))
    key = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    prints = docs.select("doc_id", key.alias("key"), near_duplicate_fingerprints(shingle)("text").alias("p")).select("doc_id", "key", "p.*")
    prints = written(prints, "fingerprints")
    distinct = prints.groupBy("key").agg(F.min("doc_id").alias("first_doc"), *(F.min(c).alias(c) for c in (*checks, *sample_names())))
    nodes = written(distinct.withColumn("node", F.monotonically_increasing_id()), "fingerprint-nodes")
    links = near_links(nodes.select("node", *checks, F.posexplode(F.array(*sample_names())).alias("at", "fp")), tables, checks, reach)
    loose = connected_components(links)
    members = loose.select("node", F.col("root").alias("grp")).unionByName(loose.select(F.col("root").alias("node"), F.col("root").alias("grp")).distinct())
    members = nodes.select("node", "key").join(members, "node")
    texts = docs.select(key.alias("key"), "text").join(members, "key").dropDuplicates(["key"])
    roots = verified_components(written(texts.select("node", "grp", shingle_set(shingle)("text").alias("grams")), "shingle-sets"), likeness)
    rooted = nodes.join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"), "first_doc")
    first = written(rooted.groupBy("root").agg(F.min("first_doc").alias("component_id")), "component-firsts")
    lookup = rooted.join(first, "root").select("key", "component_id")
    return prints.join(lookup, "key").select("doc_id", "component_id")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document; see simhash_components for nulls, repeats and empty tables."""
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, likeness: float = 0.8) -> DataFrame:
    """docs with one document of each near-duplicate group, the one with the smallest doc_id; same columns, whatever
    their names.

    Rows that repeat the kept doc_id all stay, as do rows without a doc_id. Texts with the same shingles, as with
    other white space or case, are alike; so are all that have no word, null texts among them. A very long text is
    shingled whole, inside one task.
    """
    kept = near_duplicates(docs, shingle, likeness).where("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    own = docs.select(carried(docs).alias("own"), F.col("doc_id").alias("doc"))
    return own.join(kept, F.col("doc") == F.col("kept"), "left_semi").unionByName(own.where("doc is null")).select(*unpacked(docs, (), "own"))

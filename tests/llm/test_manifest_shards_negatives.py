"""Merkle manifest, sharding and hard negatives against plain Python."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqweave.llm import hard_negatives, merkle, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc, source, lang, n, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def climbed(hashes, at):
    """Root over hashes and the way from place at: (sibling, is left) or nothing."""
    way, level = [], list(hashes)
    while len(level) > 1:
        pair = level[at // 2 * 2 : at // 2 * 2 + 2]
        way.append(None if len(pair) == 1 else (pair[1 - at % 2], at % 2 == 1))
        level, at = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)], at // 2
    return level[0], way


def fold(h, way):
    for step in way:
        h = sha(h if step is None else step[0] + h if step[1] else h + step[0])
    return h


def plain_manifest(rows):
    leaves = [(lang, doc, leaf_of(doc, source, lang, n, text), n, source, text) for doc, text, lang, source, n in rows]
    first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    leaves.sort(key=lambda x: (first(x[0]), first(x[1]), x[2]))
    langs = sorted({x[0] for x in leaves}, key=first)
    groups = {g: [x for x in leaves if x[0] == g] for g in langs}
    subroots = [climbed([x[2] for x in groups[g]], 0)[0] for g in langs]
    root = climbed(subroots, 0)[0] if subroots else None
    out = []
    for g, sub in zip(langs, subroots, strict=True):
        for at, (lang, doc, leaf, n, source, text) in enumerate(groups[g]):
            way = climbed([x[2] for x in groups[g]], at)[1] + climbed(subroots, langs.index(g))[1]
            bad = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0 and n is not None
            folded = fold(leaf_of(doc, source, lang, n + 1, text) if bad else leaf, way)
            out.append((doc, leaf, sub, root, sha("".join(s[0] for s in way if s)), folded, folded == root))
    return out


def manifest_rows(docs, stride):
    claim = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, merkle.leaf(n_chars=F.try_add("n_chars", F.lit(1))))
    return [tuple(r) for r in merkle.verify(docs.sparkSession, merkle.build(docs, claim, stride)).collect()]


@pytest.mark.parametrize("stride", [2, 10])
def test_manifest_is_the_plain_tree(spark, stride):
    rng = random.Random(stride)
    rows = [(i, f"text {i} é漢", rng.choice(["en", "en", "en", "de", "fr", None, "é"]), "web", i * 3) for i in range(37)]
    rows += [(None, None, None, None, None), (None, "", "en", "", 0), (5, "again", "en", "web", 1), (5, "again", "en", "web", 1), (7, "x" * 300_000, "zz", None, 300_000), (10, "y", "en", "s", None), (11, "z", "en", "s", (1 << 63) - 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"hash": F.lit(1), "tree": F.lit("clash"), "row": F.lit(0)})
    want = plain_manifest([r for r in rows if r[0] != 11]) if zlib.crc32(b"11") % 7 == 0 else plain_manifest(rows)
    assert sorted(map(repr, manifest_rows(docs, stride))) == sorted(map(repr, want))


def test_manifest_of_one_row_one_language_and_none(spark):
    for rows in ([], [(1, "a", "en", "s", 1)], [(i, "a", "en", "s", 1) for i in range(5)]):
        assert sorted(map(repr, manifest_rows(spark.createDataFrame(rows, DOCS), 2))) == sorted(map(repr, plain_manifest(rows)))


def test_manifest_finds_what_changed_and_stores_parents(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", i) for i in range(21)], DOCS)
    manifest = merkle.build(docs, F.when(F.col("doc_id") == 13, merkle.leaf(text=F.lit("other"))), 2)
    assert [r["doc_id"] for r in merkle.verify(spark, manifest).where("not verified").collect()] == [13]
    stored = {(r["tree"], r["ix"]): r for r in manifest.table(spark, "leaves").collect()}
    assert stored[0, 20]["parent_ix"] == 5 and list(stored[0, 20]["path"]) == [None, None]
    assert manifest.hops == 2 and manifest.table(spark, "nodes").where("hop = 0").count() == 6


def plain_place(x, n, seed=0):
    side = math.isqrt(n - 1) + 1
    while True:
        left, right = divmod(x, side)
        for k in range(sharding.ROUNDS):
            left, right = right, (left + int(hashlib.md5(f"{seed}:{k}:{right}".encode()).hexdigest()[:15], 16) % side) % side
        x = left * side + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 26, 101, 1000])
def test_permutation_is_the_plain_one_and_goes_back(spark, n):
    walk = sharding.longest_walk(spark, n, 3)
    found = spark.createDataFrame(spark.range(n).select("id", sharding.permuted(F.col("id"), n, walk, 3).alias("to")).collect())
    rows = {r["id"]: (r["to"], r["again"]) for r in found.withColumn("again", sharding.permuted(F.col("to"), n, walk, 3, back=True)).collect()}
    assert rows == {i: (plain_place(i, n, 3), i) for i in range(n)}
    assert sorted(to for to, _ in rows.values()) == list(range(n))


def test_shards_are_even_gapless_and_computable(spark):
    rows = [(i if i % 3 else None, None if i % 5 == 0 else "é" * i, "en", "s", i) for i in range(203)] + [(4, "same", "en", "s", 4)] * 70
    docs = spark.createDataFrame(rows, DOCS).withColumns({"row": F.lit("clash"), "SLOT": F.lit(1), "size": F.lit("x")})
    found = sharding.shard_documents(docs, 8, 5).collect()
    assert len(found) == len(rows)
    for shard in range(8):
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots))) and len(slots) in (34, 35)
    assert all(r["slot"] * 8 + r["shard"] == plain_place(r["row"], 273, 5) for r in found)
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in found) == sorted((d if d is not None else -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    back = sharding.rows_at(spark.createDataFrame([(r["shard"], r["slot"], r["row"]) for r in found], "shard int, slot long, was long"), 273, 8, 5)
    assert back.where("row <> was").isEmpty()
    again = sharding.shard_documents(docs.repartition(7), 8, 5)
    assert sorted(map(repr, (r[:3] + r[4:] for r in map(tuple, again.collect())))) == sorted(map(repr, (r[:3] + r[4:] for r in map(tuple, found))))
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_strassen_is_the_product():
    rng = np.random.default_rng(1)
    for m, k, n in ((1, 1, 1), (5, 7, 3), (33, 64, 65), (100, 37, 130)):
        a, b = rng.integers(-(1 << 30), 1 << 30, (m, k)), rng.integers(-(1 << 30), 1 << 30, (k, n))
        assert (hard_negatives.strassen(a, b, 2) == a @ b).all()


def test_heaps_merge_to_the_heap_of_all():
    rng = np.random.default_rng(2)
    score, ids = rng.integers(0, 6, 200), rng.integers(0, 50, 200)
    rows = np.arange(200)
    parts = [hard_negatives.Heap(7) for _ in range(3)]
    whole, merged = hard_negatives.Heap(7), hard_negatives.Heap(7)
    whole.add(score, ids, rows)
    for i, part in enumerate(parts):
        part.add(score[i::3], ids[i::3], rows[i::3])
        merged.add(part.score, part.id, part.row)
    want = sorted(zip(-score, ids, rows, strict=True))[:7]
    assert [(-s, i, r) for s, i, r in zip(whole.score, whole.id, whole.row, strict=True)] == want
    assert (merged.row == whole.row).all()


def plain_negatives(rows):
    own = []
    for at, (vec, x, label) in enumerate(rows):
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        own.append((at, vec, [math.floor(256 * float(np.float32(v))) for v in x], (label + 1) % 10 if vec is not None and vec % 7 == 0 else label))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    out = []
    for at, vec, x, label in own:
        if vec is None or vec % 100:
            continue
        score = [(sum(a * b for a, b in zip(x, y, strict=False)), v, i, other) for i, v, y, other in own]
        for positive in sorted((s for s in score if s[3] == label and s[2] != at), key=order)[:5]:
            fits = sorted((s for s in score if s[3] != label and 30 * positive[0] <= 100 * s[0] <= 90 * positive[0]), key=order)[:10]
            out += [(vec, positive[1], k + 1, s[1], positive[0], s[0]) for k, s in enumerate(fits)]
    return out


def mined(spark, rows):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit("clash"), "row": F.lit(0), "vector": F.lit(0)})
    return [tuple(r) for r in hard_negatives.mine(df, F.col("id") % 100 == 0, label=moved).collect()]


def test_negatives_are_the_plain_ones(spark, monkeypatch):
    for name, value in (("ANCHOR_BLOCK", 3), ("CANDIDATE_BLOCK", 50), ("LEAST_BLOCK", 20), ("TILE", 16), ("LEAF", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(3)
    rows = [(i * 10, rng.normal(0.2, 0.4, 5).tolist(), int(rng.integers(0, 4))) for i in range(120)]
    rows += [(300, rows[0][1], 1), (300, rows[0][1], 1), (5, rows[1][1], 0), (5, rows[1][1], 0), (None, rows[2][1], 2), (None, rows[3][1], 1)]  # repeats and ties
    rows += [(400, None, 1), (500, [0.1] * 5, None), (600, [0.1, None, 0.1, 0.1, 0.1], 1), (700, [float("nan")] * 5, 2), (800, [float("inf")] * 5, 2), (900, [0.5, 0.5], 1), (1000, [], 1)]
    found = mined(spark, rows)
    assert len(found) > 300
    assert sorted(map(repr, found)) == sorted(map(repr, plain_negatives(rows)))


def test_negatives_of_nothing_and_of_too_large_vectors(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [0.5], 1), (2, [0.5], 2)]) == []
    assert mined(spark, [(100, [0.5], 1)]) == []
    with pytest.raises(Exception, match="too large"):
        mined(spark, [(100, [1e30], 1), (101, [0.5], 1)])

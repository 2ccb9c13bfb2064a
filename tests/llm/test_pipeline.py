"""The pipeline's stages against brute force on a small table."""

import math
import random

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from seqweave.llm import toxicity
from seqweave.llm.tokenizer import id_bytes

SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def test_toxic_documents_go_by_their_score(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels, held_out=False)
    want = {r["doc_id"] for r in docs.collect() if 1 / (1 + math.exp(-toxicity.log_odds(toxicity.words_of(r["text"]), model))) < 0.3}
    assert {r["doc_id"] for r in corpus_pipeline.reject_toxic(spark, docs, SF).collect()} == want and 100 < len(want) < docs.count()


def test_near_duplicates_against_all_pairs(spark):
    """The whole table beside cut, extended and slightly changed copies: one document stays of each linked group."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    draw, rows = random.Random(5), [(r["doc_id"], r["text"]) for r in docs.collect()]
    for d, text in [x for x in rows if x[1] and len(x[1].split()) > 60][:60]:
        words = text.split()
        kind = d % 3
        if kind == 0:
            words = words[: len(words) * 9 // 10]
        elif kind == 1:
            words += [f"new{d}x{k}" for k in range(len(words) // 8)]
        else:
            words[draw.randrange(len(words))] = "changed"
        rows.append((10_000 + d, " ".join(words)))
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or len(a & b) >= 0.8 * len(a | b) > 0:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").withColumn("_kept", F.lit(1)).withColumn("own", F.lit(2)), SF)
    assert kept.columns == ["doc_id", "text", "_kept", "own"]
    assert {r["doc_id"] for r in kept.collect()} == set(least.values()) and len(least) < len(rows) - 40


def test_packing_holds_every_row_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.read.parquet(f"{SF}/documents.parquet").limit(20))
    got = corpus_pipeline.pack_sequences(spark, docs, SF).toPandas()
    held, asked = got.groupby("doc_id")["length"].sum().to_dict(), {}
    for r in docs.collect():
        asked[r["doc_id"]] = asked.get(r["doc_id"], 0) + len(id_bytes(r["text"])) // 4 + 1
    assert held == asked
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *part["length"].cumsum()[:-1]] and part["length"].sum() <= 2048


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, out = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {(r["doc_id"], r["text"]) for r in out.collect()}
        out = spark.createDataFrame(stage(spark, out, SF).collect(), docs.schema)
        after = [(r["doc_id"], r["text"]) for r in out.collect()]
        assert out.columns == columns and set(after) <= before, name
        if name == "exact dedup":
            keep = {}
            for d, t in before:
                keep[t] = max(d, keep.get(t, d))
            assert sorted(after) == sorted((d, t) for t, d in keep.items())
        if name == "source mixing":
            assert set(after) == before
    assert len(out.collect()) > 50


def test_run_is_registered_and_packs_what_is_left(spark):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    rows = corpus_pipeline.run(spark, SF).toPandas()
    assert rows.groupby("sequence_id")["length"].sum().max() <= 2048 and len(corpus_pipeline.STAGES) == 5

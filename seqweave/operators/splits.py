"""Leakage-safe splits of sequence ids."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def eligible(ids: DataFrame, error: DataFrame, holdout: DataFrame) -> DataFrame:
    return ids.select("protein_id").distinct().join(error.select("protein_id"), "protein_id", "left_anti").join(holdout.select("protein_id"), "protein_id", "left_anti")


def validation_size(n: int, ratio: float) -> int:
    """n x ratio rounded half to even, at least 1 and at most n - 1."""
    if n < 2:
        raise ValueError("a split needs two eligible ids")
    return min(max(1, round(n * ratio)), n - 1)


def seeded_split(ids: DataFrame, error: DataFrame, holdout: DataFrame, ratio: float = 0.2, seed: int = 42, compat: bool = False) -> DataFrame:
    """protein_id, split (train or val).

    The order is that of md5(id:seed): stable under any partitioning. A threshold on the first digest digits, taken
    from their histogram, picks all but the last few ids; only the ids of one histogram cell are ranked. compat
    shuffles the sorted ids on the driver as a seeded Python generator does (small id lists, to match a manifest).
    """
    spark = ids.sparkSession
    left = eligible(ids, error, holdout)
    if compat:
        names = sorted(r["protein_id"] for r in left.collect())
        random.Random(seed).shuffle(names)
        n = validation_size(len(names), ratio)
        return spark.createDataFrame([(x, "val" if i < n else "train") for i, x in enumerate(names)], "protein_id string, split string")
    keyed = left.withColumn("h", F.md5(F.concat_ws(":", "protein_id", F.lit(str(seed))))).withColumn("cell", F.substring("h", 1, 3))
    cells = sorted((r["cell"], r["n"]) for r in keyed.groupBy("cell").agg(F.count("*").alias("n")).collect())
    wanted, seen, edge = validation_size(sum(n for _, n in cells), ratio), 0, None
    for cell, n in cells:
        if seen + n >= wanted:
            edge = cell
            break
        seen += n
    within = F.row_number().over(Window.partitionBy("cell").orderBy("h", "protein_id"))
    on_edge = keyed.where(F.col("cell") == edge).withColumn("nth", within)
    rest = keyed.where(F.col("cell") != edge).select("protein_id", F.when(F.col("cell") < edge, "val").otherwise("train").alias("split"))
    return rest.unionByName(on_edge.select("protein_id", F.when(F.col("nth") <= wanted - seen, "val").otherwise("train").alias("split")))


def fixed_split(train: DataFrame, val: DataFrame, error: DataFrame, holdout: DataFrame) -> DataFrame:
    """protein_id, split from two id lists that must be disjoint; error and holdout ids are dropped, each side keeps one."""
    if not train.select("protein_id").intersect(val.select("protein_id")).isEmpty():
        raise ValueError("train and val share ids")
    out = eligible(train, error, holdout).withColumn("split", F.lit("train")).unionByName(eligible(val, error, holdout).withColumn("split", F.lit("val")))
    if out.select("split").distinct().count() < 2:
        raise ValueError("a split is empty")
    return out


def exclusion_counts(ids: DataFrame, error: DataFrame, holdout: DataFrame) -> DataFrame:
    """status, n over all ids: eligible, error, holdout (an id in both lists counts as error), and error ids that no record has."""
    known = ids.select("protein_id").distinct()
    e, h = error.select("protein_id").distinct().withColumn("e", F.lit(True)), holdout.select("protein_id").distinct().withColumn("h", F.lit(True))
    status = F.when(F.col("e"), "error").when(F.col("h"), "holdout").otherwise("eligible")
    counted = known.join(e, "protein_id", "left").join(h, "protein_id", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    missing = e.join(known, "protein_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("error_missing").alias("status"), "n")
    return counted.unionByName(missing)


def resolve_manifest(records: DataFrame, manifest: DataFrame, sample: int = 10) -> DataFrame:
    """split, listed, missing, sample (of the missing ids the first ones, in order): whether a manifest (protein_id,
    split) still fits the records. The samples are taken in each task first, so no task sees all missing ids."""
    has = records.select("protein_id").distinct().withColumn("has", F.lit(True))
    joined = manifest.join(has, "protein_id", "left").withColumn("lost", F.when(F.col("has").isNull(), F.col("protein_id")))
    counts = joined.groupBy("split").agg(F.count("*").alias("listed"), F.count("lost").alias("missing"))
    parts = joined.where("lost is not null").withColumn("part", F.pmod(F.xxhash64("lost"), F.lit(256)))
    nth = lambda *by: F.row_number().over(Window.partitionBy("split", *by).orderBy("lost"))
    few = parts.select("split", "part", "lost", nth("part").alias("nth")).where(F.col("nth") <= sample).select("split", "lost", nth().alias("nth")).where(F.col("nth") <= sample)
    samples = few.groupBy("split").agg(F.array_sort(F.collect_list("lost")).alias("sample"))
    none = F.array().cast("array<string>")
    return counts.join(samples, "split", "left").select("split", "listed", "missing", F.coalesce("sample", none).alias("sample"))


def use_or_rebuild(records: DataFrame, manifest: DataFrame | None, error: DataFrame, holdout: DataFrame, ratio: float = 0.2, seed: int = 42, rebuild: bool = True) -> tuple[DataFrame, str, DataFrame | None]:
    """(protein_id, split; "used" or "rebuilt"; resolve_manifest's report): the manifest if every id it lists has a
    record, else a new seeded split, or an error where rebuild is False. No manifest: as if it didn't fit."""
    report = None if manifest is None else resolve_manifest(records, manifest)
    if report is not None and report.where("missing > 0").isEmpty():
        return manifest.select("protein_id", "split"), "used", report
    if not rebuild:
        lost = "there is none" if report is None else ", ".join(f"{r['split']}: {r['missing']} ids without a record" for r in report.where("missing > 0").orderBy("split").collect())
        raise ValueError(f"the split manifest doesn't fit the records ({lost})")
    return seeded_split(records.select("protein_id"), error, holdout, ratio, seed), "rebuilt", report


def leaked(split: DataFrame, holdout: DataFrame) -> DataFrame:
    """Ids of a split that the holdout has, too; must be empty."""
    return split.join(holdout.select("protein_id").distinct(), "protein_id", "left_semi")


def split_features(features: DataFrame, split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features with split, report): report has split, copied, missing ids per split and extra ids under a null split."""
    doubled = split.groupBy("protein_id").agg(F.countDistinct("split").alias("n")).where("n > 1")
    if not doubled.isEmpty():
        raise ValueError("an id is in two splits")
    have = features.select("protein_id").distinct().withColumn("has", F.lit(1))
    report = have.join(split, "protein_id", "full_outer").groupBy("split").agg(
        F.count_if(F.col("has").isNotNull() & F.col("split").isNotNull()).alias("copied"), F.count_if(F.col("has").isNull()).alias("missing"), F.count_if(F.col("split").isNull()).alias("extra")
    )
    return features.join(split, "protein_id"), report

"""Losses and samples as aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.ordering import numbered
from seqweave.operators.rank import group_join


def weighted_bce(logit: Column, label: Column, pos_weight: float | Column) -> Column:
    """Binary cross entropy of a logit, positives weighted; stable for large logits. Null for a masked label."""
    weight = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))
    return (1 - label) * logit + (1 + (weight - 1) * label) * (F.log1p(F.exp(-F.abs(logit))) + F.greatest(-logit, F.lit(0.0)))


def mean_loss(rows: DataFrame, by: list[str], pos_weight: float, other: str | None = None, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """loss per group over unmasked positions; with a second logit column, the weighted sum of both losses."""
    own = F.avg(weighted_bce(F.col("logit"), F.col("label"), pos_weight))
    loss = own if other is None else weights[0] * own + weights[1] * F.avg(weighted_bce(F.col(other), F.col("label"), pos_weight))
    return rows.where("label is not null").groupBy(*by).agg(loss.alias("loss"))


def capped_sample(rows: DataFrame, by: list[str], key: Column, limit: int, seed: int = 0) -> DataFrame:
    """At most limit rows of each class in each group, by a keyed hash: a sampling operator.

    The limit smallest draws of a class lie in its first bins of draws; a histogram of bins, which is added up before
    anything is shuffled, says in how many. Only rows of these bins are ordered, about limit of each class, so a class
    may hold any share of the rows. A null in a group column is a group of its own; a masked label takes no part.
    """
    groups = [*by, "label"]
    drawn = rows.where("label is not null").withColumn("_draw", F.md5(F.concat_ws(":", key, F.lit(str(seed)))))
    drawn = drawn.withColumn("_bin", F.conv(F.substring("_draw", 1, 4), 16, 10).cast("int"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*groups).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = drawn.groupBy(*groups, "_bin").agg(F.count("*").alias("_n")).withColumn("_before", before)
    last = bins.where(F.col("_before") < limit).groupBy(*groups).agg(F.max("_bin").alias("_last"))
    near = group_join(drawn, last, groups, how="inner").where(F.col("_bin") <= F.col("_last"))
    nth = F.row_number().over(Window.partitionBy(*groups).orderBy("_draw"))
    return near.withColumn("_nth", nth).where(F.col("_nth") <= limit).select(*rows.columns)


def _tile(temperature: float):
    """For each anchor of one block, over the candidates of another: the greatest logit, the others' exponentials below
    it, and the partners' logits and number."""

    def one(anchors: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        def unit(rows: pd.DataFrame) -> np.ndarray:
            x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
            return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

        if not len(anchors) or not len(candidates):
            return pd.DataFrame({c: np.zeros(0, dtype=np.int64 if c in ("row", "first", "partners") else float) for c in ("row", "first", "most", "others", "logits", "partners")})
        own, other = (rows["row"].to_numpy()[:, None] for rows in (anchors, candidates))
        together = anchors["first"].to_numpy()[:, None] == candidates["first"].to_numpy()
        apart = together & (own != other.T)
        partners = apart & (anchors["label"].to_numpy()[:, None] == candidates["label"].to_numpy())
        logits = unit(anchors) @ unit(candidates).T / temperature
        most = np.where(together, logits, -np.inf).max(axis=1)
        others = (np.exp(np.where(apart, logits - most[:, None], -np.inf))).sum(axis=1)
        return pd.DataFrame({"row": own[:, 0], "first": anchors["first"], "most": most, "others": others, "logits": np.where(partners, logits, 0.0).sum(axis=1), "partners": partners.sum(axis=1)})

    return one


def contrastive_loss(sample: DataFrame, by: list[str], temperature: float = 0.1, block: int = 1024) -> DataFrame:
    """by, n, loss: supervised contrastive loss of each group of (embedding, label); 0 below two rows or two classes.

    Rows are numbered by group and dealt into blocks. Each pair of blocks that a group has rows in is a tile of the
    matrix of similarities, and a group of its own for Spark; what a tile gives an anchor (greatest logit, sum of
    exponentials below it, sum over partners) is merged with what the others give it. Raises if a loss isn't finite.
    """
    rows = numbered(sample.select(*by, "embedding", "label"), list(by), "contrastive")
    bounds = rows.groupBy(*by).agg(F.min("row").alias("first"), F.max("row").alias("last"), F.count("*").alias("n"), F.count_distinct("label").alias("classes"))
    at = lambda c: F.floor(F.col(c) / block).cast("long")
    known = group_join(rows, bounds.drop("n", "classes"), list(by), how="inner").select("row", "first", "label", "embedding", at("row").alias("own"), F.sequence(at("first"), at("last")).alias("all"))
    carried = [F.col(c).alias(c) for c in ("row", "first", "label", "embedding")]  # columns of its own for either side
    anchors = known.select(*carried, F.col("own").alias("a"), F.explode("all").alias("c"))
    candidates = known.select(*carried, F.explode("all").alias("a"), F.col("own").alias("c"))
    tiles = anchors.groupBy("a", "c").cogroup(candidates.groupBy("a", "c")).applyInPandas(_tile(temperature), "row long, first long, most double, others double, logits double, partners long")
    top = tiles.withColumn("top", F.max("most").over(Window.partitionBy("row")))
    merged = top.groupBy("row", "first").agg(F.max("top").alias("top"), F.sum(F.col("others") * F.exp(F.col("most") - F.col("top"))).alias("others"), F.sum("logits").alias("logits"), F.sum("partners").alias("partners"))
    each = -(F.col("logits") / F.col("partners") - F.col("top") - F.log(F.col("others") + 1e-12))
    means = merged.where("partners > 0").groupBy("first").agg(F.avg(each).alias("loss"))
    out = bounds.join(means, "first", "left")
    loss = F.when((F.col("n") < 2) | (F.col("classes") < 2), 0.0).otherwise(F.coalesce("loss", F.lit(0.0)))
    odd = F.raise_error(F.lit("the contrastive loss isn't finite")).cast("double")
    return out.withColumn("loss", loss).select(*by, "n", F.when(F.isnan("loss") | (F.abs("loss") == float("inf")), odd).otherwise(F.col("loss")).alias("loss"))

"""Scoring positions with stored heads, fitting them, and checks of feature widths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweave.functions.tiling import opened, with_halos

ACTIVATIONS = {
    "relu": lambda x: np.maximum(x, 0),
    "tanh": np.tanh,
    "gelu": lambda x: 0.5 * x * (1 + np.vectorize(__import__("math").erf)(x / np.sqrt(2))),
}


def check_width(rows: DataFrame, width: int, column: str = "embedding") -> DataFrame:
    """rows, if every vector has the width that the head expects."""
    seen = rows.agg(F.min(F.size(column)).alias("low"), F.max(F.size(column)).alias("high")).first()
    if seen["low"] is not None and (seen["low"] != width or seen["high"] != width):
        raise ValueError(f"vectors have {seen['low']} to {seen['high']} values; the head expects {width}")
    return rows


def linear_logit(vector: Column, weights: list[float], bias: float) -> Column:
    """Dot product with built-in functions, in double precision."""
    products = F.zip_with(vector, F.array(*map(F.lit, map(float, weights))), lambda x, w: x.cast("double") * w)
    return F.aggregate(products, F.lit(float(bias)), lambda a, x: a + x)


def _dense(x: np.ndarray, layers: list[dict], activation: str) -> np.ndarray:
    for layer in layers[:-1]:
        x = x @ np.asarray(layer["weight"], dtype=np.float64).T + np.asarray(layer["bias"], dtype=np.float64)
        if "scale" in layer:
            x = (x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + 1e-5) * np.asarray(layer["scale"]) + np.asarray(layer["shift"])
        x = ACTIVATIONS[activation](x)
    return (x @ np.asarray(layers[-1]["weight"], dtype=np.float64).T + np.asarray(layers[-1]["bias"], dtype=np.float64))[:, 0]


def mlp_logits(rows: DataFrame, layers: list[dict], activation: str = "relu", column: str = "embedding") -> DataFrame:
    """rows (without the vector) with logit: dense layers {weight, bias[, scale, shift]}, normalised where scale is given."""
    kept = [c for c in rows.columns if c != column]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[kept].copy()
            out["logit"] = _dense(np.stack(batch[column].to_numpy()).astype(np.float64), layers, activation) if len(batch) else np.zeros(0)
            yield out

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInPandas(score, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", logit double")


def _convolved(x: np.ndarray, layer: dict) -> np.ndarray:
    """A dilated convolution along the rows of x, zeros beyond its ends."""
    weight, step = np.asarray(layer["weight"], dtype=np.float64), int(layer.get("dilation", 1))
    reach = step * (weight.shape[2] - 1) // 2
    padded = np.pad(x, ((reach, reach), (0, 0)))
    return sum(padded[k * step : k * step + len(x)] @ weight[:, :, k].T for k in range(weight.shape[2])) + np.asarray(layer["bias"])


def receptive_reach(layers: list[dict]) -> int:
    """How many positions to either side a convolutional head's logit depends on."""
    return sum(int(layer.get("dilation", 1)) * (np.asarray(layer["weight"]).shape[2] - 1) // 2 for layer in layers)


def cnn_logits(rows: DataFrame, layers: list[dict], activation: str = "relu", by: tuple[str, ...] = ("protein_id",), tile: int = 4096) -> DataFrame:
    """by, position, logit: dilated convolutions along the positions of each window, zeros beyond its ends.

    layers: {weight [out, in, odd kernel], bias, dilation}; the last is the 1-wide output layer. A window is cut into
    tiles of so many positions, each with a halo as wide as the head can see, so its length is unbounded: a tile's own
    logits are those of the whole window. Positions of a window must follow one another without a gap, or it raises.
    """
    if any(np.asarray(layer["weight"]).shape[2] % 2 == 0 for layer in layers):
        raise ValueError("kernels must have an odd width")
    reach = receptive_reach(layers)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group, own = opened(group, tile)
        x = np.stack(group["embedding"].to_numpy()).astype(np.float64)
        for layer in layers[:-1]:
            x = ACTIVATIONS[activation](_convolved(x, layer))
        out = group.loc[own, [*by, "position"]].copy()
        out["logit"] = _convolved(x, layers[-1])[own, 0]
        return out

    tiled = with_halos(rows.select(*by, "position", "embedding"), tile, reach)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return tiled.groupBy(*by, "_tile").applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in (*by, "position")) + ", logit double")


def fit_linear(rows: DataFrame, pos_weight: float = 1.0):
    """Weighted logistic regression on (embedding, label); not bit-equal to a gradient loop."""
    data = rows.where("label is not null").select(array_to_vector("embedding").alias("features"), F.col("label").cast("double").alias("label"), F.when(F.col("label") == 1, float(pos_weight)).otherwise(1.0).alias("weight"))
    return LogisticRegression(weightCol="weight", maxIter=25, regParam=0.01).fit(data)


def predicted(rows: DataFrame, model) -> DataFrame:
    """rows with score, the model's probability of label 1."""
    out = model.transform(rows.withColumn("features", array_to_vector("embedding")))
    return out.withColumn("score", vector_to_array("probability")[1]).select(*rows.columns, "score")


def feature_audit(rows: DataFrame, context: DataFrame, neighbours: int) -> DataFrame:
    """protein_id, length, width, expected and actual context width, cells, matches."""
    own = rows.groupBy("protein_id").agg(F.count("*").alias("length"), F.max(F.size("embedding")).alias("width"))
    other = context.groupBy("protein_id").agg(F.max(F.size("context")).alias("actual_dim"))
    out = own.join(other, "protein_id").withColumn("expected_dim", F.col("width") * neighbours)
    return out.withColumn("cells", F.col("length") * F.col("expected_dim")).withColumn("matches", F.col("expected_dim") == F.col("actual_dim"))


def extraction_report(records: DataFrame, stored: DataFrame, width: int) -> DataFrame:
    """written, skipped, short (at most one window) and long sequences."""
    has = stored.select("protein_id").distinct().withColumn("_has", F.lit(True))
    return records.join(has, "protein_id", "left").agg(
        F.count_if(F.col("_has").isNull()).alias("written"), F.count_if(F.col("_has")).alias("skipped"), F.count_if(F.length("sequence") <= width).alias("short"), F.count_if(F.length("sequence") > width).alias("long")
    )

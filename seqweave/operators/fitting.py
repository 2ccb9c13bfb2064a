"""Fitting stored heads by gradients that tasks add up; the driver holds the weights alone."""

from __future__ import annotations

from collections.abc import Iterator
from math import erf

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.functions.shared import written
from seqweave.functions.tiling import in_order, opened, tiles, with_halos
from seqweave.operators.scoring import receptive_reach

#: Weights at most of a head, and sums that one task adds up.
MAX_WEIGHTS, FAN = 4_000_000, 16
PARTS = ("weight", "bias", "scale", "shift")
_erf = np.vectorize(erf, otypes=[float])
#: Each activation and its slope.
SLOPES = {
    "relu": (lambda x: np.maximum(x, 0), lambda x: (x > 0).astype(np.float64)),
    "tanh": (np.tanh, lambda x: 1 - np.tanh(x) ** 2),
    "gelu": (lambda x: 0.5 * x * (1 + _erf(x / np.sqrt(2))), lambda x: 0.5 * (1 + _erf(x / np.sqrt(2))) + x * np.exp(-x * x / 2) / np.sqrt(2 * np.pi)),
}


def _kernels(layers: list[dict]) -> list[dict]:
    """layers with float64 arrays; a dense layer is a convolution of width 1."""
    out = []
    for layer in layers:
        own = {k: np.asarray(layer[k], dtype=np.float64) for k in PARTS if k in layer}
        own["weight"] = own["weight"] if own["weight"].ndim == 3 else own["weight"][:, :, None]
        out.append(own | {"dilation": int(layer.get("dilation", 1))})
    return out


def flat(layers: list[dict]) -> np.ndarray:
    return np.concatenate([layer[k].ravel() for layer in _kernels(layers) for k in PARTS if k in layer])


def shaped(values: np.ndarray, like: list[dict]) -> list[dict]:
    """The inverse of flat(), with the shapes and dilations of like."""
    out, at = [], 0
    for layer in like:
        own = {}
        for k in PARTS:
            if k in layer:
                size = np.size(layer[k])
                own[k] = values[at : at + size].reshape(np.shape(layer[k]))
                at += size
        out.append(own | ({"dilation": layer["dilation"]} if "dilation" in layer else {}))
    return out


def gradient(x: np.ndarray, label: np.ndarray, layers: list[dict], activation: str, pos_weight: float) -> tuple[np.ndarray, float, int]:
    """Summed gradient (as flat()), summed loss and number of the positions with a label (NaN: none) of one stretch.

    The loss is binary cross entropy of the logit, positives weighted.
    """
    act, slope = SLOPES[activation]
    kernels, seen = _kernels(layers), []
    for n, layer in enumerate(kernels):
        weight, step = layer["weight"], layer["dilation"]
        reach = step * (weight.shape[2] - 1) // 2
        padded = np.pad(x, ((reach, reach), (0, 0)))
        z = sum(padded[k * step : k * step + len(x)] @ weight[:, :, k].T for k in range(weight.shape[2])) + layer["bias"]
        spread = unit = None
        if "scale" in layer:
            spread = np.sqrt(z.var(axis=1, keepdims=True) + 1e-5)
            unit = (z - z.mean(axis=1, keepdims=True)) / spread
            z = unit * layer["scale"] + layer["shift"]
        seen.append((padded, reach, spread, unit, z))
        x = act(z) if n < len(kernels) - 1 else z
    logit, known = x[:, 0], ~np.isnan(label)
    y = np.where(known, label, 0.0)
    weight = 1 + (pos_weight - 1) * y
    loss = (1 - y) * logit + weight * (np.log1p(np.exp(-np.abs(logit))) + np.maximum(-logit, 0))
    below = np.exp(-np.logaddexp(0, logit))  # 1 - sigmoid
    back = np.where(known, (1 - y) - weight * below, 0.0)[:, None]
    parts: list[list[np.ndarray]] = []
    for n in reversed(range(len(kernels))):
        layer, (padded, reach, spread, unit, z) = kernels[n], seen[n]
        own: dict[str, np.ndarray] = {}
        if n < len(kernels) - 1:
            back = back * slope(z)
        if "scale" in layer:
            own["scale"], own["shift"] = (back * unit).sum(axis=0), back.sum(axis=0)
            back = back * layer["scale"]
            back = (back - back.mean(axis=1, keepdims=True) - unit * (back * unit).mean(axis=1, keepdims=True)) / spread
        step, kernel = layer["dilation"], layer["weight"]
        own["weight"], own["bias"] = np.zeros_like(kernel), back.sum(axis=0)
        earlier = np.zeros_like(padded)
        for k in range(kernel.shape[2]):
            here = slice(k * step, k * step + len(back))
            own["weight"][:, :, k] = back.T @ padded[here]
            earlier[here] += back @ kernel[:, :, k]
        parts.append([own[k].ravel() for k in PARTS if k in layer])
        back = earlier[reach : len(earlier) - reach]
    return np.concatenate([p for own in reversed(parts) for p in own]), float(loss[known].sum()), int(known.sum())


def _added(sums: DataFrame) -> np.ndarray:
    """The sum of a table of vectors (part, total), in a tree of groups of FAN."""
    schema = "part long, total array<double>"
    many = sums.agg(F.max("part")).first()[0] or 0

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "total": [np.sum(np.stack(rows.sort_values("part")["total"].to_numpy()), axis=0)]})

    while many >= FAN:
        sums, many = sums.withColumn("part", F.floor(F.col("part") / FAN).cast("long")).groupBy("part").applyInPandas(add, schema), many // FAN
    return np.sum([r["total"] for r in sums.orderBy("part").collect()], axis=0)


def adam(values: np.ndarray, slopes: np.ndarray, state: dict, rate: float, decay: float) -> np.ndarray:
    """One step of Adam with decoupled weight decay; state keeps the moments."""
    state["step"] = state.get("step", 0) + 1
    state["mean"] = 0.9 * state.get("mean", 0.0) + 0.1 * slopes
    state["square"] = 0.999 * state.get("square", 0.0) + 0.001 * slopes**2
    mean, square = state["mean"] / (1 - 0.9 ** state["step"]), state["square"] / (1 - 0.999 ** state["step"])
    return values * (1 - rate * decay) - rate * mean / (np.sqrt(square) + 1e-8)


def fit_head(rows: DataFrame, layers: list[dict], pos_weight: float | None = None, steps: int = 50, rate: float = 0.01, decay: float = 0.01, activation: str = "relu", by: tuple[str, ...] = ("protein_id",), tile: int = 4096) -> tuple[list[dict], list[float]]:
    """(layers, mean loss before each step): a head fitted on (by, position, embedding, label) by gradients over all rows.

    layers give the shapes and the values to begin with: dense layers {weight [out, in], bias[, scale, shift]} or
    convolutions {weight [out, in, odd kernel], bias, dilation}, the last 1 wide. pos_weight is negatives by positives
    unless given. Each step, every task adds up the gradients of its rows, the sums are added in a tree, and the driver,
    which holds the weights and no row, takes one step of Adam. A head that looks at neighbours sees windows as
    tiles with halos, in which only a tile's own positions have a label; a task adds up tile by tile, and gives one sum
    however many tiles it has. Masked labels take no part; without any label nothing changes.
    """
    values = flat(layers)
    if len(values) > MAX_WEIGHTS:
        raise ValueError(f"a head has at most {MAX_WEIGHTS} weights")
    reach = receptive_reach(_kernels(layers))
    kept = rows.select(*by, "position", "embedding", F.col("label").cast("double").alias("label"))
    data = written(with_halos(kept, tile, reach) if reach else kept.where("label is not null"), "fit")
    if pos_weight is None:
        positives, negatives = rows.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
        if not positives:
            raise ValueError("there is no positive label to weigh")
        pos_weight = negatives / positives
    state: dict = {}
    losses: list[float] = []

    def summed(held: np.ndarray) -> np.ndarray:
        now, size = shaped(held, layers), len(held) + 2

        def of(frame: pd.DataFrame, label: np.ndarray) -> np.ndarray:
            slopes, loss, n = gradient(np.stack(frame["embedding"].to_numpy()).astype(np.float64), label, now, activation, pos_weight)
            return np.r_[slopes, loss, n]

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(size)
            for batch in batches:
                if len(batch):
                    total += of(batch, batch["label"].to_numpy(dtype=float))
            yield pd.DataFrame({"total": [total]})

        def tiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(size)
            for group in tiles(batches):
                group, own = opened(group, tile)
                total += of(group, np.where(own, group["label"].to_numpy(dtype=float), np.nan))
            yield pd.DataFrame({"total": [total]})

        if not reach:
            sums = data.select("embedding", "label").mapInPandas(whole, "total array<double>")
        else:
            sums = in_order(data, by).select("position", "_tile", "_first", "embedding", "label").mapInPandas(tiled, "total array<double>")
        return _added(written(sums.withColumn("part", F.spark_partition_id().cast("long")).select("part", "total"), "gradients"))

    for _ in range(steps):
        total = summed(values)
        if not np.ndim(total) or not total[-1]:
            break
        losses.append(float(total[-2] / total[-1]))
        values = adam(values, total[:-2] / total[-1], state, rate, decay)
    return shaped(values, layers), losses

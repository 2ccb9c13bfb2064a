"""Fits, samples, losses and context means against single-process versions."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqweave.functions import tiling
from seqweave.operators import fitting, losses, scoring, windows

ROWS = "protein_id string, position int, embedding array<float>, label int"


def labelled(draw, sizes):
    rows = []
    for p, n in sizes.items():
        for i in range(n):
            x = draw.normal(size=3).astype(np.float32)
            rows.append((p, i + 1, x.tolist(), None if draw.random() < 0.1 else int(x[0] + 0.5 * draw.normal() > 0.8)))
    return rows


DENSE = [{"weight": (4, 3), "bias": (4,), "scale": (4,), "shift": (4,)}, {"weight": (1, 4), "bias": (1,)}]
WIDE = [{"weight": (4, 3, 3), "bias": (4,), "dilation": 2}, {"weight": (3, 4, 3), "bias": (3,), "scale": (3,), "shift": (3,)}, {"weight": (1, 3, 1), "bias": (1,)}]


def drawn(draw, shapes):
    return [{k: (np.ones(v) if k == "scale" else draw.normal(size=v)) if isinstance(v, tuple) else v for k, v in layer.items()} for layer in shapes]


@pytest.mark.parametrize("activation", ["relu", "tanh", "gelu"])
@pytest.mark.parametrize("shapes", [DENSE, WIDE])
def test_gradient_is_the_slope_of_the_loss(activation, shapes):
    draw = np.random.default_rng(3)
    layers, x = drawn(draw, shapes), draw.normal(size=(9, 3))
    label = np.array([0, 1, np.nan, 1, 0, 0, 1, np.nan, 0])
    slopes, loss, n = fitting.gradient(x, label, layers, activation, 2.5)
    values = fitting.flat(layers)
    assert n == 7 and len(slopes) == len(values) and loss > 0
    for i in range(len(values)):
        at = [fitting.gradient(x, label, fitting.shaped(values + d * np.eye(len(values))[i], layers), activation, 2.5)[1] for d in (1e-6, -1e-6)]
        assert abs((at[0] - at[1]) / 2e-6 - slopes[i]) < 1e-4


@pytest.mark.parametrize("shapes, tile", [(DENSE, 4096), (WIDE, 5), (WIDE, 4096)])
def test_fit_is_that_of_one_process(spark, monkeypatch, shapes, tile):
    monkeypatch.setattr(fitting, "FAN", 2)
    draw = np.random.default_rng(4)
    rows = labelled(draw, {"a": 40, "b": 7, "c": 23})
    layers = drawn(draw, shapes)
    found, means = fitting.fit_head(spark.createDataFrame(rows, ROWS).repartition(5), layers, steps=3, rate=0.05, tile=tile)
    known = [r for r in rows if r[3] is not None]
    pos_weight = sum(r[3] == 0 for r in known) / sum(r[3] == 1 for r in known)
    values, state, plain = fitting.flat(layers), {}, []
    for _ in range(3):
        total = np.zeros(len(values) + 2)
        for p in "abc":
            own = [r for r in rows if r[0] == p]
            slopes, loss, n = fitting.gradient(np.array([r[2] for r in own], dtype=np.float32).astype(float), np.array([np.nan if r[3] is None else r[3] for r in own], dtype=float), fitting.shaped(values, layers), "relu", pos_weight)
            total += np.r_[slopes, loss, n]
        plain.append(total[-2] / total[-1])
        values = fitting.adam(values, total[:-2] / total[-1], state, 0.05, 0.01)
    assert np.allclose(fitting.flat(found), values, atol=1e-9) and np.allclose(means, plain) and means[-1] < means[0]


def test_a_task_gives_one_sum_however_many_tiles_it_has(spark, monkeypatch):
    seen, write = [], fitting.written

    def spied(df, name, *more):
        if name == "gradients":
            seen.append((df._jdf.queryExecution().executedPlan().toString(), df.groupBy("part").count().collect()))
        return write(df, name, *more)

    monkeypatch.setattr(fitting, "written", spied)
    draw = np.random.default_rng(8)
    fitting.fit_head(spark.createDataFrame(labelled(draw, {"a": 60, "b": 25}), ROWS), drawn(draw, WIDE), steps=1, tile=2)
    (plan, counts), = seen
    assert "FlatMapGroupsInPandas" not in plan and plan.count("MapInPandas") == 1
    assert counts and all(r["count"] == 1 for r in counts)


@pytest.mark.parametrize("most", [1, 2, 3, 7, 100])
def test_tiles_are_whole_whatever_batches_they_come_in(most):
    sizes = [3, 1, 1, 6, 2]
    rows = pd.DataFrame({"tile": np.repeat(range(5), sizes), "at": np.concatenate([range(n) for n in sizes])})
    rows["_first"] = rows["at"] == 0
    batches = [rows.iloc[:0], *(rows.iloc[k : k + most] for k in range(0, len(rows), most)), rows.iloc[:0]]
    found = [(group["tile"].tolist(), group["at"].tolist()) for group in tiling.tiles(iter(batches))]
    assert found == [([i] * n, list(range(n))) for i, n in enumerate(sizes)]
    assert list(tiling.tiles(iter([rows.iloc[:0]]))) == []


def test_fitted_head_ranks_positives_first_and_empty_fits_change_nothing(spark):
    draw = np.random.default_rng(5)
    rows = spark.createDataFrame(labelled(draw, {"a": 300}), ROWS)
    layers, means = fitting.fit_head(rows, drawn(draw, DENSE), steps=30, rate=0.05)
    logits = scoring.mlp_logits(rows, layers).groupBy("label").agg(F.avg("logit").alias("m")).where("label is not null").collect()
    by = {r["label"]: r["m"] for r in logits}
    assert by[1] > by[0] + 1 and means[-1] < 0.7 * means[0]
    start = drawn(draw, WIDE)
    assert (fitting.flat(fitting.fit_head(rows.limit(0), start, pos_weight=1.0, steps=2)[0]) == fitting.flat(start)).all()
    with pytest.raises(ValueError, match="no positive"):
        fitting.fit_head(rows.where("label = 0"), start)


def test_sample_of_five_thousand_is_the_smallest_draws(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 50 != 0, "big").alias("g"), F.when(F.col("id") % 7 == 0, 1).when(F.col("id") % 11 != 0, 0).alias("label"), F.col("id").cast("string").alias("k"))
    found = losses.capped_sample(rows, ["g"], F.col("k"), 5000).collect()
    import hashlib
    from collections import defaultdict

    groups = defaultdict(list)
    for i in range(60_000):
        label = 1 if i % 7 == 0 else 0 if i % 11 else None
        if label is not None:
            groups["big" if i % 50 else None, label].append((hashlib.md5(f"{i}:0".encode()).hexdigest(), str(i)))
    want = sorted((str(g), label, k) for (g, label), draws in groups.items() for _, k in sorted(draws)[:5000])
    assert sorted((str(r["g"]), r["label"], r["k"]) for r in found) == want
    assert losses.capped_sample(rows, [], F.col("k"), 3).count() == 6


def test_contrastive_loss_in_tiles_is_that_of_one_matrix(spark):
    draw = np.random.default_rng(6)
    rows = [(g, draw.normal(size=4).tolist(), int(draw.integers(0, 3))) for g, n in (("a", 30), ("b", 9), (None, 12), ("one", 1)) for _ in range(n)]
    rows += [("flat", [1.0, 0.0, 0.0, 0.0], 1)] * 5 + [("zero", [0.0] * 4, 1), ("zero", [1.0, 0.0, 0.0, 0.0], 2), ("zero", [0.0] * 4, 2)]

    def plain(x, y):
        if len(y) < 2 or len(set(y)) < 2:
            return 0.0
        x = np.array(x) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        z = x @ x.T / 0.1
        z -= z.max(axis=1, keepdims=True)
        apart = ~np.eye(len(y), dtype=bool)
        logs = z - np.log((np.exp(z) * apart).sum(axis=1, keepdims=True) + 1e-12)
        partners = (np.array(y)[:, None] == np.array(y)) & apart
        has = partners.any(axis=1)
        return float(-((logs * partners).sum(axis=1)[has] / partners.sum(axis=1)[has]).mean()) if has.any() else 0.0

    df = spark.createDataFrame(rows, "g string, embedding array<double>, label int")
    want = {g: (len(own), plain([r[1] for r in own], [r[2] for r in own])) for g in {r[0] for r in rows} for own in [[r for r in rows if r[0] == g]]}
    for block in (1, 8, 1024):
        found = {r["g"]: (r["n"], r["loss"]) for r in losses.contrastive_loss(df, ["g"], block=block).collect()}
        assert found.keys() == want.keys() and all(found[g][0] == n and abs(found[g][1] - v) < 1e-9 for g, (n, v) in want.items())
    assert losses.contrastive_loss(df.limit(0), ["g"]).count() == 0


def test_context_means_cost_the_same_for_any_radius(spark):
    draw = np.random.default_rng(7)
    rows = [(p, 3 * i, draw.normal(size=2).astype(np.float32).tolist(), i) for p, n in (("a", 40), ("b", 1), ("c", 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "protein_id string, position int, embedding array<float>, extra int")
    for radius, include, tile in ((1, False, 4096), (3, True, 4), (5, False, 2), (0, False, 3)):
        found = {(r["protein_id"], r["position"]): r["context"] for r in windows.context_mean(df, radius, include, tile).collect()}
        assert len(found) == len(rows)
        for p, at, x, i in rows:
            near = [r[2] for r in rows if r[0] == p and abs(r[3] - i) <= radius and (include or r[3] != i)] or [x]
            assert np.allclose(found[p, at], x + np.mean(near, axis=0).tolist(), atol=1e-6)
    many = spark.range(30_000).select(F.lit("p").alias("protein_id"), F.col("id").cast("int").alias("position"), F.array_repeat(F.rand(1).cast("float"), 16).alias("embedding")).cache()
    many.count()
    took = {}
    for radius in (1, 50, 1, 50):
        began = time.perf_counter()
        windows.context_mean(many, radius).agg(F.sum(F.get("context", F.lit(20)))).collect()
        took[radius] = time.perf_counter() - began
    assert took[50] < 2 * took[1] + 0.5

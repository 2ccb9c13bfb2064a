"""Window plans, crops, neighbourhood features and overlap merging."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.expressions import low_complexity, safe_key
from seqweave.functions.intervals import points_in_spans
from seqweave.functions.tiling import opened, with_halos
from seqweave.operators.joins import chunk_groups


def sliding_starts(length: Column, width: int, stride: int) -> Column:
    """0, stride, .. and a last window that ends with the sequence; [0] if one window covers it."""
    last, step = length - width, max(1, stride)
    starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))  # in order; the last window is missing unless the stride meets it
    return F.when(last <= 0, F.array(F.lit(0))).when(last % step == 0, starts).otherwise(F.array_append(starts, last))


def met_starts(start: Column, end: Column, length: Column, width: int, stride: int) -> Column:
    """Those of sliding_starts() whose windows share a position with the span [start, end) of the same sequence, by arithmetic alone."""
    last, step = length - width, max(1, stride)
    before = start - width  # a window that begins here ends where the span begins
    first = F.greatest(F.lit(0), before - F.pmod(before, F.lit(step)) + step)
    upto = F.least(end - 1, last)
    regular = F.when(first <= upto, F.sequence(first, F.greatest(first, upto), F.lit(step))).otherwise(F.array().cast("array<int>"))
    closing = (last % step != 0) & (last > before) & (last < end)
    none = (end <= start) | (start >= length) | (end <= 0)
    return F.when(none, F.array().cast("array<int>")).when(last <= 0, F.array(F.lit(0))).when(closing, F.array_append(regular, last)).otherwise(regular)


def tumbling_starts(length: Column, width: int) -> Column:
    """Windows that don't overlap; the last may be short."""
    if width <= 0:
        raise ValueError("the width must be positive")
    return F.when(length > 0, F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), F.lit(width))).otherwise(F.array().cast("array<int>"))


def evaluation_starts(records: DataFrame, width: int, stride: int | None = None, top: int = 4) -> DataFrame:
    """protein_id, starts: windows that cover the sequence, and the top windows by low complexity.

    Candidate centres lie max(8, width // 4) apart; ties of the score go to the later centre. For odd widths the last
    candidate may be one symbol short, and is scored by its real length.
    """
    n, half, last = F.length("sequence"), width // 2, F.length("sequence") - width
    cover = sliding_starts(n, width, stride or max(1, half))
    centres = F.sequence(F.lit(half), F.greatest(n - half, F.lit(half)), F.lit(max(8, width // 4)))
    rated = F.transform(centres, lambda c: F.struct(low_complexity(F.substring(F.col("sequence"), c - half + 1, F.lit(width))).alias("score"), c.alias("centre")))
    best = F.slice(F.sort_array(rated, asc=False), 1, top)
    extra = F.transform(best, lambda x: F.greatest(F.lit(0), F.least(x["centre"] - half, last)))
    return records.select("protein_id", F.when(last <= 0, F.array(F.lit(0))).otherwise(F.array_sort(F.array_union(cover, extra))).alias("starts"))


def windows(records: DataFrame, starts: Column, width: int) -> DataFrame:
    """protein_id, window_ix (from 0), start (from 0), end_exclusive, length.

    The outer form of the generator keeps Spark from inferring a filter on the size of starts, which would compute the
    sequence again for every row that is scanned.
    """
    rows = records.select("protein_id", F.length("sequence").alias("n"), starts.alias("starts")).select("protein_id", "n", F.posexplode_outer("starts").alias("window_ix", "start")).where("start is not null")
    end = F.least(F.col("start") + width, F.col("n"))
    return rows.select("protein_id", "window_ix", "start", end.alias("end_exclusive"), (end - F.col("start")).alias("length"))


def window_positions(spans: DataFrame) -> DataFrame:
    """Windows with a row per position (from 1), for windows that carry no more than their bounds."""
    return spans.select("*", F.explode(F.sequence(F.col("start") + 1, F.col("end_exclusive"))).alias("position"))


def window_slices(residues: DataFrame, spans: DataFrame, width: int | None = None) -> DataFrame:
    """Every position with each window of its sequence that covers it: residues' columns and the windows' own.

    width is that of the widest window, where it is known. Both sides are shuffled as they are, a window in one or two bins; rows are multiplied only behind the exchange.
    """
    return points_in_spans(residues, spans, ["protein_id"], F.col("position") - 1, "start", "end_exclusive", width)


def training_crop(records: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """protein_id, start, sequence, labels: one crop, centred on the span of positives; without any, at a seeded place."""
    n = F.length("sequence")
    first, last = F.locate("1", F.col("labels")) - 1, n - F.locate("1", F.reverse("labels"))
    centred = F.floor((first + last) / 2).cast("int") - width // 2
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", "protein_id", F.lit(str(seed)))), 1, 8), 16, 10).cast("long") % (n - width + 1)
    start = F.when(n <= width, 0).when(F.contains("labels", F.lit("1")), F.greatest(F.lit(0), F.least(centred, n - width))).otherwise(drawn).cast("int")
    return records.withColumn("start", start).select("protein_id", "start", F.substring("sequence", F.col("start") + 1, F.lit(width)).alias("sequence"), F.substring("labels", F.col("start") + 1, F.lit(width)).alias("labels"))


def positive_runs(residues: DataFrame) -> DataFrame:
    """protein_id, run_start, run_end (positions, inclusive): maximal runs of positive labels."""
    island = F.col("position") - F.row_number().over(Window.partitionBy("protein_id").orderBy("position"))
    return residues.where("label = 1").withColumn("island", island).groupBy("protein_id", "island").agg(F.min("position").alias("run_start"), F.max("position").alias("run_end")).drop("island")


def window_scores(residues: DataFrame, spans: DataFrame, penalty: float = 3.0) -> DataFrame:
    """spans with positives, cuts (runs of positives that a window's edge cuts), score = positives - penalty x cuts.

    A window cuts a run at its left edge if positions start and start + 1 are both positive, at its right edge
    likewise; a run that sticks out on both sides is one cut. So two equi-joins with the positions that a run goes
    on from decide, whatever the number of runs and windows in a sequence.
    """
    at = window_positions(spans).join(residues.select("protein_id", "position", "label"), ["protein_id", "position"], "left")
    positives = at.groupBy("protein_id", "start").agg(F.count_if(F.col("label") == 1).alias("positives"))
    goes_on = positive_runs(residues).where("run_end > run_start")
    goes_on = goes_on.select("protein_id", "run_start", F.explode(F.sequence(F.col("run_start"), F.col("run_end") - 1)).alias("edge"))
    left = goes_on.select("protein_id", F.col("edge").alias("start"), F.col("run_start").alias("_left"))
    right = goes_on.select("protein_id", F.col("edge").alias("end_exclusive"), F.col("run_start").alias("_right"))
    out = spans.join(positives, ["protein_id", "start"]).join(left, ["protein_id", "start"], "left").join(right, ["protein_id", "end_exclusive"], "left")
    both = F.coalesce(F.col("_left") == F.col("_right"), F.lit(False))
    cuts = F.col("_left").isNotNull().cast("int") + F.col("_right").isNotNull().cast("int") - both.cast("int")
    return out.withColumn("cuts", cuts).drop("_left", "_right").withColumn("score", F.col("positives") - F.lit(penalty) * F.col("cuts"))


def best_training_window(scored: DataFrame, seed: int = 0) -> DataFrame:
    """The window of each sequence with the best score; a keyed hash chooses among those within 1e-9 of it."""
    best = F.max("score").over(Window.partitionBy("protein_id"))
    draw = F.md5(F.concat_ws(":", "protein_id", F.col("start").cast("string"), F.lit(str(seed))))
    nth = F.row_number().over(Window.partitionBy("protein_id").orderBy(draw, "start"))
    return scored.withColumn("best", best).where(F.col("score") >= F.col("best") - 1e-9).withColumn("nth", nth).where("nth = 1").drop("best", "nth")


def context_concat(rows: DataFrame, radius: int, width: int, by: list[str] = ("protein_id",), include_self: bool = True) -> DataFrame:
    """rows with context: the vectors at offsets -radius..radius side by side, zeros outside.

    by decides what outside is: ["protein_id"] takes neighbours from the full sequence, ["protein_id", "window_ix"]
    only from the window. radius 0 gives the vector itself.
    """
    along = Window.partitionBy(*by).orderBy("position")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), width)
    parts = []
    for k in range(-radius, radius + 1):
        if k or include_self or not radius:
            near = F.lag("embedding", -k).over(along) if k < 0 else F.lead("embedding", k).over(along) if k else F.col("embedding")
            parts.append(F.coalesce(F.lag("embedding", -k).over(along), zeros) if k < 0 else F.coalesce(near, zeros))
    return rows.withColumn("context", F.concat(*parts))


def context_mean(rows: DataFrame, radius: int, include_self: bool = False, tile: int = 4096) -> DataFrame:
    """rows with context: the vector, then the mean of its neighbours; itself counts only if asked or if alone.

    Neighbours are those at most radius places away in order of position. A sequence is cut into tiles, each with a
    halo as wide as the radius; in a tile, running sums of vectors are taken once, and every mean is a difference of
    two of them, so its cost doesn't grow with the radius. Vectors of a sequence must have one length.
    """
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy("protein_id").orderBy("position")))
    kinds, columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), rows.columns

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group, own = opened(group, tile, "_place")
        x = np.stack(group["embedding"].to_numpy())
        sums = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0, dtype=np.float64)])
        at = np.arange(len(x))
        low, high = np.maximum(at - radius, 0), np.minimum(at + radius + 1, len(x))
        total, n = sums[high] - sums[low], high - low
        if not include_self:
            others = n > 1
            total, n = np.where(others[:, None], total - x, total), np.where(others, n - 1, n)
        out = group.loc[own, columns].copy()
        out["context"] = pd.Series(list(np.concatenate([x, total / n[:, None]], axis=1).astype(np.float32)[own]), index=out.index, dtype=object)
        return out

    return with_halos(placed, tile, radius, "_place").groupBy("protein_id", "_tile").applyInPandas(one, f"{kinds}, context array<float>")


def chunk_index(records: DataFrame, width: int, overlap: int, stored: DataFrame | None = None) -> DataFrame:
    """chunk_id, protein_id, chunk_index_1based, start, end_exclusive, length, status (skipped where already stored)."""
    rows = windows(records, sliding_starts(F.length("sequence"), width, max(1, width - overlap)), width)
    rows = rows.withColumn("chunk_index_1based", F.col("window_ix") + 1).withColumn("chunk_id", F.concat_ws("_", "protein_id", F.col("chunk_index_1based").cast("string")))
    if stored is None:
        rows = rows.withColumn("status", F.lit("written"))
    else:
        rows = rows.join(stored.select("chunk_id").distinct().withColumn("_has", F.lit(True)), "chunk_id", "left").withColumn("status", F.when(F.col("_has"), "skipped").otherwise("written"))
    return rows.select("chunk_id", "protein_id", "chunk_index_1based", "start", "end_exclusive", "length", "status")


def merge_windows(residues: DataFrame, scores: DataFrame) -> DataFrame:
    """residues (protein_id, position) with logit: the mean over the windows that cover it, 0 where none does.

    scores: protein_id, position, logit; positions that residues lacks are ignored.
    """
    mean = scores.groupBy("protein_id", "position").agg(F.avg("logit").alias("logit"))
    return residues.join(mean, ["protein_id", "position"], "left").withColumn("logit", F.coalesce("logit", F.lit(0.0)))


def concat_chunks(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """protein_id, position, embedding from chunk rows (protein_id, start, offset, embedding) of windows that don't
    overlap; raises if a sequence's rows don't add up to its length."""
    rows = chunks.select("protein_id", (F.col("start") + F.col("offset") + 1).alias("position"), "embedding")
    n = rows.groupBy("protein_id").agg(F.count("*").alias("rows"), F.max("position").alias("last"))
    off = n.join(records.select("protein_id", F.length("sequence").alias("n")), "protein_id").where((F.col("rows") != F.col("n")) | (F.col("last") != F.col("n")))
    if not off.isEmpty():
        raise ValueError("chunks don't add up to the sequence length")
    return rows


def merge_report(chunks: DataFrame, records: DataFrame, width: int, dry_run: bool = False) -> DataFrame:
    """protein_id, seq_len, num_windows, old_chunk_indices (sorted), output, dry_run: what merging stored chunks
    (chunk_id: <id>_<number>) into whole sequences does, or with dry_run would do. A chunk of an unknown sequence raises."""
    groups = chunk_groups(chunks, records).select("protein_id", "indices", "known")
    lost = F.raise_error(F.concat(F.lit("chunks of an unknown sequence: "), "protein_id")).cast("array<int>")
    rows = groups.join(records.select("protein_id", F.length("sequence").alias("seq_len")), "protein_id", "left")
    windows_ = F.ceil(F.col("seq_len") / width).cast("int")
    return rows.select(
        "protein_id", "seq_len", windows_.alias("num_windows"), F.when(F.col("known"), F.col("indices")).otherwise(lost).alias("old_chunk_indices"),
        F.concat(safe_key(F.col("protein_id")), F.lit(".resfeat.txt")).alias("output"), F.lit(dry_run).alias("dry_run"),
    )


def merge_summary(report: DataFrame) -> DataFrame:
    """merged_proteins, deleted_chunk_files, chunk_stems_found over a merge report; nothing is merged in a dry run."""
    done = ~F.col("dry_run")
    return report.agg(F.count_if(done).alias("merged_proteins"), F.coalesce(F.sum(F.when(done, F.size("old_chunk_indices")).otherwise(0)), F.lit(0)).alias("deleted_chunk_files"), F.count("*").alias("chunk_stems_found"))

"""Greedy choice of spans that don't overlap, for groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.ordering import numbered
from seqweave.functions.shared import cut, written

#: Matches of one sequence that one task takes in order; the starts of a longer list are cut into blocks of so many.
BLOCK = 1 << 18
SPAN = "protein_id string, motif_order int, motif_id string, token string, start int, end int"


def first_at_start(found: DataFrame) -> DataFrame:
    """The match that counts at each start: the longest, then library order, then id. Those behind it overlap it."""
    rest = F.struct((F.col("start") - F.col("end")).alias("minus"), "motif_order", "motif_id", "end", "token")
    return found.groupBy("protein_id", "start").agg(F.min(rest).alias("x")).select("protein_id", "x.motif_order", "x.motif_id", "x.token", "start", "x.end")


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The choice over rows in order of sequence and start, the longest first; the end of the last one taken is all that is kept."""
    now, upto = None, 0
    for batch in batches:
        taken = []
        for i, (p, start, end) in enumerate(zip(batch["protein_id"].tolist(), batch["start"].tolist(), batch["end"].tolist(), strict=True)):
            if p != now:
                now, upto = p, 0
            if start >= upto:
                upto = end
                taken.append(i)
        yield batch.iloc[taken]


def _short(found: DataFrame) -> DataFrame:
    order = ["protein_id", "start", F.col("start") - F.col("end"), "motif_order", "motif_id"]
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(n, "protein_id").sortWithinPartitions(*order).mapInPandas(_streamed, SPAN)


def _exits(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each span of a block: where the choice that begins with it leaves the block, by the next compatible span."""
    following, out = np.searchsorted(starts, ends).tolist(), ends.tolist()
    for i in range(len(out) - 1, -1, -1):
        if following[i] < len(out):
            out[i] = out[following[i]]
    return np.array(out, dtype=np.int64)


def _leaving(rows: pd.DataFrame) -> pd.DataFrame:
    """A block's sequences that may go on beyond it (kind 0, with their last start), and where choices leave it: all
    (kind 1) and the one that takes the first span (kind 2)."""
    rows = rows.sort_values("row")
    block, ids = rows["block"].iloc[0], rows["protein_id"].to_numpy()
    out = [(p, block, int(rows["start"].to_numpy()[ids == p].max()), 0) for p in {ids[0], ids[-1]}]
    own = rows[ids == ids[-1]]
    exits = _exits(own["start"].to_numpy(), own["end"].to_numpy())
    out += [(ids[-1], block, int(e), 1) for e in np.unique(exits)] + [(ids[-1], block, int(exits[0]), 2)]
    return pd.DataFrame(out, columns=["protein_id", "block", "at", "kind"])


NONE_STEPPED = {"protein_id": np.zeros(0, dtype=object), **{c: np.zeros(0, dtype=np.int64) for c in ("block", "at", "after")}}


def _stepped(rows: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
    """Where a choice that enters a block at a position leaves it, if the block is one sequence's alone."""
    rows = rows.sort_values("row")
    starts, ids = rows["start"].to_numpy(), rows["protein_id"].to_numpy()
    if not len(nodes) or ids[0] != ids[-1]:
        return pd.DataFrame(NONE_STEPPED)
    exits = _exits(starts, rows["end"].to_numpy())
    return nodes.assign(after=exits[np.searchsorted(starts, nodes["at"].to_numpy())])


def _taken(rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
    """The spans chosen in a block. entry: where the choice of a sequence that began earlier enters, null if it passes
    the block by; no row if the block's first sequence begins in it."""
    if not len(rows):
        return rows
    rows = rows.sort_values("row")
    starts, ids, chosen = rows["start"].to_numpy(), rows["protein_id"].to_numpy(), []
    edges = np.r_[np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]), len(ids)]
    for a, b in zip(edges, edges[1:], strict=False):
        here, following = starts[a:b], np.searchsorted(starts[a:b], rows["end"].to_numpy()[a:b])
        i = 0
        if a == 0 and len(entry):
            at = entry["at"].iloc[0]
            i = len(here) if pd.isna(at) else int(np.searchsorted(here, at))
        while i < len(here):
            chosen.append(a + i)
            i = int(following[i])
    return rows.iloc[chosen]


def _long(best: DataFrame, block: int) -> DataFrame:
    """The same choice over blocks of starts: each block says where choices leave it, and one that enters at which
    position comes out where; these few links between blocks are then followed by doubling."""
    columns = ["protein_id", "motif_order", "motif_id", "token", "start", "end"]
    rows = written(numbered(best.select(*columns), ["protein_id", "start"], "span-rows").withColumn("block", F.floor(F.col("row") / block).cast("long")), "span-blocks")
    thin = rows.select("block", "row", "protein_id", "start", "end")
    seen = written(thin.groupBy("block").applyInPandas(_leaving, "protein_id string, block long, at long, kind int"), "span-exits")
    # The block that a position leads to: the first whose last start isn't before it.
    backwards = Window.partitionBy("protein_id").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    leads = seen.withColumn("to", F.last(F.when(F.col("kind") == 0, F.col("block")), ignorenulls=True).over(backwards))
    leads = leads.withColumn("first", F.min("block").over(Window.partitionBy("protein_id")))
    exits = written(leads.where("kind > 0 and to is not null"), "span-leads")
    nodes = exits.select("protein_id", F.col("to").alias("block"), "at").distinct()
    stepped = thin.groupBy("block").cogroup(nodes.groupBy("block")).applyInPandas(_stepped, "protein_id string, block long, at long, after long")
    onward = exits.select("protein_id", F.col("at").alias("after"), F.col("to").alias("next")).distinct()
    jumps = [cut(stepped.join(onward, ["protein_id", "after"]).select("block", "at", F.col("next").alias("to_block"), F.col("after").alias("to_at")))]
    most = leads.groupBy("protein_id").agg((F.max("block") - F.min("block")).alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(int(most).bit_length()):
        once = jumps[-1]
        again = once.select(F.col("block").alias("to_block"), F.col("at").alias("to_at"), F.col("to_block").alias("block2"), F.col("to_at").alias("at2"))
        jumps.append(cut(once.join(again, ["to_block", "to_at"]).select("block", "at", F.col("block2").alias("to_block"), F.col("at2").alias("to_at"))))
    reached = cut(exits.where("kind = 2 and block = first").select(F.col("to").alias("block"), "at").distinct())
    for jump in reversed(jumps):
        further = reached.join(jump, ["block", "at"]).select(F.col("to_block").alias("block"), F.col("to_at").alias("at"))
        reached = cut(reached.unionByName(further).distinct())
    going = leads.where("kind = 0 and block > first").select("block").distinct().join(reached, "block", "left")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy("block").cogroup(going.groupBy("block")).applyInPandas(_taken, schema).select(*columns)


def greedy_spans(found: DataFrame, block: int = BLOCK) -> DataFrame:
    """Matches that don't overlap: by start, the longest, then library order; one is taken if it begins after the last taken ends.

    Sequences with at most block matches are dealt out whole and run through in order. A longer one is cut into blocks
    of starts, each handled by a task of its own. Repeated matches count once; a table without matches gives no rows.
    """
    found = written(found.select("protein_id", "motif_order", "motif_id", "token", "start", "end"), "matches")
    long = found.groupBy("protein_id").agg(F.count("*").alias("n")).where(F.col("n") > block).select("protein_id")
    if found.count() <= block or long.isEmpty():
        return _short(found)
    return _short(found.join(long, "protein_id", "left_anti")).unionByName(_long(first_at_start(found.join(long, "protein_id", "left_semi")), block))

"""Pairwise alignment, choice of structures, and comparison of predictions with labels on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.expressions import ratio


#: Rows of scores kept of a section of an alignment, and cells of a section whose moves are held at once.
KEPT, CELLS = 48, 4_000_000


class _Scores:
    """Rows of local alignment scores, one from the other. A row is filled at once: without horizontal gaps first, then
    the best chain of gaps from the left as a running maximum of (score - gap x column)."""

    def __init__(self, q: np.ndarray, s: np.ndarray, match: int, mismatch: int, gap: int) -> None:
        self.q, self.s, self.match, self.mismatch, self.gap = q, s, match, mismatch, gap
        self.slope = gap * np.arange(len(s) + 1, dtype=np.int32)

    def below(self, above: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row i + 1 from row i, and the scores that a diagonal step and a gap in the subject lead to; as wide as above."""
        n = len(above)
        diagonal = above[:-1] + np.where(self.s[: n - 1] == self.q[i], np.int32(self.match), np.int32(self.mismatch))
        up = above[1:] + np.int32(self.gap)
        here = np.zeros(n, dtype=np.int32)
        np.maximum(diagonal, up, out=here[1:])
        np.maximum(here, 0, out=here)
        here -= self.slope[:n]
        np.maximum.accumulate(here, out=here)
        here += self.slope[:n]
        return here, diagonal, up

    def kept(self, row: np.ndarray, low: int, high: int) -> tuple[list[tuple[int, np.ndarray]], tuple[int, int, int]]:
        """Some rows from low to high - 1, each with its number, and the first best cell after low: score, row, column."""
        step, out, best = max(1, -(-(high - low) // KEPT)), [], (0, 0, 0)
        for i in range(low, high):
            if (i - low) % step == 0:
                out.append((i, row))
            row, *_ = self.below(row, i)
            top = int(row.argmax())
            if row[top] > best[0]:
                best = (int(row[top]), i + 1, top)
        return out, best

    def back(self, rows: list[tuple[int, np.ndarray]], i: int, j: int, pairs: list[tuple[int, int]]) -> tuple[int, int]:
        """Follow the moves from cell (i, j) up to the first row kept or the alignment's start; where it comes out.

        The last section's moves are found anew from its kept row, only as wide as the path can reach; a section with
        too many cells keeps rows of its own first. So memory grows with the sum of both lengths. Ties prefer the
        diagonal, then the gap in the subject.
        """
        for low, row in reversed(rows):
            if low >= i:
                continue
            row = row[: j + 1]
            if (i - low) * len(row) > CELLS and i - low > 1:
                i, j = self.back(self.kept(row, low, i)[0], i, j, pairs)
            else:
                moves = np.zeros((i - low, len(row)), dtype=np.int8)
                for k in range(low, i):
                    row, diagonal, up = self.below(row, k)
                    left, move = row[:-1] + np.int32(self.gap), moves[k - low, 1:]
                    move[left > 0] = 3
                    move[(up > 0) & (up >= left)] = 2
                    move[(diagonal > 0) & (diagonal >= up) & (diagonal >= left)] = 1
                while i > low and j > 0 and (move := moves[i - low - 1, j]):
                    if move == 1:
                        pairs.append((i, j))
                    i, j = i - (move != 3), j - (move != 2)
                del moves
            if i > low or j == 0:  # it began inside this section
                return -1, 0
        return i, j


def local_alignment(query: str, subject: str, match: int = 2, mismatch: int = -1, gap: int = -2) -> tuple[list[tuple[int, int]], int, float]:
    """(pairs of positions from 1, score, identity) of the best local alignment with a linear gap, case ignored.

    Of several best ends the first in row order counts; ties on the way prefer the diagonal, then the gap in the
    subject. Memory grows with the lengths, not with their product: only some rows of scores are kept, and the moves
    between two of them are found anew on the way back.
    """
    q, s = np.frombuffer(query.upper().encode("utf-32-le"), dtype=np.uint32), np.frombuffer(subject.upper().encode("utf-32-le"), dtype=np.uint32)
    if not len(q) or not len(s):
        return [], 0, 0.0
    scores = _Scores(q, s, match, mismatch, gap)
    rows, (best, i, j) = scores.kept(np.zeros(len(s) + 1, dtype=np.int32), 0, len(q))
    pairs: list[tuple[int, int]] = []
    scores.back(rows, i, j, pairs)
    same = sum(q[a - 1] == s[b - 1] for a, b in pairs)
    return pairs[::-1], best, same / len(pairs) if pairs else 0.0


def align_pairs(pairs: DataFrame) -> DataFrame:
    """pair_id, score, identity, mapped, query_length, pairs (array of query_pos, subject_pos) of (pair_id, query, subject)."""

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for pair, query, subject in zip(batch["pair_id"], batch["query"], batch["subject"], strict=True):
                found, score, identity = local_alignment(query or "", subject or "")
                rows.append((pair, score, identity, len(found), len(query or ""), [{"query_pos": a, "subject_pos": b} for a, b in found]))
            yield pd.DataFrame(rows, columns=["pair_id", "score", "identity", "mapped", "query_length", "pairs"])

    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.select("pair_id", "query", "subject").repartition(n, "pair_id").mapInPandas(align, "pair_id string, score int, identity double, mapped int, query_length int, pairs array<struct<query_pos:int,subject_pos:int>>")


def best_structure(candidates: DataFrame) -> DataFrame:
    """The candidate of each protein_id with the largest (coverage, mapped, identity), first in source_order; nothing mapped: dropped."""
    rows = candidates.where("mapped > 0").withColumn("coverage", F.col("mapped") / F.greatest(F.col("query_length"), F.lit(1)))
    nth = F.row_number().over(Window.partitionBy("protein_id").orderBy(F.desc("coverage"), F.desc("mapped"), F.desc("identity"), "source_order"))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def positional_fallback(records: DataFrame, residues: DataFrame) -> DataFrame:
    """protein_id, chain, query_pos, subject_pos, same: position by position on the alphabetically first chain.

    residues: protein_id, chain, subject_pos, symbol.
    """
    first = residues.groupBy("protein_id").agg(F.min("chain").alias("chain"))
    own = residues.join(first, ["protein_id", "chain"])
    joined = own.join(records.select("protein_id", "sequence"), "protein_id").where(F.col("subject_pos") <= F.length("sequence"))
    same = F.upper(F.substring(F.col("sequence"), F.col("subject_pos"), F.lit(1))) == F.upper("symbol")
    return joined.select("protein_id", "chain", F.col("subject_pos").alias("query_pos"), "subject_pos", same.alias("same"))


def choose_source(records: DataFrame, best: DataFrame, fallback: DataFrame, min_coverage: float = 0.5) -> DataFrame:
    """protein_id, source (RCSB, AlphaFold, Failed), reason: the aligned structure, or why not, and whether a fallback serves."""
    has = fallback.select("protein_id").distinct().withColumn("_back", F.lit(True))
    rows = records.select("protein_id").join(best.select("protein_id", "coverage"), "protein_id", "left").join(has, "protein_id", "left")
    good = F.col("coverage") >= min_coverage
    reason = F.when(F.col("coverage").isNull(), "no structure").when(~good, "low coverage").otherwise("")
    return rows.select("protein_id", F.when(good, "RCSB").when(F.col("_back"), "AlphaFold").otherwise("Failed").alias("source"), reason.alias("reason"))


def compared(residues: DataFrame, positions: DataFrame) -> DataFrame:
    """residues with status: unmapped, unknown (masked), or tp, fp, fn, tn.

    residues: protein_id, chain, query_pos (null: unmapped); positions: protein_id, position, label, pred_label.
    """
    at = positions.select("protein_id", F.col("position").alias("query_pos"), "label", "pred_label")
    rows = residues.join(at, ["protein_id", "query_pos"], "left")
    hit = F.coalesce("pred_label", F.lit(0)) == 1
    status = F.when(F.col("query_pos").isNull(), "unmapped").when(F.col("label").isNull(), "unknown").when(hit & (F.col("label") == 1), "tp").when(hit, "fp").when(F.col("label") == 1, "fn").otherwise("tn")
    return rows.withColumn("status", status)


def comparison_totals(rows: DataFrame) -> DataFrame:
    """Counts, precision, recall, f1 per protein and, with a null protein_id, in total."""
    counts = rows.rollup("protein_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("tp", "fp", "fn", "tn", "unknown", "unmapped")))
    out = counts.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def manifest(choices: DataFrame, totals: DataFrame) -> DataFrame:
    """A row for each sequence: where its structure comes from, how much of it is mapped, and how the labels compare.

    choices: protein_id, uniprot, source_type, structure_id, chain, mapped_count, coverage, fallback_reason.
    totals: comparison_totals; a sequence without any has zeros.
    """
    counts, ratios = ("tp", "fp", "fn", "tn", "unknown"), ("precision", "recall", "f1")
    rows = choices.join(totals.where("protein_id is not null").select("protein_id", *counts, *ratios), "protein_id", "left")
    named = ("protein_id", "uniprot", "source_type", "structure_id", "chain", "mapped_count", "coverage", "fallback_reason")
    return rows.select(*named, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ratios))


def manifest_summary(rows: DataFrame) -> DataFrame:
    """One row over a manifest: sequences by source, those with a structure, and the counts and ratios in total."""
    by = {"num_rcsb": "RCSB", "num_alphafold": "AlphaFold", "num_failed": "Failed"}
    sums = rows.agg(F.count("*").alias("num_total"), *(F.count_if(F.col("source_type") == v).alias(k) for k, v in by.items()), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "tn", "unknown")))
    out = sums.withColumn("num_success", F.col("num_total") - F.col("num_failed")).withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))

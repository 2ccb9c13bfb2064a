"""Temperature mixing of sources, realised as budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqweave.functions.shared import written
from seqweave.llm.columns import carried, unpacked

WORD = "[^\\x20\\x09-\\x0D]+"
#: Budgets of so many sources are broadcast; of more, joined like any table.
BROADCAST_SOURCES = 100_000
#: Exponents that one pass over the totals tries: five bisections at once.
TRIED = 31


@dataclass(frozen=True)
class Mix:
    """Target of the exponent (one of the two) and the size of a block in tokens.

    repetition: the flattest mix in which no source is repeated more than this many times, where the source that is
    repeated least is read once. entropy: the least flattening whose weights reach this share of the largest entropy.
    """

    repetition: float | None = 2.0
    entropy: float | None = None
    block_tokens: int = 1_000_000
    seed: int = 42


def word_tokens() -> Column:
    """Tokens of a text: runs of characters that aren't ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def bisect(good, low: float = 0.0, high: float = 1.0, steps: int = 60) -> float:
    """The end of [low, high] towards low at which good still holds; good(high) is taken as given."""
    if good(low):
        return low
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if good(middle) else (middle, high)
    return high


def entropies(totals: DataFrame, tried: list[float]) -> list[float]:
    """Entropy of the weights at each exponent, in one pass over totals (tokens)."""
    share = F.col("tokens") / totals.agg(F.sum("tokens")).first()[0]
    raised = totals.select(F.posexplode(F.array(*(F.pow(share, F.lit(a)) for a in tried))).alias("k", "x"))
    # With norm N = sum x, the entropy is log N - sum(x log x) / N.
    sums = raised.groupBy("k").agg(F.sum("x").alias("norm"), F.sum(F.when(F.col("x") > 0, F.col("x") * F.log("x")).otherwise(0.0)).alias("xlogx"))
    return [r["h"] for r in sums.select("k", (F.log("norm") - F.col("xlogx") / F.col("norm")).alias("h")).orderBy("k").collect()]


def exponent(totals: DataFrame, mix: Mix) -> float:
    """The exponent on the token shares that meets the target; 1 leaves the shares as they are, 0 makes them equal.

    totals: tokens, a row for each source. Only sums over the sources reach the driver, so there may be any number.
    """
    if (mix.repetition is None) == (mix.entropy is None):
        raise ValueError("give a repetition limit or a target entropy")
    if mix.entropy is not None and not 0 <= mix.entropy <= 1:
        raise ValueError("the target entropy is a share of the largest")
    totals = totals.where("tokens > 0").select("tokens")
    ends = totals.agg(F.count("*").alias("n"), F.min("tokens").alias("least"), F.max("tokens").alias("most")).first()
    if ends["n"] < 2:
        return 1.0
    if mix.repetition is not None:
        ratio = ends["least"] / ends["most"]
        return bisect(lambda a: ratio ** (a - 1) <= mix.repetition)
    goal, low, high = mix.entropy * math.log(ends["n"]), 0.0, 1.0
    if entropies(totals, [1.0])[0] >= goal:
        return 1.0
    while high - low > 1e-12:  # the entropy falls with the exponent
        tried = [low + (high - low) * k / (TRIED + 1) for k in range(1, TRIED + 1)]
        good = sum(h >= goal for h in entropies(totals, tried))
        low, high = ([low, *tried, high])[good : good + 2]
    return low


def _draw(*parts: Column | str) -> Column:
    """md5 of the parts, joined by colons; the same in any engine."""
    return F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts)))


def budgets(units: DataFrame, mix: Mix) -> DataFrame:
    """source, tokens, budget, epochs, blocks: normalised weights of the sources as token budgets.

    Budgets are in proportion to the weights and as small as lets every source be read in full at least once. A
    source without tokens is read once.
    """
    totals = written(units.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix-totals")
    alpha = exponent(totals, mix)
    largest = totals.agg(F.max("tokens")).first()[0] or 0
    tokens, some = F.col("tokens"), F.col("tokens") > 0
    budget = F.when(some, F.floor(tokens * F.pow(tokens / F.lit(float(largest or 1)), F.lit(alpha - 1)) + 0.5)).otherwise(0).cast("long")
    epochs = F.when(some, F.greatest(F.lit(1), F.ceil(F.col("budget") / tokens))).otherwise(1).cast("long")
    blocks = F.greatest(F.lit(1), F.ceil(tokens / F.lit(mix.block_tokens))).cast("long")
    return totals.withColumn("budget", budget).select("source", "tokens", "budget", epochs.alias("epochs"), blocks.alias("blocks"))


def mixture(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, source, epoch, block, position, slot: the order in which the mix reads documents, repeats included.

    Rows that share doc_id and source move together as one unit. Each epoch of a source permutes its blocks and the
    units inside each block by a keyed hash; a unit is read if its position (tokens of its source read before it) is
    inside the source's budget. Sorting by (slot, source, position) interleaves the sources in proportion to their
    budgets. A null source is a source of its own; null texts have no tokens and are read in every full epoch; no
    rows: no rows. Extra columns are ignored. Only a block's rows meet in a task, and per source one row per block.
    """
    units = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_tokens().alias("tokens")).groupBy("doc_id", "source").agg(F.sum("tokens").alias("tokens")), "mix-units")
    of = written(budgets(units, mix), "mix-budgets")
    seed = str(mix.seed)
    few = of.count() <= BROADCAST_SOURCES
    shares = of.select(F.col("source").alias("_of"), F.col("tokens").alias("source_tokens"), "budget", "epochs", "blocks")
    wide = units.join(F.broadcast(shares) if few else shares, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    block = F.conv(F.substring(_draw(seed, F.col("doc_id")), 1, 8), 16, 10).cast("long") % F.col("blocks")
    rows = wide.withColumn("block", block).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    inside = Window.partitionBy("source", "epoch", "block").orderBy(_draw(seed, F.col("epoch"), F.col("doc_id")), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    sizes = wide.withColumn("block", block).groupBy("source", "block").agg(F.sum("tokens").alias("block_sum"), F.max("epochs").alias("epochs"))
    sizes = sizes.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    along = Window.partitionBy("source", "epoch").orderBy(_draw(seed, F.col("epoch"), F.col("source"), F.col("block")), "block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("source").alias("_source"), F.col("epoch").alias("_epoch"), F.col("block").alias("_block"), F.coalesce(F.sum("block_sum").over(along), F.lit(0)).alias("block_at"))
    placed = rows.join(sizes, F.col("source").eqNullSafe(F.col("_source")) & (F.col("epoch") == F.col("_epoch")) & (F.col("block") == F.col("_block")))
    start = F.col("epoch") * F.col("source_tokens") + F.col("block_at")
    placed = placed.withColumn("position", start + F.col("before")).where((F.col("position") < F.col("budget")) | (F.col("epoch") == 0))
    return placed.select("doc_id", "source", "epoch", "block", "position", F.coalesce(F.try_divide(start.cast("double"), F.col("budget").cast("double")), F.lit(0.0)).alias("slot"))


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """docs as often as the mixture reads them; same columns, whatever their names. Otherwise as mixture."""
    times = mixture(docs, mix).groupBy("doc_id", "source").agg(F.count("*").alias("times"))
    own = docs.select(carried(docs).alias("own"), F.col("doc_id").cast("long").alias("doc"), F.col("source").cast("string").alias("of"))
    joined = own.join(times, F.col("doc").eqNullSafe(F.col("doc_id")) & F.col("of").eqNullSafe(F.col("source")))
    return joined.select("own", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("time")).select(*unpacked(docs, (), "own"))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, epoch, block, position, slot over all of documents; see mixture."""
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL_WITH = r"""
mix_units AS (
  SELECT doc_id, source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS tokens
  FROM {docs} GROUP BY doc_id, source),
mix_totals AS (SELECT source, sum(tokens)::BIGINT AS source_tokens FROM mix_units GROUP BY source),
mix_ends AS (SELECT min(source_tokens) FILTER (source_tokens > 0)::DOUBLE / max(source_tokens) AS ratio, max(source_tokens) AS largest FROM mix_totals),
mix_bisect AS (
  SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, ratio FROM mix_ends
  UNION ALL
  SELECT step + 1, CASE WHEN pow(ratio, (low + high) / 2 - 1) <= 2.0 THEN low ELSE (low + high) / 2 END,
         CASE WHEN pow(ratio, (low + high) / 2 - 1) <= 2.0 THEN (low + high) / 2 ELSE high END, ratio
  FROM mix_bisect WHERE step < 60),
mix_alpha AS (SELECT CASE WHEN pow(ratio, -1.0) <= 2.0 THEN 0.0 ELSE high END AS alpha FROM mix_bisect WHERE step = 60),
mix_budgets AS (
  SELECT source, source_tokens, budget, CASE WHEN source_tokens > 0 THEN greatest(1, ceil(budget::DOUBLE / source_tokens)) ELSE 1 END::BIGINT AS epochs,
         greatest(1, (source_tokens + 999999) // 1000000) AS blocks
  FROM (SELECT source, source_tokens, CASE WHEN source_tokens > 0 THEN floor(source_tokens * pow(source_tokens::DOUBLE / largest, alpha - 1) + 0.5) ELSE 0 END::BIGINT AS budget
        FROM mix_totals, mix_ends, mix_alpha)),
mix_wide AS (
  SELECT u.*, source_tokens, budget, epochs, ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % blocks AS block
  FROM mix_units u JOIN mix_budgets b ON u.source IS NOT DISTINCT FROM b.source),
mix_rows AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source, epoch, block ORDER BY md5('42:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')), doc_id
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM (SELECT *, unnest(range(epochs)) AS epoch FROM mix_wide)),
mix_blocks AS (
  SELECT source, epoch, block, coalesce(sum(block_sum) OVER (PARTITION BY source, epoch ORDER BY md5('42:' || epoch || ':' || coalesce(source, '') || ':' || block), block
                                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS block_at
  FROM (SELECT source, block, sum(tokens) AS block_sum, unnest(range(max(epochs))) AS epoch FROM mix_wide GROUP BY source, block)),
mix_plan AS (
  SELECT doc_id, r.source, r.epoch, r.block, r.epoch * source_tokens + block_at + before AS position, budget,
         coalesce((r.epoch * source_tokens + block_at)::DOUBLE / nullif(budget, 0)::DOUBLE, 0.0) AS slot
  FROM mix_rows r JOIN mix_blocks b ON r.source IS NOT DISTINCT FROM b.source AND r.epoch = b.epoch AND r.block = b.block)
"""
SQL = "WITH RECURSIVE " + SQL_WITH.format(docs="documents").strip() + "\nSELECT doc_id, source, epoch, block, position, slot FROM mix_plan WHERE position < budget OR epoch = 0\n"

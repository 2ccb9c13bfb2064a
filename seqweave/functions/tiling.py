"""Long windows cut into tiles, each with what its neighbours must lend it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_halos(rows: DataFrame, tile: int, reach: int, position: str = "position") -> DataFrame:
    """rows with _tile: each position (from 1) in its own tile of so many, and in those that begin or end within reach of it."""
    near = F.floor((F.col(position) - 1 - reach) / tile), F.floor((F.col(position) - 1 + reach) / tile)
    return rows.withColumn("_tile", F.explode(F.sequence(*near)))


def opened(group: pd.DataFrame, tile: int, position: str = "position") -> tuple[pd.DataFrame, np.ndarray]:
    """A tile's rows in order, and which of them are its own; raises where positions have a gap or repeat."""
    group = group.sort_values(position)
    at = group[position].to_numpy()
    if (np.diff(at) != 1).any():
        raise ValueError("the positions of a window have a gap or repeat")
    return group, (at - 1) // tile == group["_tile"].iloc[0]


def in_order(rows: DataFrame, by: tuple[str, ...], position: str = "position") -> DataFrame:
    """Rows of with_halos() with _first: each tile whole in one task and in order, its first row marked."""
    return rows.withColumn("_first", F.row_number().over(Window.partitionBy(*by, "_tile").orderBy(position)) == 1)


def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The tiles of rows from in_order(), whatever batches these come in; one batch and one tile are held."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        cuts = np.flatnonzero(batch["_first"].to_numpy(dtype=bool)).tolist()
        for k, (low, high) in enumerate(zip([0, *cuts], [*cuts, len(batch)], strict=True)):
            if k and held:  # what comes before the first mark belongs to the tile that is held
                yield pd.concat(held)
                held = []
            if high > low:
                held.append(batch.iloc[low:high])
    if held:
        yield pd.concat(held)

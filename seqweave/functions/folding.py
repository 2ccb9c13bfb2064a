"""Sequential passes over arrays by built-in functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def folded(items: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """array<kind> of what a pass over items gives; step(state, item) says the next state, whether to keep, and what.

    aggregate() copies its state at each step, and an array that grows in it would take quadratic time. So items are
    cut into about sqrt(n) runs: a first pass keeps the state alone, where each run begins, and a second one collects
    inside each run. state must be small.
    """

    def go(items: Column) -> Column:
        n = F.greatest(F.ceil(F.sqrt(F.size(items))).cast("int"), F.lit(16))
        runs = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / n).cast("int")), lambda i: F.slice(items, i * n + 1, n))
        return bound(runs, lambda runs: bound(starts(runs), lambda states: F.flatten(F.transform(runs, lambda run, i: collected(run, F.get(states, i))))))

    def starts(runs: Column) -> Column:
        return F.aggregate(runs, F.array(state), lambda seen, run: F.array_append(seen, F.aggregate(run, F.element_at(seen, -1), lambda s, x: step(s, x)[0])))

    def collected(run: Column, start: Column) -> Column:
        def merge(so_far: Column, x: Column) -> Column:
            after, keep, what = step(so_far["state"], x)
            return F.struct(after.alias("state"), F.when(keep, F.array_append(so_far["kept"], what.cast(kind))).otherwise(so_far["kept"]).alias("kept"))

        return F.aggregate(run, F.struct(start.alias("state"), F.array().cast(f"array<{kind}>").alias("kept")), merge, lambda x: x["kept"])

    return bound(items, go)

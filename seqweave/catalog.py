"""Registered queries of the position-labelling operators, with their SQL."""

from __future__ import annotations

from seqweave.plans import evaluation, files, modelling, motifs, preparation, windowing  # noqa: F401  (they register their queries)
from seqweave.plans.registry import QUERIES, SQL

FLAGSHIP = "a10_evaluation_summary"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

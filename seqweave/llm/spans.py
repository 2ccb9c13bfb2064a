"""Places of regular expressions in texts, by built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqweave.functions.folding import bound as bound
from seqweave.functions.folding import folded as folded


def match_spans(text: Column, pattern: Column) -> Column:
    """array<struct<start:int,end:int,match:string>> of the leftmost non-overlapping matches, in code points.

    What stands between the matches comes from split, the matches from regexp_extract_all; added up they give the
    places. pattern must not match the empty string. Null text: null. Time grows with the text and its matches.
    """
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"))

    def step(at: Column, piece: Column) -> tuple[Column, Column, Column]:
        start = at + F.length(piece["gap"])
        end = start + F.coalesce(F.length(piece["match"]), F.lit(0))
        return end, piece["match"].isNotNull(), F.struct(start.alias("start"), end.alias("end"), piece["match"].alias("match"))

    return folded(pieces, F.lit(0), "struct<start:int,end:int,match:string>", step)

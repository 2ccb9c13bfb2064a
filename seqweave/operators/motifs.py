"""Motif libraries: compilation, matching, greedy selection, tokens and coverage.

A library is a small table of (motif_order, motif_id, kind, pattern, regex, token); list order has meaning.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqweave.functions.intervals import points_in_spans
from seqweave.functions.shared import written
from seqweave.operators.literals import Matcher, unpickled
from seqweave.operators.spans import greedy_spans as greedy_spans

#: Classes of the ambiguous letters; every other letter, and the hyphen, stands for itself.
AMBIGUOUS = {"B": "[DN]", "Z": "[EQ]", "X": "[A-Z]", "J": "[IL]"}
#: Letters that a degenerate pattern may use.
DEGENERATE = "ACDEFGHIKLMNPQRSTVWYBZXJUO-"
KINDS = ("regex", "profile", "prosite")
MAX_MOTIFS = 100_000
_ELEMENT = re.compile(r"(?:(?P<sep>-)|(?P<edge>[<>])|(?P<wild>[xX])|(?P<letter>[^\W\d_])|\[(?P<any>[^\]]*)\]|\{(?P<none>[^}]*)\})(?:\(\s*(?P<low>\d+)\s*(?:,\s*(?P<high>\d+)\s*)?\))?")


def prosite_regex(pattern: str) -> str:
    """PROSITE notation as a regex: hyphens part, < and > anchor, x is any symbol, [..] and {..} are classes, (n) and (n,m) repeat."""
    text = re.sub(r"\s+", "", pattern)
    text = text[:-1] if text.endswith(".") else text
    out, at = [], 0
    while at < len(text):
        m = _ELEMENT.match(text, at)
        if not m or (m["low"] and (m["sep"] or m["edge"])):
            raise ValueError(f"can't read {pattern!r} at {text[at:]!r}")
        at = m.end()
        if m["sep"]:
            continue
        if m["edge"]:
            out.append("^" if m["edge"] == "<" else "$")
            continue
        atom = "." if m["wild"] else re.escape(m["letter"].upper()) if m["letter"] else f"[{re.escape(m['any'])}]" if m["any"] is not None else f"[^{re.escape(m['none'])}]"
        if m["low"]:
            atom = f"(?:{atom}){{{m['low']},{m['high']}}}" if m["high"] else f"(?:{atom}){{{m['low']}}}"
        out.append(atom)
    re.compile("".join(out))
    return "".join(out)


def compile_pattern(pattern: str, matching: str) -> str:
    if matching == "exact":
        return re.escape(pattern)
    if matching == "regex":
        re.compile(pattern)
        return pattern
    if matching == "degenerate":
        if wrong := sorted(set(pattern) - set(DEGENERATE)):
            raise ValueError(f"{wrong} can't stand in a degenerate pattern")
        return "".join(AMBIGUOUS.get(c, c) for c in pattern)
    if matching == "prosite":
        return prosite_regex(pattern)
    raise ValueError(f"no matching mode {matching!r}")


def library(spark: SparkSession, motifs: list[dict], matching: str = "prosite") -> DataFrame:
    """A library from dicts with pattern or pa, and perhaps id, kind, ac, token, regex. Without an id it is M and the place, from 1."""
    if not motifs or len(motifs) > MAX_MOTIFS:
        raise ValueError("a library holds 1 to 100,000 motifs")
    rows = []
    for order, m in enumerate(motifs):
        name, kind = str(m.get("id", f"M{order + 1}")).strip(), str(m.get("kind", "regex")).strip().lower()
        pattern = str(m["pa"] if m.get("pa") is not None else m.get("pattern") or "").strip()
        if not name or not pattern or kind not in KINDS:
            raise ValueError(f"motif {order + 1} needs an id, a pattern and a known kind")
        given = str(m.get("regex") or "").strip() if kind != "regex" else ""
        regex = given or compile_pattern(pattern, "prosite" if kind == "prosite" else matching)
        re.compile(regex)
        token = str(m.get("token") or "").strip() or "<PROSITE:" + re.sub(r"\s", "_", str(m.get("ac") or "").strip() or name) + ">"
        rows.append((order, name, kind, pattern, regex, token))
    return spark.createDataFrame(rows, "motif_order int, motif_id string, kind string, pattern string, regex string, token string")


def matches(records: DataFrame, motifs: DataFrame, with_length: bool = False) -> DataFrame:
    """protein_id, motif_order, motif_id, token, start (from 0), end: for every motif each start at which it matches, greedily; overlaps stay.

    with_length adds length, that of the sequence, to every match.

    The library is small by definition. Literals that its patterns require are put into one automaton, which is built
    once and broadcast; a sequence is read once for all of them, and a pattern is tried only where one of its
    literals stands. Sequences stream through in Arrow batches.
    """
    spark = records.sparkSession
    known = [(r["motif_order"], r["motif_id"], r["token"], r["regex"]) for r in motifs.orderBy("motif_order").limit(MAX_MOTIFS + 1).collect()]
    if len(known) > MAX_MOTIFS:
        raise ValueError("a library holds at most 100,000 motifs")
    packed = spark.sparkContext.broadcast(pickle.dumps(Matcher([regex for *_, regex in known])))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = unpickled(packed.value)
        for batch in batches:
            out = [(p, *known[i][:3], start, end, len(s)) for p, s in zip(batch["protein_id"], batch["sequence"], strict=True) for i, start, end in matcher.find(s or "")]
            yield pd.DataFrame(out, columns=["protein_id", "motif_order", "motif_id", "token", "start", "end", "length"])

    found = records.select("protein_id", "sequence").mapInPandas(search, "protein_id string, motif_order int, motif_id string, token string, start int, end int, length int")
    return found if with_length else found.drop("length")


def tokens(records: DataFrame, spans: DataFrame) -> DataFrame:
    """protein_id, token_ix (from 0), token, span_length, start: spans as one token each, other positions as their symbol."""
    at = F.when(F.length("sequence") > 0, F.sequence(F.lit(0), F.length("sequence") - 1)).otherwise(F.array().cast("array<int>"))
    single = records.select("protein_id", "sequence", F.explode(at).alias("start"))
    covered = spans.select("protein_id", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("start"))
    rest = single.join(covered, ["protein_id", "start"], "left_anti").select("protein_id", "start", F.substring(F.col("sequence"), F.col("start") + 1, F.lit(1)).alias("token"), F.lit(1).alias("span_length"))
    both = rest.unionByName(spans.select("protein_id", "start", "token", (F.col("end") - F.col("start")).alias("span_length")))
    return both.withColumn("token_ix", F.row_number().over(Window.partitionBy("protein_id").orderBy("start")) - 1)


def spread_tokens(token_rows: DataFrame) -> DataFrame:
    """protein_id, position (from 1), token, token_ix: every position with its token."""
    return token_rows.select("protein_id", F.explode(F.sequence(F.col("start") + 1, F.col("start") + F.col("span_length"))).alias("position"), "token", "token_ix")


def vocabulary(motifs: DataFrame) -> DataFrame:
    """motif_id, vocab_id: places from 1; of a repeated id the last."""
    return motifs.groupBy("motif_id").agg((F.max("motif_order") + 1).alias("vocab_id"))


def special_tokens(motifs: DataFrame) -> DataFrame:
    """token, motif_order of its first motif."""
    return motifs.groupBy("token").agg(F.min("motif_order").alias("motif_order"))


def position_motifs(residues: DataFrame, found: DataFrame, motifs: DataFrame, max_per_residue: int = 1, longest: int | None = 64) -> DataFrame:
    """residues (protein_id, position) with motif_id: the vocab id of the first motif in library order that covers the position, else 0.

    Matches are put into bins as wide as longest, which few exceed (those meet more bins); None asks found for the
    widths in use, and serves where matches are long.
    """
    if max_per_residue <= 0:
        raise ValueError("max_per_residue must be positive")
    # Of matches at one span only the first in library order can decide, so the others go before the join.
    spans = found.groupBy("protein_id", "start", "end").agg(F.min("motif_order").alias("_order"))
    names = motifs.groupBy("motif_order").agg(F.max("motif_id").alias("_name")).join(vocabulary(motifs), F.col("_name") == F.col("motif_id")).select(F.col("motif_order").alias("_first"), F.col("vocab_id").alias("motif_id"))
    rows = residues.withColumn("_row", F.monotonically_increasing_id())  # rows that repeat stay apart
    if not longest:
        spans = written(spans, "motif-spans")
        met = points_in_spans(rows, spans, ["protein_id"], F.col("position") - 1, "start", "end")
        met = rows.join(met.groupBy("protein_id", "position").agg(F.min("_order").alias("_order")), ["protein_id", "position"], "left")
    else:
        met = points_in_spans(rows, spans, ["protein_id"], F.col("position") - 1, "start", "end", longest, "left")
    first = met.groupBy(*residues.columns, "_row").agg(F.min("_order").alias("_first")).drop("_row")
    return first.join(F.broadcast(names), "_first", "left").select(*residues.columns, F.coalesce("motif_id", F.lit(0)).alias("motif_id"))


def coverage(encoded: DataFrame, by: list[str]) -> DataFrame:
    """total, covered, ratio and mean covered positions per sequence."""
    per = encoded.groupBy(*by, "protein_id").agg(F.count("*").alias("n"), F.count_if(F.col("motif_id") != 0).alias("hits"))
    out = per.groupBy(*by).agg(F.sum("n").alias("total"), F.sum("hits").alias("covered"), F.avg("hits").alias("mean_hits"), F.count("*").alias("records"))
    return out.withColumn("ratio", F.coalesce(F.try_divide(F.col("covered").cast("double"), F.col("total").cast("double")), F.lit(0.0)))


def top_motifs(encoded: DataFrame, motifs: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """by, motif_id, hits, nth: motifs by covered positions; ties in library order, motifs without a hit take part."""
    # One pass over the positions; uncovered ones count too, so that every group is in the small table that it gives.
    counts = written(encoded.groupBy(*by, F.col("motif_id").alias("vocab_id")).agg(F.count("*").alias("hits")), "motif-hits")
    hits = counts.where("vocab_id <> 0")
    every = counts.select(*by).distinct().crossJoin(F.broadcast(vocabulary(motifs)))  # groups x library, both small
    joined = every.join(hits, [*by, "vocab_id"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("hits"), "vocab_id"))
    return joined.withColumn("nth", nth).where(F.col("nth") <= max(1, k)).select(*by, "motif_id", "hits", "nth")

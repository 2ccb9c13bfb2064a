"""Motif queries over the event sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.operators import motifs, windows
from seqweave.plans.registry import query
from seqweave.plans.windowing import SPANS
from seqweave.sources.adapters import EVENT_RESIDUES, EVENT_SEQUENCES, event_residues, event_sequences

#: The demonstration library.
PATTERNS = ("C-V-x-P", "[SE]-x(2)-P", "{C}-C-{C}", "<S", "P>", "S-E", "S-E-C")
REGEXES = ("CV.P", "[SE](?:.){2}P", "[^C]C[^C]", "^S", "P$", "SE", "SEC")
ES = f"WITH {EVENT_RESIDUES}, {EVENT_SEQUENCES}"
LIB = "lib(motif_order, motif_id, regex) AS (VALUES " + ", ".join(f"({i}, 'M{i + 1}', '{r}')" for i, r in enumerate(REGEXES)) + ")"
FOUND = f"""{LIB}, pl AS (SELECT protein_id, sequence, unnest(range(1, length(sequence) + 1)) AS i FROM es),
fo AS (SELECT protein_id, motif_order, motif_id, (i - 1)::INT AS start, (i - 1 + length(m))::INT AS "end" FROM
  (SELECT protein_id, motif_order, motif_id, i, CASE WHEN starts_with(regex, '^') AND i > 1 THEN '' ELSE regexp_extract(substr(sequence, i), '^(?:' || regex || ')') END AS m FROM pl, lib) WHERE m <> '')"""
REC = ES.replace("WITH", "WITH RECURSIVE", 1)
GREEDY = f"""{FOUND}, od AS (SELECT *, row_number() OVER (PARTITION BY protein_id ORDER BY start, -("end" - start), motif_order) AS k FROM fo),
wk AS (SELECT protein_id, k, motif_order, motif_id, start, "end", true AS taken, "end" AS upto FROM od WHERE k = 1
  UNION ALL SELECT o.protein_id, o.k, o.motif_order, o.motif_id, o.start, o."end", o.start >= w.upto, CASE WHEN o.start >= w.upto THEN o."end" ELSE w.upto END FROM wk w JOIN od o ON o.protein_id = w.protein_id AND o.k = w.k + 1),
gs AS (SELECT protein_id, motif_order, motif_id, start, "end" FROM wk WHERE taken)"""


def _library(spark):
    return motifs.library(spark, [{"pattern": p} for p in PATTERNS])


def _found(spark, sf):
    return motifs.matches(event_sequences(spark, sf), _library(spark))


def _encoded(spark, sf):
    return motifs.position_motifs(event_residues(spark, sf).select("protein_id", "position", "split"), _found(spark, sf), _library(spark))


@query("m1_compiled_matches", f"{ES}, {LIB} SELECT motif_id, count(*) FILTER (regexp_matches(sequence, regex)) AS sequences FROM es, lib GROUP BY motif_id")
def m1(spark, sf):
    return _hits(event_sequences(spark, sf), _library(spark))


def _hits(records, library):
    """motif_id, sequences: how many sequences each motif of a small library matches."""
    known = library.select("motif_id", "regex").collect()
    tried = F.array(*(F.struct(F.lit(r["motif_id"]).alias("motif_id"), F.rlike("sequence", F.lit(r["regex"])).alias("hit")) for r in known))
    return records.select(F.inline(tried)).groupBy("motif_id").agg(F.count_if("hit").alias("sequences"))


#: Patterns in the other notations, and what they mean as regular expressions.
MODES = (("exact", ("SEC", "S.C", "P-V"), ("SEC", "S\\.C", "P-V")), ("regex", ("S[EC]+V", "(?:PV){2}"), ("S[EC]+V", "(?:PV){2}")), ("degenerate", ("ZXC", "SB", "CX", "JV"), ("[EQ][A-Z]C", "S[DN]", "C[A-Z]", "[IL]V")))
MODE_LIB = "lib(motif_id, regex) AS (VALUES " + ", ".join(f"('{mode}/M{i + 1}', '{r}')" for mode, _, regexes in MODES for i, r in enumerate(regexes)) + ")"


@query("m1_other_notations", f"{ES}, {MODE_LIB} SELECT motif_id, count(*) FILTER (regexp_matches(sequence, regex)) AS sequences FROM es, lib GROUP BY motif_id")
def m1_other(spark, sf):
    library = None
    for mode, patterns, _ in MODES:
        part = motifs.library(spark, [{"pattern": p} for p in patterns], mode).withColumn("motif_id", F.concat(F.lit(f"{mode}/"), "motif_id"))
        library = part if library is None else library.unionByName(part)
    return _hits(event_sequences(spark, sf), library)


@query("m2_all_matches", f"{ES}, {FOUND} SELECT * FROM fo")
def m2(spark, sf):
    return _found(spark, sf).drop("token")


@query("m3_greedy_spans", f"{REC}, {GREEDY} SELECT * FROM gs")
def m3(spark, sf):
    return motifs.greedy_spans(_found(spark, sf)).drop("token")


TOKENS = f"""{GREEDY}, cv AS (SELECT protein_id, unnest(range(start, "end")) AS p FROM gs), sg AS (SELECT protein_id, sequence, unnest(range(length(sequence))) AS p FROM es),
tk AS (SELECT protein_id, p::INT AS start, substr(sequence, p + 1, 1) AS token, 1 AS span_length FROM sg ANTI JOIN cv USING (protein_id, p)
  UNION ALL SELECT protein_id, start, '<PROSITE:' || motif_id || '>', "end" - start FROM gs)"""


@query("m4_tokens", f"{REC}, {TOKENS} SELECT protein_id, (row_number() OVER (PARTITION BY protein_id ORDER BY start) - 1)::INT AS token_ix, token, span_length, start FROM tk")
def m4(spark, sf):
    return motifs.tokens(event_sequences(spark, sf), motifs.greedy_spans(_found(spark, sf)))


@query("m5_token_positions", f"{REC}, {TOKENS} SELECT protein_id, unnest(range(start + 1, start + span_length + 1))::INT AS position, token FROM tk")
def m5(spark, sf):
    rows = motifs.tokens(event_sequences(spark, sf), motifs.greedy_spans(_found(spark, sf)))
    return motifs.spread_tokens(rows).drop("token_ix")


ENCODED = f"""{FOUND}, cp AS (SELECT protein_id, unnest(range(start + 1, "end" + 1)) AS position, motif_order FROM fo),
en AS (SELECT e.protein_id, e.position, e.split, coalesce(min(motif_order) + 1, 0)::INT AS motif_id FROM ev e LEFT JOIN cp USING (protein_id, position) GROUP BY ALL)"""


@query("m6_position_motifs", f"{ES}, {ENCODED} SELECT protein_id, position, motif_id FROM en")
def m6(spark, sf):
    return _encoded(spark, sf).drop("split")


@query("m7_vocabulary", f"{ES}, {FOUND} SELECT motif_id, (motif_order + 1)::INT AS vocab_id, count(*) AS matches FROM fo GROUP BY ALL")
def m7(spark, sf):
    counted = _found(spark, sf).groupBy("motif_id").agg(F.count("*").alias("matches"))
    return counted.join(F.broadcast(motifs.vocabulary(_library(spark))), "motif_id")


@query("m8_coverage", f"""{ES}, {ENCODED}, p AS (SELECT split, protein_id, count(*) AS n, count(*) FILTER (motif_id <> 0) AS h FROM en GROUP BY ALL)
SELECT split, sum(n)::BIGINT AS total, sum(h)::BIGINT AS covered, round(avg(h), 9) AS mean_hits, count(*) AS records, round(sum(h)::DOUBLE / sum(n), 9) AS ratio FROM p GROUP BY split""")
def m8(spark, sf):
    return motifs.coverage(_encoded(spark, sf), ["split"]).withColumns({"mean_hits": F.round("mean_hits", 9), "ratio": F.round("ratio", 9)})


@query("m9_top_motifs", f"""{ES}, {ENCODED}, h AS (SELECT s.split, l.motif_id, l.motif_order, count(e.protein_id) AS hits FROM (SELECT DISTINCT split FROM ev) s CROSS JOIN lib l
  LEFT JOIN en e ON e.split = s.split AND e.motif_id = l.motif_order + 1 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY hits DESC, motif_order)::INT AS nth FROM h) SELECT split, motif_id, hits, nth FROM r WHERE nth <= 3""")
def m9(spark, sf):
    return motifs.top_motifs(_encoded(spark, sf), _library(spark), ["split"], 3)


@query("j10_window_motifs", f"""{ES}, {SPANS}, {FOUND} SELECT s.protein_id, s.start AS window_start, f.start, f."end", f.motif_id FROM sp s JOIN fo f ON f.protein_id = s.protein_id AND f.start < s.end_exclusive AND f."end" > s.start""")
def j10_motifs(spark, sf):
    """Every window with every match that it meets, wholly or in part; a match's windows follow from its place, without a join."""
    found = motifs.matches(event_sequences(spark, sf), _library(spark), with_length=True)
    met = windows.met_starts(F.col("start"), F.col("end"), F.col("length"), 24, 16)
    return found.select("protein_id", F.explode(met).alias("window_start"), "start", "end", "motif_id")

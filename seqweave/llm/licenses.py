"""License scan by ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.llm.columns import carried, unpacked
from seqweave.llm.signatures import PRIORITIES, Rule, signature_rules
from seqweave.llm.spans import bound, folded, match_spans
from seqweave.llm.urls import LOWER, UPPER

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WORD_ANY_CASE = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: The phrases of the base scan and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
DETECTION = "start:int,minus_end:int,priority:int,nth:int,label:string,confidence:double"


def _text(value: str) -> str:
    """value as a SQL string. Hundreds of rules are put into few SQL expressions, which are quicker to build than columns."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _holds(column: str, words: Iterable[str]) -> str:
    return "(" + (" OR ".join(f"contains({column}, {_text(w)})" for w in words) or "false") + ")"


def may_match(lower: str, rules: Sequence[Rule], phrases: Sequence[tuple[str, str]]) -> Column:
    """Whether a text, in lower case and otherwise as it stands, can hold a phrase or a rule's match: it has the longest
    word of one, and that of an anchor.

    A phrase, keyword or anchor may run over signs that aren't word characters; a word of it can't.
    """
    longest = lambda x: max(x.split(" "), key=len)
    wanted: dict[tuple[str, ...], set[str]] = {}
    for r in rules:
        wanted.setdefault(r.anchors, set()).update(map(longest, r.keywords))
    parts = [f"({_holds(lower, sorted({longest(a) for a in anchors})) if anchors else 'true'} AND {_holds(lower, sorted(words))})" for anchors, words in wanted.items()]
    return F.expr(" OR ".join([_holds(lower, sorted({longest(p) for p, _ in phrases})), *parts]))


def resolve(detections: Column) -> Column:
    """Detections that no detection of at least their priority contains; of equal ones the first rule stays.

    Sorted by (start, -end, priority, rule), a detection is contained if an earlier one of no weaker priority ends at
    or after its end, so a running largest end per priority decides, in one pass.
    """
    ordered = F.array_sort(F.transform(detections, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("minus_end"), d["priority"].alias("priority"), d["nth"].alias("nth"), d["label"].alias("label"), d["confidence"].alias("confidence"))))

    def step(ends: Column, d: Column) -> tuple[Column, Column, Column]:
        end = -d["minus_end"]
        covered = F.array_max(F.slice(ends, F.lit(1), d["priority"] + 1)) >= end
        return F.transform(ends, lambda e, i: F.when(i == d["priority"], F.greatest(e, end)).otherwise(e)), ~covered, d

    return folded(ordered, F.array(*[F.lit(0)] * PRIORITIES), f"struct<{DETECTION}>", step)


def awake(joined: str, said: dict[tuple[str, ...], str], rules: Sequence[Rule]) -> Column:
    """The rules that match somewhere in joined, as structs with their place in the order; said names for each set of
    anchors the column that tells whether one is there.

    Rules that share their keywords and anchors are looked at together: none of them unless the text has a keyword and
    an anchor, and each for itself only where one pattern, made of all of theirs and compiled once, matches.
    """
    groups: dict[tuple, list[tuple[int, Rule]]] = {}
    for nth, rule in enumerate(rules):
        groups.setdefault((rule.keywords, rule.anchors), []).append((nth, rule))
    kind = "array<struct<regex:string,label:string,priority:int,confidence:double,nth:int>>"
    parts = []
    for (keywords, anchors), members in groups.items():
        rows = json.dumps([{"regex": r.regex, "label": r.label, "priority": r.priority, "confidence": r.confidence, "nth": n} for n, r in members])
        held = f"{_holds(joined, keywords)} AND {said.get(anchors, 'true')} AND {joined} RLIKE {_text('|'.join(r.regex for _, r in members))}"
        parts.append(f"CASE WHEN {held} THEN from_json({_text(rows)}, '{kind}') ELSE CAST(array() AS {kind}) END")
    hits = F.expr(f"concat({', '.join(parts)})") if parts else F.array().cast(kind)
    return F.filter(hits, lambda r: F.rlike(F.col(joined), r["regex"]))


def scan(docs: DataFrame, rules: Sequence[Rule] | None = None, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    docs: text; further columns are carried along, whatever their names, and those called like a result (in any case)
    are replaced. Base: every place where a phrase's words stand consecutively (A-Z lower-cased). Rules: a document is
    looked at only if it holds a word of a phrase or of a rule's keyword, a rule only if the document holds one of its
    keywords (and anchors); matches are then resolved by priority and interval containment, ties by the order of the
    rules. detections has what stays, as places in the words joined by single spaces. score is the largest confidence
    of what was found, 0 if nothing. Null text is empty: no words, no labels, score 0. Repeated rows are scanned each;
    no rows: no rows. Everything happens inside the row: nothing is shuffled, whatever the text's length, and the time
    grows with the text and its matches.
    """
    rules = signature_rules() if rules is None else rules
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select(carried(docs, RESULTS).alias("own"), text.alias("text"), F.lower(text).alias("lower"))
    text, gate = F.col("text"), may_match("lower", rules, phrases)
    one = one.select("own", F.coalesce(F.regexp_count(text, F.lit(WORD_ANY_CASE)), F.lit(0)).cast("long").alias("n"), F.when(gate, F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))).alias("words"))
    one = one.withColumn("joined", F.array_join("words", " ")).withColumn("padded", F.concat(F.lit(" "), "joined", F.lit(" ")))
    anchors = list(dict.fromkeys(r.anchors for r in rules if r.anchors))
    one = one.select("own", "n", "words", "joined", *(F.expr(_holds("padded", x)).alias(f"said{i}") for i, x in enumerate(anchors)))
    said = {x: f"said{i}" for i, x in enumerate(anchors)}

    def places(phrase: str) -> Column:
        parts = phrase.split(" ")
        words, n = F.col("words"), F.size("words")

        def here(i: Column) -> Column:
            hit = F.lit(True)
            for k, w in enumerate(parts):
                hit = hit & (F.get(words, i + k) == w)
            return hit

        held = F.col("joined").contains(phrase) & (n >= len(parts))
        return F.when(held, F.filter(F.sequence(F.lit(0), n - len(parts)), here)).otherwise(F.array().cast("array<int>"))

    def found(rule: Column) -> Column:
        return F.transform(match_spans(F.col("joined"), rule["regex"]), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), rule["priority"].alias("priority"), rule["nth"].alias("nth"), rule["label"].alias("label"), rule["confidence"].alias("confidence")))

    none = F.array().cast(f"array<struct<{DETECTION}>>")
    kept = bound(awake("joined", said, rules), lambda hits: F.when(F.size(hits) > 0, resolve(F.flatten(F.transform(hits, found)))).otherwise(none))
    one = one.select("*", *(places(p).alias(f"p{i}") for i, (p, _) in enumerate(phrases)), F.coalesce(F.when(F.col("joined").isNotNull(), kept), none).alias("kept"))
    every = F.concat(*(f"p{i}" for i in range(len(phrases)))) if phrases else F.array().cast("array<int>")
    base = F.array_compact(F.array(*(F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)))) if phrases else F.array().cast("array<string>")
    labels = F.array_sort(F.array_union(base, F.transform("kept", lambda d: d["label"])))
    confidence = F.coalesce(F.array_max(F.transform("kept", lambda d: d["confidence"])), F.lit(0.0))
    return one.select(
        *unpacked(docs, RESULTS, "own"),
        F.col("n").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(confidence, F.when(F.size(every) > 0, F.lit(0.95)).otherwise(F.lit(0.0))).alias("score"),
        F.transform("kept", lambda d: F.struct(d["start"].alias("start"), (-d["minus_end"]).alias("end"), d["label"].alias("label"))).alias("detections"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every whole text of documents; see scan."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

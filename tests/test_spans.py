"""Greedy spans, literal automaton and interval joins against plain loops."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from seqweave.functions.intervals import overlapping, points_in_spans
from seqweave.functions.ordering import numbered
from seqweave.operators import motifs, spans
from seqweave.operators.literals import Matcher, anchor

FOUND = "protein_id string, motif_order int, motif_id string, token string, start int, end int"


def plain_greedy(rows):
    out, upto = [], {}
    for p, order, name, token, start, end in sorted(rows, key=lambda r: (r[0] or "", r[4], r[4] - r[5], r[1], r[2])):
        if start >= upto.get(p, 0):
            upto[p] = end
            out.append((p, order, name, token, start, end))
    return out


@pytest.mark.parametrize("block", [1, 3, 16, 1000])
def test_greedy_spans_are_the_plain_ones_for_any_block(spark, block):
    rng = random.Random(block)
    rows = []
    for p, n, longest in (("a", 60, 4), ("b", 90, 30), ("c", 5, 3), ("d", 40, 200), (None, 20, 5), ("e", 1, 1)):
        for _ in range(n):
            start, order = rng.randrange(120), rng.randrange(4)
            rows.append((p, order, f"M{order}", f"<{order}>", start, start + rng.randint(1, longest)))
    rows += rows[:10]
    found = motifs.greedy_spans(spark.createDataFrame(rows, FOUND), block).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, plain_greedy(rows)))
    assert motifs.greedy_spans(spark.createDataFrame([], FOUND), block).count() == 0


def test_greedy_spans_of_a_million_matches_of_one_sequence(spark):
    at = F.col("id").cast("int")
    length = (F.col("id") % 7 + F.col("id") % 11 + 1).cast("int")
    found = spark.range(1_000_000).select(F.lit("p").alias("protein_id"), F.lit(0).alias("motif_order"), F.lit("M").alias("motif_id"), F.lit("<M>").alias("token"), at.alias("start"), (at + length).alias("end"))
    got = [r["start"] for r in spans.greedy_spans(found).orderBy("start").select("start").toLocalIterator()]
    want, at = [], 0
    while at < 1_000_000:
        want.append(at)
        at += at % 7 + at % 11 + 1
    assert got == want


REGEXES = ["CV.P", "[SE](?:.){2}P", "[^C]C[^C]", "^S", "P$", "SE", "(?:AB){2,4}C", "A+B", "(?:AC|CA)E", "x*", "(?=A)AC", "[A-E]{3}P", "A(?:.){0,30}C", "(?i:ac)e", "(A)\\1", "S.{2,5}EC", "\\bA", "(?:.)", "A??B"]


def plain_matches(regex, text):
    found = re.compile(regex)
    return [(i, m.end()) for i in range(len(text) + 1) if (m := found.match(text, i)) and m.end() > i]


def test_automaton_finds_what_each_pattern_matches():
    rng = random.Random(4)
    matcher = Matcher(REGEXES)
    for n in (0, 1, 2, 50, 300):
        text = "".join(rng.choices("ABCEPSVx", k=n))
        want = sorted((i, a, b) for i, r in enumerate(REGEXES) for a, b in plain_matches(r, text))
        assert sorted(matcher.find(text)) == want
    assert anchor("C-[DE]{2}-x").words == ("C-DD-x", "C-DE-x", "C-ED-x", "C-EE-x")
    assert anchor("[^A].") is None and anchor("(?:AB|CD)") is None


def test_many_patterns_cost_little_more_than_a_few():
    rng = random.Random(5)
    letters = "ACDEFGHIKLMNPQRSTVWY"

    def element():
        kind = rng.random()
        return rng.choice(letters) if kind < 0.6 else "[" + "".join(rng.sample(letters, 2)) + "]" if kind < 0.8 else "x"

    patterns = [motifs.prosite_regex("-".join([rng.choice(letters), *(element() for _ in range(6)), *rng.sample(letters, 3)])) for _ in range(1500)]
    text = "".join(rng.choices(letters, k=100_000))
    took = {}
    for n in (7, 1500):
        matcher = Matcher(patterns[:n])
        began = time.perf_counter()
        found = list(matcher.find(text))
        took[n] = time.perf_counter() - began
    assert sorted(found) == sorted((i, m.start(), m.end(1)) for i, p in enumerate(patterns) for m in re.finditer(f"(?=({p}))", text))
    assert took[1500] < 5 * took[7] + 0.1


def test_points_and_spans_pair_once(spark):
    rng = random.Random(6)
    spans_ = [(rng.choice("ab"), s, s + rng.choice([0, 1, 2, 3, 8, 9, 64, 1000]), i) for i, s in enumerate(rng.choices(range(2000), k=150))] + [("a", None, 5, 900), (None, 1, 9, 901)]
    points = [(rng.choice("ab"), rng.randrange(2000), i) for i in range(300)] + [("a", None, 900), (None, 3, 901)]
    want = sorted((g, p, i, j) for g, p, i in points if g and p is not None for h, s, e, j in spans_ if g == h and s is not None and s <= p < e)
    left, right = spark.createDataFrame(points, "g string, at int, i int"), spark.createDataFrame(spans_, "g string, s int, e int, j int")
    for longest in (None, 4, 1000):
        found = points_in_spans(left, right, ["g"], F.col("at"), "s", "e", longest).select("g", "at", "i", "j").collect()
        assert sorted(map(tuple, found)) == want
    assert points_in_spans(left, right.limit(0), ["g"], F.col("at"), "s", "e").count() == 0


def test_overlapping_spans_pair_once(spark):
    rng = random.Random(7)
    make = lambda n: [(rng.choice("ab"), s, s + rng.choice([0, 1, 2, 5, 16, 17, 300]), i) for i, s in enumerate(rng.choices(range(600), k=n))]
    a, b = make(90), make(120)
    want = sorted((i, j) for g, s, e, i in a for h, t, f, j in b if g == h and max(s, t) < min(e, f))
    found = overlapping(spark.createDataFrame(a, "g string, s int, e int, i int"), spark.createDataFrame(b, "g string, t int, f int, j int"), ["g"], ("s", "e"), ("t", "f"))
    assert sorted((r["i"], r["j"]) for r in found.collect()) == want


def test_rows_are_numbered_in_order(spark):
    rows = [(3, "a"), (None, "b"), (1, "c"), (2, "a")] + [(5, "same")] * 40
    found = numbered(spark.createDataFrame(rows, "k long, v string"), ["k", "v"]).orderBy("row").collect()
    assert [r["row"] for r in found] == list(range(44)) and [r["k"] for r in found[:4]] == [None, 1, 2, 3]
    assert numbered(spark.createDataFrame([], "k long"), ["k"]).count() == 0

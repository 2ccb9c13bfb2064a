"""Toxicity scores by a classifier that swaps of identity terms must leave alone.

Every labelled sentence with an identity term has counterfactuals: the same sentence with another term of the group in
its place, and the same label. Texts rarely name a group, so a keyed share of the labelled rows is also taken with a
term put in. The fit penalises the change of the score over every such pair.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.functions.shared import written

#: Identity terms that may stand for one another, by group and language.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"),
    ("gay", "lesbian", "bisexual", "straight"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """sample: labelled rows that the fit may see, at most about so many (a hash of doc_id chooses); the bound of
    everything that reaches the driver together with features. swap_weight: of the penalty on score changes;
    mention_share: one in so many labelled rows is also taken with an identity term put in."""

    sample: int = 20_000
    features: int = 4096
    min_docs: int = 4
    prefixes: tuple[int, ...] = (4, 5, 6)
    ridge: float = 1e-3
    swap_weight: float = 4.0
    mention_share: int = 2
    rounds: int = 400
    terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS
    threshold: float = 0.3


@dataclass
class Model:
    """Weights of words ("w:") and of word beginnings ("p:"); pairs: counterfactuals that the fit was held to."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    prefixes: tuple[int, ...] = ()
    pairs: int = 0


def features(words: set[str], prefixes: tuple[int, ...]) -> set[str]:
    """Each word once, and its beginnings of the given lengths."""
    out = {f"w:{w}" for w in words}
    for n in prefixes:
        out.update(f"p:{w[:n]}" for w in words if len(w) > n)
    return out


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def swapped(words: set[str], terms: tuple[tuple[str, ...], ...]) -> list[tuple[str, str]]:
    """(term, other) for every identity term among the words and every other term of its group that isn't."""
    return [(t, o) for group in terms for t in group if t in words for o in group if o not in words]


def mention(text: str | None, settings: Settings) -> tuple[str, ...]:
    """The identity terms of one group, the one to put into the text first; none for a text that isn't chosen.

    A keyed hash of the text chooses, so the same text always takes the same term, whatever its label.
    """
    h = zlib.crc32(f"mention:{text or ''}".encode("utf-8", "surrogatepass"))
    if h % settings.mention_share:
        return ()
    h //= settings.mention_share
    group = settings.terms[h % len(settings.terms)]
    k = h // len(settings.terms) % len(group)
    return group[k:] + group[:k]


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings, held_out: bool) -> DataFrame:
    """doc_id, text, toxic of the labelled sample, as a table. Only the bounded sample of labels is broadcast; texts
    stay put. Of rows that share a doc_id one counts, the one with the largest text."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    if held_out:
        known = known.where(~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if n > settings.sample:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * settings.sample / n))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    return written(rows.select("doc_id", "text", "toxic"), "toxicity-sample")


def _counted(prefixes: tuple[int, ...]):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[int]] = {}

        def out() -> pd.DataFrame:
            frame = pd.DataFrame([(k, v[0], v[1]) for k, v in seen.items()], columns=["feature", "clean", "toxic"])
            seen.clear()
            return frame.astype({"feature": "str", "clean": "int64", "toxic": "int64"})

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                for f in features(words_of(text), prefixes):
                    seen.setdefault(f, [0, 0])[1 if toxic else 0] += 1
                if len(seen) > 150_000:
                    yield out()
        yield out()

    return count


def _indexed(index: dict[str, int], settings: Settings):
    """mapInPandas: toxic, own (features), plus and minus (features that a swap brings and takes, a list for each pair).

    A row that mention() chooses gives another row with the term in its text, the same label, and its pairs.
    """

    def known(words: set[str]) -> list[int]:
        return sorted(index[f] for f in features(words, settings.prefixes) if f in index)

    def pairs(words: set[str]) -> tuple[list[list[int]], list[list[int]]]:
        plus, minus = [], []
        own = set(known(words))
        for term, other in swapped(words, settings.terms):
            changed = set(known((words - {term}) | {other}))
            plus.append(sorted(changed - own))
            minus.append(sorted(own - changed))
        return plus, minus

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                words, put = words_of(text), mention(text, settings)[:1]
                for w in (words, words | set(put)) if put else (words,):
                    out.append((int(toxic), known(w), *pairs(w)))
            yield pd.DataFrame(out, columns=["toxic", "own", "plus", "minus"])

    return rows


def _sparse(lists: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(x) for x in lists]
    return np.repeat(np.arange(len(lists)), sizes), np.concatenate([*(np.asarray(x, dtype=np.int64) for x in lists), np.zeros(0, dtype=np.int64)])


def loss(w: np.ndarray, b: float, own: tuple, toxic: np.ndarray, plus: tuple, minus: tuple, pairs: int, settings: Settings) -> tuple[float, np.ndarray, float]:
    """Value and gradients of: logistic loss, ridge, and the mean squared change of the score (log-odds) under a swap."""
    (rows, cols), n, width = own, len(toxic), len(w)
    z = np.clip(np.bincount(rows, weights=w[cols], minlength=n) + b, -30, 30)
    value = float(np.mean(np.log1p(np.exp(z)) - toxic * z)) + settings.ridge / np.sqrt(n) * float(w @ w) / 2
    error = (1 / (1 + np.exp(-z)) - toxic) / n
    g, gb = np.bincount(cols, weights=error[rows], minlength=width) + settings.ridge * w / np.sqrt(n), error.sum()
    if pairs:
        change = np.bincount(plus[0], weights=w[plus[1]], minlength=pairs) - np.bincount(minus[0], weights=w[minus[1]], minlength=pairs)
        value += settings.swap_weight * float(change @ change) / pairs
        change *= 2 * settings.swap_weight / pairs
        g += np.bincount(plus[1], weights=change[plus[0]], minlength=width) - np.bincount(minus[1], weights=change[minus[0]], minlength=width)
    return value, g, gb


def descend(own: list, plus: list, minus: list, toxic: np.ndarray, width: int, settings: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise loss(), by Adam; plus and minus have a list for each pair."""
    own, pairs, plus, minus = _sparse(own), len(plus), _sparse(plus), _sparse(minus)
    rate = min(max(toxic.mean(), 1e-3), 1 - 1e-3)
    w, b = np.zeros(width), float(np.log(rate / (1 - rate)))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, settings.rounds + 1):
        _, g, gb = loss(w, b, own, toxic, plus, minus, pairs, settings)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate_now = 0.1 / (1 + step / 200)
        w -= rate_now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        b -= rate_now * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), held_out: bool = True) -> Model:
    """Model from the labelled sample. Features are those whose document counts have a log likelihood ratio that as
    many unrelated features would hardly reach, the largest first.

    held_out: leave the rows out whose crc32(doc_id) mod 4 is 2. Labels without a document, null labels and null ids
    are ignored; a document labelled twice counts as toxic if either says so. With one class only the model is its
    constant rate, without labels 0. Of equally telling features at the bound the first in alphabetical order stays.
    """
    rows = training_rows(docs, labels, settings, held_out)
    counts = rows.mapInPandas(_counted(settings.prefixes), "feature string, clean long, toxic long")
    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    n, toxic = totals["n"], totals["toxic"]
    if not toxic or toxic == n:
        return Model(bias=30.0 if n and toxic else -30.0)
    both = counts.groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).where(F.col("c") + F.col("t") >= settings.min_docs)
    both = written(both, "toxicity-features")

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    share, all_ = toxic / n, F.col("c") + F.col("t")
    ratio = part(F.col("t"), all_ * share) + part(F.col("c"), all_ * (1 - share))
    bar = np.log(max(1, both.count()))  # what the best of so many unrelated features would reach by chance
    chosen = [r["feature"] for r in both.where(ratio > float(bar)).orderBy(ratio.desc(), "feature").limit(settings.features).collect()]
    known = set(chosen)
    chosen += [f for group in settings.terms for t in group for f in sorted(features({t}, settings.prefixes)) if f not in known and not known.add(f)]
    index = {f: i for i, f in enumerate(chosen)}
    frame = rows.mapInPandas(_indexed(index, settings), "toxic int, own array<int>, plus array<array<int>>, minus array<array<int>>").toPandas()
    plus, minus = ([x for row in frame[c] for x in row] for c in ("plus", "minus"))
    w, b = descend(frame["own"].tolist(), plus, minus, frame["toxic"].to_numpy(dtype=float), len(chosen), settings)
    return Model(b, {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-6}, settings.prefixes, len(plus))


def log_odds(words: set[str], model: Model) -> float:
    """The score of a set of words as log-odds, within 30 of zero."""
    z = model.bias + sum(model.weights.get(f, 0.0) for f in sorted(features(words, model.prefixes)))
    return min(max(z, -30.0), 30.0)


def score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Score of the whole text in [0, 1]; null and empty texts have the score of no evidence.

    A text's words count once, so a very long text costs memory for its distinct words only. Repeated rows are scored
    each and alike; no rows: no rows. It is a column: what else docs has, and how it is called, doesn't matter.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        held: Model = shipped.value

        @lru_cache(maxsize=200_000)
        def known(word: str) -> tuple[str, ...]:
            return tuple(f for f in (f"w:{word}", *(f"p:{word[:n]}" for n in held.prefixes if len(word) > n)) if f in held.weights)

        def one(t: str | None) -> float:
            hits = {f for w in words_of(t) for f in known(w)}
            z = held.bias + sum(held.weights[f] for f in sorted(hits))
            return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))

        return pd.Series([one(t) for t in texts], dtype="float64")

    return scored(docs[text])


def with_mention(docs: DataFrame, term: str) -> DataFrame:
    """docs with a neutral mention of the term at the end of every text; same columns."""
    return docs.withColumn("text", F.concat_ws(" ", F.coalesce("text", F.lit("")), F.lit(term)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document; see fit for what is learnt, and score for nulls and long texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= Settings.threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, reject: float = Settings.threshold) -> DataFrame:
    """docs without those whose score is at least reject, from where on op3 predicts toxic; same columns."""
    model = fit(docs, labels, held_out=False)
    return docs.where(score(docs, model) < reject)

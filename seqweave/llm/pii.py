"""Personal data: exact base patterns, and candidate spans that boosted trees accept."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.functions.shared import written
from seqweave.llm.columns import carried, unpacked
from seqweave.llm.spans import bound, folded, match_spans

KINDS = ("email", "ip", "card", "phone")
RESULTS = (*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "redactions")
#: The base patterns. Possessive repeats and lookbehinds give the matches of the plain patterns, in linear time and
#: without recursion: a match can only begin where a run of its first class begins, or where the last match ended.
BASE = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: What a text must hold for a base pattern to match.
BASE_GATE = {"email": "@", "ip": "[0-9]\\.[0-9]++\\.[0-9]++\\.[0-9]", "card": "[0-9](?:[\\x20-]?[0-9]){11}", "phone": "\\+[0-9]"}
#: High-recall generators, two of them for cards and phones (loose and tight): other separators, obfuscations, numbers
#: that the base loses because another stands beside them. They overlap the base and one another.
GENERATORS = (
    ("email", "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\\s?(?:@|&#64;|[(\\[{<]\\s?(?:at|AT)\\s?[)\\]}>])\\s?[A-Za-z0-9-]++(?:\\s?(?:\\.|[(\\[{<]\\s?(?:dot|DOT)\\s?[)\\]}>])\\s?[A-Za-z0-9-]++)++"),
    ("email", "(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]++(?:\\x20(?:dot|DOT)\\x20[A-Za-z0-9_%+-]++)*+\\x20(?:at|AT)\\x20[A-Za-z0-9-]++(?:\\x20(?:dot|DOT)\\x20[A-Za-z0-9-]++)++"),
    ("ip", "(?<![0-9A-Za-z])[0-9]{1,3}(?:(?:\\x20?\\.\\x20?|,|\\x20?\\[\\.\\]\\x20?|\\(\\.\\)|\\x20?[(\\[]dot[)\\]]\\x20?|\\x20dot\\x20)[0-9]{1,3}){3}(?![0-9A-Za-z])"),
    ("card", "(?<![0-9])[0-9]{3,7}(?:[\\x20./-]{0,2}[0-9]){8,15}(?![0-9])"),
    ("card", "(?<![0-9])[0-9]{4}([\\x20./-]{0,2})[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}(?![0-9])"),
    ("phone", "(?<![0-9])(?:\\+|00)?\\(?[0-9][\\x20()./0-9-]{6,22}[0-9](?![0-9])"),
    ("phone", "(?<![0-9A-Za-z])(?:\\+[0-9]{1,3}[\\x20.-]?)?\\(?[0-9]{3}\\)?[\\x20.-]?[0-9]{3}[\\x20.-][0-9]{4}(?![0-9])"),
)
#: What a text must hold for any generator to match.
GATE = "[0-9][^A-Za-z]{0,40}[0-9]|@|&#64;|[(\\[{<]\\s?(?:at|AT)\\s?[)\\]}>]|\\x20(?:dot|DOT)\\x20"
#: Words before a span that speak for a kind, and words that speak against all.
CONTEXT = {"email": "mail|contact|write|correo|courriel", "ip": "\\bip\\b|address|host|server|adresse", "card": "card|visa|credit|payment|karte|carte|tarjeta", "phone": "phone|\\btel\\b|call|fax|mobile|anruf|appel|llama"}
AGAINST = "order|invoice|isbn|version|\\bref\\b|price|page|date|section|serial|tracking|timestamp|total|index|seite|commande|pedido"
BEFORE = 24
SPAN = "array<struct<start:int,end:int,match:string,nth:int>>"

#: How personal data is planted: kind, what stands before it, the span, what stands after it. {d4}: four digits,
#: {o}: an octet, {u}: letters, {card:.}: a card number in fours with that separator, {bad:.}: one that fails Luhn.
POSITIVE = (
    ("email", "", "{u}(at){u}(dot)com", ""),
    ("email", "", "{u}.{u} [at] {u}[dot]org", ""),
    ("email", "", "{u}{d2} (at) {u}.net", ""),
    ("email", "", "{u} @ {u}.com", ""),
    ("email", "", "{u}_{u}[at]{u}.co.uk", ""),
    ("email", "", "{u} dot {u} at {u} dot org", ""),
    ("email", "", "{u} AT {u} DOT com", ""),
    ("email", "", "{u}&#64;{u}.net", ""),
    ("ip", "", "{o}[.]{o}[.]{o}[.]{o}", ""),
    ("ip", "", "{o} . {o} . {o} . {o}", ""),
    ("ip", "", "{o}[dot]{o}[dot]{o}[dot]{o}", ""),
    ("ip", "", "{o}(dot){o}(dot){o}(dot){o}", ""),
    ("ip", "", "{o} dot {o} dot {o} dot {o}", ""),
    ("ip", "host ", "{o},{o},{o},{o}", ""),
    ("card", "", "{card:.}", ""),
    ("card", "", "{card:  }", ""),
    ("card", "", "{card:}", " {bad:}"),
    ("card", "{card:} ", "{card:}", ""),
    ("card", "", "{card:-}", " {d4}"),
    ("phone", "", "00{d2} {d2} {d7}", ""),
    ("phone", "", "00{d2}-{d3}-{d6}", ""),
    ("phone", "", "0{d2}/{d7}", ""),
    ("phone", "", "0{d3}/{d6}", ""),
    ("phone", "", "0{d3} {d7}", ""),
    ("phone", "", "0{d2}-{d8}", ""),
    ("phone", "", "0{d4} {d6}", ""),
    ("phone", "", "0{d1} {d2} {d2} {d2} {d2}", ""),
    ("phone", "", "({d3}) {d3}-{d4}", ""),
    ("phone", "", "(0{d2}) {d7}", ""),
    ("phone", "tel ", "{d3}.{d3}.{d4}", ""),
    ("phone", "", "{d3}-{d3}-{d4}", ""),
    ("phone", "", "1-{d3}-{d3}-{d4}", ""),
    ("phone", "", "+1 ({d3}) {d3}-{d4}", " {o}.{o}.{o}.{o}"),
    ("phone", "", "+{d2} {d3} {d3} {d4}", " {card:}"),
    ("phone", "", "+{d2} {d2} {d7}", " (2{d3})"),
)
#: What only looks like it.
DECOYS = (
    ("email", "", "{d2} @ {d1}.{d2}", ""),
    ("email", "", "{d1}x @ {d3}.{d2}", ""),
    ("ip", "", "{d1},{d3},{d3},{d3}", ""),
    ("ip", "", "9{d2}[.]{o}[.]{o}[.]{o}", ""),
    ("ip", "", "{d1} . {d1} . 7{d2} . {d1}", ""),
    ("card", "", "{bad:.}", ""),
    ("card", "", "{bad:}", ""),
    ("card", "", "{bad:-}", ""),
    ("card", "", "{bad: }", " {d4}"),
    ("card", "", "978-{d1}-{d2}-{d6}-{d1}", ""),
    ("card", "", "16{d11}", ""),
    ("card", "", "20{d2}/0{d1}/1{d1} 1{d1}.{d2}.{d2}", ""),
    ("card", "", "{d20}", ""),
    ("card", "{u}", "{d11}", "{u}"),
    ("card", "{u}{d2}{u}", "{d13}", "{u}"),
    ("card", "", "{d11}", ""),
    ("phone", "{u}", "{d9}", "{u}"),
    ("phone", "", "20{d2}-0{d1}-1{d1}", ""),
    ("phone", "", "1{d1}/0{d1}/20{d2}", ""),
    ("phone", "", "0{d1}/1{d1}/20{d2}", ""),
    ("phone", "", "0{d1}-2{d1}-20{d2}", ""),
    ("phone", "", "20{d2} - 20{d2}", ""),
    ("phone", "", "{d3}-{d7}-{d7}", ""),
    ("phone", "", "{d1}-{d4}-{d4}-{d1}", ""),
    ("phone", "", "0-{d3}-{d5}-{d1}", ""),
    ("phone", "", "{d3}.{d3}.{d3}", ""),
    ("phone", "", "{d4}/{d4}", ""),
    ("phone", "", "0.{d8}", ""),
    ("phone", "", "{d2}.{d9}", ""),
    ("phone", "", "{d5}-{d4}", ""),
    ("phone", "", "(20{d2}) {d3}-{d3}", ""),
    ("phone", "", "{d8}", ""),
    ("phone", "", "{d10}", ""),
    ("phone", "", "0{d9}", ""),
)
#: Forms and decoys that the trees never see; they choose the thresholds, and report what the trees make of new forms.
UNSEEN = (
    ("email", "", "{u} ( at ) {u} ( dot ) de", ""),
    ("email", "", "{u}.{u}<at>{u}.com", ""),
    ("email", "", "{u} dot {u} at {u} dot co dot uk", ""),
    ("email", "", "{u}{d2}[AT]{u}[DOT]org", ""),
    ("ip", "", "{o}(.){o}(.){o}(.){o}", ""),
    ("ip", "", "{o} [.] {o} [.] {o} [.] {o}", ""),
    ("ip", "server ", "{o},{o},{o},{o}", ""),
    ("card", "", "{card:/}", ""),
    ("card", "{bad:} ", "{card:}", ""),
    ("card", "", "{card:. }", ""),
    ("phone", "", "0{d3}/{d8}", ""),
    ("phone", "", "0{d2} {d8}", ""),
    ("phone", "", "00{d2}/{d3}/{d6}", ""),
    ("phone", "", "(0{d3}) {d6}", ""),
    ("phone", "", "({d3}) {d3}.{d4}", ""),
    ("phone", "", "+1 {d3}-{d3}-{d4}", " ({d4})"),
)
UNSEEN_DECOYS = (
    ("email", "", "{u} @ {d1}.{d1}", ""),
    ("ip", "", "{d2},{d2},{d1},{d2}", ""),
    ("ip", "", "{d1},{d3},{d3},{d2}", ""),
    ("card", "", "{bad:/}", ""),
    ("card", "", "{bad:  }", ""),
    ("card", "id {u}", "{d12}", "{u}{d2}"),
    ("phone", "", "1{d1}.0{d1}.20{d2} 1{d1}.{d2}", ""),
    ("phone", "", "4-{d2}/{d4}-{d2}", ""),
    ("phone", "", "20{d2}/0{d1}/2{d1}", ""),
    ("phone", "", "1-{d4}-{d4}-{d1}", ""),
    ("phone", "", "7{d2}/{d6}", ""),
    ("phone", "", "(19{d2}) {d2}-{d3}", ""),
)
#: Words that stand before half of what is planted.
SPOKEN = {"email": ("e-mail: ", "contact ", "write to "), "ip": ("ip ", "server ", "address "), "card": ("card ", "visa ", "payment "), "phone": ("call ", "phone: ", "fax "), None: ("order ", "ref ", "isbn ", "version ", "price ", "page ", "date ", "serial ")}


@dataclass(frozen=True)
class Settings:
    """sample_docs: rows, drawn whatever they hold, that spans are planted into, about so many at most; plants: spans in
    all of them together, about; precision: what a kind's threshold must reach on the planted spans of forms that were set aside; min_positive: spans that
    must be there for a kind to have a threshold."""

    sample_docs: int = 12_000
    plants: int = 24_000
    trees: int = 20
    depth: int = 5
    precision: float = 0.98
    min_positive: int = 20
    seed: int = 1


@dataclass
class Model:
    """Weighted trees, a threshold for each kind (above 1: nothing is added), and how they did on what was set aside:
    kind to (planted, proposed, accepted, accepted by mistake)."""

    trees: list = field(default_factory=list)
    thresholds: tuple[float, ...] = (2.0,) * len(KINDS)
    report: dict[str, tuple[int, int, int, int]] = field(default_factory=dict)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(number: Column) -> Column:
    """Luhn's sum over a digit string."""
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 1, F.coalesce(F.try_multiply(c.try_cast("int"), F.lit(2)), F.lit(0))).otherwise(F.coalesce(c.try_cast("int"), F.lit(0))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))


def luhn(number: Column) -> Column:
    return luhn_sum(number) % 10 == 0


def octets_fit(match: Column, between: str = "\\.") -> Column:
    parts = F.transform(F.split(match, between), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))


def valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return octets_fit(match)
    n = F.length(digits(match))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.when((n >= 12) & (n <= 19), luhn(digits(match))).otherwise(False)


def _spans(text: Column, pattern: str, nth: int) -> Column:
    return F.transform(match_spans(text, F.lit(pattern)), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("match"), F.lit(nth).alias("nth")))


def base_spans(text: Column, nth: int) -> Column:
    """Leftmost non-overlapping matches of a base pattern that pass its check; failing ones are dropped, not retried."""
    kind = KINDS[nth]
    held = text.contains("@") if kind == "email" else text.rlike(BASE_GATE[kind])
    return F.when(held, F.filter(_spans(text, BASE[kind], nth), lambda m: valid(kind, m["match"]))).otherwise(F.array().cast(SPAN))


def proposals(text: Column) -> Column:
    """Spans of all generators, each once, with 24 code points before and one after; only texts that can hold one are searched."""
    parts = F.array_distinct(F.concat(*(_spans(text, pattern, KINDS.index(k)) for k, pattern in GENERATORS)))

    def seen(m: Column) -> Column:
        at = F.greatest(m["start"] - BEFORE, F.lit(0))
        return F.struct(
            m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("match"), m["nth"].alias("nth"),
            F.lower(F.substring(text, at + 1, m["start"] - at)).alias("before"), F.substring(text, m["end"] + 1, F.lit(1)).alias("after"),
        )

    kind = SPAN.replace("nth:int", "nth:int,before:string,after:string")
    return F.when(text.rlike(GATE), F.transform(parts, seen)).otherwise(F.array().cast(kind))


def features(c: Column) -> list[Column]:
    """Format and context of a proposed span, as doubles."""
    match, number = c["match"], digits(c["match"])
    n, size = F.length(number), F.length(match)
    spoken = F.lit(0)
    for i, k in enumerate(KINDS):
        spoken = F.when((c["nth"] == i) & c["before"].rlike(CONTEXT[k]), 1).otherwise(spoken)
    groups = F.transform(F.regexp_extract_all(match, F.lit("[0-9A-Za-z]+"), F.lit(0)), lambda g: F.length(g))
    raw = [
        c["nth"], size, n, n / F.greatest(size, F.lit(1)), F.size(groups), F.coalesce(F.array_max(groups), F.lit(0)), F.coalesce(F.array_min(groups), F.lit(0)),
        F.coalesce(F.get(groups, F.lit(0)), F.lit(0)), F.coalesce(F.element_at(groups, -1), F.lit(0)), F.size(F.array_distinct(F.regexp_extract_all(match, F.lit("[^0-9A-Za-z]+"), F.lit(0)))),
        F.when((n >= 12) & (n <= 19), luhn(number)).otherwise(False).cast("int"), (match.rlike("^[0-9]+(?:[^0-9]+[0-9]+){3}$") & octets_fit(match, "[^0-9]+")).cast("int"),
        match.contains("@").cast("int"), match.rlike("(?i)[(\\[{<]\\s?(?:at|dot|\\.)\\s?[)\\]}>]|\\sdot\\s|&#64;").cast("int"), match.startswith("+").cast("int"), match.startswith("0").cast("int"), match.startswith("00").cast("int"),
        match.contains("(").cast("int"), match.contains("/").cast("int"), match.contains(".").cast("int"), match.contains(",").cast("int"), match.rlike("\\s").cast("int"), match.rlike("[A-Za-z]{2,}$").cast("int"),
        match.rlike("(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])").cast("int"), c["before"].rlike("[0-9A-Za-z]$").cast("int"), c["before"].rlike("[0-9][^0-9A-Za-z]?$").cast("int"), c["after"].rlike("[0-9A-Za-z]").cast("int"),
        spoken, c["before"].rlike(AGAINST).cast("int"), F.regexp_count(match, F.lit("\\(")) - F.regexp_count(match, F.lit("\\)")),
    ]
    return [F.coalesce(x.cast("double"), F.lit(0.0)) for x in raw]


def _node(node) -> dict:
    if node.subtreeDepth() == 0:
        return {"value": float(node.prediction())}
    split = node.split()
    return {"feature": split.featureIndex(), "at": float(split.threshold()), "low": _node(node.leftChild()), "high": _node(node.rightChild())}


def _grown(tree: dict, values: Column) -> Column:
    if "value" in tree:
        return F.lit(tree["value"])
    return F.when(F.get(values, F.lit(tree["feature"])) <= tree["at"], _grown(tree["low"], values)).otherwise(_grown(tree["high"], values))


def probability(model: Model, values: Column) -> Column:
    """The boosted trees over an array of features as nested conditions, so scoring stays inside the row."""

    def margin(v: Column) -> Column:
        total = F.lit(0.0)
        for weight, tree in model.trees:
            total = total + weight * _grown(tree, v)
        return total

    return 1 / (1 + F.exp(-2 * bound(values, margin)))


def _filled(template: str, seed: Column, salt: int) -> Column:
    """The template with its places filled from the seed."""
    out = []
    for k, (plain, name, size, between) in enumerate(re.findall(r"([^{]+)|\{(d|o|u|card|bad)([0-9]*)(?::([^}]*))?\}", template)):
        draw = F.pmod(F.xxhash64(seed, F.lit(1000 * salt + k)), F.lit(10**18))
        if plain:
            out.append(F.lit(plain))
        elif name == "d":
            more = F.pmod(F.xxhash64(seed, F.lit(1000 * salt + k + 500)), F.lit(10**18))
            out.append(F.substring(F.concat(F.lpad(draw.cast("string"), 18, "0"), F.lpad(more.cast("string"), 18, "0")), 1, int(size)))
        elif name == "o":
            out.append((draw % 256).cast("string"))
        elif name == "u":
            out.append(F.translate(F.substring(F.md5(draw.cast("string")), F.lit(1), (3 + draw % 6).cast("int")), "0123456789", "ghijklmnop"))
        else:
            first = F.concat(F.when(draw % 2 == 0, "4").otherwise("5"), F.lpad((draw % 10**14).cast("string"), 14, "0"))
            off = F.lit(0) if name == "card" else 1 + (draw % 9).cast("int")
            number = F.concat(first, F.pmod(10 - luhn_sum(F.concat(first, F.lit("0"))) % 10 + off, F.lit(10)).cast("string"))
            out.append(F.regexp_replace(number, "([0-9]{4})(?=[0-9])", f"$1{between}") if between else number)
    return F.concat(*out) if out else F.lit("")


def planted(docs: DataFrame, settings: Settings) -> DataFrame:
    """window, kind (-1: a decoy), start, end, aside: spans planted into surroundings that the documents give.

    Rows are drawn by place, so a text that many rows share is drawn as often as its share says. A window has up to 40
    code points of the text before and after the place. Set aside for calibration are the windows of UNSEEN and
    UNSEEN_DECOYS: whole forms, so none of theirs is among what the trees learn from.
    """
    n = docs.count()
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).sample(fraction=min(1.0, settings.sample_docs / max(n, 1)), seed=settings.seed)
    rows = written(rows.select("text", F.monotonically_increasing_id().alias("nth")), "span-sample")
    each = -(-settings.plants // max(1, min(n, settings.sample_docs)))
    rows = rows.select("text", "nth", F.explode(F.sequence(F.lit(1), F.lit(each))).alias("k")).select("text", F.xxhash64("text", "nth", F.col("k") + settings.seed).alias("seed"))
    seed = F.col("seed")
    drawn = lambda salt, n: F.pmod(F.xxhash64(seed, F.lit(salt)), n)
    seen = [(KINDS.index(t[0]), t) for t in POSITIVE] + [(-1, t) for t in DECOYS]
    table = seen + [(KINDS.index(t[0]), t) for t in UNSEEN] + [(-1, t) for t in UNSEEN_DECOYS]
    made = []
    for k, (kind, (name, before, span, after)) in enumerate(table):
        words = SPOKEN[name] if kind >= 0 else SPOKEN[None]
        said = F.when(drawn(1, F.lit(2)) == 0, F.get(F.array(*map(F.lit, words)), drawn(2, F.lit(len(words))).cast("int"))).otherwise("")
        parts = F.struct(F.lit(kind).alias("kind"), F.concat(said, _filled(before, seed, 3 * k)).alias("before"), _filled(span, seed, 3 * k + 1).alias("span"), _filled(after, seed, 3 * k + 2).alias("after"))
        made.append(F.when(F.col("choice") == k, parts))
    at = drawn(3, F.length("text") + 1).cast("int")
    left = F.regexp_replace(F.substring(F.col("text"), F.greatest(at - 39, F.lit(1)), F.least(at, F.lit(40))), "\\S+$", "")
    right = F.regexp_replace(F.substring(F.col("text"), at + 1, F.lit(40)), "^\\S+", "")
    rows = rows.select("seed", left.alias("left"), right.alias("right"), drawn(4, F.lit(len(table))).alias("choice"))
    rows = rows.select("choice", "left", "right", F.coalesce(*made).alias("p"))
    start = F.length("left") + F.length("p.before")
    window = F.concat("left", "p.before", "p.span", "p.after", F.lit(" "), "right")
    return rows.select(window.alias("window"), F.col("p.kind").alias("kind"), start.alias("start"), (start + F.length("p.span")).alias("end"), (F.col("choice") >= len(seen)).alias("aside"))


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Boosted trees over what the generators propose at planted spans.

    No table has labelled spans, so they are made: personal data as people write it to get past a pattern (words for
    signs, other separators, numbers side by side), and decoys (order numbers, dates, lists), each planted at a known
    place among the words of a bounded sample of rows. A proposal that touches the place is true if it is exactly the
    planted span, of its kind. A kind's threshold is the lowest score from which on the true share of the proposals
    at forms that the trees haven't seen reaches settings.precision. Fewer than min_positive proposals of either class: no trees, and the base
    alone decides; of a kind: nothing of that kind is added. No documents: no trees.
    """
    spots = written(planted(docs, settings), "planted-spans")
    found = spots.select("*", F.explode(proposals(F.col("window"))).alias("c")).where("c.start < end and start < c.end")
    truth = (F.col("c.nth") == F.col("kind")) & (F.col("c.start") == F.col("start")) & (F.col("c.end") == F.col("end"))
    table = written(found.select(truth.cast("double").alias("label"), F.col("c.nth").alias("nth"), F.array(*features(F.col("c"))).alias("values"), "aside"), "span-proposals")
    counts = {r["label"]: r["n"] for r in table.where("not aside").groupBy("label").agg(F.count("*").alias("n")).collect()}
    if min(counts.get(0.0, 0), counts.get(1.0, 0)) < settings.min_positive:
        return Model()
    data = table.where("not aside").select("label", array_to_vector("values").alias("features"))
    fitted = GBTClassifier(maxIter=settings.trees, maxDepth=settings.depth, stepSize=0.3, seed=settings.seed).fit(data)
    model = Model([(float(w), _node(t._call_java("rootNode"))) for w, t in zip(fitted.treeWeights, fitted.trees, strict=True)])
    aside = table.where("aside").select("nth", "label", probability(model, F.col("values")).alias("p")).groupBy("nth", "p").agg(F.sum("label").alias("good"), F.count("*").alias("all")).toPandas()
    there = {r["kind"]: r["n"] for r in spots.where("aside").groupBy("kind").agg(F.count("*").alias("n")).collect()}
    thresholds = []
    for i, kind in enumerate(KINDS):
        part = aside[aside["nth"] == i].sort_values("p", ascending=False)
        good, every = part["good"].cumsum().to_numpy(), part["all"].cumsum().to_numpy()
        ok = np.flatnonzero((good >= settings.precision * every) & (good >= settings.min_positive))
        thresholds.append(float(part["p"].to_numpy()[ok[-1]]) if len(ok) else 2.0)
        taken = (int(good[ok[-1]]), int(every[ok[-1]] - good[ok[-1]])) if len(ok) else (0, 0)
        model.report[kind] = (there.get(i, 0), int(part["good"].sum()), *taken)
    model.thresholds = tuple(thresholds)
    return model


PLACE = "struct<start:int,cand:int,minus_end:int,nth:int>"


def _places(spans: Column, cand: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(cand).alias("cand"), (-s["end"]).alias("minus_end"), s["nth"].alias("nth")))


def added(base: Column, accepted: Column) -> Column:
    """What of the accepted spans is added: none that overlaps a base span, leftmost first, of equal starts the longest.

    Three passes over the spans in order of their starts, so the time grows with their number.
    """
    spans = F.array_sort(F.concat(_places(base, 0), _places(accepted, 1)))
    is_base = lambda s: s["cand"] == 0
    end = lambda s: -s["minus_end"]
    after = folded(spans, F.lit(0), PLACE, lambda reach, s: (F.when(is_base(s), F.greatest(reach, end(s))).otherwise(reach), is_base(s) | (s["start"] >= reach), s))
    clear = folded(F.reverse(after), F.lit(2**31 - 1), PLACE, lambda near, s: (F.when(is_base(s), F.least(near, s["start"])).otherwise(near), ~is_base(s) & (end(s) <= near), s))
    return folded(F.reverse(clear), F.lit(0), PLACE, lambda reach, s: (F.when(s["start"] >= reach, end(s)).otherwise(reach), s["start"] >= reach, s))


def _joined(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["nth"].alias("nth"), s["end"].alias("end"))))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["nth"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, model: Model) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, base_sha256, spans, redactions.

    docs: text; further columns are carried along, whatever their names, and those called like a result (in any case)
    are replaced. Base spans always stay. Added are proposals at or above their kind's threshold that overlap no base
    span, leftmost first; ties in the start go to the longest, then to the kind listed first. Null text is empty and
    has no spans. redactions has kind, start and end (code points, end exclusive). Repeated rows are searched each. No
    rows: no rows. Everything happens inside the row: nothing is shuffled, and a very long text takes time in
    proportion to its length and little more than that to its spans.
    """
    one = docs.select(carried(docs, RESULTS).alias("own"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    one = one.select("own", "text", *(base_spans(F.col("text"), i).alias(f"b{i}") for i in range(len(KINDS))))
    kind = "array<struct<start:int,end:int,nth:int>>"
    slim = lambda spans: F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["nth"].alias("nth")))
    one = one.withColumn("base", slim(F.concat(*(f"b{i}" for i in range(len(KINDS))))))
    more = F.array().cast(kind)
    if model.trees and min(model.thresholds) <= 1:
        limits = F.array(*map(F.lit, model.thresholds))
        accepted = F.filter(proposals(F.col("text")), lambda c: probability(model, F.array(*features(c))) >= F.get(limits, c["nth"]))
        one = one.withColumn("accepted", slim(accepted))
        found = F.transform(added(F.col("base"), F.col("accepted")), lambda c: F.struct(c["start"].alias("start"), (-c["minus_end"]).alias("end"), c["nth"].alias("nth")))
        more = F.when(F.size("accepted") > 0, found).otherwise(more)
    one = one.withColumn("every", F.concat("base", more))
    names = F.array(*map(F.lit, KINDS))
    return one.select(
        *unpacked(docs, RESULTS, "own"),
        *(F.size(f"b{i}").cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("every")).alias("spans"),
        F.transform(F.array_sort("every"), lambda s: F.struct(F.get(names, s["nth"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("redactions"),
    )


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every whole text of documents; see find, and fit for what the trees learn from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find(docs, fit(docs)).select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans")

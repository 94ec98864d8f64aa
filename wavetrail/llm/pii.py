"""Personal data: candidate spans from high-recall generators, scored by boosted trees.

Main path in DataFrame functions only. Generators are regular expressions; some propose what
a format check confirms (the base spans), others propose obfuscated or loosely written forms
and overlap the base. Every candidate gets features of its format and of the 24 characters
before it. Boosted depth-two trees, fitted to the spans of all texts, are evaluated as a sum of
CASE expressions; a calibrated threshold per kind selects further spans. Base spans stay.

Offsets are code points, end exclusive. A null text counts as empty and has no span.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# Fixed values of the contract, written with possessive quantifiers and a start guard, which
# accept the same leftmost matches in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser forms: spelled-out addresses, spaced or bracketed dots, odd card separators, phones
# with a leading 00 or an area code in brackets.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+(?:\x20?[\[({]\x20?(?:at|@)\x20?[\])}]\x20?|\x20at\x20|\x20?@\x20?)[a-z0-9-]{1,63}+(?:(?:\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?|\x20dot\x20|\.)[a-z0-9-]{1,63}+){1,4}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\x20?[\[(]?\x20?(?:\.|dot)\x20?[\])]?\x20?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{1,2}+[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9])(?:00[1-9][0-9]{0,2}|\([0-9]{2,4}\))[\x20./-]{0,2}+[0-9]{2,4}(?:[\x20./-]{1,2}+[0-9]{2,4}){1,3}(?![0-9])",
}
# A cheap test that must hold before a pattern runs on a text.
NEEDS = {"email": r"@|(?i:[\x20\[({]at[\x20\])}])", "ip": r"[0-9]", "card": r"[0-9]", "phone": r"[0-9]"}
# Words before a span that speak for its kind (English, German, French, Spanish).
CUES = {
    "email": r"mail|contact|kontakt|correo|courriel",
    "ip": r"\bip\b|host|server|addr|ping",
    "card": r"card|karte|carte|tarjeta|visa|pay|credit",
    "phone": r"tel|phone|call|fon|anruf|mobil|fax|appel",
}
CONTEXT = 24
ROUNDS, RATE, PRECISION = 20, 0.3, 0.98


def _spans(text: Column, pattern: str, kind: str, base: bool) -> Column:
    """array<struct<kind, s, e, value, base>> of the leftmost matches, with offsets from the lengths between them.

    The running sum folds blocks of sqrt(n) matches, then the blocks, so no array grows by one match
    at a time over all n of a text. Arguments of a lambda are bound, so that each is computed once.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    span = "struct<s:int,e:int,value:string>"

    def match(acc, pair):
        s = acc["at"] + F.length(pair["g"])
        e = s + F.length(pair["h"])
        one = F.struct(s.alias("s"), e.alias("e"), pair["h"].alias("value"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def block(acc, part):
        one = F.struct(acc["at"].alias("base"), part["out"].alias("out"))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def empty(item: str) -> Column:
        return F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{item}>").alias("out"))

    def located(pairs: Column) -> Column:
        n = F.size(pairs)
        width = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
        firsts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), width)
        parts = F.transform(firsts, lambda i: F.aggregate(F.slice(pairs, i, width), empty(span), match))
        blocks = F.aggregate(parts, empty(f"struct<base:int,out:array<{span}>>"), block, lambda acc: acc["out"])
        return F.flatten(F.transform(blocks, lambda y: F.transform(y["out"], lambda x: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), (y["base"] + x["s"]).alias("s"), (y["base"] + x["e"]).alias("e"),
            x["value"].alias("value"), F.lit(base).alias("base")))))

    pairs = F.transform(F.array(F.struct(gaps.alias("gaps"), hits.alias("hits"))), lambda y: F.arrays_zip(
        F.slice(y["gaps"], 1, F.size(y["hits"])).alias("g"), y["hits"].alias("h")))
    return F.flatten(F.transform(pairs, located))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if the digit string passes the Luhn check; digits count from the right."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _octets(value: Column) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.cast("int"), F.lit(999)) <= 255))


def _valid(kind: str, value: Column) -> Column:
    """The check of the contract on a base match."""
    n = F.length(digits(value))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _octets(value)
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), luhn(digits(value))).otherwise(F.lit(False))
    return (n >= 9) & (n <= 15)


def _checked(spans: Column, kind: str, good: bool) -> Column:
    """Those spans that pass (or fail) the check of their kind."""
    return F.filter(spans, lambda x: _valid(kind, x["value"]) if good else ~_valid(kind, x["value"]))


def _of_kind(spans: str, k: int) -> Column:
    return F.filter(spans, lambda x: x["kind"] == k)


_EMPTY = "array<struct<kind:int,s:int,e:int,value:string,base:boolean>>"


def base_spans(text: Column) -> Column:
    """The base spans of all kinds, by kind, then start."""
    found = []
    for kind in KINDS:
        need = F.contains(text, F.lit("@")) if kind == "email" else text.rlike("[0-9]")
        spans = _checked(_spans(text, BASE[kind], kind, True), kind, True)
        found.append(F.when(need, spans).otherwise(F.array().cast(_EMPTY)))
    return F.concat(*found)


def candidate_spans(text: Column) -> Column:
    """Every candidate: base matches that fail their check and the loose forms; they may overlap."""
    found = []
    for kind in KINDS:
        need = text.rlike(NEEDS[kind])
        loose = _spans(text, LOOSE[kind], kind, False)
        if kind != "email":
            refused = _checked(_spans(text, BASE[kind], kind, False), kind, False)
            loose = F.concat(loose, refused)
        found.append(F.when(need, loose).otherwise(F.array().cast(_EMPTY)))
    return F.concat(*found)


def features(kind: Column, value: Column, before: Column) -> dict[str, Column]:
    """Small whole numbers that describe format and context."""
    n = F.length(digits(value))
    cue = reduce(lambda a, k: F.when(kind == KINDS.index(k), F.lower(before).rlike(CUES[k])).otherwise(a), KINDS, F.lit(False))
    return {
        "kind": kind,
        "n_digits": F.least(n, F.lit(24)),
        "n_chars": F.least(F.length(value), F.lit(64)),
        "n_letters": F.least(F.length(F.regexp_replace(value, "[^A-Za-z]", "")), F.lit(32)),
        "n_marks": F.least(F.length(F.regexp_replace(value, "[A-Za-z0-9]", "")), F.lit(16)),
        "plus": value.startswith("+").cast("int"),
        "zeros": value.startswith("00").cast("int"),
        "bracket": value.rlike(r"[\[({]").cast("int"),
        "at_sign": value.rlike("@").cast("int"),
        "at_word": value.rlike(r"(?i)(?:^|[\x20\[({])at(?:[\x20\])}]|$)").cast("int"),
        "dot_word": value.rlike(r"(?i)[\x20\[({]dot[\x20\])}]").cast("int"),
        "luhn": F.when((n >= 13) & (n <= 19), luhn(digits(value))).otherwise(F.lit(False)).cast("int"),
        "octets": F.when(F.length(value) <= 40, F.size(F.filter(F.split(value, "[^0-9]+"), lambda p: (p != "") & (F.length(p) <= 3) & (F.coalesce(p.cast("int"), F.lit(999)) <= 255)))).otherwise(0),
        "cue": cue.cast("int"),
    }


FEATURES = ("kind", "n_digits", "n_chars", "n_letters", "n_marks", "plus", "zeros", "bracket", "at_sign", "at_word", "dot_word", "luhn", "octets", "cue")

# A small table of written examples for forms that a corpus may lack, with their label.
EXAMPLES = (
    ("email", "mail me: ", "jane.doe at example dot com", 1), ("email", "", "jane [at] example [dot] org", 1),
    ("email", "kontakt ", "info(at)firma(dot)de", 1), ("email", "", "bob (at) mail.example.com", 1),
    ("email", "write to ", "ann_lee @ example.net", 1), ("email", "", "x.y at z dot co dot uk", 1),
    ("email", "we met ", "him at noon. Then", 0), ("email", "", "look at this. And", 0), ("email", "she was ", "there at home. It", 0),
    ("email", "", "was at 5.30", 0), ("email", "arrive ", "home at last. We", 0), ("email", "", "price at 10.50", 0),
    ("ip", "server ", "10[.]0[.]0[.]12", 1), ("ip", "", "192 dot 168 dot 1 dot 7", 1), ("ip", "host ", "10(.)1(.)2(.)3", 1),
    ("ip", "version ", "1.2.300.4", 0), ("ip", "", "999.12.40.3", 0), ("ip", "section ", "3. 1. 4. 1", 0),
    ("card", "card ", "4111.1111.1111.1111", 1), ("card", "visa ", "4012/8888/8888/1881", 1), ("card", "", "5555_5555_5555_4444", 1),
    ("card", "", "1234 5678 9012 3456", 0), ("card", "order ", "9999-8888-7777-6666", 0), ("card", "", "2000/2001/2002/2003", 0),
    ("card", "id ", "1234567890123456", 0), ("card", "", "20240101", 0), ("card", "no ", "12345", 0),
    ("phone", "tel ", "(030) 123 4567", 1), ("phone", "call ", "0049 30 1234 567", 1), ("phone", "phone ", "(555) 123-4567", 1),
    ("phone", "", "(020) 7946-0958", 1), ("phone", "", "0033 1 4266 1014", 1), ("phone", "", "(2020) 12 14", 0),
    ("phone", "year ", "(1999) 20-21", 0), ("phone", "", "+1 2", 0), ("phone", "", "+12 34 56", 0), ("phone", "see ", "(12) 34 56", 0),
)


def candidate_rows(docs: DataFrame, spans: Column) -> DataFrame:
    """One row per span with its `FEATURES`."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(text.alias("text"), F.explode(spans).alias("c"))
    before = F.expr(f"substring(text, greatest(c.s - {CONTEXT} + 1, 1), least(c.s, {CONTEXT}))")
    named = features(F.col("c.kind"), F.col("c.value"), before)
    return rows.select(*[named[f].cast("int").alias(f) for f in FEATURES], F.col("c.base").alias("base"))


def training_rows(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct feature rows of all texts and of `EXAMPLES`: (values, weights, positive weights).

    Base spans are positive, matches that fail the check of their kind are negative. Spark counts
    them by feature row, so what the driver fits on grows with the kinds of spans (features are
    small whole numbers), not with the texts.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs["text"], F.lit(""))
    refused = F.concat(*[F.when(text.rlike("[0-9]"), _checked(_spans(text, BASE[k], k, False), k, False)).otherwise(F.array().cast(_EMPTY)) for k in KINDS[1:]])
    rows = candidate_rows(docs, F.concat(base_spans(text), refused))
    known = rows.groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base").cast("long")).alias("pos")).toArrow()
    written = spark.createDataFrame([(KINDS.index(k), b, v, y) for k, b, v, y in EXAMPLES], "kind int, before string, value string, y int")
    named = features(F.col("kind"), F.col("value"), F.col("before"))
    written = written.select(*[named[f].cast("int").alias(f) for f in FEATURES], F.col("y")).toArrow()

    def column(name):
        return np.concatenate([t.column(name).to_numpy().astype(np.int16) for t in (known, written)])

    values = np.stack([column(f) for f in FEATURES], axis=1)
    n, pos = (known.column(c).to_numpy().astype(np.float64) for c in ("n", "pos"))
    heavy = max(1.0, n.sum() / 200)
    weight = np.concatenate([n, np.full(len(EXAMPLES), heavy)])
    positive = np.concatenate([pos, heavy * written.column("y").to_numpy()])
    # one order of rows, so that sums do not depend on the order of arrival
    order = np.lexsort((positive, weight, *values.T[::-1]))
    return values[order], weight[order], positive[order]


def fit_trees(rows: tuple[np.ndarray, np.ndarray, np.ndarray], rounds: int = ROUNDS, rate: float = RATE) -> tuple[float, list]:
    """Depth-two trees on the logistic loss: (start, [(f, t, low, high)]), low and high being (f, t, left, right).

    Each split is chosen by the second-order gain over all thresholds of all features.
    """
    values, weight, positive = rows
    pos, n = float(positive.sum()), float(weight.sum())
    start = math.log((pos + 1) / (n - pos + 1))
    score = np.full(len(weight), start)
    trees = []

    def leaf(ids, g, h):
        return rate * float(g[ids].sum()) / (float(h[ids].sum()) + 1.0)

    def split(ids, g, h):
        best = (1e-9, 0, 10**6)
        sg, sh = g[ids].sum(), h[ids].sum()
        for f in range(len(FEATURES)):
            found, place = np.unique(values[ids, f], return_inverse=True)
            a = np.cumsum(np.bincount(place, g[ids], len(found)))[:-1]
            b = np.cumsum(np.bincount(place, h[ids], len(found)))[:-1]
            gains = a * a / (b + 1) + (sg - a) ** 2 / (sh - b + 1) - sg * sg / (sh + 1)
            if len(gains) and gains.max() > best[0] + 1e-12:
                best = (float(gains.max()), f, int(found[gains.argmax()]))
        return best[1], best[2]

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = positive - weight * p, weight * p * (1 - p)
        f, t = split(np.arange(len(weight)), g, h)
        sides = []
        for ids in (np.flatnonzero(values[:, f] <= t), np.flatnonzero(values[:, f] > t)):
            f2, t2 = split(ids, g, h)
            left, right = ids[values[ids, f2] <= t2], ids[values[ids, f2] > t2]
            a, b = leaf(left, g, h), leaf(right, g, h)
            sides.append((f2, t2, a, b))
            score[left] += a
            score[right] += b
        trees.append((f, t, *sides))
    return start, trees


def tree_scores(model: tuple[float, list], values: np.ndarray) -> np.ndarray:
    total = np.full(len(values), model[0])
    for f, t, (f2, t2, a, b), (f3, t3, c, d) in model[1]:
        low, high = np.where(values[:, f2] <= t2, a, b), np.where(values[:, f3] <= t3, c, d)
        total += np.where(values[:, f] <= t, low, high)
    return total


def thresholds(model, rows: tuple[np.ndarray, np.ndarray, np.ndarray], precision: float = PRECISION) -> list[float]:
    """Per kind the lowest score at which the fitted rows reach the wanted precision; at least 0."""
    values, weight, positive = rows
    score = tree_scores(model, values)
    out = []
    for k in range(len(KINDS)):
        mine = np.flatnonzero(values[:, 0] == k)
        ranked = mine[np.lexsort((positive[mine], weight[mine], score[mine]))[::-1]]
        good = np.cumsum(positive[ranked]) / np.cumsum(weight[ranked]) >= precision
        best = float(score[ranked[good]].min()) if good.any() else math.inf
        out.append(max(0.0, best - 1e-9))
    return out


def score_column(model: tuple[float, list], feats: dict[str, Column]) -> Column:
    """The boosted trees as one expression."""
    def pick(f, t, a, b):
        return F.when(feats[FEATURES[f]] <= t, a).otherwise(b)

    parts = [pick(f, t, pick(*low[:2], F.lit(low[2]), F.lit(low[3])), pick(*high[:2], F.lit(high[2]), F.lit(high[3]))) for f, t, low, high in model[1]]
    return reduce(lambda a, b: a + b, parts, F.lit(model[0]))


def find_spans(docs: DataFrame) -> DataFrame:
    """`docs` with `base_spans` and `more_spans`: array<struct<kind, s, e, value, base>>.

    Further spans never repeat a base span of the same kind and range. The fit counts the spans of
    all texts by their features; the rest is one projection without a shuffle.
    """
    rows = training_rows(docs)
    model = fit_trees(rows)
    limits = thresholds(model, rows)
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumns({"base_spans": base_spans(text), "__more": candidate_spans(text)})

    def described(x):
        before = F.substring(text, F.greatest(x["s"] - CONTEXT + 1, F.lit(1)), F.least(x["s"], F.lit(CONTEXT)))
        named = features(x["kind"], x["value"], before)
        return F.struct(x.alias("span"), *[named[f].cast("int").alias(f) for f in FEATURES])

    def chosen(y):
        limit = F.element_at(F.array(*[F.lit(v) for v in limits]), y["kind"] + 1)
        return score_column(model, {f: y[f] for f in FEATURES}) >= limit

    def is_new(x):
        return ~F.exists("base_spans", lambda b: (b["kind"] == x["kind"]) & (b["s"] == x["s"]) & (b["e"] == x["e"]))

    scored = F.filter(F.transform("__more", described), chosen)
    more = F.filter(F.transform(scored, lambda y: y["span"]), is_new)
    return found.withColumn("more_spans", F.when(F.size("__more") > 0, more).otherwise(F.array().cast(_EMPTY))).drop("__more")


def _joined(spans: Column) -> Column:
    name = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


def span_report(docs: DataFrame) -> DataFrame:
    """Per document: counts of base spans by kind, hash of the base spans, all spans as text."""
    out = find_spans(docs.select("doc_id", "text"))
    every = F.array_sort(F.array_distinct(F.transform(F.concat("base_spans", "more_spans"), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))))
    counts = [F.size(_of_kind("base_spans", k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(_joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with `redacted`: every character inside a selected span, base or further, becomes a block sign."""
    out = find_spans(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = F.array_sort(F.transform(F.concat("base_spans", "more_spans"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))

    def step(acc, x):
        s = F.greatest(x["s"], acc["at"])
        e = F.greatest(x["e"], acc["at"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s - acc["at"]), F.repeat(F.lit("\u2588"), e - s)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return out.withColumn("redacted", done)

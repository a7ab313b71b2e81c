"""Personal data by weak supervision, in DataFrame operations only.

Base patterns (e-mail addresses, IP addresses, payment cards, phone numbers) always stand. Wider patterns propose more
candidate spans, on which labelers vote yes, no or not at all: the strict pattern, a shape test, gazetteers (top-level
domains, card issuers, calling codes, placeholders), the words before the span, and its boundary.
Expectation-maximisation over the counts of vote patterns, taken from all documents, estimates each labeler's
reliability and the share of true spans, kind by kind; an abstention is no evidence. Its posteriors train the final
span classifier, a logistic regression per kind on the votes and on the span's own length, variety and characters,
which decides about the candidates that are not base spans.

Rates start from the documented priors ``PRIOR`` with the weight of ``STRENGTH`` candidates, and a kind's n candidates
together weigh n * STRENGTH / (n + STRENGTH), so a table of any size moves a rate at most halfway from its prior. What
the table holds still counts: a candidate near the threshold that is no base span may be accepted beside some texts and
not beside others. Base spans never change. Only the counts of (kind, votes, features) reach the
driver, at most kinds x 3^labelers x feature bins.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE = KINDS[:4]
LABELERS = ["pattern", "shape", "gazetteer", "context", "boundary"]
#: A vote is a digit of base three.
NO, NONE, YES = 0, 1, 2
PATTERNS = 3 ** len(LABELERS)
#: Prior rates of a yes among the votes on true and on false candidates, by labeler; the share of true candidates is one half.
PRIOR = {"pattern": (0.999, 0.30), "shape": (0.85, 0.30), "gazetteer": (0.80, 0.35), "context": (0.85, 0.25), "boundary": (0.90, 0.45)}
#: Where a kind's labeler knows more: a secret is hardly ever a placeholder, a number of an order or invoice hardly ever a phone or a card.
PRIOR_OF = {("secret", "gazetteer"): (0.98, 0.35), ("phone", "context"): (0.98, 0.25), ("card", "context"): (0.98, 0.25)}
STRENGTH = 100.0
#: Bins of a span's features: code points, distinct code points, and whether it has digits only, letters only or both.
LENGTHS, VARIETY, CLASSES = (12, 20, 40), (6, 10), 3
BINS = (len(LENGTHS) + 1) * (len(VARIETY) + 1) * CLASSES

# The base patterns, written so that Java's matcher neither recurses per repetition nor rescans a run of characters:
# possessive repetitions where nothing can be given back, and starts only after the last match or outside a run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole chains of digits with single separators: 13 to 19 digits; the base kind keeps 16 to 19 that pass Luhn.
CHAIN = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Wider patterns: spelled-out addresses, national phone numbers, assigned secrets (the span is the value alone).
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?:(?: ?(?:\[dot\]|\(dot\)) ?|\.)[A-Za-z0-9-]++)++"
NATIONAL = r"(?<![0-9+().-])(?<![0-9+)][ .-])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])"
SECRET = r"""(?i)(?<=token|secret|password|passwd|api_key|apikey)["']?\s*+[:=]\s*+["']?[0-9a-z+/_=-]{16,}+["']?"""
VALUE = r"""["']?([0-9A-Za-z+/_=-]{16,})["']?$"""

PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
OCTETS = rf"^(?:{PART}\.){{3}}{PART}$"
#: Gazetteers.
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|io|info|biz|de|fr|es|it|uk|nl|eu|us|ca)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|36|38|6011|62|65)"
CALLING = r"^(?:\+?(?:1|33|34|39|44|49|31|32|41|43|46|47|48|52|55|61|81|86|91)[^0-9]|\(?[2-9])"
PLACEHOLDER = r"(?i)(?:example|changeme|change_me|placeholder|your[_-]|dummy|sample|xxxx|0000000|1234567|abcdefg)"
KNOWN = r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|sk-[0-9A-Za-z_-]{20,}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35})$"
CONTEXT = {
    "email": r"(?i)(?:e-?mail|contact|write|reach|@|correo|courriel)",
    "ip": r"(?i)(?:\bip\b|host|server|addr|login)",
    "card": r"(?i)(?:card|visa|master|credit|payment|karte|carte|tarjeta)",
    "phone": r"(?i)(?:phone|tel\b|call|mobile|fax|telefon|t[eé]l)",
    "secret": r"(?i)(?:auth|bearer|access|private|client|credential|export|header|login)",
}
AGAINST = {
    "email": r"(?i)(?:for example|e\.g\.|such as)\s*\S*\s*$",
    "ip": r"(?i)(?:version|release|section|chapter|\bv)\.?\s*$",
    "card": r"(?i)(?:isbn|order|invoice|serial|article|tracking|account)\W*(?:no\.?|number|#)?\W*$",
    "phone": r"(?i)(?:isbn|order|invoice|serial|article|part|fig)\W*(?:no\.?|number|#)?\W*$",
    "secret": r"(?i)(?:example|sample|placeholder|dummy|fake)\W*\w*$",
}
BEFORE = 24
SPANS = "array<struct<kind:int,s:int,e:int,base:boolean,votes:int,bin:int>>"


def _found(text, pattern: str):
    """Array of (s, e, v, before, after): code-point span, matched text, the code points before it and the one after it, in order."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ends = F.zip_with(gaps, F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))), lambda g, h: F.struct(F.length(g).alias("n"), F.substring(g, -BEFORE, BEFORE).alias("before"), F.substring(F.coalesce(h, F.lit("")), 1, 1).alias("after")))
    pairs = F.zip_with(ends, hits, lambda g, m: F.struct(g["n"].alias("n"), g["before"].alias("before"), g["after"].alias("after"), m.alias("m")))
    kind = "array<struct<s:int,e:int,v:string,before:string,after:string>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(kind).alias("out"))

    def step(acc, x):
        s = acc["at"] + x["n"]
        e = s + F.length(x["m"])
        one = F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("v"), x["before"].alias("before"), x["after"].alias("after")))
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(e.alias("at"), F.when(acc["out"].isNull(), one).otherwise(F.concat(acc["out"], one)).alias("out")))

    return F.coalesce(F.aggregate(pairs, start, step, lambda acc: acc["out"]), F.array().cast(kind))


def _digits(v):
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits):
    """Whether the Luhn sum of a string of digits ends in 0."""
    at = F.split(F.reverse(digits), "(?<=.)(?=.)")
    value = F.transform(at, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def _vote(yes, no):
    return F.when(yes, F.lit(YES)).when(no, F.lit(NO)).otherwise(F.lit(NONE))


def _rated(kind: str, x, base, strict):
    """One candidate with the digits of its votes as a number, the bin of its features, and whether it is a base span.

    ``strict``: the vote of the strict pattern.
    """
    v, before, s, e = x["v"], x["before"], x["s"], x["e"]
    if kind == "secret":  # the assignment's sign and the quotes are no part of the secret
        value = F.regexp_extract(v, VALUE, 1)
        e = e - F.when(v.rlike("[\"']$"), 1).otherwise(0)
        v, s = value, e - F.length(value)
    digits = _digits(v)
    letters, figures = v.rlike("[A-Za-z]"), v.rlike("[0-9]")
    shape = {
        "email": lambda: _vote(v.rlike(r"(?i)[.)\]] ?[a-z]{2,24}$"), F.lit(True)),
        "ip": lambda: _vote(~v.rlike(r"(?:^|\.)0[0-9]"), F.lit(True)),
        "card": lambda: _vote(F.length(digits).isin(15, 16) & ~v.rlike("-.* | .*-"), F.lit(True)),
        "phone": lambda: _vote(F.length(digits).between(10, 12), ~F.length(digits).between(8, 15)),
        "secret": lambda: _vote(letters & figures, F.lit(True)),
    }[kind]()
    gazetteer = {
        "email": lambda: _vote(v.rlike(DOMAINS), F.lit(False)),
        "ip": lambda: _vote(v.rlike(r"^(?!0|127\.|255\.)"), F.lit(True)),
        "card": lambda: _vote(digits.rlike(ISSUERS), F.lit(True)),
        "phone": lambda: _vote(v.rlike(CALLING), F.lit(False)),
        "secret": lambda: _vote(~v.rlike(PLACEHOLDER), F.lit(True)),
    }[kind]()
    context = _vote(before.rlike(CONTEXT[kind]), before.rlike(AGAINST[kind]))
    word = r"[\p{L}\p{N}]"
    # a secret's value ends at a quote or where no more of its characters follow; its left end is the sign before it
    joined = x["after"].rlike(word) if kind == "secret" else before.rlike(word + "$") | x["after"].rlike(word)
    votes = [strict, shape, gazetteer, context, _vote(~joined, F.lit(True))]
    number = sum((d * F.lit(3**i) for i, d in enumerate(votes[1:], 1)), votes[0])
    length, many = F.length(v), F.size(F.array_distinct(F.split(v, "")))
    bins = sum((F.when(length >= n, 1).otherwise(0) for n in LENGTHS), F.lit(0))
    bins = bins * (len(VARIETY) + 1) + sum((F.when(many >= n, 1).otherwise(0) for n in VARIETY), F.lit(0))
    bins = bins * CLASSES + F.when(letters & figures, 2).when(letters, 1).otherwise(0)
    return F.struct(F.lit(KINDS.index(kind)).alias("kind"), s.alias("s"), e.alias("e"), base.alias("base"), number.cast("int").alias("votes"), bins.cast("int").alias("bin"))


def candidate_spans(text):
    """Candidate spans of a text with kind (index into KINDS), s, e, base, votes and feature bin, by kind, then start."""
    no, yes = F.lit(False), F.lit(True)

    def gated(gate, pattern: str, rate):
        # most texts have none of a kind: a plain search is far cheaper than the full pattern
        return F.when(gate, F.transform(_found(text, pattern), rate)).otherwise(F.array().cast(SPANS))

    def card(x):
        digits = _digits(x["v"])
        base = F.length(digits).between(16, 19) & _luhn(digits)
        return _rated("card", x, base, _vote(base, ~_luhn(digits)))

    def sure(kind, ok):
        return lambda x: _rated(kind, x, ok(x["v"]), _vote(ok(x["v"]), F.lit(True)))

    unsure = F.lit(NONE)
    sets = [
        gated(F.contains(text, F.lit("@")), EMAIL, sure("email", lambda v: yes)),
        gated(F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]")), SPELLED, lambda x: _rated("email", x, no, unsure)),
        gated(text.rlike(r"[0-9]\.[0-9]"), IP, sure("ip", lambda v: v.rlike(OCTETS))),
        gated(text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), CHAIN, card),
        gated(F.contains(text, F.lit("+")), PHONE, sure("phone", lambda v: F.length(_digits(v)).between(8, 15))),
        gated(text.rlike(r"[0-9]{3}[-.][0-9]{4}"), NATIONAL, lambda x: _rated("phone", x, no, unsure)),
        gated(text.rlike(r"""[:=]\s*+["']?[0-9A-Za-z+/_=-]{16}"""), SECRET, lambda x: _rated("secret", x, no, _vote(F.regexp_extract(x["v"], VALUE, 1).rlike(KNOWN), F.lit(False)))),
    ]
    return F.array_sort(F.concat(*sets))


def _digits_of(votes: int) -> list[int]:
    return [votes // 3**i % 3 for i in range(len(LABELERS))]


def estimate(counts: list[tuple[int, int, int, bool, int]], rounds: int = 100) -> tuple[list[float], list[list[tuple[float, float]]]]:
    """EM on (kind, votes, bin, base, count) rows: per kind the share of true spans and each labeler's rates of yes among its votes, on true and on false spans.

    Base spans are true by definition. The share is that of the other candidates.
    """
    share, rates = [], []
    for kind in range(len(KINDS)):
        rows = [(_digits_of(v), base, n) for k, v, _bin, base, n in counts if k == kind]
        total = sum(n for *_x, n in rows)
        weight = STRENGTH / (total + STRENGTH)
        prior = [PRIOR_OF.get((KINDS[kind], x), PRIOR[x]) for x in LABELERS]
        pi, rate = 0.5, prior
        for _ in range(rounds):
            post = [1.0 if base else _sigmoid(_evidence(d, pi, rate)) for d, base, _n in rows]
            open_ = [(p, n * weight) for p, (_d, base, n) in zip(post, rows) if not base]
            pi = (sum(p * n for p, n in open_) + STRENGTH / 2) / (sum(n for _p, n in open_) + STRENGTH)
            new = []
            for i, name in enumerate(LABELERS):
                cast = [(p, n * weight, d[i] == YES) for p, (d, _b, n) in zip(post, rows) if d[i] != NONE]
                hit, alarm = prior[i]
                if name != "pattern":  # what a true span of a kind looks like is the strict pattern's definition
                    hit = (hit * STRENGTH + sum(p * n for p, n, yes in cast if yes)) / (STRENGTH + sum(p * n for p, n, _y in cast))
                alarm = (alarm * STRENGTH + sum((1 - p) * n for p, n, yes in cast if yes)) / (STRENGTH + sum((1 - p) * n for p, n, _y in cast))
                new.append((hit, min(alarm, hit)))  # a labeler is never worse than chance, so the classes cannot swap
            rate = new
        share.append(pi)
        rates.append(rate)
    return share, rates


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _evidence(digits: list[int], pi: float, rate: list[tuple[float, float]]) -> float:
    """Log odds that a candidate is true; an abstention adds nothing."""
    z = math.log(pi / (1 - pi))
    for d, (hit, alarm) in zip(digits, rate):
        z += math.log(hit / alarm) if d == YES else math.log((1 - hit) / (1 - alarm)) if d == NO else 0.0
    return z


def _features(votes: int, bin_: int | None) -> list[float]:
    """Bias, a yes and a no per labeler, then one of each group of feature bins (none of them for a vote pattern as such)."""
    out = [1.0] + [float(d == want) for d in _digits_of(votes) for want in (YES, NO)]
    sizes = (len(LENGTHS) + 1, len(VARIETY) + 1, CLASSES)
    at = (-1, -1, -1) if bin_ is None else (bin_ // (sizes[1] * sizes[2]), bin_ // sizes[2] % sizes[1], bin_ % sizes[2])
    return out + [float(i == a) for a, n in zip(at, sizes) for i in range(n)]


def train(counts: list[tuple[int, int, int, bool, int]], share: list[float], rates: list[list[tuple[float, float]]], steps: int = 30) -> list[np.ndarray]:
    """Weights of the span classifier per kind: a ridge logistic regression of the EM posteriors, by Newton's method.

    It is fitted on the kind's candidates and, with the weight ``STRENGTH``, on all vote patterns, so that patterns
    which the table does not hold are judged by the estimated rates.
    """
    out = []
    for kind in range(len(KINDS)):
        own = [(v, b, base, n) for k, v, b, base, n in counts if k == kind]
        total = sum(r[3] for r in own)
        x = [_features(v, b) for v, b, _base, _n in own] + [_features(v, None) for v in range(PATTERNS)]
        y = [1.0 if base else _sigmoid(_evidence(_digits_of(v), share[kind], rates[kind])) for v, _b, base, _n in own] + [_sigmoid(_evidence(_digits_of(v), share[kind], rates[kind])) for v in range(PATTERNS)]
        c = [n * STRENGTH / (total + STRENGTH) for *_x, n in own] + [STRENGTH / PATTERNS] * PATTERNS
        x, y, c = np.array(x), np.array(y), np.array(c)
        w = np.zeros(x.shape[1])
        ridge = np.full(len(w), 1e-2)
        ridge[1 + 2 * len(LABELERS) :] = 1.0  # features of the span weigh less than votes
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x.T * (c * p * (1 - p))) @ x + np.diag(ridge), x.T @ (c * (y - p)) - ridge * w)
            w = w + step
            if np.abs(step).max() < 1e-9:
                break
        out.append(w)
    return out


def learn(spans: DataFrame) -> list[np.ndarray]:
    """The classifier's weights per kind, from a column ``spans`` of candidates: EM, then the regression."""
    one = spans.select(F.explode("spans").alias("x")).groupBy("x.kind", "x.votes", "x.bin", "x.base").agg(F.count(F.lit(1)).alias("n"))
    counts = sorted((r["kind"], r["votes"], r["bin"], r["base"], r["n"]) for r in one.collect())
    return train(counts, *estimate(counts))


def log_odds(weights: list[np.ndarray], kind: int, votes: int, bin_: int) -> float:
    return float(np.dot(_features(votes, bin_), weights[kind]))


def _constant(values) -> object:
    """An array constant: one literal in the plan, folded once, looked up by position."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def _accepted(df: DataFrame, weights: list[np.ndarray], threshold: float) -> DataFrame:
    """``spans`` cut to the base spans and the accepted candidates: structs (kind, s, e, base, p)."""
    votes = _constant(np.dot(_features(v, None), w) for w, v in product(weights, range(PATTERNS)))
    rest = _constant(np.dot(np.subtract(_features(0, b), _features(0, None)), w) for w, b in product(weights, range(BINS)))
    others = [c for c in df.columns if c not in ("spans", "rated", "sure")]
    cols = [F.col(f"`{c}`") for c in others]
    z = lambda x: F.get(votes, x["kind"] * PATTERNS + x["votes"]) + F.get(rest, x["kind"] * BINS + x["bin"])
    rated = F.transform("spans", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base"), (1 / (1 + F.exp(-z(x)))).alias("p")))
    keep = F.filter("rated", lambda x: x["base"] | ((x["p"] >= threshold) & ~F.exists("sure", lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"]))))
    return df.select(*cols, rated.alias("rated")).select(*cols, "rated", F.filter("rated", lambda x: x["base"]).alias("sure")).select(*cols, keep.alias("spans"))


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, spans)``, one row per document: base spans and the candidates that the classifier accepts.

    Spans are structs (kind, s, e, base, p) in the order of KINDS, then start; offsets in code points, end exclusive.
    Added spans never overlap a base span. A null text is empty; repeated rows keep their number; an empty table gives
    an empty result, and no candidates give empty arrays.
    """
    found = written(text_or_empty(docs, "doc_id").select("doc_id", candidate_spans(F.col("text")).alias("spans")), "pii-candidates")
    return _accepted(found, learn(found), threshold)


def _of_kind(k: int):
    return lambda x: x["kind"] == k


def digest(found: DataFrame) -> DataFrame:
    """The query's columns: counts and hash of the base spans, and all spans as ``kind:start:end``."""
    kinds = F.array(*[F.lit(k) for k in KINDS])

    def line(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["s"], x["e"])), ",")

    base = F.filter("spans", lambda x: x["base"])
    n = [F.size(F.filter(base, _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    added = F.size(F.filter("spans", lambda x: ~x["base"])).cast("long")
    return found.select("doc_id", *n, F.sha2(line(base), 256).alias("base_sha256"), line("spans").alias("spans"), added.alias("n_added"))


def redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents with every found span replaced by ``<KIND>``; overlapping spans by the first one's kind.

    Columns, their order and null texts stay; ``n_chars``, where there is one, is recounted for changed texts. The
    candidates are computed twice, for the counts and for the texts, rather than kept beside copies of all texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    weights = learn(docs.select(candidate_spans(text).alias("spans")))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), candidate_spans(text).alias("spans"))
    spans = _accepted(own, weights, threshold)
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    by_start = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        new = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), F.get(names, x["kind"]))
        return F.when(x["s"] >= acc["at"], F.struct((-x["e"]).alias("at"), new.alias("out"))).otherwise(F.struct(F.greatest(acc["at"], -x["e"]).alias("at"), acc["out"].alias("out")))

    cut = F.aggregate(by_start, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    done = spans.withColumn("new", F.when(F.size("spans") > 0, cut))
    cols = []
    for c in docs.columns:
        old = F.col(f"row.`{c}`")
        if c == "text":
            old = F.coalesce(F.col("new"), old)
        elif c == "n_chars":
            old = F.when(F.col("new").isNotNull(), F.length("new").cast(docs.schema[c].dataType)).otherwise(old)
        cols.append(old.alias(c))
    return done.select(*cols)

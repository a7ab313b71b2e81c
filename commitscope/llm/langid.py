"""Hierarchical language identification.

Level one tells language families apart, level two the languages within a family; both use one-versus-one linear
support vector machines (squared hinge, trained by accelerated gradient descent) over hashed byte 2- and 3-grams of the
whole, ASCII-lower-cased text. The classifiers are fitted on the driver from a bounded sample of labelled documents
(``SAMPLE_PER_LANG``) of distinct texts, whose gram counts the executors take over whole texts; prediction streams
Arrow batches through numpy on the executors.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, slices, text_or_empty

#: Distinct labelled texts per language that training uses at most.
SAMPLE_PER_LANG = 400
BUCKETS = 1 << 14
#: Bytes whose grams are hashed at a time; bounds a worker's arrays.
PART_BYTES = 1 << 20
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Families of ISO 639-1 codes; any other label is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "bg", "sr", "mk", "hr", "bs", "sl", "cs", "sk", "pl"],
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}


def grams(data: bytes) -> np.ndarray:
    """Bucket of the 2-gram and of the 3-gram that start at each byte; ``data`` ends with two spare bytes."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    two = b[:-2] << np.uint32(8) | b[1:-1]
    three = two << np.uint32(8) | b[2:]
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    return np.concatenate([(two + np.uint32(0x5EED)) * np.uint32(2654435761) >> shift, (three + np.uint32(0xC0FFEE)) * np.uint32(2246822519) >> shift])


def sparse_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the grams of a whole text, the non-zero ones; long texts are counted in overlapping parts."""
    data = b" " + text.lower() + b"  "
    total = np.zeros(BUCKETS, np.int64)
    for i in range(0, len(data) - 2, PART_BYTES):
        total += np.bincount(grams(data[i : i + PART_BYTES + 2]), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def features(counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Rows of gram frequencies, square-rooted and scaled to unit length: sensitive to rare grams, not to text length."""
    x = np.zeros((len(counts), BUCKETS), np.float32)
    for i, (at, n) in enumerate(counts):
        x[i, at] = np.sqrt(n)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM for y in {-1, 1}; classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    pw, pb = w.copy(), b
    rate = 1.0 / (1.0 / c + 4.0)
    for t in range(rounds):
        m = t / (t + 3.0)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        g = -2.0 * weight * y * np.maximum(0, 1 - y * (x @ vw + vb))
        pw, pb = w, b
        w = vw - rate * (x.T @ g + vw / c / len(y))
        b = vb - rate * float(g.sum())
    return w, float(b)


class LanguageModel:
    """One-versus-one machines over families, then over the languages of each family."""

    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray):
        self.langs = langs
        self.family = [FAMILY_OF.get(x, x) for x in langs]
        self.families = sorted(set(self.family))
        fam = np.array([self.families.index(f) for f in self.family])
        self.duels, w, b = [], [], []
        groups = [(("family", i), fam[y] == i if len(y) else y) for i in range(len(self.families))]
        pairs = list(combinations(groups, 2))
        for f in range(len(self.families)):
            pairs += combinations([(("lang", i), y == i) for i in range(len(langs)) if fam[i] == f], 2)
        for (p, has_p), (q, has_q) in pairs:
            rows = has_p | has_q
            wk, bk = fit_svm(x[rows], np.where(has_p[rows], 1.0, -1.0).astype(np.float32))
            self.duels.append((p, q))
            w.append(wk)
            b.append(bk)
        self.w = np.array(w, np.float32).reshape(-1, BUCKETS).T.copy()
        self.b = np.array(b)
        self.fam = fam

    def decide(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) from the duels' margins: votes, ties by summed margin, at both levels; the score is the weakest deciding margin's logistic."""
        n = len(margin)

        def winner(kind: str, members: list[int]) -> tuple[np.ndarray, np.ndarray]:
            votes, weakest = np.zeros((n, len(members))), np.full((n, len(members)), np.inf)
            for k, (p, q) in enumerate(self.duels):
                if p[0] == kind and p[1] in members and q[1] in members:
                    for side, sign in ((p[1], 1), (q[1], -1)):
                        j = members.index(side)
                        m = sign * margin[:, k]
                        votes[:, j] += (m > 0) + 1e-3 * np.tanh(m)
                        weakest[:, j] = np.minimum(weakest[:, j], m)
            best = votes.argmax(axis=1)
            return np.array(members)[best], weakest[np.arange(n), best]

        family, least = winner("family", list(range(len(self.families))))
        lang = np.zeros(n, np.int64)
        for f in range(len(self.families)):
            at = family == f
            pick, m = winner("lang", [i for i in range(len(self.langs)) if self.fam[i] == f])
            lang[at], least[at] = pick[at], np.minimum(least, m)[at]
        return lang, np.where(np.isinf(least), 1.0, 1 / (1 + np.exp(-3 * np.clip(least, -10, 10))))

    def margins(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.b)))
        if not len(self.b):
            return out
        for i, j in slices(texts, PART_BYTES):
            size = np.array([len(t) + 3 for t in texts[i:j]])
            data = b"".join(b" " + t + b"  " for t in texts[i:j]).lower()
            g = grams(data + b"  ")
            half = len(g) // 2
            end = np.cumsum(size)
            for k, (s, e) in enumerate(zip((end - size).tolist(), end.tolist())):
                # grams within the document and its padding only
                f = np.bincount(g[s : e - 2], minlength=BUCKETS) + np.bincount(g[half + s : half + e - 2], minlength=BUCKETS)
                at = np.flatnonzero(f) if e - s < BUCKETS else slice(None)
                v = np.sqrt(f[at].astype(np.float32))
                out[i + k] = v @ self.w[at] / max(float(np.linalg.norm(v)), 1e-9)
        return out + self.b


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> LanguageModel:
    """Learn from ``text`` and ``lang`` of ``docs``; at most ``per_lang`` distinct texts of each language.

    These are the texts with the smallest hashes, so the choice does not depend on partitions or on how often a text is
    repeated. Executors count the grams of the whole texts; the driver gets one sparse row of at most ``BUCKETS``
    entries a text.
    """
    rows = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text", F.lit("sample")).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}  # one row a language
    langs = sorted(counts)
    if not langs:
        return LanguageModel([], np.zeros((0, BUCKETS), np.float32), np.zeros(0, np.int64))
    # a share of each language that leaves somewhat more than enough, cut to the exact number by the window
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, 3.0 * per_lang / max(1, counts[k]))))])
    few = rows.where(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).dropDuplicates(["lang", "h"])
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))).where(F.col("r") <= per_lang)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sparse_counts(t.as_py().encode("utf-8", "surrogatepass")) for t in b.column(2)]
            raw = [pa.array([x[k].astype(kind).tobytes() for x in found], pa.binary()) for k, kind in enumerate(("<u2", "<i8"))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *raw], ["lang", "h", "at", "n"])

    sample = few.select("lang", "h", "text").mapInArrow(frugal("langid", count), "lang string, h long, at binary, n binary").collect()
    sample.sort(key=lambda r: (r["lang"], r["h"]))
    x = features([(np.frombuffer(r["at"], "<u2"), np.frombuffer(r["n"], "<i8")) for r in sample])
    return LanguageModel(langs, x, np.array([langs.index(r["lang"]) for r in sample]))


def predict(docs: DataFrame, model: LanguageModel, *keys: str, text: bool = False) -> DataFrame:
    """Key columns, ``lang_pred`` and ``score`` of every document, with ``text`` its text too.

    Only the text is looked at. Null texts and texts without a letter get ``und`` with score 0, as does every text
    when the model has learned no language. Repeated rows keep their number; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))  # fixed size: buckets x duels
    nk = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(held.value)
        for b in batches:
            lang, score = np.full(b.num_rows, -1), np.zeros(b.num_rows)
            texts = b.column(nk).to_pylist()
            at = [i for i, t in enumerate(texts) if m.langs and LETTER.search(t)]
            if at:
                lang[at], score[at] = m.decide(m.margins([texts[i].encode("utf-8", "surrogatepass") for i in at]))
            names = np.array([*m.langs, UNKNOWN], object)
            keep = nk + text
            yield pa.RecordBatch.from_arrays([*b.columns[:keep], pa.array(names[lang], pa.string()), pa.array(score)], [*b.schema.names[:keep], "lang_pred", "score"])

    rows = text_or_empty(docs, *keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (rows.schema if text else rows.schema[:-1]))
    return rows.mapInArrow(frugal("langid", run), f"{schema}, lang_pred string, score double")


def held_out(doc_id="doc_id"):
    """True for the fifth of the documents that training must not see; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``: learned from the documents that are not held out, applied to all."""
    model = fit(docs.where(~held_out()))
    return predict(docs, model, "doc_id").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

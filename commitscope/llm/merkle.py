"""Document fingerprints by Merkle trees over sections, paragraphs and leaves.

A text is cut into sections (runs of paragraphs that a hash of the paragraph ends, or a blank line), paragraphs
(lines) and leaves (``LEAST`` to ``MOST`` code points, cut after certain characters, so that an edit moves only the
leaves around it, in texts with and without blanks). Every node's digest covers its children's digests, so equal roots
mean equal texts, and walking down the differing branches of two trees locates the edits.

The fingerprint string is ``root:sections``; sections are joined by ``/``. A section is its digest, ``=`` and its
paragraphs, joined by ``.``; a paragraph is its digest, followed, if it has several leaves, by ``~`` and theirs.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

LEAST, MOST, SECTION_ONE_IN = 24, 128, 8
LEAF_HEX, NODE_HEX = 8, 32
#: Ranges of doc_id that a table is dealt to at most: 2 GB each of 100 TB, streamed and sorted with spill.
MOST_RANGES = 50_000
LINES = re.compile(r"[^\n]*\n|[^\n]+")
#: Characters after which a leaf may end: one in eight code points, by a multiplicative hash.
ENDS = "".join(chr(c) for c in range(32, 0xD800) if (c * 668265263 & 0xFFFFFFFF) >> 29 == 0)
LEAVES = re.compile(rf"(?s).{{{LEAST - 1},{MOST - 1}}}?[{re.escape(ENDS)}]|.{{{MOST}}}|.+")

#: A tree as parsed: (section's digest, [(paragraph's digest, leaves' digests)]).
Sections = list[tuple[str, list[tuple[str, list[str]]]]]


def _digest(data: bytes, size: int, tag: bytes) -> str:
    return hashlib.blake2b(data, digest_size=size // 2, person=tag).hexdigest()


def leaves(line: str) -> list[str]:
    return LEAVES.findall(line) if len(line) > LEAST else [line]


def tree(text: str) -> Sections:
    """Sections of paragraphs of leaf digests; paragraphs keep their line ends, so nothing of the text is left out."""
    leaf, sections, current = xxhash.xxh32_hexdigest, [], []
    for line in LINES.findall(text):
        cut = [leaf(p.encode("utf-8", "surrogatepass")) for p in leaves(line)]
        node = cut[0] if len(cut) == 1 else _digest("".join(cut).encode(), LEAF_HEX, b"paragraph")
        current.append((node, cut))
        if not line.strip() or int(node, 16) % SECTION_ONE_IN == 0:
            sections.append(current)
            current = []
    if current or not sections:
        sections.append(current)
    return [(_digest("|".join(node for node, _cut in s).encode(), LEAF_HEX, b"section"), s) for s in sections]


def shown(text: str, sections: Sections) -> str:
    """The fingerprint string of a text and its tree."""
    # short digests could collide, so the root also covers the whole text's own digest
    own = _digest(text.encode("utf-8", "surrogatepass"), NODE_HEX, b"text")
    root = _digest((own + "".join(node for node, _s in sections)).encode(), NODE_HEX, b"root")
    return root + ":" + "/".join(node + "=" + ".".join(p if len(cut) == 1 else p + "~" + "".join(cut) for p, cut in s) for node, s in sections)


def fingerprint(text: str) -> str:
    return shown(text, tree(text))


def parsed(fp: str) -> tuple[str, Sections]:
    """Root and sections of a fingerprint string."""
    root, body = fp.split(":", 1)
    out: Sections = []
    for section in body.split("/"):
        node, rest = section.split("=", 1)
        paragraphs = []
        for p in rest.split(".") if rest else []:
            digest, _, cut = p.partition("~")
            paragraphs.append((digest, [cut[i : i + LEAF_HEX] for i in range(0, len(cut), LEAF_HEX)] or [digest]))
        out.append((node, paragraphs))
    return root, out


def _of(a) -> tuple[str, Sections]:
    return parsed(a) if isinstance(a, str) else a


def likeness(a: str | tuple[str, Sections], b: str | tuple[str, Sections]) -> float:
    """Dice coefficient of two trees' leaf multisets; 1 for equal roots and only for these, 0 where no leaf is shared."""
    (root, x), (other, y) = _of(a), _of(b)
    if root == other:
        return 1.0
    x, y = [d for _n, s in x for _p, cut in s for d in cut], [d for _n, s in y for _p, cut in s for d in cut]
    if not x or not y:
        return 0.0
    return min(2.0 * (Counter(x) & Counter(y)).total() / (len(x) + len(y)), 1 - 1 / (len(x) + len(y) + 1))


def align(x: list[str], y: list[str]) -> list[tuple[int, int, int, int]]:
    """Runs (i0, i1, j0, j1) in which two lists differ, in order; outside of them the lists are equal.

    Equal ends are cut off, then values that occur once in both lists are matched as far as their order agrees, and
    equal ends of what lies between the matches are cut off again: n log n steps whatever the lists hold.
    """

    def trim(i0, i1, j0, j1):
        while i0 < i1 and j0 < j1 and x[i0] == y[j0]:
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and x[i1 - 1] == y[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
        return i0, i1, j0, j1

    i0, i1, j0, j1 = trim(0, len(x), 0, len(y))
    if i0 == i1 or j0 == j1:
        return [(i0, i1, j0, j1)] if (i0, j0) != (i1, j1) else []
    once, twice = Counter(x[i0:i1]), Counter(y[j0:j1])
    spot = {d: j for j, d in enumerate(y[j0:j1], j0) if twice[d] == 1}
    both = [(i, spot[d]) for i, d in enumerate(x[i0:i1], i0) if once[d] == 1 and d in spot]
    # the longest run of matches that rises in both lists
    tails, last, back = [], [], [-1] * len(both)
    for k, (_i, j) in enumerate(both):
        at = bisect_left(tails, j)
        back[k] = last[at - 1] if at else -1
        tails[at : at + 1], last[at : at + 1] = [j], [k]
    line, k = [], last[-1] if last else -1
    while k >= 0:
        line.append(both[k])
        k = back[k]
    out, i, j = [], i0, j0
    for a, b in [*reversed(line), (i1, j1)]:
        gap = trim(i, a, j, b)
        if gap[0] < gap[1] or gap[2] < gap[3]:
            out.append(gap)
        i, j = a + 1, b + 1
    return out


def differences(a: str | tuple[str, Sections], b: str | tuple[str, Sections]) -> list[tuple[int, int, int, int]]:
    """Runs (i0, i1, j0, j1) of leaves, counted through the text, in which two trees differ: none for equal roots, else at least one.

    Walks down from the roots: only sections that differ are opened, and of these only paragraphs that differ.
    """
    (root, x), (other, y) = _of(a), _of(b)
    if root == other:
        return []

    def numbered(nodes, first):
        # (digest, first leaf, children) of each node
        out = []
        for digest, kids in nodes:
            out.append((digest, first, kids))
            first += sum(len(cut) for _p, cut in kids) if kids and isinstance(kids[0], tuple) else len(kids)
        return out, first

    (x, nx), (y, ny) = numbered(x, 0), numbered(y, 0)
    todo, out = [(x, y, nx, ny, True)], []
    while todo:
        left, right, end_x, end_y, upper = todo.pop()
        for i0, i1, j0, j1 in align([n[0] for n in left], [n[0] for n in right]):
            first_x, first_y = left[i0][1] if i0 < len(left) else end_x, right[j0][1] if j0 < len(right) else end_y
            kids_x, kids_y = [k for n in left[i0:i1] for k in n[2]], [k for n in right[j0:j1] for k in n[2]]
            if upper:
                (kids_x, last_x), (kids_y, last_y) = numbered(kids_x, first_x), numbered(kids_y, first_y)
                todo.append((kids_x, kids_y, last_x, last_y, False))
            else:
                out += [(first_x + p, first_x + q, first_y + r, first_y + t) for p, q, r, t in align(kids_x, kids_y)]
    # leaves' digests are short: where all are equal and the texts are not, any of them may differ
    return sorted(out) or [(0, nx, 0, ny)]


def places(fp: str | tuple[str, Sections]) -> list[tuple[int, int]]:
    """(section, paragraph) of each leaf, counted through the text."""
    return [(i, j) for i, (_n, s) in enumerate(_of(fp)[1]) for j, (_p, cut) in enumerate(s) for _d in cut]


def starts(text: str) -> list[int]:
    """Code point at which each leaf starts, and the text's length."""
    out = [0]
    for line in LINES.findall(text):
        for p in leaves(line):
            out.append(out[-1] + len(p))
    return out


def edits(text: str, other: str, a: tuple[str, Sections], b: tuple[str, Sections]) -> list[tuple[int, int, int, int]]:
    """The runs of ``differences`` in code points of both texts."""
    runs = differences(a, b)
    if not runs:
        return []
    x, y = starts(text), starts(other)
    return [(x[i0], x[i1], y[j0], y[j1]) for i0, i1, j0, j1 in runs]


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits string"


def _constant(values: list, kind: str):
    """An array constant of any length: one literal in the plan, folded once, looked up by position."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def _below(cuts: list[int], x):
    """How many of the sorted ``cuts`` are below ``x``: the chunk that ``x`` falls into, then its place there."""
    step = math.isqrt(len(cuts)) + 1
    chunk = F.greatest(F.size(F.filter(_constant(cuts[::step], "long"), lambda c: c < x)) - 1, F.lit(0)) * step
    return chunk + F.size(F.filter(F.slice(_constant(cuts, "long"), chunk + 1, F.lit(step)), lambda c: c < x))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, with likenesses to the edited and to the next document's text.

    ``edits`` locates the edit by the trees' differing branches: ``start:end>start:end`` in code points of the text and
    of the edited text, comma-joined; outside of these runs the two texts are equal.

    Next: by descending doc_id (null last), of equal ids by text; after the last comes the first, so a single document
    follows itself. A null text is empty. Repeated rows keep their number; an empty table gives an empty result.

    Documents are dealt by ranges of doc_id, so each text is shuffled once. The only rows sent twice are the first
    of each range, which the range before it needs; they are found from the id column alone.
    """
    rows = text_or_empty(docs, "doc_id")
    parts = min(MOST_RANGES, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions()))
    ids = rows.select("doc_id")
    shares = _constant([i / parts for i in range(1, parts)] or [0.5], "double")
    cuts = ids.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * parts))).first()[0]
    cuts = sorted(set(cuts or []))
    # range 0 has the largest ids; null ids come last of all
    spot = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - _below(cuts, F.col("doc_id"))).cast("int")
    tops = {r["part"]: r["top"] for r in ids.select("doc_id", spot.alias("part")).groupBy("part").agg(F.max("doc_id").alias("top")).collect()}  # one row a range
    order = sorted(tops)
    if not order:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    before = {p: order[i - 1] for i, p in enumerate(order)}  # the first range also follows the last
    every = range(len(cuts) + 2)
    lead = F.get(_constant([before.get(p, 0) for p in every], "int"), F.col("part"))
    top = F.get(_constant([tops.get(p) or 0 for p in every], "long"), F.col("part"))
    placed = rows.withColumn("part", spot).withColumn("first", F.col("doc_id").isNull() | (F.col("doc_id") == top))
    # a row goes to its own range, and if it may be the range's first, to the range before as a guest
    goes = F.when(F.col("first"), F.array(F.struct(F.col("part").alias("to"), F.lit(False).alias("guest")), F.struct(lead.alias("to"), F.lit(True).alias("guest")))).otherwise(
        F.array(F.struct(F.col("part").alias("to"), F.lit(False).alias("guest")))
    )
    sent = placed.select("doc_id", "text", F.explode(goes).alias("g")).select("g.to", "g.guest", "doc_id", "text")
    dealt = sent.repartitionById(len(cuts) + 2, F.col("to")).sortWithinPartitions("to", "guest", F.desc_nulls_last("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in range(8)]
        held = None  # (doc_id, text, fingerprint, tree) of the document that waits for its next
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edits"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]

        def marked(text):
            sections = tree(text)
            fp = shown(text, sections)
            return fp, (fp[:NODE_HEX], sections)

        def emit(doc, text, fp, own, following, next_tree):
            new = edited(text, following)
            new_fp, new_tree = marked(new)
            where = ",".join(f"{a}:{b}>{c}:{d}" for a, b, c, d in edits(text, new, own, new_tree))
            for c, v in zip(cols, (doc, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), fp, new_fp, likeness(own, new_tree), likeness(own, next_tree), where)):
                c.append(v)

        for b in batches:
            for to, guest, doc, text in zip(*(c for c in b.columns)):
                to, guest, doc, text = to.as_py(), guest.as_py(), doc.as_py(), text.as_py()
                if held is None and guest:
                    continue  # a second candidate for a place already filled
                fp, own = marked(text)
                if held is not None:
                    emit(*held, text, own)
                held = None if guest else (doc, text, fp, own)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
            for c in cols:
                c.clear()

    return dealt.mapInArrow(run, SCHEMA)

"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints: per document the majority of the bits of the XXH64 hashes (seed 42) of its 3-word shingles.

Links: two fingerprints that differ in at most two of 64 bits agree exactly on one of three bands (22, 21, 21 bits).
So three rotated tries are searched, each from the nodes at the end of its first band: equal bands meet in one cell.
A cell that is too large for a task is split further down the trie into *node pairs*: its rows go to the pairs of
subtrees whose prefixes are within the budget. Within a task a vectorised traversal walks all node pairs together,
adds the differing bits and prunes a pair as soon as its Hamming budget is exceeded. Equal fingerprints are collapsed
before the join, so copies cost nothing; each task sends a spanning forest of its links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nearcopies
from .common import checkpointed, frugal, text_or_empty, written
from .components import connected_components
from .shingles import SEED, body_of, shingles

BUDGET, BITS = 2, 64
#: (rotation, width) of the bands that lead the three tries.
BANDS = ((0, 22), (22, 21), (43, 21))
#: Rows of a cell beyond which it is split, and trie levels taken per split.
CELL_ROWS, SPLIT_BITS = 2000, 8
CHUNK_ROWS = 100_000


def fingerprint(text: str, width: int = 3, seed: int = SEED) -> int:
    return majority(shingles(text, width, seed))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero for none."""
    n = len(hashes)
    if n <= 1:
        return int(hashes[0]) if n else 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, body)``, fp as a signed 64-bit integer, body a hash of the text; a null text counts as empty (fingerprint zero)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), b.column(2)], ["doc_id", "fp", "body"])

    return text_or_empty(docs, "doc_id").withColumn("body", body_of("text")).mapInArrow(frugal("simhash", run), "doc_id long, fp long, body long")


def _links(key: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``budget`` bits; ``key`` sorted within [start, mid) and [mid, end) of each cell.

    A cell with mid == end joins with itself. The frontier holds node pairs as index ranges (a0, a1, b0, b1) and the
    bits they differ in so far; all pairs of one depth advance together.
    """
    own = mid == end
    a0, a1 = start, mid
    b0, b1 = np.where(own, start, mid), end
    spent = np.zeros(len(start), np.int64)
    out_i, out_j = [], []
    stack = [(0, a0, a1, b0, b1, spent)]
    while stack:
        depth, a0, a1, b0, b1, spent = stack.pop()
        small = (a1 - a0) * (b1 - b0) <= 48
        if depth == BITS:
            small[:] = True
        if small.any():
            na, nb = (a1 - a0)[small], (b1 - b0)[small]
            reps = na * nb
            k = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            i = np.repeat(a0[small], reps) + k // np.repeat(nb, reps)
            j = np.repeat(b0[small], reps) + k % np.repeat(nb, reps)
            near = (np.bitwise_count(key[i] ^ key[j]) <= budget) & (i != j)
            out_i.append(i[near])
            out_j.append(j[near])
        big = ~small
        if not big.any():
            continue
        a0, a1, b0, b1, spent = (x[big] for x in (a0, a1, b0, b1, spent))
        ones = np.concatenate(([0], np.cumsum((key >> np.uint64(BITS - 1 - depth)) & np.uint64(1)))).astype(np.int64)
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = (a0 == b0) & (a1 == b1)
        cross = ~same
        part = [
            (a0, am, b0, bm, spent), (am, a1, bm, b1, spent), (a0, am, bm, b1, spent + 1),
            (am[cross], a1[cross], b0[cross], bm[cross], spent[cross] + 1),
        ]
        a0, a1, b0, b1, spent = (np.concatenate(x) for x in zip(*part))
        live = (a1 > a0) & (b1 > b0) & (spent <= budget) & ~((a0 == b0) & (a1 - a0 == 1) & (b1 - b0 == 1))
        a0, a1, b0, b1, spent = (x[live] for x in (a0, a1, b0, b1, spent))
        for s in range(0, len(a0), 1 << 18):
            stack.append((depth + 1, *(x[s : s + (1 << 18)] for x in (a0, a1, b0, b1, spent))))
    none = np.empty(0, np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j])


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest linked index of each of n items, by minimum propagation with pointer jumping."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        root = new
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    return root


def _join_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, side, key, fp) sorted by cell -> links (a, b) of a spanning forest per run of cells."""

    def solve(t: np.ndarray):
        cell, side, key, fp = t
        order = np.lexsort((key.view(np.uint64), side, cell))
        cell, side, key, fp = cell[order], side[order], key[order].view(np.uint64), fp[order]
        start = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        end = np.append(start[1:], len(cell))
        # side 2: both sides at once (a cell joined with itself); else 0 before 1
        own = side[start] == 2
        ones = np.concatenate(([0], np.cumsum(side == 1)))
        mid = np.where(own, end, end - (ones[end] - ones[start]))
        keep = np.where(own, end - start > 1, (mid > start) & (end > mid))
        i, j = _links(key, start[keep], mid[keep], end[keep])
        root = _forest(len(cell), i, j)
        at = np.flatnonzero(root != np.arange(len(cell)))
        return pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[root[at]])], ["a", "b"])

    held = None
    for b in batches:
        t = np.stack([np.asarray(c) for c in b.columns]) if b.num_rows else None
        if t is None:
            continue
        held = t if held is None else np.concatenate([held, t], axis=1)
        if held.shape[1] >= CHUNK_ROWS:
            cut = int(np.flatnonzero(held[0] != held[0][-1])[-1]) + 1 if (held[0] != held[0][-1]).any() else 0
            if cut:
                yield solve(held[:, :cut])
                held = held[:, cut:]
    if held is not None and held.shape[1]:
        yield solve(held)


def _rotated(fp, by: int):
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within two bits of each other, directly or by a path."""
    fp = F.col("fp")
    tries = [F.struct(F.lit(k).cast("long").alias("band"), _rotated(fp, by).alias("key"), F.shiftrightunsigned(_rotated(fp, by), BITS - w).alias("prefix")) for k, (by, w) in enumerate(BANDS)]
    rows = fps.select("fp", F.explode(F.array(*tries)).alias("t")).select(
        (F.col("t.band") * (1 << 22) + F.col("t.prefix")).alias("cell"), F.lit(2).cast("long").alias("side"), F.col("t.key").alias("key"), "fp", F.lit(0).alias("spent")
    )
    masks = F.array(*[F.lit(m).cast("long") for m in range(1 << SPLIT_BITS) if m.bit_count() <= BUDGET])
    done, bit = None, 22
    while True:
        sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("side").alias("lo"), F.max("side").alias("hi"))
        live = sizes.where("(hi = 2 and n > 1) or lo < hi")
        large = checkpointed(live.where(F.col("n") > CELL_ROWS).select("cell"))
        if bit + SPLIT_BITS > BITS or large.isEmpty():
            ready = rows
        else:
            ready = rows.join(large, "cell", "left_anti")
        part = ready.join(live.select("cell"), "cell", "left_semi").select("cell", "side", "key", "fp")
        done = part if done is None else done.union(part)
        if ready is rows:
            break
        # split hot cells: each row meets, SPLIT_BITS levels deeper, the subtrees within what is left of the budget
        own = F.shiftrightunsigned("key", BITS - bit - SPLIT_BITS).bitwiseAND(F.lit((1 << SPLIT_BITS) - 1))
        m, sub = F.col("m"), F.col("sub")
        other = sub.bitwiseXOR(m)
        left = F.when(F.col("side") == 0, sub).when(F.col("side") == 1, other).otherwise(F.least(sub, other))
        right = F.when(F.col("side") == 0, other).when(F.col("side") == 1, sub).otherwise(F.greatest(sub, other))
        side = F.when(F.col("side") != 2, F.col("side")).when(m == 0, F.lit(2)).when(sub < other, F.lit(0)).otherwise(F.lit(1)).cast("long")
        hot = rows.join(large, "cell", "left_semi").withColumn("sub", own)
        hot = hot.withColumn("m", F.explode(F.filter(masks, lambda x: F.bit_count(x) + F.col("spent") <= BUDGET)))
        rows = checkpointed(hot.select(F.xxhash64("cell", left, right).alias("cell"), side.alias("side"), "key", "fp", (F.col("spent") + F.bit_count(m)).cast("int").alias("spent")))
        bit += SPLIT_BITS
    return done.repartition("cell").sortWithinPartitions("cell").mapInArrow(frugal("simhash", _join_cells), "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)``: one row per document; component_id is the smallest doc_id it is linked with.

    Documents link when their fingerprints differ in at most two bits; components follow chains of links. Empty and
    null texts have fingerprint zero and link like any other. Repeated rows keep their number. A null doc_id is kept;
    it never names a component unless all members lack an id. An empty table gives an empty result. Other columns of
    the table are ignored.
    """
    return _grouped(docs).select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame) -> DataFrame:
    docs = written(fingerprints(docs), "simhash")
    reps = docs.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    of = connected_components(links(reps.select("fp"))).withColumnRenamed("node", "fp")
    labelled = reps.join(of, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    return docs.join(labelled.join(least, "component").select("fp", "component", "component_id"), "fp").select("doc_id", "fp", "body", "component", "component_id")


def keep_one(docs: DataFrame, *columns: str, width: int = 5) -> DataFrame:
    """The given columns of one row of each group of near copies: the smallest doc_id's, of equal ids the smallest text hash's.

    Near copies have a Jaccard similarity of at least ``nearcopies.LEAST`` between their sets of ``width``-word shingles;
    groups follow chains of them. The trie self-join over fingerprints of the same shingles links the closest copies, so
    that large groups shrink to few components; at that similarity fingerprints may differ in 20 bits, so a second, wider
    pass (see ``nearcopies``) finds the links between components. Every link of both passes is checked exactly.

    A null doc_id comes last, so a row without an id stays only where no member of its group has one; rows without an
    id and with different texts are told apart by these. Repeated rows leave one. Texts without words are one group.
    An empty table gives an empty result.
    """
    texts = text_or_empty(docs, "doc_id").withColumn("body", body_of("text"))
    distinct = written(texts.select("body", "text").dropDuplicates(["body"]), "near-texts")
    marks = written(nearcopies.marks(distinct, width, majority), "near-marks")
    # of texts with one fingerprint the smallest hash stands for the others; links of the tries join such texts
    reps = marks.groupBy("fp").agg(F.min("body").alias("rep"))
    tight = links(reps.select("fp")).join(reps.select(F.col("fp").alias("a"), F.col("rep").alias("rep_a")), "a").join(reps.select(F.col("fp").alias("b"), F.col("rep").alias("rep_b")), "b")
    same = marks.select("fp", "body").join(reps, "fp").where("body <> rep")
    pairs = tight.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).union(same.select(F.col("rep").alias("a"), F.col("body").alias("b")))
    found = nearcopies.checked(pairs, marks, distinct, width)
    of = nearcopies.groups(distinct, marks, found, width).withColumnRenamed("node", "body")
    ids = texts.groupBy("body").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("i"))
    first = F.struct(F.col("i.none").alias("none"), F.col("i.doc_id").alias("doc_id"), "body")
    keep = ids.join(of, "body", "left").groupBy(F.coalesce("component", "body").alias("component")).agg(F.min(first).alias("k"))
    keep = keep.select(F.col("k.doc_id").alias("keep_id"), F.col("k.body").alias("keep_body"))
    rows = docs.select(*columns).withColumn("own_body", body_of("text"))
    kept = rows.join(keep, F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("own_body") == F.col("keep_body")), "left_semi")
    return kept.dropDuplicates(["doc_id", "own_body"]).drop("own_body")


def hex_of(fp):
    """16 lowercase hex digits of a signed 64-bit integer column."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")

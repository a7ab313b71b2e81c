"""Vector code compression: product codebooks in integers, found through broadcast kd-trees.

Components become integers floor(4096 x). Vectors are cut into equal consecutive parts and each part position has a
codebook. A round broadcasts one kd-tree per codebook, whose size depends on the number of entries and the width alone;
every task finds the nearest entry of each part by branch and bound and adds up its parts' integers per entry, and Spark
adds up the tasks' sums. Integers make the sums independent of the order, so reruns and lost executors change nothing.

Defined results: rows whose vector is null or holds null or non-finite components are dropped. Shorter vectors count as
zero-padded to the longest, and all to a multiple of the number of parts. Components beyond ``limit(width)`` (46,340 as
a value at 64 dimensions) saturate there, so that all errors fit a long. Rows without an id start no codebook entry
before rows with one; of repeated ids the smaller vector comes first; equal rows each count. Fewer rows than entries
give fewer entries. An empty table gives an empty result. Columns other than vec_id, embedding and label are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
LEAF = 2
#: Copies of a label's sum that its rows are dealt over, as one label may hold most rows.
SALTS = 8
MOST = (1 << 63) - 1


def limit(width: int) -> int:
    """The largest integer component for which the squared distances of two vectors still fit a long."""
    return int((MOST / max(1, width)) ** 0.5 / 2)


class EntryTree:
    """A kd-tree over one codebook: median splits on the widest dimension, tight boxes. ``nodes``, where given, are those of a tree that was sent."""

    def __init__(self, entries: np.ndarray, nodes: list | None = None, leaf: int = LEAF):
        self.entries, self.leaf, self.nodes = entries, leaf, nodes or []
        if not nodes:
            self._grow(np.arange(len(entries)))

    def _grow(self, own: np.ndarray) -> int:
        at, box = len(self.nodes), self.entries[own]
        lo, hi = box.min(axis=0), box.max(axis=0)
        self.nodes.append(None)
        axis = int(np.argmax(hi - lo)) if box.shape[1] else 0
        kids = None
        if len(own) > self.leaf and box.shape[1] and hi[axis] > lo[axis]:
            by = own[np.argsort(box[:, axis], kind="stable")]
            kids = (self._grow(by[: len(by) // 2]), self._grow(by[len(by) // 2 :]))
        self.nodes[at] = (lo, hi, kids, np.sort(own))
        return at

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of every row's nearest entry; of equally near ones the lowest index."""
        best, index = np.full(len(x), MOST, np.int64), np.full(len(x), len(self.entries), np.int64)
        if len(x):
            self._visit(0, x, np.arange(len(x)), best, index)
        return index, best

    def _bound(self, node: int, x: np.ndarray) -> np.ndarray:
        lo, hi, _, _ = self.nodes[node]
        off = np.maximum(np.maximum(lo - x, x - hi), 0)
        return (off * off).sum(axis=1)

    def _visit(self, node: int, x: np.ndarray, who: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        _, _, kids, own = self.nodes[node]
        rows = x[who]
        if kids is None:
            for e in own:
                off = rows - self.entries[e]
                d = (off * off).sum(axis=1)
                better = (d < best[who]) | ((d == best[who]) & (e < index[who]))
                best[who[better]], index[who[better]] = d[better], e
            return
        bounds = [self._bound(k, rows) for k in kids]
        first = bounds[0] <= bounds[1]
        for mine, order in ((first, (0, 1)), (~first, (1, 0))):
            for k in order:
                # an equal bound may hide an equally near entry of lower index
                going = who[mine & (bounds[k] <= best[who])]
                if len(going):
                    self._visit(kids[k], x, going, best, index)


@dataclass
class Codebooks:
    """``entries[part][entry][position]``, integers."""

    entries: np.ndarray

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def trees(self) -> list[tuple]:
        """The parts' kd-trees as plain values, for a broadcast."""
        return [(tree.entries, tree.nodes) for tree in map(EntryTree, self.entries)]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integer_vectors(embeddings: DataFrame, parts: int = PARTS) -> tuple[DataFrame, int]:
    """``(vec_id, label, v)``, written, every v of the same width, and that width."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding").where(F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(False)))
    widest = own.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
    width = -(-widest // parts) * parts
    most = limit(width)
    whole = F.transform("embedding", lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(x.cast("double") * SCALE))).cast("int"))
    padded = F.concat(whole, F.array_repeat(F.lit(0), F.lit(width) - F.size("embedding")))
    return written(own.select("vec_id", "label", padded.alias("v")), "code-vectors"), width


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    values = batch.column(batch.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.int64).reshape(batch.num_rows, width)


def _sums(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """``(part, entry, position, total, n)``: the sums of the parts whose nearest entry it is, one row a task before they are added up."""
    parts, entries, size = books.entries.shape
    trees = vectors.sparkSession.sparkContext.broadcast(books.trees())

    def run(batches):
        total, n = np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _matrix(batch, parts * size).reshape(batch.num_rows, parts, size)
            for p, tree in enumerate(trees.value):
                index, _ = EntryTree(*tree).nearest(x[:, p])
                n[p] += np.bincount(index, minlength=entries)
                for e in np.unique(index):
                    total[p, e] += x[index == e, p].sum(axis=0)
        p, e = np.nonzero(n)
        rep = lambda a: np.repeat(a, size)
        yield pa.RecordBatch.from_arrays([pa.array(rep(p)), pa.array(rep(e)), pa.array(np.tile(np.arange(size), len(p))), pa.array(total[p, e].ravel()), pa.array(rep(n[p, e]))], names=["part", "entry", "position", "total", "n"])

    found = vectors.select("v").mapInArrow(run, "part long, entry long, position long, total long, n long")
    return found.groupBy("part", "entry", "position").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n"))


def train(vectors: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of the integer vectors: the rows of the smallest ids, then ``rounds`` of assignment and floored means.

    What comes to the driver is the codebooks' sums, entries x width numbers a round.
    """
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    books = Codebooks(np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy())
    for _ in range(rounds if len(first) and width else 0):
        new = books.entries.copy()
        for r in _sums(vectors, books).collect():
            new[r["part"], r["entry"], r["position"]] = int(r["total"]) // r["n"]
        books = Codebooks(new)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """``(vec_id, label, code, error)``: each part's nearest entry, two hex digits, and the squared distance over all parts."""
    parts, _, size = books.entries.shape
    trees = vectors.sparkSession.sparkContext.broadcast(books.trees())

    def run(batches):
        for batch in batches:
            x = _matrix(batch, parts * size).reshape(batch.num_rows, parts, size)
            code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p, tree in enumerate(trees.value):
                index, d = EntryTree(*tree).nearest(x[:, p])
                code[:, p] = index
                error += d
            digits = code.tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"]
            )

    return vectors.select("vec_id", "label", "v").mapInArrow(run, "vec_id long, label string, code string, error long")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """The rows with ``v``, the integer vector that the code stands for."""
    book = F.array(*[F.array(*[F.array(*[F.lit(int(c)) for c in e]).cast("array<long>") for e in part]) for part in books.entries])
    index = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("v", F.flatten(F.array(*[book.getItem(p).getItem(index(p)) for p in range(len(books.entries))])))


def label_errors(codes: DataFrame) -> DataFrame:
    """The rows with ``label_error``, the errors of all rows of the same label (nulls together); each label's rows are dealt over ``SALTS`` tasks."""
    sums = codes.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(MOST)).cast("long").alias("label_error"))
    copies = sums.select(F.col("label").alias("own"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = codes.withColumn("to", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return dealt.join(copies, dealt["label"].eqNullSafe(copies["own"]) & (dealt["to"] == copies["salt"])).drop("own", "salt", "to")


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of every vector that is kept."""
    vectors, width = integer_vectors(embeddings, parts)
    books = train(vectors, width, parts, entries, rounds)
    if not books.entries.shape[1]:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    codes = written(encode(vectors, books), "codes")
    return label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))

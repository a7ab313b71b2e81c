"""The wider pass of near-duplicate detection: texts whose sets of word shingles have a Jaccard similarity of at least 0.8.

Candidates come from MinHash bands, so a pair of similarity s shares at least one of ``BANDS`` buckets with probability
1 - (1 - s^ROWS)^BANDS (0.99993 at 0.8).

In a bucket of at most ``ALL_PAIRS`` texts every pair is checked: by signatures first (``FEWEST`` of the minima must agree,
5 standard deviations below 0.8), and what passes on the texts. Texts that meet in larger buckets form clouds. Within a
cloud texts are dealt by size into classes a factor of 1.25 apart, as alike texts' sizes differ by no more, and classes
into blocks of bounded size. Each pair of blocks of one or neighbouring classes is a cell, in which the exact similarity of
all texts of different components is found from one table of shingles; a cell's links are a spanning forest of what it
finds. So every pair of a cloud is settled in one pass, no link between components is lost, a text travels once for each
block it meets, and no task holds a cloud.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, frugal, written
from .components import connected_components
from .shingles import shingles

LEAST = 0.8
BANDS, ROWS = 24, 5
ALL_PAIRS = 16
#: Texts of a block at most, and their shingles about; a longer text makes a block of its own.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1 << 20
#: Minima of a signature, and how many of two must agree before their texts are compared: 5 standard deviations below LEAST.
SIGNATURE = 192
FEWEST = int(SIGNATURE * (LEAST - 5 * (LEAST * (1 - LEAST) / SIGNATURE) ** 0.5))
#: Texts that one task compares with a text at a time.
FAN = 256
#: Odd multipliers of the permutations.
FACTORS = np.random.default_rng(11).integers(0, 1 << 63, SIGNATURE, np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.random.default_rng(12).integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def minima(found: np.ndarray) -> np.ndarray:
    """The smallest image of a set of shingles under each permutation; of a text without words, minima of its own kind."""
    least = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 1 << 10):
        least = np.minimum(least, (found[i : i + (1 << 10), None] * FACTORS).min(axis=0))
    return least ^ least >> np.uint64(29)


def bands(least: np.ndarray) -> np.ndarray:
    """One bucket for each band of the first minima."""
    h = (least[: BANDS * ROWS].reshape(BANDS, ROWS) * MIX).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of shingles have a similarity of at least ``LEAST``; two empty sets are alike."""
    if min(len(a), len(b)) < LEAST * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= LEAST * (len(a) + len(b) - both)


def marks(texts: DataFrame, width: int, majority: Callable[[np.ndarray], int]) -> DataFrame:
    """``(body, fp, buckets, sig, size)`` of every text (body, text) in one pass over its shingles; size: how many distinct ones; sig: 8 bits of each minimum, by which unequal ones agree once in 256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                fps, flat, sigs, sizes = [], [], [], []
                for t in part.column(1):
                    found = shingles(t.as_py(), width)
                    least = minima(found)
                    fps.append(majority(found))
                    flat.append(bands(least))
                    sigs.append((least >> np.uint64(56)).astype(np.uint8).tobytes())
                    sizes.append(len(np.unique(found)))
                lists = pa.ListArray.from_arrays(np.arange(0, BANDS * len(fps) + 1, BANDS, np.int32), pa.array(np.concatenate(flat)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), lists, pa.array(sigs, pa.binary()), pa.array(sizes, pa.int32())], ["body", "fp", "buckets", "sig", "size"])

    return texts.select("body", "text").mapInArrow(frugal("near", run), "body long, fp long, buckets array<long>, sig binary, size int")


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, sig_a, sig_b) -> the (a, b) that may be alike."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SIGNATURE) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= FEWEST))


def checked(pairs: DataFrame, marked: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The distinct pairs (a, b) of bodies whose texts are alike, written. Signatures come first, so few texts travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows (a, part, b, text); a null b comes first of its (a, part) and brings a's own text
        held = None
        for batch in batches:
            keep = []
            for b, t in zip(batch.column(2).is_valid().to_pylist(), batch.column(3)):
                own = np.unique(shingles(t.as_py(), width))
                keep.append(b and alike(held, own))
                held = held if b else own
            if any(keep):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["a", "b"]).filter(pa.array(keep))

    sig = marked.select("body", "sig")
    both = pairs.distinct().join(sig.withColumnsRenamed({"body": "a", "sig": "sig_a"}), "a").join(sig.withColumnsRenamed({"body": "b", "sig": "sig_b"}), "b")
    few = written(both.select("a", "b", "sig_a", "sig_b").mapInArrow(frugal("near", _agree), "a long, b long"), "near-pairs")
    # a text travels once for each FAN of the texts that it is compared with
    fans = few.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("fans"))
    few = few.join(fans, "a").select("a", F.pmod(F.xxhash64("b"), F.col("fans")).cast("int").alias("part"), "b")
    heads = few.select("a", "part").distinct().join(texts.withColumnRenamed("body", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    tails = few.join(texts.withColumnRenamed("body", "b"), "b").select("a", "part", "b", "text")
    rows = heads.union(tails).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return written(rows.mapInArrow(frugal("near", run), "a long, b long"), "near-links")


def forest(sets: list[np.ndarray], component: np.ndarray, first: int | None = None) -> list[tuple[int, int]]:
    """Links (i, j) between alike sets of different components that join all which alike sets join.

    With ``first``, pairs are those of a set before it and a set from it on; else all pairs. Similarities are exact: a
    set's shingles are marked in a table, and one pass over the other sets counts the marked ones of each.
    """
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    _, flat = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True)
    end = np.cumsum(size)
    seen, root, out = np.zeros(len(flat) + 1, np.int32), component.copy(), []
    for i in range(n if first is None else first):
        low = i + 1 if first is None else first
        other = low + np.flatnonzero(root[low:] != root[i])
        other = other[np.minimum(size[other], size[i]) >= LEAST * np.maximum(size[other], size[i])]
        if not len(other):
            continue
        own = flat[end[i] - size[i] : end[i]]
        seen[own] = 1
        # sums up to each place give every set's count, empty ones too
        if 4 * len(other) < n - low:
            both = np.array([seen[flat[end[j] - size[j] : end[j]]].sum() for j in other])
        else:
            upto = np.concatenate([[0], np.cumsum(seen[flat[end[low] - size[low] :]])])
            at = end - (end[low] - size[low])
            both = upto[at[other]] - upto[at[other] - size[other]]
        seen[own] = 0
        for j in other[both >= LEAST * (size[i] + size[other] - both)]:
            if root[j] != root[i]:
                out.append((i, int(j)))
                root[root == root[j]] = root[i]
    return out


def cloud_links(texts: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """The links (a, b) between components of each cloud; ``members``: (body, cloud, component, size), one row a text."""
    step = float(np.log(1 / LEAST))
    kind = F.when(F.col("size") < 1, -2).otherwise(F.floor(F.log(F.col("size").cast("double")) / step + 1e-9)).cast("int")
    rows = members.withColumn("class", kind)
    # texts of a class have at most 1.25 times the shingles of its smallest
    fit = F.greatest(F.lit(1), F.least(F.lit(BLOCK_TEXTS), F.floor(F.lit(float(BLOCK_SHINGLES)) / F.exp((F.col("class") + 1) * step)))).cast("int")
    blocks = rows.groupBy("cloud", "class").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / fit).cast("int")).select("cloud", "class", "blocks")
    near = lambda d, name: blocks.select("cloud", (F.col("class") - d).alias("class"), F.col("blocks").alias(name))
    rows = rows.join(blocks, ["cloud", "class"]).join(near(1, "above"), ["cloud", "class"], "left").join(near(-1, "below"), ["cloud", "class"], "left")
    own = F.pmod(F.xxhash64("body", F.lit("block")), F.col("blocks")).cast("int")
    upto = lambda c: F.when(F.col(c).isNotNull(), F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    # (class of the first block, its number, whether the second is of the class above, its number, side)
    spot = lambda low, i, up, j, side: F.struct(low.alias("low"), i.alias("i"), F.lit(up).alias("up"), j.alias("j"), side.alias("side"))
    c, o = F.col("class"), F.col("own")
    spots = F.concat(
        F.transform(upto("blocks"), lambda t: spot(c, F.least(o, t), False, F.greatest(o, t), F.when(o <= t, 0).otherwise(1))),
        F.transform(upto("above"), lambda t: spot(c, o, True, t, F.lit(0))), F.transform(upto("below"), lambda t: spot(c - 1, t, True, o, F.lit(1))),
    )
    rows = rows.withColumn("own", own).select("body", "component", "cloud", F.explode(spots).alias("s")).select("body", "component", "cloud", "s.*")
    rows = rows.join(texts.select("body", "text"), "body")
    kinds = [pa.int64(), pa.int64()]

    def cell(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("side", "ascending"), ("body", "ascending")])
        sets = [np.unique(shingles(t.as_py(), width)) for t in table.column("text")]
        side, body = table.column("side").to_numpy(), table.column("body").to_numpy()
        alone = not table.column("up")[0].as_py() and table.column("i")[0] == table.column("j")[0]
        found = forest(sets, table.column("component").to_numpy().copy(), None if alone else int((side == 0).sum())) if alone or 0 < side.sum() < len(side) else []
        return pa.Table.from_arrays([pa.array([body[p] for p, _ in found], kinds[0]), pa.array([body[q] for _, q in found], kinds[1])], names=["a", "b"])

    return rows.groupBy("cloud", "low", "i", "up", "j").applyInArrow(cell, "a long, b long")


def groups(texts: DataFrame, marked: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """``(node, component)`` of the linked ``texts`` (body, text): by the ``known`` links (a, b) and those that are found from the ``marks``."""
    rows = written(marked.select("body", F.explode("buckets").alias("bucket")), "near-buckets")
    live = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("body").alias("head")).where("n > 1")
    rows = written(rows.join(live, "bucket"), "near-live")
    few = rows.where(F.col("n") <= ALL_PAIRS).groupBy("bucket").agg(F.sort_array(F.collect_list("body")).alias("m"))
    few = few.select("m").distinct().select(F.explode(F.transform("m", lambda x, i: F.struct(x.alias("a"), F.slice("m", i + 2, F.greatest(F.size("m") - i - 1, F.lit(0))).alias("rest")))).alias("p"))
    label = checkpointed(connected_components(known.union(checked(few.select(F.col("p.a").alias("a"), F.explode("p.rest").alias("b")), marked, texts, width))))
    # a text's large buckets, at most BANDS, by their smallest texts; what meets in a text is one cloud
    heads = written(rows.where(F.col("n") > ALL_PAIRS).groupBy("body").agg(F.min("head").alias("top"), F.collect_set("head").alias("heads")), "near-heads")
    of = connected_components(heads.select(F.col("top").alias("a"), F.explode(F.filter("heads", lambda h: h != F.col("top"))).alias("b")).distinct())
    members = heads.select("body", "top").join(of.select(F.col("node").alias("top"), F.col("component").alias("cloud")), "top", "left").select("body", F.coalesce("cloud", "top").alias("cloud"))
    members = members.join(label.withColumnRenamed("node", "body"), "body", "left").withColumn("component", F.coalesce("component", "body"))
    members = written(members.join(marked.select("body", "size"), "body"), "near-members")
    # clouds that are one component by now have nothing left to find
    open_ = members.groupBy("cloud").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("cloud")
    more = written(cloud_links(texts, members.join(open_, "cloud", "left_semi"), width), "near-cloud-links")
    joined = label.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)
    return checkpointed(connected_components(joined))

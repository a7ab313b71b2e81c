"""The trie of conversations' prefixes, with sums over subtrees by heavy-path decomposition.

A conversation c is rebuilt as the first h turns of conversation c - c % 5, then its own turns after its first h, with
h = crc32(decimal c) % 9. Each distinct sequence of first turns is a node. Nodes are named by 128 bits: the exclusive or
of a hash of every (position, turn), so a prefix's name follows from a running scan, and its parent's by taking the last
turn out again.

Scans run in blocks: rows are ranked through a range partitioning, whose partitions hold about as many rows each however
long one conversation is, and running values start anew every ``BLOCK`` turns and get the blocks before added. So no task
holds a conversation, a node's members or a path.

Subtrees: of each node's children the one with the most conversations continues its path. Another child has at most half
its parent's conversations, so the heads of paths that hang on a path lie in lower classes floor(log2(conversations)).
Classes are worked through upwards: suffix sums along the paths of a class, whose heads' totals are added to their
parents for later classes. There are at most log2(conversations) + 1 rounds, and each node is summed in one of them.

Defined results: turns are ordered by turn (null first), then role, then text; null roles and texts are empty; equal rows
are turns of their own. Rows without a conv_id take no part. ``%`` keeps the sign of c, as in SQL. A conversation whose
base is absent has only its own turns after the first h. An empty table gives an empty result. Other columns than
conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK = 1024
MOST_SHARED = 8
#: Copies of a parent that its children are dealt over, as most nodes may be children of one.
SALTS = 8
#: Conversation ids that are joined into one string.
IDS = 4096
KEY, PARENT, TOP = ["k1", "k2"], ["p1", "p2"], ["t1", "t2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def _half(digest: str, at: int) -> Column:
    """16 hex digits as a long."""
    return F.conv(F.substring(digest, at, 16), 16, -10).cast("long")


def _ranked(conversations: DataFrame) -> DataFrame:
    """``(c, mid, h1, h2, bytes)``: every turn's hash and size; ``mid`` grows along a conversation, by 1 within a partition."""
    own = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")
    )
    order = ["c", "turn", "role", "text", "row"]
    digest = F.sha2(F.concat_ws(":", F.octet_length("role"), "role", "text"), 256)
    dealt = own.repartitionByRange(*order).sortWithinPartitions(*order).select("c", F.monotonically_increasing_id().alias("mid"), digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    return written(dealt.select("c", "mid", _half("digest", 1).alias("h1"), _half("digest", 17).alias("h2"), "bytes"), "trie-turns")


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(c, d, h1, h2, bytes, size)``, the d-th turn of each rebuilt conversation and its number of turns; and ``(c, size)`` of all."""
    part = F.shiftright("mid", 33).alias("part")
    spans = written(turns.groupBy("c", part).agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("n")), "trie-spans")
    whole = spans.groupBy("c").agg(F.sum("n").alias("n")).select("c", "n", (F.col("c") - F.col("c") % 5).alias("base"), (F.crc32(F.col("c").cast("string").cast("binary")) % 9).alias("h"))
    sizes = whole.select(F.col("c").alias("base"), F.col("n").alias("there"))
    shared = F.least("h", F.coalesce("there", F.lit(0)))
    convs = written(whole.join(sizes, "base", "left").select("c", "base", "h", shared.alias("shared"), (shared + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "trie-conversations")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = spans.withColumn("before", before).join(convs, "c").select("c", "part", "first", "before", "h", "shared", "size")
    placed = turns.withColumn("part", part).join(known, ["c", "part"]).withColumn("pos", F.col("mid") - F.col("first") + F.col("before") + 1)
    placed = written(placed.select("c", "pos", "h1", "h2", "bytes", "h", "shared", "size"), "trie-placed")
    tails = placed.where("pos > h").select("c", (F.col("pos") - F.col("h") + F.col("shared")).alias("d"), "h1", "h2", "bytes", "size")
    # at most MOST_SHARED turns of a base meet the few conversations built on it
    heads = placed.where(F.col("pos") <= MOST_SHARED).select(F.col("c").alias("base"), "pos", "h1", "h2", "bytes")
    heads = heads.join(convs, "base").where("pos <= h").select("c", F.col("pos").alias("d"), "h1", "h2", "bytes", "size")
    return tails.union(heads), convs.select("c", "size")


def _members(rows: DataFrame) -> DataFrame:
    """``(c, d, k1, k2, p1, p2, bytes, size)``: each conversation's nodes, their names and their parents'."""
    block = F.floor((F.col("d") - 1) / BLOCK)
    marked = rows.select("c", "d", block.alias("block"), F.xxhash64("d", "h1", "h2", F.lit(1)).alias("e1"), F.xxhash64("d", "h1", "h2", F.lit(2)).alias("e2"), "bytes", "size")
    here = Window.partitionBy("c", "block").orderBy("d")
    scanned = written(marked.withColumn("x1", F.bit_xor("e1").over(here)).withColumn("x2", F.bit_xor("e2").over(here)), "trie-scan")
    upto = Window.partitionBy("c").orderBy("block")
    full = scanned.where(F.col("d") % BLOCK == 0).select("c", (F.col("block") + 1).alias("block"), F.bit_xor("x1").over(upto).alias("o1"), F.bit_xor("x2").over(upto).alias("o2"))
    xor = lambda a, b: F.col(a).bitwiseXOR(F.coalesce(b, F.lit(0)))
    named = scanned.join(full, ["c", "block"], "left").select("c", "d", xor("x1", "o1").alias("k1"), xor("x2", "o2").alias("k2"), "e1", "e2", "bytes", "size")
    return written(named.select("c", "d", "k1", "k2", xor("k1", "e1").alias("p1"), xor("k2", "e2").alias("p2"), "bytes", "size"), "trie-members")


def _end_hashes(members: DataFrame, convs: DataFrame) -> DataFrame:
    """``(k1, k2, ends_sha256)`` of the nodes at which conversations end; ids stream through the hash in order, joined into pieces before they meet."""
    ends = members.where("d = size").select("k1", "k2", "c").union(convs.where("size = 0").select(F.lit(0).cast("long"), F.lit(0).cast("long"), "c"))

    def pieces(batches):
        node, first, ids = None, None, []
        for batch in batches:
            out = []
            for k1, k2, c in zip(*(col.to_pylist() for col in batch.columns)):
                if (k1, k2) != node or len(ids) == IDS:
                    if ids:
                        out.append((*node, first, ",".join(ids)))
                    node, first, ids = (k1, k2), c, []
                ids.append(str(c))
            yield _batch(out, ["k1", "k2", "first", "ids"], [pa.int64(), pa.int64(), pa.int64(), pa.string()])
        if ids:
            yield _batch([(*node, first, ",".join(ids))], ["k1", "k2", "first", "ids"], [pa.int64(), pa.int64(), pa.int64(), pa.string()])

    def digests(batches):
        node, state = None, None
        kinds = [pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            out = []
            for k1, k2, _, ids in zip(*(col.to_pylist() for col in batch.columns)):
                if (k1, k2) != node:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _batch(out, ["k1", "k2", "ends_sha256"], kinds)
        if node:
            yield _batch([(*node, state.hexdigest())], ["k1", "k2", "ends_sha256"], kinds)

    joined = ends.repartitionByRange("k1", "k2", "c").sortWithinPartitions("k1", "k2", "c").mapInArrow(pieces, "k1 long, k2 long, first long, ids string")
    return joined.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(digests, "k1 long, k2 long, ends_sha256 string")


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _tops(nodes: DataFrame) -> DataFrame:
    """``(k1, k2, t1, t2, convs)``: the head of each node's path and its number of conversations, by pointer jumping up the paths.

    A path's nodes that are still under way point at nodes of their own, so no target is met by many.
    """
    own = nodes.select("k1", "k2", F.when(F.col("heavy"), F.col("p1")).otherwise(F.col("k1")).alias("t1"), F.when(F.col("heavy"), F.col("p2")).otherwise(F.col("k2")).alias("t2"), F.when(~F.col("heavy"), F.col("n_convs")).alias("convs"))
    done, going = own.where("convs is not null"), written(own.where("convs is null"), "trie-jump")
    while not going.isEmpty():
        target = done.unionByName(going).select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.col("t1").alias("n1"), F.col("t2").alias("n2"), F.col("convs").alias("found"))
        step = written(going.drop("convs").join(target, TOP).select("k1", "k2", F.col("n1").alias("t1"), F.col("n2").alias("t2"), F.col("found").alias("convs")), "trie-jump")
        done, going = done.unionByName(step.where("convs is not null")), step.where("convs is null")
    return done


def _paths(nodes: DataFrame) -> DataFrame:
    """Nodes with ``n_children``, their path's head (t1, t2), its class, their parent's conv_id and its path's class."""
    kids = nodes.where("depth > 0").groupBy(*PARENT).agg(F.count(F.lit(1)).alias("n_children"), F.max(F.struct("n_convs", "k1", "k2")).alias("largest"))
    kids = written(kids, "trie-children")
    below = kids.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children")
    largest = kids.select(F.col("largest.k1").alias("k1"), F.col("largest.k2").alias("k2"), F.lit(True).alias("heavy"))
    known = nodes.join(below, KEY, "left").join(largest, KEY, "left").withColumn("heavy", F.coalesce("heavy", F.lit(False))).withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = written(known, "trie-kinds")
    kind = F.length(F.bin("convs")) - 1
    placed = written(known.join(_tops(known), KEY).withColumn("class", kind).drop("convs"), "trie-paths")
    parents = placed.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("class").alias("parent_class"))
    parents = parents.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return written(placed.withColumn("salt", F.pmod("k1", F.lit(SALTS)).cast("int")).join(parents, [*PARENT, "salt"], "left").drop("salt"), "trie-nodes")


def _suffix_sums(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each column summed from a node to its path's end: within blocks of ``BLOCK`` depths, then with the blocks below."""
    block = F.floor(F.col("depth") / BLOCK)
    here = Window.partitionBy(*TOP, "block").orderBy(F.desc("depth"))
    sums = rows.withColumn("block", block).select("*", *[F.sum(c).over(here).alias(f"{c}_here") for c in columns], (F.col("depth") == F.min("depth").over(Window.partitionBy(*TOP, "block"))).alias("first"))
    after = Window.partitionBy(*TOP).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = sums.where("first").select(*TOP, "block", *[F.sum(f"{c}_here").over(after).alias(f"{c}_below") for c in columns]).where(F.col(f"{columns[0]}_below").isNotNull())
    joined = sums.join(totals, [*TOP, "block"], "left")
    return joined.select(*rows.columns, *[(F.col(f"{c}_here") + F.coalesce(f"{c}_below", F.lit(0))).alias(f"{c}_sum") for c in columns])


def _subtrees(nodes: DataFrame) -> DataFrame:
    """The nodes with ``n_leaves`` and ``saved_tokens`` over their subtrees."""
    spark = nodes.sparkSession
    own = nodes.select("*", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    classes = sorted(r["class"] for r in nodes.select("class").distinct().collect())  # at most log2 of the conversations
    schema = "p1 long, p2 long, parent_class int, leaf_sum long, saved_sum long"
    hanging, parts = spark.createDataFrame([], schema), []
    for at in classes:
        extra = hanging.where(F.col("parent_class") == at).groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("leaf_sum").alias("more_leaf"), F.sum("saved_sum").alias("more_saved"))
        rows = own.where(F.col("class") == at).join(extra, KEY, "left")
        rows = rows.withColumn("leaf", F.col("leaf") + F.coalesce("more_leaf", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0))).drop("more_leaf", "more_saved")
        done = written(_suffix_sums(rows, ["leaf", "saved"]), f"trie-class-{at}")
        parts.append(done)
        hanging = hanging.unionByName(done.where("not heavy and depth > 0").select("p1", "p2", "parent_class", "leaf_sum", "saved_sum"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("leaf_sum", "n_leaves").withColumnRenamed("saved_sum", "saved_tokens")


def build(conversations: DataFrame) -> DataFrame:
    """One row a node: ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``."""
    rows, convs = _rebuilt(_ranked(conversations))
    members = _members(rows)
    zero = F.lit(0).cast("long")
    nodes = members.groupBy("k1", "k2").agg(F.min("d").alias("depth"), F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    root = convs.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    none = F.lit(None).cast("long")
    root = root.select(zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("bytes"), none.alias("p1"), none.alias("p2"))
    nodes = written(nodes.union(root), "trie-found")
    if nodes.isEmpty():
        return nodes.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    sums = _subtrees(_paths(nodes)).join(_end_hashes(members, convs), KEY, "left")
    return sums.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))

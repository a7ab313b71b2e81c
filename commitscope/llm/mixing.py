"""Mixing sources to target weights by Sainte-Lague apportionment.

1. Targets: all words are shared among the sources by weight; a target stops at three times its source's size and the
   excess is shared again by weight.
2. The words to take are cut into equal blocks; blocks go to sources by highest quotients target / (2 k + 1).
3. Each source is dealt over shards of about ``SHARD_DOCS`` documents (so a hot source has many), the shards over
   groups of ``GROUP_SHARDS``; its blocks go to its groups, and a group's blocks to its shards, by the same rule with
   their sizes, which gives an integer quota per shard. No task sees more than one group's shards.
4. Within a shard the documents stand in a seeded order and their words are cut into blocks; whole passes take every
   block once, and the rest of the quota goes to the blocks with the smallest seeded hashes. A document gets the words
   of the chosen blocks that are its own.

One summary row per source (see ``MOST_SOURCES``) and per group of shards reaches the driver; per-shard summaries stay
distributed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CAP = 3
SHARD_DOCS, GROUP_SHARDS, MOST_BLOCK = 512, 4096, 512
#: Sources are mixture components, named in a recipe; more than this many is an error, not a silent cut.
MOST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)


def apportion(seats: int, weights, most=None) -> np.ndarray:
    """Sainte-Lague: ``seats`` by highest quotients weight / (2 k + 1), ties to earlier entries; ``most`` limits entries.

    The divisor is found by bisection and the last seats by their quotients, so the cost does not depend on ``seats``.
    """
    w = np.asarray(weights, np.float64)
    cap = np.full(len(w), np.inf) if most is None else np.asarray(most, np.float64)
    cap = np.where(w > 0, cap, 0)
    seats = int(min(seats, cap.sum())) if len(w) else 0
    if seats <= 0:
        return np.zeros(len(w), np.int64)

    def given(unit: float) -> np.ndarray:
        # entries keep the seats whose quotient w / (2 k + 1) is above unit
        return np.minimum(np.maximum(np.ceil((w / unit - 1) / 2), 0), cap)

    low, high = 0.0, float(w.max()) * 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (low, mid) if given(mid).sum() <= seats else (mid, high)
    got = given(high).astype(np.int64)
    while (rest := seats - int(got.sum())) > 0:
        quotient = np.where(got < cap, w / (2 * got + 1), -1)
        got[np.argsort(-quotient, kind="stable")[:rest]] += 1
    return got


def targets(sizes, weights, cap: float = CAP) -> np.ndarray:
    """Shares of the total size by weight, none above ``cap`` times its own size; the excess is reshared by weight."""
    size, w = np.asarray(sizes, np.float64), np.asarray(weights, np.float64)
    out, free, left = np.zeros(len(size)), np.ones(len(size), bool), float(size.sum())
    while free.any() and left > 0:
        share = left * w / w[free].sum()
        over = free & (share > cap * size)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = cap * size[over]
        free &= ~over
        left = float(size.sum()) - float(out[~free].sum())
    return out


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: int = 7) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)``, one row per document.

    size: words of the text (null: 0). Sources in code-point order, null last, weigh ``weights`` in turn. ``taken`` is
    the number of the document's words in the mix, repeats counted, at most ``cap`` times its size. Reruns on the same
    rows agree; repeated rows (equal id and text) are told apart by nothing, so they may swap their parts. Documents
    without words take nothing; an empty table gives an empty result.
    """
    return _placed(docs, weights, cap, seed).select("doc_id", "source", "size", "source_size", "target", "taken")


def settle(size: np.ndarray, taken: np.ndarray, start: float, cap: int = CAP) -> np.ndarray:
    """Whole copies of a shard's documents that stand for the words taken of each; all sizes above 0, in ascending order.

    Systematic sampling from ``start`` in [0, 1): along the documents the running sum of ``taken / size`` is cut to whole
    numbers, so no document is favoured by its length. What the copies then miss, or have too much, is made up for by
    single documents of about that size, the nearest first, as long as that helps.
    """
    share = taken / size
    upto = np.floor(np.cumsum(share) + start + 1e-9)
    times = np.clip(np.diff(upto, prepend=np.floor(start + 1e-9)), 0, cap).astype(np.int64)
    for _ in range(16):
        rest = int(taken.sum() - (times * size).sum())
        may = np.flatnonzero((times < cap) if rest > 0 else (times > 0))
        if rest == 0 or not len(may):
            break
        at = may[np.argmin(np.abs(size[may] - abs(rest)))]
        if size[at] >= 2 * abs(rest):
            break
        times[at] += 1 if rest > 0 else -1
    return times


def copies(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: int = 7) -> DataFrame:
    """``(doc_id, source, body, times)``, one row per document: whole copies in the mix, at most ``cap``.

    Each shard settles the fractions on its own (see ``settle``), so its words differ from those taken by at most half of
    one of its shortest documents that can still be added or left out. Documents without words have none. ``body``: hash
    of the text.
    """
    start = F.pmod(F.xxhash64(F.lit(seed + 3), "source", "shard"), F.lit(1 << 20)) / (1 << 20)
    rows = _placed(docs, weights, cap, seed).withColumn("start", start)

    def run(part: pa.Table) -> pa.Table:
        size, taken = part["size"].to_numpy(), part["taken"].to_numpy()
        order = np.lexsort((taken, part["order"].to_numpy(), size))
        times = np.empty(len(size), np.int64)
        times[order] = settle(size[order], taken[order], part["start"][0].as_py(), cap)
        return part.select(["doc_id", "source", "body"]).append_column("times", pa.array(times, pa.int32()))

    some = rows.where("size > 0").groupBy("source", "shard").applyInArrow(run, "doc_id long, source string, body long, times int")
    return some.union(rows.where("size = 0").select("doc_id", "source", "body", F.lit(0)))


def _placed(docs: DataFrame, weights, cap: int, seed: int) -> DataFrame:
    """The rows of ``mix`` with their shard, seeded order and text hash."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    base = written(docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("body")), "mix-sizes")
    found = base.groupBy("source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    size = [r["s"] for r in found]
    target = targets(size, [weights[i % len(weights)] for i in range(len(found))], cap)
    total = int(sum(size))
    # a block is small against the smallest target, so that whole blocks come near it
    least = min([t for t in target if t > 0], default=1)
    block = max(1, min(MOST_BLOCK, int(least / 200)))
    quota = apportion(round(target.sum() / block), target, [cap * (s // block) for s in size])
    shards = [max(1, min(-(-r["n"] // SHARD_DOCS), r["s"] // (block * 64))) for r in found]
    recipe = spark.createDataFrame(
        [(r["source"], int(r["s"]), float(t), int(q), int(k)) for r, t, q, k in zip(found, target, quota, shards)], "source string, source_size long, target double, quota long, shards long"
    )
    order = F.xxhash64(F.lit(seed), "doc_id", "body")
    same = base["source"].eqNullSafe(recipe["source"])
    rows = base.join(recipe, same).drop(recipe["source"]).withColumn("order", order)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "body"), F.col("shards")))

    group = F.expr(f"shard div {GROUP_SHARDS}").alias("group")
    sizes = rows.groupBy("source", "shard", group).agg(F.sum("size").alias("words"), F.first("quota").alias("quota")).withColumn("blocks", F.expr(f"words div {block}"))
    # one row a group of GROUP_SHARDS shards reaches the driver, that is one for two million documents
    groups = sizes.groupBy("source", "group").agg(F.sum("words").alias("words"), F.sum("blocks").alias("blocks"), F.first("quota").alias("quota")).collect()
    of: dict = {}
    for r in sorted(groups, key=lambda r: r["group"]):
        of.setdefault(r["source"], []).append(r)
    given = [(k, r["group"], int(t)) for k, rs in of.items() for r, t in zip(rs, apportion(rs[0]["quota"], [r["words"] for r in rs], [cap * r["blocks"] for r in rs]))]
    given = spark.createDataFrame(given, "s string, g long, quota long")

    def quotas(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("shard")
        part["take"] = apportion(int(part["quota"].iloc[0]), part["words"].to_numpy(), cap * part["blocks"].to_numpy())
        return part[["source", "shard", "blocks", "take"]]

    sizes = sizes.drop("quota").join(given, F.expr("source <=> s and group = g")).drop("s", "g")
    plan = sizes.groupBy("source", "group").applyInPandas(quotas, "source string, shard long, blocks long, take long")
    # of a shard's whole blocks, which take part in the last, partial pass: the smallest hashes
    extra = plan.where("blocks > 0 and take % blocks > 0").select("source", "shard", (F.col("take") % F.col("blocks")).alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("no"))
    by = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "source", "shard", "no"), "no")
    chosen = extra.withColumn("r", F.row_number().over(by)).where("r <= k").groupBy("source", "shard").agg(F.sort_array(F.collect_list("no")).alias("chosen"))
    plan = plan.join(chosen.withColumnsRenamed({"source": "s", "shard": "h"}), F.expr("source <=> s and shard = h"), "left").select("source", "shard", "blocks", "take", "chosen")
    line = Window.partitionBy("source", "shard").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum("size").over(line), F.lit(0)))
    plan = plan.withColumnsRenamed({"source": "s", "shard": "h"})
    placed = placed.join(plan, F.expr("source <=> s and shard = h"), "left")
    # words within the whole blocks, once a pass; then the overlap with the chosen blocks
    whole = F.expr(f"greatest(0, least(start + size, blocks * {block}) - start)")
    first, last = F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")
    mine = F.filter("chosen", lambda b: (b >= first) & (b <= last))
    part = F.aggregate(mine, F.lit(0).cast("long"), lambda a, b: a + F.least(F.col("start") + F.col("size"), (b + 1) * block) - F.greatest(F.col("start"), b * block))
    taken = F.coalesce(F.when(F.col("blocks") > 0, F.expr("take div blocks") * whole), F.lit(0)) + F.coalesce(part, F.lit(0))
    return placed.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, taken).otherwise(0).cast("long").alias("taken"), "body", "shard", "order")

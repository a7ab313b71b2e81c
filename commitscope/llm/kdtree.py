"""Exact top-k by inner product over sharded KD-trees.

Vectors become integers floor(256 x). Each shard builds a KD-tree: median splits on the widest dimension, tight
bounding boxes at every node. For a query q the best inner product within a box is sum(max(q*lo, q*hi)); nodes whose
bound is below the query's kth score are pruned on the way down and the surviving leaves are visited best first.

Round one searches each query's own shard. The kth score found there is propagated: round two, over all other shards,
starts from it. Shards and query blocks have fixed row counts, so a task's memory does not depend on the input size;
each (shard, query block) pair is one group of a cogrouped equi-join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEAF, SHARD_ROWS, QUERY_ROWS = 128, 4096, 8192


class KDTree:
    """Leaves are index ranges of ``order``; ``levels`` holds (lo, hi, first leaf, last leaf + 1) of each level's nodes."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        nodes, self.levels = [(0, len(x))] if len(x) else [], []
        while nodes:
            lo = np.array([x[self.order[i:j]].min(axis=0) for i, j in nodes])
            hi = np.array([x[self.order[i:j]].max(axis=0) for i, j in nodes])
            below, kids = [], []
            for (i, j), low, high in zip(nodes, lo, hi):
                axis = int(np.argmax(high - low))
                if j - i <= leaf or high[axis] == low[axis]:
                    kids.append((len(below), len(below) + 1))
                    below.append((i, j))
                    continue
                m = (j - i) // 2
                part = self.order[i:j]
                self.order[i:j] = part[np.argpartition(x[part, axis], m, kind="introselect")]
                kids.append((len(below), len(below) + 2))
                below += [(i, i + m), (i + m, j)]
            self.levels.append((lo, hi, np.array(kids)))
            if below == nodes:
                break
            nodes = below
        self.leaves = nodes

    def search(self, x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query index, id, score) of at most k rows per query: all that can be among its k best, ties to smaller ids.

        least: a score that k other rows are known to reach (else the smallest number). Rows whose id is the query's
        own are no candidates.
        """
        n = len(q)
        kth = least.astype(np.float64).copy()
        best_s, best_i = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        live = np.ones((n, 1), bool)
        for depth, (lo, hi, kids) in enumerate(self.levels):
            bound = up @ hi.T + down @ lo.T
            live = live & (bound >= kth[:, None])
            if depth + 1 < len(self.levels):
                live = np.repeat(live, kids[:, 1] - kids[:, 0], axis=1)
        bound = np.where(live, bound, -np.inf)
        turn = np.argsort(-bound, axis=1, kind="stable")
        for r in range(len(self.leaves)):
            leaf = turn[:, r]
            top = bound[np.arange(n), leaf]
            going = np.flatnonzero((top >= kth) & (top > -np.inf))
            if not len(going):
                break
            for at in np.unique(leaf[going]):
                who = going[leaf[going] == at]
                rows = self.order[slice(*self.leaves[at])]
                score = q[who] @ x[rows].T
                score[own[who][:, None] == ids[rows][None, :]] = -np.inf
                s = np.concatenate([best_s[who], score], axis=1)
                i = np.concatenate([best_i[who], np.broadcast_to(ids[rows], score.shape)], axis=1)
                pick = np.lexsort((i, -s), axis=1)[:, :k]
                best_s[who], best_i[who] = np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)
                kth[who] = np.maximum(kth[who], best_s[who, k - 1])
        who, rank = np.nonzero((best_s > -np.inf) & (best_s >= least[:, None]))
        return who, best_i[who, rank], best_s[who, rank]


def _matrix(vectors, width: int) -> np.ndarray:
    x = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    return x


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, v)``, v = floor(256 x) as doubles holding integers; rows with a null id, vector or component or a non-finite component take no part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("v")
    )


def top_k(embeddings: DataFrame, is_query, k: int = 5, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query row's k largest integer inner products over all other rows.

    ``is_query`` is a condition on ``vec_id``. Ties go to the smaller vec_id; fewer than k candidates give fewer rows.
    Rows that share the query's vec_id are its own; repeated query ids give one set of results, over their
    distinct vectors; repeated candidates each count. Shorter vectors count as zero-padded. Components up to 2**20 and 2**12 dimensions are exact (doubles
    hold the sums). An empty table gives an empty result.
    """
    vectors = integer_vectors(embeddings)
    n, n_query, width = vectors.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_query // query_rows))
    # seeded numbers, written once, deal repeated rows evenly too; any dealing gives the same results
    dealt = F.least(F.floor(F.rand(7) * shards).cast("int"), F.lit(shards - 1))
    rows = written(vectors.select("vec_id", "v", dealt.alias("shard")), "kd-rows")
    block = F.pmod(F.xxhash64("query_id", F.lit("block")), F.lit(blocks)).cast("int").alias("block")
    queries = rows.where(is_query).groupBy(F.col("vec_id").alias("query_id"), "v").agg(F.min("shard").alias("shard")).select("query_id", "v", "shard", block)

    def search(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if data.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        x, q = _matrix(data["v"].to_numpy(), width), _matrix(asked["v"].to_numpy(), width)
        ids, own = data["vec_id"].to_numpy(), asked["query_id"].to_numpy()
        who, vec, score = KDTree(x).search(x, ids, q, own, k, asked["least"].to_numpy())
        return pd.DataFrame({"query_id": own[who], "vec_id": vec, "score": score.astype(np.int64)})

    schema = "query_id long, vec_id long, score long"
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def run(data: DataFrame, asked: DataFrame) -> DataFrame:
        asked = asked.toDF(*asked.columns)  # new column ids: both sides come from one table
        return data.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(search, schema)

    # at home a shard meets only its own queries, at most its rows: no row is sent twice
    asked = queries.withColumn("block", F.lit(0)).withColumn("least", F.lit(float("-inf")))
    home = written(run(rows.withColumn("block", F.lit(0)), asked), "kd-home")
    kth = home.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.sort_array(F.collect_list("score"), asc=False).getItem(k - 1)).alias("kth"))
    known = queries.join(kth, "query_id", "left").withColumn("least", F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf"))))
    if shards > 1:
        others = F.explode(F.expr(f"filter(sequence(0, {shards - 1}), s -> s <> shard)")).alias("to")
        spots = rows.select("vec_id", "v", "shard", F.explode(F.expr(f"sequence(0, {blocks - 1})")).alias("block"))
        away = run(spots, known.select("query_id", "v", "least", "block", others).withColumnRenamed("to", "shard"))
        home = home.union(away)
    return home.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is taken relative to the centre of its cell, scaled to length one, rotated at random and kept as the signs of
its components: one bit each, packed. With the correction scalar f = <code, rotated vector> (code: the signs over the
square root of their number) the inner product with a query's rotated offset is estimated as <code, query> / f, and its
error stays below ``SIGMAS`` * |query| * sqrt((1 - f^2) / (f^2 (D - 1))) but for rare cases. Rows whose distance could by
that bound be below the kth best known are reranked by their original vectors in double precision; all others are passed over.

Every row is indexed. Cells' centres are fitted on a sample of at most ``SAMPLE`` rows a cell, drawn by a hash of the
rows; cells are cut into shards of ``SHARD_BYTES`` of vectors, so one cell may hold most rows. A query first searches
its own shard. A cell is left out where the triangle inequality puts all its rows beyond the kth distance found there,
which loses nothing; rows are passed over by their codes alone. Queries of a cell are dealt into blocks, and a
(shard, block) pair is one group of a cogrouped equi-join.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows without an id, take no
part. Shorter vectors count as zero-padded. Vectors so long that squares overflow are reranked every time. Rows with the query's id are no candidates of it; repeated query ids give
one set of results, the k best of what each of their distinct vectors finds; repeated rows each count. Ties go to the
smaller id. An empty table gives an empty result. Only vec_id and embedding are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Cells have about this many rows, up to MOST_CELLS of them; SAMPLE rows a cell are sampled to fit the centres.
CELL_ROWS, MOST_CELLS, SAMPLE, STEPS = 4096, 256, 32, 8
#: Bytes of vectors of a shard, and of a block of queries.
SHARD_BYTES, QUERY_BYTES = 8 << 20, 8 << 20
#: Estimated inner products of one step within a task.
STEP = 1 << 20
SIGMAS = 3.0


def rotation(width: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix; the same on every executor."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, correction scalar and length of every row."""
    size = np.sqrt((x * x).sum(axis=1))
    unit = (x / np.where(size > 0, size, 1)[:, None]) @ turn
    signs = unit >= 0
    scalar = np.abs(unit).sum(axis=1) / np.sqrt(x.shape[1])
    return np.packbits(signs, axis=1), np.where((size > 0) & np.isfinite(size), scalar, 1.0), size


def distance(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of the rows from ``q``, added up component by component, so that any engine gets the same doubles."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        off = x[:, j] - q[j]
        total += off * off
    return np.sqrt(total)


def _rows(data, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(data), np.float64).reshape(-1, width)


def search_shard(ids, x, codes, scalar, size, centre, turn, asked, q, kth, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, distance): the rows of a shard that can be among a query's k nearest, k at most.

    kth: a distance within which k other rows are known to lie, or infinity. Rows are bounded by their codes
    first; what may lie within the kth distance is reranked, nearest estimates first, and lowers it.
    """
    width, out = x.shape[1], []
    signs = (np.unpackbits(codes, axis=1, count=width).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(width))
    slack = SIGMAS * np.sqrt(np.maximum(0, 1 - scalar**2) / (scalar**2 * max(1, width - 1)))
    step = max(1, STEP // max(1, len(x)))
    for i in range(0, len(q), step):
        off = q[i : i + step] - centre
        far = np.sqrt((off * off).sum(axis=1))
        inner = (off @ turn).astype(np.float32) @ signs.T
        base = far[:, None] ** 2 + size[None, :] ** 2
        about = base - 2 * size[None, :] * inner / scalar[None, :]
        least = about - 2 * size[None, :] * far[:, None] * slack[None, :] - 1e-5 * base
        least[np.isnan(least)] = -np.inf
        other = asked[i : i + step][:, None] != ids[None, :]
        for a in range(len(off)):
            bound = kth[i + a]
            hit = np.flatnonzero((least[a] <= bound * bound) & other[a])
            if not len(hit):
                continue
            if len(hit) > 4 * k:  # the nearest estimates lower the bound for the others
                near = hit[np.argpartition(about[a, hit], 2 * k)[: 2 * k]]
                bound = min(bound, np.partition(distance(x[near], q[i + a]), k - 1)[k - 1])
                hit = hit[least[a, hit] <= bound * bound]
            d = distance(x[hit], q[i + a])
            best = np.lexsort((ids[hit], d))[:k]
            best = best[d[best] <= bound]
            out.append((np.full(len(best), i + a), ids[hit[best]], d[best]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out))


@dataclass
class Index:
    """``rows``: (vec_id, cell, shard, x, code, scalar, size), a row each; ``shards``: of each cell; ``reach``: the largest length in it."""

    rows: DataFrame
    centres: np.ndarray
    shards: dict[int, int]
    reach: np.ndarray
    width: int


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, embedding)`` of the rows that take part, as doubles."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    own = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False)))
    return own.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


def _centres(sample: np.ndarray, cells: int, steps: int = STEPS) -> np.ndarray:
    """Lloyd's algorithm over the sample, from evenly spread rows."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(steps):
        near = _nearest(sample, centres)
        for c in range(cells):
            if (own := near == c).any():
                centres[c] = sample[own].mean(axis=0)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


def build(embeddings: DataFrame, cells: int | None = None) -> Index | None:
    """Index every vector; nothing for a table without any. What the driver gets is the sample, the centres and a row a cell."""
    vectors = whole_vectors(embeddings)
    spark = vectors.sparkSession
    n, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not n:
        return None
    cells = cells or max(1, min(MOST_CELLS, n // CELL_ROWS))
    picked = vectors.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(cells * SAMPLE).collect()
    sample = np.zeros((len(picked), width))
    for i, r in enumerate(picked):
        sample[i, : len(r["embedding"])] = r["embedding"]
    sample = sample[np.abs(sample).max(axis=1) < 1e100]
    centres = _centres(sample, min(cells, len(sample))) if len(sample) else np.zeros((1, width))
    shared = spark.sparkContext.broadcast(centres)  # at most MOST_CELLS vectors

    def run(batches):
        turn = rotation(width)
        for batch in batches:
            at, values = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy(zero_copy_only=False)
            x, long = np.zeros((batch.num_rows, width)), np.diff(at)
            x[np.arange(width)[None, :] < long[:, None]] = values[at[0] : at[-1]]
            with np.errstate(all="ignore"):
                cell = _nearest(x, shared.value)
                code, scalar, size = encode(x - shared.value[cell], turn)
            raw = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(cell.astype(np.int32)), raw(x), raw(code), pa.array(scalar), pa.array(size)], names=["vec_id", "deal", "cell", "x", "code", "scalar", "size"])

    # a number of its own deals every row, equal ones too
    dealt = vectors.withColumn("deal", F.xxhash64("vec_id", F.monotonically_increasing_id()))
    found = written(dealt.mapInArrow(run, "vec_id long, deal long, cell int, x binary, code binary, scalar double, size double"), "bit-codes")
    own = found.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("reach")).collect()  # a row a cell
    most = max(1, SHARD_BYTES // (8 * width))
    shards = {r["cell"]: -(-r["n"] // most) for r in own}
    reach = np.full(len(centres), -np.inf)
    for r in own:
        reach[r["cell"]] = r["reach"]
    return Index(found.withColumn("shard", F.pmod("deal", _per_cell(shards)).cast("int")).drop("deal"), centres, shards, reach, width)


def _per_cell(numbers: dict[int, int]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for p in numbers.items() for v in p]), F.col("cell")), F.lit(0))


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k nearest found. ``queries``: rows of the index (``vec_id, cell, shard, x``)."""
    width, centres, shards, reach = index.width, index.centres, index.shards, index.reach
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(centres)
    best = Window.partitionBy("query_id").orderBy("d", "vec_id")
    kept = "query_id long, vec_id long, d double"

    def pair(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if data.empty or asked.empty:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "d": np.zeros(0)})
        x, q = _rows(data["x"], width), _rows(asked["x"], width)
        codes = np.frombuffer(b"".join(data["code"]), np.uint8).reshape(len(x), -1)
        own = asked["query_id"].to_numpy()
        with np.errstate(all="ignore"):
            who, ids, d = search_shard(data["vec_id"].to_numpy(), x, codes, data["scalar"].to_numpy(), data["size"].to_numpy(), shared.value[data["cell"].iat[0]], rotation(width), own, q, asked["kth"].to_numpy(), k)
        return pd.DataFrame({"query_id": own[who], "vec_id": ids, "d": d})

    def run(data: DataFrame, asked: DataFrame) -> DataFrame:
        keys = ["cell", "shard", "block"]
        return data.groupBy(*keys).cogroup(asked.toDF(*asked.columns).groupBy(*keys)).applyInPandas(pair, kept)

    # at home a shard meets its own queries, at most its rows
    asked = written(queries.select(F.col("vec_id").alias("query_id"), "cell", "shard", "x").dropDuplicates(["query_id", "x"]), "bit-queries")
    rows = index.rows.select("vec_id", "cell", "shard", "x", "code", "scalar", "size")
    at_home = run(rows.withColumn("block", F.lit(0)), asked.withColumn("block", F.lit(0)).withColumn("kth", F.lit(float("inf"))))
    home = written(at_home, "bit-home")
    kth = home.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.sort_array(F.collect_list("d")).getItem(k - 1)).alias("kth"))
    known = asked.join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("inf"))))

    def spread(batches):
        """The cells that the triangle inequality doesn't put beyond a query's kth distance."""
        for batch in batches:
            q = _rows(batch.column(1).to_pylist(), width)
            with np.errstate(all="ignore"):
                far = np.sqrt(np.maximum(0, (q * q).sum(axis=1)[:, None] - 2 * q @ shared.value.T + (shared.value**2).sum(axis=1)[None, :]))
            who, cell = np.nonzero(~((far - reach[None, :]) * (1 - 1e-9) - 1e-6 > batch.column(2).to_numpy()[:, None]) & (reach >= 0))
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(who)) for i in range(5)] + [pa.array(cell.astype(np.int32))], names=["query_id", "x", "kth", "home", "own", "cell"])

    near = known.select("query_id", "x", "kth", F.col("cell").alias("home"), F.col("shard").alias("own")).mapInArrow(spread, "query_id long, x binary, kth double, home int, own int, cell int")
    near = written(near, "bit-near")
    most = max(1, QUERY_BYTES // (8 * width))
    blocks = {r["cell"]: -(-r["n"] // most) for r in near.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cell
    if not blocks:
        return home.select("query_id", F.lit(1).alias("rank"), "vec_id", F.col("d").alias("score"))
    block = F.pmod(F.xxhash64("query_id", "x"), _per_cell(blocks)).cast("int")
    elsewhere = ~((F.col("cell") == F.col("home")) & (F.col("shard") == F.col("own")))
    sent = near.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), _per_cell(shards) - 1))).where(elsewhere)
    spots = rows.where(_per_cell(blocks) > 0).withColumn("block", F.explode(F.sequence(F.lit(0), _per_cell(blocks) - 1)))
    away = run(spots, sent.select("query_id", "x", "kth", "cell", "shard", "block"))
    found = home.unionByName(away)
    # every shard gives a query at most k rows
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("d").alias("score"))


def nearest(embeddings: DataFrame, is_query: Column, k: int = 10, cells: int | None = None) -> DataFrame:
    """Index all vectors and search for those whose ``vec_id`` meets the condition."""
    index = build(embeddings, cells)
    if index is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, index.rows.where(is_query), k)

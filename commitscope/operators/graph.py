"""Ways up a forest by contraction, and connected components by repeated minimum labels with pointer jumping, for the identity graph."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the checkpoint folder that the session names, which all executors share; a temporary folder takes its place only for a local master without one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="commitscope-")
        sc.setCheckpointDir(folder)
    return f"{sc.getCheckpointDir()}/{kind}/{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LEAN = threading.Lock()
#: By session, how many threads write intermediate tables now, and the setting that holds when none does.
_USERS: dict[int, tuple[int, str | None]] = {}


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files go when it ends, not when the driver collects garbage; several threads may be within at once."""
    key = id(spark)
    with _LEAN:
        n, had = _USERS.get(key, (0, spark.conf.get(_CLEANUP, None)))
        _USERS[key] = (n + 1, had)
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _LEAN:
            n, had = _USERS.pop(key)
            if n > 1:
                _USERS[key] = (n - 1, had)
            elif had is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, had)


def checkpointed(df: DataFrame) -> DataFrame:
    """A table written in the shared folder and read back: it cuts lineage, survives lost executors and is computed once."""
    path = shared_path(df.sparkSession, "tables")
    with lean(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Nodes up to which pointers are doubled; longer lists are contracted first, so that what is shuffled is in proportion to them.
FEW = 1_000_000


def ways(line: DataFrame, few: int | None = None) -> DataFrame:
    """``(id, top, steps)`` of the nodes ``line`` (id, to: long), each with one way up: where it ends, a node that is no ``id``, and after how many steps.

    A round takes the nodes out that drew heads and whose next one drew tails, a quarter of all; who pointed at one points
    past it. No two neighbours leave in one round, so each later learns its way from the one it pointed at, round by round
    backwards. Doubling all pointers instead would shuffle all nodes log2(longest way) times.
    """
    line, left = checkpointed(line.select("id", "to", F.lit(1).cast("long").alias("steps"))), []
    while line.count() > (FEW if few is None else few):
        heads = lambda c, r=len(left): F.xxhash64(c, F.lit(r)).bitwiseAND(F.lit(1)) == 1
        out = line.where(heads("id") & ~heads("to"))
        past = out.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        moved = line.where(heads("to")).join(past, "to", "left").select("id", F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        left.append(out)
        line = checkpointed(moved.union(line.where(~heads("id") & ~heads("to"))))
    moved = True
    while moved:
        ahead = line.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        step = checkpointed(line.join(ahead, "to", "left").select("id", F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved")))
        moved = not step.where("moved").isEmpty()
        line = step.drop("moved")
    known = line.withColumnRenamed("to", "top")
    for out in reversed(left):
        ahead = known.select(F.col("id").alias("to"), "top", F.col("steps").alias("more"))
        known = known.union(checkpointed(out.join(ahead, "to", "left").select("id", F.coalesce("top", "to").alias("top"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))))
    return known


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, component)`` for all nodes; edges (a, b) are undirected; the component is its smallest node."""
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = checkpointed(nodes.select("node", F.col("node").alias("component")))
    while True:
        seen = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("component").alias("low"))
        near = label.join(seen, label["node"] == seen["a"], "left").select("node", "component", F.least("component", "low").alias("new"))
        up = near.select(F.col("node").alias("at"), F.col("new").alias("jump"))
        step = checkpointed(near.join(up, near["new"] == up["at"]).select("node", "component", F.least("new", "jump").alias("new")))
        changed = not step.where("new <> component").isEmpty()
        label = step.select("node", F.col("new").alias("component"))
        if not changed:
            return label

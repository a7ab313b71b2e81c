"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest slice of concatenated text (bytes) that a Python worker handles at once.
SLICE_BYTES = 4 << 20


#: Folders of this process's own, where a local session names none, by application.
_OWN: dict[str, str] = {}
#: The tables written so far, thread by thread: a run releases its own only.
_LOCAL = threading.local()


def _written() -> list[str]:
    return _LOCAL.__dict__.setdefault("paths", [])


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master gets a temporary folder that goes when the process ends (tests); any other master
    is an error, as a machine-local folder would not be visible to the executors. The session's settings stay as they are.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if sc.applicationId not in _OWN:
            own = tempfile.mkdtemp(prefix="commitscope-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            _OWN[sc.applicationId] = "file://" + own
        base = _OWN[sc.applicationId]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def table_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, noted for ``release``."""
    _written().append(f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}")
    return _written()[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back; cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def noted() -> int:
    """How many tables this thread has noted so far; give it to ``release`` to remove only later ones."""
    return len(_written())


def release(spark: SparkSession, since: int = 0) -> None:
    """Remove the intermediate tables that this thread wrote after ``since``; call it when the results that read them are written."""
    while len(_written()) > since:
        remove(spark, _written().pop())


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Within, Spark removes a query's shuffle files when the query ends, not when the driver happens to collect garbage; tables in Parquet or checkpoints are all that later queries read."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; it stays unless the session sets ``spark.cleaner.referenceTracking.cleanCheckpoints``."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(df: DataFrame, *keys: str) -> DataFrame:
    """Only the key columns and ``text`` (null: empty), whatever other columns the table has."""
    return df.select(*[F.col(f"`{k}`") for k in keys], F.coalesce(F.col("text"), F.lit("")).alias("text"))


def slices(texts, most: int = SLICE_BYTES):
    """Index ranges (i, j) of ``texts`` of about ``most`` bytes each; one long text makes a range of its own."""
    i, n = 0, 0
    for j, t in enumerate(texts):
        if n and n + len(t) > most:
            yield i, j
            i, n = j, 0
        n += len(t)
    if i < len(texts):
        yield i, len(texts)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, so that later tasks find what earlier ones built."""
    import sys

    return sys.__dict__.setdefault("_commitscope_caches", {}).setdefault(name, {})


def _give_back() -> None:
    """Return a worker's unused memory to the system; Arrow and the C library would keep it for later."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def frugal(name: str, run):
    """``run`` for a Python worker that other operators use too: what theirs remember goes first, and unused memory is given back after each task."""

    def wrapped(*batches):
        import sys

        caches = sys.__dict__.get("_commitscope_caches", {})
        if others := [k for k in caches if not k.startswith(name)]:
            for k in others:
                del caches[k]
            _give_back()
        yield from run(*batches)
        _give_back()

    return wrapped

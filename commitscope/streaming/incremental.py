"""Incremental indexing and event windows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..indexing import Run, Settings
from ..operators.ingest import merge_commits, one_each
from ..sources.files import Store
from ..sources.parts import Manifest, Parts


def moved(refs: DataFrame, watermark: DataFrame) -> DataFrame:
    """``(name, sha, seen)``: references whose tip differs from the watermark (name, sha); an unchanged tip is no work."""
    w = watermark.withColumnsRenamed({"sha": "seen", "name": "n"})
    return refs.join(w, F.col("name") == F.col("n"), "left").where(~F.col("sha").eqNullSafe(F.col("seen"))).select("name", "sha", "seen")


def delta(commits: DataFrame, known: DataFrame) -> DataFrame:
    """Commits that the table ``known`` (sha) does not hold yet, each once."""
    return one_each(commits).join(known.select("sha"), "sha", "left_anti")


def index_stream(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Micro-batches of commits merged into generations of a Parquet table; a repeated batch gives the same generation.

    The generation of a batch is written whole before the offsets are committed, so a killed run loses nothing.
    """

    def batch(df: DataFrame, no: int) -> None:
        spark = df.sparkSession
        new = one_each(df)
        if no > 0:
            new = merge_commits(spark.read.schema(df.schema).parquet(f"{table}/generation={no - 1}"), new)
        new.write.mode("overwrite").parquet(f"{table}/generation={no}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_stream(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """As ``index_stream``, into parts: a micro-batch rewrites the quarters of the commits that it changes and no others.

    A batch's manifest is written last, so a killed batch leaves the state before it and is made again; ``merged`` reads
    the newest. Commits need ``sha`` and ``committed_at``.
    """

    def batch(df: DataFrame, no: int) -> None:
        spark, store = df.sparkSession, Store(df.sparkSession)
        parts, numbers = Parts(spark, store, f"{folder}/parts"), [n for n in _batches(store, folder) if n < no]
        before = _manifest(store, folder, numbers[-1]) if numbers else {}
        run = Run(spark, parts, before, no, Settings(), lambda _step: None)
        changed = run.changes(df)
        months = [r["part"] for r in changed.select("part").distinct().collect()]
        now = before
        if months or run.cold:
            rows = changed.drop("is_new")
            if not run.cold:
                rows = run.old("commits", months).join(changed.select("sha"), "sha", "left_anti").unionByName(rows)
            now = parts.write(before, "commits", rows, no, replaced=months)
        store.write(f"{folder}/batch={no}.json", json.dumps(now))
        parts.drop_unused([before, now])

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _batches(store: Store, folder: str) -> list[int]:
    return sorted(int(n[6:-5]) for n in store.names(folder) if n.startswith("batch=") and n.endswith(".json"))


def _manifest(store: Store, folder: str, no: int) -> Manifest:
    return json.loads(store.read(f"{folder}/batch={no}.json"))


def merged(spark: SparkSession, folder: str) -> DataFrame:
    """The commits of a ``merge_stream``, as of its last complete batch."""
    store = Store(spark)
    own = _manifest(store, folder, _batches(store, folder)[-1])
    return Parts(spark, store, f"{folder}/parts").read(own, "commits").drop("part", "version")


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Counts and sums per window and type; with ``late``, events behind the watermark by more are dropped."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 day", step: str = "6 hours", late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def distinct_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event id once. In a stream, ids are remembered for as long as the watermark leaves their events in time."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


STATE = "start timestamp, last timestamp, n long"
VISITS = "user_id long, start timestamp, last timestamp, n long"


def visits(stream: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Sessions of a user with their last event, kept in state per user and emitted once the watermark has passed their gap.

    Events of one batch are taken in order of time; an event older than the open session's last one joins that session.
    """
    span = pd.Timedelta(gap)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            yield pd.DataFrame([(key[0], *state.get)], columns=["user_id", "start", "last", "n"])
            state.remove()
            return
        closed, open_ = [], state.get if state.exists else None
        for at in pd.concat([f["ts"] for f in frames]).sort_values():
            if open_ and at - open_[1] >= span:
                closed.append((key[0], *open_))
                open_ = None
            open_ = (min(open_[0], at), max(open_[1], at), open_[2] + 1) if open_ else (at, at, 1)
        state.update(open_)
        state.setTimeoutTimestamp(max(int((open_[1] + span).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        if closed:
            yield pd.DataFrame(closed, columns=["user_id", "start", "last", "n"])

    return stream.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, VISITS, STATE, "append", GroupStateTimeout.EventTimeTimeout)

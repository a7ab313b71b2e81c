"""Stories as a stream: the fold of ``operators.stories``, kept in state per repository and carried from batch to batch."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.stories import Fold

EVENT = "repo string, at long, sha string, author string, dirs array<string>, is_tag boolean"
MEMBER = "repo string, sha string, story string, reason string"


def story_stream(events: DataFrame, window_hours: int = 24, need_author: bool = False) -> DataFrame:
    """``(repo, sha, story, reason)`` of each commit as it arrives; ``events`` as ``EVENT``: commits, and tags (``is_tag``) that end a stretch.

    Batches come in order of time, however they are cut: within one, rows are taken by time, a tag after the commits of
    its time, then by hash. A commit that comes after later ones were taken joins the open stretch by the same rule. The
    state of a repository holds the open stretch's stories and no commits; a tag empties it. Repositories are
    independent of each other.
    """
    window = int(window_hours * 3600)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = Fold(window, need_author)
        if state.exists:
            fold.load(pickle.loads(state.get[0]))
        out = []
        for r in pd.concat(frames).sort_values(["at", "is_tag", "sha"]).itertuples():
            if r.is_tag:
                fold = Fold(window, need_author)
            else:
                dirs = sorted({d for d in r.dirs if d is not None}) if r.dirs is not None else []
                out.append((key[0], r.sha, *fold.take(r.sha, int(r.at), r.author or "", dirs)))
        state.update((pickle.dumps(fold.dump()),))
        yield pd.DataFrame(out, columns=["repo", "sha", "story", "reason"])

    return events.groupBy("repo").applyInPandasWithState(step, MEMBER, "fold binary", "append", GroupStateTimeout.NoTimeout)


def events_of(commits: DataFrame, tags: DataFrame) -> DataFrame:
    """``EVENT`` rows from commits (repo, sha, committed_at, author_email, dirs) and tags (repo, tagged_at)."""
    own = commits.select("repo", F.col("committed_at").alias("at"), "sha", F.coalesce(F.lower("author_email"), F.lit("")).alias("author"), "dirs", F.lit(False).alias("is_tag"))
    mark = tags.select("repo", F.col("tagged_at").alias("at"), F.lit("").alias("sha"), F.lit("").alias("author"), F.array().cast("array<string>").alias("dirs"), F.lit(True).alias("is_tag"))
    return own.union(mark)

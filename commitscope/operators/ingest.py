"""Index-time operators: projections, references, reverts, merge and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .classify import classify, counters
from .graph import checkpointed, ways
from .reach import between, history_of, within

REVERT_WINDOW = 30 * 86400
BLOCK = 7
EXCLUDED_REFS = r"^refs/(?:stash$|notes/|keep/|replace/|pull/)"
#: Columns that a later sight of a commit does not change.
KEPT = ["author_name", "author_email", "committer_name", "committer_email", "authored_at", "committed_at", "is_revert", "reverted_by_sha"]


def topology(commits: DataFrame) -> DataFrame:
    n = F.size("parents")
    return commits.select("sha", n.cast("long").alias("parent_count"), (n >= 2).alias("is_merge"), (n == 0).alias("is_root"))


def totals(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Insertions, deletions, files and top-level directories per commit; merge commits keep zeros."""
    per = files.groupBy("sha").agg(
        F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.count(F.lit(1)).alias("file_count"), F.sort_array(F.collect_set(T.top_dir(F.col("path")))).alias("dirs")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    dirs = F.coalesce("dirs", F.array().cast("array<string>"))
    return commits.select("sha").join(per, "sha", "left").select("sha", zero("insertions"), zero("deletions"), zero("file_count"), F.array_join(dirs, ",").alias("dirs_touched"), F.size(dirs).cast("long").alias("dir_count"))


def category_counters(files: DataFrame, ecosystems=(), extra=None) -> DataFrame:
    """Each distinct path is classified once, then joined back to its changes."""
    kinds = files.select("path").distinct().withColumn("category", classify(F.col("path"), ecosystems, extra))
    return files.select("sha", "path").join(kinds, "path").groupBy("sha").agg(*counters(files))


def search_documents(commits: DataFrame, files: DataFrame, path_cap: int = 2048) -> DataFrame:
    """``sha, subject, body, expanded, paths`` as the full-text index sees them; one builder for all ways of indexing."""
    per = files.groupBy("sha").agg(F.array_sort(F.collect_list("path")).alias("p"), F.sort_array(F.collect_set(T.top_dir(F.col("path")))).alias("dirs"))
    joined = commits.select("sha", "subject", "body").join(per, "sha", "left")
    dirs = F.coalesce("dirs", F.array().cast("array<string>"))
    joined = joined.select("sha", F.coalesce("subject", F.lit("")).alias("subject"), F.coalesce("body", F.lit("")).alias("body"), dirs.alias("dirs"), F.coalesce(F.array_join("p", " "), F.lit("")).alias("paths"))
    return joined.select(
        "sha", T.strip_prefix(F.col("subject")).alias("subject"), "body", T.expanded(F.col("subject"), F.col("body"), F.col("dirs")).alias("expanded"),
        T.cut_bytes(F.col("paths"), path_cap).alias("paths"),
    )


def included_refs(refs: DataFrame) -> DataFrame:
    """References to index: excluded namespaces left out, the first kind of a name kept (branch, remote branch, tag)."""
    order = F.expr("case ref_type when 'branch' then 0 when 'remote_branch' then 1 else 2 end")
    kept = refs.where(~F.col("name").rlike(EXCLUDED_REFS))
    # only names of several kinds lose rows; a name's rows, which may be most of the table, never meet in one task
    mixed = kept.groupBy("name").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first < last").select(F.col("name").alias("of"), "first")
    return kept.join(mixed, (F.col("name") == F.col("of")) & (order > F.col("first")), "left_anti").dropDuplicates(["name", "sha"])


def tags(refs: DataFrame, commits: DataFrame) -> DataFrame:
    """Tags of indexed commits, tagged at their commit's time; whether they are annotated and their message where the source says so."""
    extra = [F.col(c) if c in refs.columns else F.lit(v).alias(c) for c, v in (("annotated", False), ("message", ""))]
    own = refs.where(F.col("name").startswith("refs/tags/")).select("name", "sha", *extra)
    return own.join(commits.select("sha", "committed_at"), "sha").select("name", "sha", F.col("committed_at").alias("tagged_at"), "annotated", "message")


def reverts(commits: DataFrame, window: int = REVERT_WINDOW) -> DataFrame:
    """``(sha, reverted_by)``: commits that a later message reverts by a hash prefix, within ``window`` seconds.

    The prefixes have at least seven digits, so seven digits are the join's key; the rest is a residual condition.
    Of several reverts the latest counts, then the larger hash.
    """
    return reverts_of(revert_marks(commits), commits, window)


def revert_marks(commits: DataFrame, *keep: str) -> DataFrame:
    """``(sha, at, prefix)`` of the commits whose message reverts another."""
    return commits.select("sha", F.col("committed_at").alias("at"), T.reverted_prefix(F.col("body")).alias("prefix"), *keep).where("prefix is not null")


def reverts_of(marks: DataFrame, commits: DataFrame, window: int = REVERT_WINDOW) -> DataFrame:
    """As ``reverts``, from the marks and the hashes and times of all commits."""
    by = marks.select(F.col("sha").alias("by"), "at", "prefix")
    target = commits.select("sha", "committed_at", F.substring("sha", 1, BLOCK).alias("block"))
    hit = by.withColumn("block", F.substring("prefix", 1, BLOCK)).join(target, "block").where(F.col("sha").startswith(F.col("prefix")) & (F.col("sha") != F.col("by")) & (F.abs(F.col("committed_at") - F.col("at")) <= window))
    return hit.groupBy("sha").agg(F.max_by("by", F.struct("at", "by")).alias("reverted_by"))


def one_each(rows: DataFrame, key: str = "sha") -> DataFrame:
    """One row a key: of several the smallest, column by column in order."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("row")).select(key, "row.*").select(*rows.columns) if rest else rows.distinct()


def merge_commits(old: DataFrame, new: DataFrame, deduplicated: bool = False) -> DataFrame:
    """Keyed upsert: new rows win, but columns in ``KEPT`` keep an old row's values; new rows are deduplicated first."""
    fresh = new if deduplicated else one_each(new)
    o, n = old.alias("o"), fresh.alias("n")
    cols = [(F.when(F.col("o.sha").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) if c in KEPT else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))).alias(c) for c in old.columns]
    return o.join(n, F.col("o.sha") == F.col("n.sha"), "full").select(*cols)


def prune(commit_refs: DataFrame, live: DataFrame) -> DataFrame:
    """References of commits whose objects still exist; the commits themselves stay."""
    return commit_refs.join(live.select("sha").distinct(), "sha", "left_semi")


def unreachable(commits: DataFrame, refs: DataFrame) -> DataFrame:
    return commits.join(refs.select("sha"), "sha", "left_anti")


def first_parent_line(commits: DataFrame) -> DataFrame:
    """``(sha, generation)``: distance to the root along first parents; a parent outside the table ends a line and counts."""
    own = checkpointed(commits.select("sha", F.get("parents", F.lit(0)).alias("up"), F.monotonically_increasing_id().alias("id")))
    ids = own.select(F.col("sha").alias("up"), F.col("id").alias("to"))
    line = ways(own.where("up is not null").select("id", "up").join(ids, "up", "left").select("id", F.coalesce("to", F.lit(-1)).alias("to")))
    return own.select("id", "sha").join(line, "id", "left").select("sha", F.coalesce("steps", F.lit(0)).alias("generation"))


#: Formerly the links that a walk on the driver might hold. Nothing is walked there any more, so no result hangs on it.
MOST_LINKS = 1_000_000


def chains(commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A whole history's places in chains along first parents, and the links between chains; see ``reach``."""
    return history_of(commits)


def reachable(places: DataFrame, links: DataFrame, sha: str) -> DataFrame:
    """``(sha)`` of all commits that ``sha`` reaches, itself included; ``places`` and ``links`` as ``chains`` gives them."""
    return within(places, links, sha)


def range_between(commits: DataFrame, a: str, b: str) -> DataFrame:
    """``(sha)`` of the commits that ``b`` reaches and ``a`` does not."""
    return between(*history_of(commits), a, b)

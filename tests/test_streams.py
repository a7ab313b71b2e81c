import random

import pytest
from pyspark.sql import functions as F

from commitscope.operators import stories as R
from commitscope.streaming.incremental import merge_stream, merged
from commitscope.streaming.stories import EVENT, events_of, story_stream


def history(seed, n=250):
    """Commits whose directories fall into sets that share nothing, and tags."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        own = rng.choice(["abc", "defg", "hij", "k"])
        dirs = sorted({rng.choice(own) for _ in range(rng.choice([0, 1, 1, 2, 3]))})
        rows.append((f"{rng.randrange(1 << 40):010x}", rng.randrange(60) * 12 * 3600, f"Dev{rng.randrange(5)}@x", dirs))
    return rows, [12 * 3600 * x for x in (9, 30, 31)]


def tables(spark, rows, tags):
    c = spark.createDataFrame([(s, at, who) for s, at, who, _d in rows], "sha string, committed_at long, author_email string").repartition(3)
    f = spark.createDataFrame([(s, f"{d}/f") for s, _at, _w, ds in rows for d in ds], "sha string, path string")
    return c, f, spark.createDataFrame([(f"refs/tags/{x}", "s", x) for x in tags], "name string, sha string, tagged_at long")


def members(df):
    return {r["sha"]: (r["story"], r["reason"]) for r in df.collect()}


@pytest.mark.parametrize("need_author", [False, True])
def test_sets_of_directories_fold_alike(spark, monkeypatch, need_author):
    for tags in (None, []):
        rows, own = history(4)
        t = tables(spark, rows, own if tags is None else tags)
        plain = members(R.members(*t, 24, need_author))
        monkeypatch.setattr(R, "LARGE", 5)
        assert members(R.members(*t, 24, need_author)) == plain and len(plain) == len(rows)
        monkeypatch.setattr(R, "LARGE", 50_000)


@pytest.mark.parametrize("cuts", [1, 2, 7])
def test_a_stream_of_stories_equals_the_fold_in_any_cut(spark, tmp_path, cuts):
    want, rows_of = {}, {}
    for repo, seed in (("one", 1), ("two", 2)):
        rows, tags = history(seed, 120)
        rows_of[repo] = (rows, tags)
        want |= {(repo, sha): m for sha, m in members(R.members(*tables(spark, rows, tags))).items()}
    c = spark.createDataFrame([(p, s, at, who, d) for p, (rows, _t) in rows_of.items() for s, at, who, d in rows], "repo string, sha string, committed_at long, author_email string, dirs array<string>")
    t = spark.createDataFrame([(p, x) for p, (_r, tags) in rows_of.items() for x in tags], "repo string, tagged_at long")
    every = sorted(events_of(c, t).collect(), key=lambda r: (r["at"], r["is_tag"], r["sha"]))
    rng = random.Random(cuts)
    ends = sorted(rng.sample(range(1, len(every)), cuts - 1)) + [len(every)]
    for i, (a, b) in enumerate(zip([0, *ends], ends)):
        part = every[a:b]
        rng.shuffle(part)
        spark.createDataFrame(part, EVENT).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:03}"))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = story_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    got = {(r["repo"], r["sha"]): (r["story"], r["reason"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want and spark.read.parquet(str(tmp_path / "out")).count() == len(want)
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("story") == F.col("sha")).count() > 0


def test_micro_batches_rewrite_what_they_touch(spark, tmp_path):
    schema, year = "sha string, author_name string, committed_at long, subject string", 365 * 86400
    src, folder = str(tmp_path / "in"), str(tmp_path / "t")
    put = lambda *rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
    go = lambda: merge_stream(spark.readStream.schema(schema).parquet(src), folder, str(tmp_path / "c")).awaitTermination()
    put(("a", "Ann", 1, "one"), ("a", "Ann", 1, "one"), ("b", "Bob", year, "two"))
    go()
    first = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t/parts").rglob("*.parquet")}
    # seen again with another time and author, which stay, and another subject; and a new commit beside it
    put(("b", "Zoe", 9 * year, "changed"), ("c", "Cy", year + 5, "three"), ("a", "Zoe", 1, "one"))
    go()
    assert sorted(map(tuple, merged(spark, folder).select("sha", "author_name", "committed_at", "subject").collect())) == [("a", "Ann", 1, "one"), ("b", "Bob", year, "changed"), ("c", "Cy", year + 5, "three")]
    left = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t/parts").rglob("*.parquet")}
    assert [p for p in first if "part=0/" in p] and all(left[p] == t for p, t in first.items() if "part=0/" in p)
    go()
    assert merged(spark, folder).count() == 3

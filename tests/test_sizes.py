"""That work grows with the history, not with its length times a logarithm or its square."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from commitscope.functions import text as T
from commitscope.operators import analytics as A
from commitscope.operators import graph
from commitscope.operators import ingest as G
from commitscope.operators import reach as C
from commitscope.operators import search as S
from commitscope.plans import catalogue
from commitscope.sources import gitlog as L


def _counted(monkeypatch) -> list[int]:
    """Rows of every intermediate table from now on."""
    rows, plain = [], graph.checkpointed

    def write(df):
        out = plain(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "checkpointed", write)
    monkeypatch.setattr(graph, "FEW", 50, raising=False)
    return rows


def test_a_long_line_is_numbered_in_proportion_to_it(spark, monkeypatch):
    n = 1600
    rows = _counted(monkeypatch)
    line = spark.createDataFrame([(f"{i:x}", [f"{i - 1:x}"] if i else []) for i in range(n)], "sha string, parents array<string>")
    assert {int(r["sha"], 16): r["generation"] for r in G.first_parent_line(line).collect()} == {i: i for i in range(n)}
    assert sum(rows) <= 8 * n  # doubled pointers: twelve tables of all commits


def test_ways_up_a_forest_equal_a_walk(spark):
    rnd = random.Random(3)
    up = {i: rnd.choice([i - 1, rnd.randrange(i)]) for i in range(1, 300) if rnd.random() < 0.97} | {500: -1, 501: 500}
    want = {}
    for i in up:
        at, steps = i, 0
        while at in up:
            at, steps = up[at], steps + 1
        want[i] = (at, steps)
    got = graph.ways(spark.createDataFrame(list(up.items()), "id long, to long"), few=20).collect()
    assert len(got) == len(want) and {r["id"]: (r["top"], r["steps"]) for r in got} == want


def test_late_second_parents_are_links(spark):
    # the second parent of c comes after c; c goes on the chain of a all the same
    rows = lambda *x: spark.createDataFrame(list(x), "sha string, parents array<string>")
    first = rows(("a", []), ("c", ["a", "b"]))
    places = graph.checkpointed(C.place(first, spark.createDataFrame([], C.CHAINS)))
    links, dangling = C.links_of(first, places)
    assert links.count() == 0 and [tuple(r) for r in dangling.collect()] == [("c", "b")]
    places = graph.checkpointed(places.union(C.place(rows(("b", [])), places)))
    late, still = C.linked(dangling, places)
    assert [tuple(r) for r in late.collect()] == [("a", 1, "b", 0)] and still.count() == 0


def test_a_range_over_many_merges_is_not_walked_on_the_driver(spark):
    up = {f"{i:03x}": [f"{i - 1:03x}"] * (i > 0) + [f"{i - 7:03x}"] * (i % 10 == 0 and i > 7) for i in range(200)}
    c = spark.createDataFrame(list(up.items()), "sha string, parents array<string>")
    assert {r["sha"] for r in G.range_between(c, f"{40:03x}", f"{190:03x}").collect()} == {f"{i:03x}" for i in range(41, 191)}
    places, links = G.chains(c)
    assert set(places.columns) == {"sha", "chain", "pos"} and links.count() == 0


def test_stored_postings_are_read_once_a_search(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def once(word):
        seen.add(1)
        return word

    docs = spark.createDataFrame([(str(i), "red fox" if i % 2 else "red hen") for i in range(20)], "sha string, text string")
    post = graph.checkpointed(S.inverted(docs, "sha", ["text"]))
    read = post.withColumn("sha", once(F.col("sha")))
    got = S.looked_up(read, "sha", S.parse("red fox"), {"text": 1.0}, 20, 40).collect()
    assert len(got) == 10 and seen.value == 30


def test_code_items_of_single_and_compound_words(spark):
    text = "Revert URGENT word fooBar foo_bar-x a1B ABc HTTPServer v2 Ünder x-"
    got = spark.range(1).select(T.code_items(F.lit(text))).first()[0]
    variants = lambda i, *v: [x for x in v if x != i.lower()] + [p for p in i.replace("_", "-").split("-") if len(p) >= 3]
    assert got == [
        "Revert", "URGENT", "word", *variants("fooBar", "fooBar", "foo_bar", "foo-bar"), *variants("foo_bar-x", "fooBarX", "foo_bar_x", "foo-bar-x"),
        *variants("a1B", "a1B", "a1_b", "a1-b"), "ABc", "HTTPServer", "nder",
    ]


def test_risk_reads_the_files_three_times(spark):
    rows = [(str(i), 1000 * i, "s", "", f"a{i % 3}@x") for i in range(9)]
    commits = spark.createDataFrame(rows, "sha string, committed_at long, subject string, body string, author_email string")
    files = graph.checkpointed(spark.createDataFrame([(str(i), f"src/{i % 4}.rs", 1, 1) for i in range(8)], "sha string, path string, insertions long, deletions long"))
    tags = spark.createDataFrame([("v1", "3", 3000)], "name string, sha string, tagged_at long")
    out = A.risk(commits, files, tags, spark.createDataFrame([("2", "5")], "sha string, reverted_by string"), 8000)
    got = {r["sha"]: r for r in out.collect()}
    assert len(got) == 9 and got["8"]["f_size"] == 0.0 and got["7"]["f_size"] == 0.05 and got["7"]["f_churn"] == 2 / 50 and got["2"]["f_revert"] == 1.0
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") <= 3


def test_a_log_is_written_and_read_in_one_go(spark):
    plan = catalogue.QUERIES["parse_log_records"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1  # the lines met their parts twice
    assert plan.count(f"concat_ws({L.FIELD}") == 1  # the check of a record computed it a second time


def test_sections_of_a_record_in_any_order(spark):
    """Sections that git would print otherwise: repeated and missing paths, as a plain walk has them; a large commit is no square."""
    rnd = random.Random(5)
    records, want = [], {}
    for k, n in enumerate([0, 1, 5, 5, 40, 20000]):
        named = [(rnd.choice("AMDR"), f"d/{rnd.randrange(n)}") for _ in range(n)]
        counted = [(rnd.randrange(9), rnd.randrange(9), f"d/{rnd.randrange(n)}") for _ in range(n)]
        files = {}
        for status, path in named:
            files.setdefault(path, [status, 0, 0])
        for i, x, path in counted:
            f = files.setdefault(path, ["M", 0, 0])
            f[1], f[2] = f[1] + i, f[2] + x
        want[str(k)] = [(p, *f) for p, f in files.items()]
        head = L.FIELD.join([str(k), "a", "a@x", "a", "a@x", "1", "1", "s", "", ""])
        records.append((head + L.END + "\n\n" + "\n".join(f"{s}\t{p}" for s, p in named) + "\n\n" + "\n".join(f"{i}\t{x}\t{p}" for i, x, p in counted),))
    got = L.parse_log(spark.createDataFrame(records, "value string")).collect()
    assert {r["sha"]: [tuple(f) for f in r["files"]] for r in got} == want


def test_references_are_counted_without_a_row_for_each(spark):
    rnd = random.Random(8)
    up = {0: []} | {i: sorted({rnd.choice([i - 1, rnd.randrange(i)]) for _ in range(rnd.choice([1, 1, 1, 2]))}, reverse=True) for i in range(1, 700)}
    commits = spark.createDataFrame([(f"{i:03x}", [f"{p:03x}" for p in ps]) for i, ps in up.items()], "sha string, parents array<string>")
    refs = spark.createDataFrame([(f"refs/tags/{i}", f"{i:03x}", "tag") for i in rnd.sample(range(700), 40)] + [("refs/heads/x", "010", "branch"), ("refs/heads/gone", "fff", "branch")], "name string, sha string, ref_type string")
    places, links = C.history_of(commits)
    tip = graph.checkpointed(C.tips(refs, places))
    steps = C.closure(links, C.roots_of(tip))
    want = {r["sha"]: r["count"] for r in C.commit_refs(places, steps, tip).groupBy("sha").count().collect()}
    got = C.ref_counts(places, steps, tip)
    assert {r["sha"]: r["refs"] for r in got.collect()} == want and got.count() == len(want)


def test_references_of_commits_are_listed_by_many_tasks(spark):
    commits = spark.createDataFrame([(f"{i:03x}", [f"{i - 1:03x}"] if i else []) for i in range(300)], "sha string, parents array<string>")
    refs = spark.createDataFrame([(f"refs/tags/{i}", f"{i:03x}", "tag") for i in range(0, 300, 10)], "name string, sha string, ref_type string")
    out = C.membership(commits, refs)
    assert out.count() == sum(i + 1 for i in range(0, 300, 10))
    assert out.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism


def test_an_intermediate_table_leaves_no_shuffle_files(spark):
    left = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    had = left()
    out = graph.checkpointed(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.monotonic() + 10
    while left() > had and time.monotonic() < until:
        time.sleep(0.1)
    assert left() <= had and out.count() == 7
    with graph.lean(spark):
        with graph.lean(spark):
            pass
        assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"


def test_risk_shuffles_paths_before_its_result_only(spark):
    commits = spark.createDataFrame([("a", 1000, "s", "", "a@x")], "sha string, committed_at long, subject string, body string, author_email string")
    files = graph.checkpointed(spark.createDataFrame([("a", "src/x.rs", 1, 1)], "sha string, path string, insertions long, deletions long"))
    tags = spark.createDataFrame([("v1", "a", 1000)], "name string, sha string, tagged_at long")
    out = A.risk(commits, files, tags, spark.createDataFrame([], "sha string, reverted_by string"), 8000)
    assert "path#" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_documents_of_a_batch_are_built_once(spark, monkeypatch):
    seen, plain = [], S.corpus
    monkeypatch.setattr(S, "corpus", lambda docs, columns: seen.append(docs) or plain(docs, columns))
    catalogue.QUERIES["search_batch"](spark, "/root/testdata/sf0.001")
    assert "l_orderkey" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()

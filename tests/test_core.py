import math
import random
import re
import sqlite3

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from commitscope.errors import EngineError
from commitscope.functions import text as T
from commitscope.operators import analytics as A
from commitscope.operators import identity as I
from commitscope.operators import ingest as G
from commitscope.operators import metrics as M
from commitscope.operators import search as S
from commitscope.operators import stories as R
from commitscope.operators.classify import classify, ecosystems_of
from commitscope.operators.ordered import as_of
from commitscope.plans import catalogue
from commitscope.plans.history import history
from commitscope.sources import gitlog as L

#: The labelled paths of the classification golden set.
GOLDEN = {
    "generated": ["api/v1/pb.pb.go", "services/auth/proto_pb.py", "dist/bundle.js", "node_modules/react/index.js", "node_modules/some-pkg/cfg.toml"],
    "migration": ["db/migrations/20240101_init.sql", "backend/alembic/versions/0001_init.py", "db/migrations/tests/20240101_seed.py"],
    "test": ["tests/integration/users.test.ts", "internal/auth/users_test.go", "spec/models/user_spec.rb"],
    "infra": ["deploy/Dockerfile", "infra/terraform/main.tf", "ops/k8s/deploy.yaml"],
    "ci": [".github/workflows/test.yml", ".circleci/config.yml"],
    "config": ["services/api/config/app.toml", "services/api/settings.ini"],
    "asset": ["ui/src/assets/logo.png"],
    "docs": ["docs/architecture.md", "README.rst"],
    "code": ["services/api/handler.coffee"],
}


def one(spark, expr, **cols):
    df = spark.createDataFrame([Row(**cols)]) if cols else spark.range(1)
    return df.select(expr.alias("v")).first()["v"]


def test_classification_golden(spark):
    rows = [(p, c) for c, ps in GOLDEN.items() for p in ps]
    got = spark.createDataFrame(rows, "path string, want string").withColumn("got", classify(F.col("path")))
    assert got.where("got <> want").collect() == []
    extra = spark.createDataFrame([("Gemfile.lock", "config"), ("x/Gemfile.lock", "code"), ("a.gemspec", "config"), ("zz.txt", "docs")], "path string, want string")
    assert extra.withColumn("got", classify(F.col("path"), ecosystems_of(["Gemfile", "x"]))).where("got <> want").collect() == []


def test_scalars(spark):
    day = 86400
    for at, now, want in [(1000, 1000, 1.0), (1000, 900, 1.0), (0, 180 * day, 0.5), (0, 360 * day, 0.25)]:
        assert one(spark, T.recency(F.lit(at), now)) == pytest.approx(want)
    for dirs, wanted, want in [(["src/foo/bar", "src/baz"], "src/foo", 1.0), (["docs", "src"], "tests", 0.5), (["docs/readme"], "src/foo", 0.0), (["src/foobar"], "src/foo", 0.0), (["."], ".", 1.0), (["src/foo"], ".", 0.0), (["src"], None, 0.0), (["src"], "", 0.0)]:
        assert one(spark, T.path_relevance(F.col("d"), wanted), d=dirs) == want, (dirs, wanted)
    for ident in ("fooBarBaz", "foo_bar_baz", "foo-bar-baz"):
        assert one(spark, T.words(F.lit(ident))) == ["foo", "bar", "baz"]
    for name in ("  Andr\u00e9   Smith  ", "ANDRE\u0301 Smith"):
        assert one(spark, T.normal_name(F.col("n")), n=name) == "andr\u00e9 smith"
    assert T.resolve_time("2026-05-01") == 1777593600 and T.resolve_time("2026-05-01", until=True) == 1777679999
    assert T.branch_ref("main") == "refs/heads/main" and T.branch_ref("refs/x") == "refs/x"
    assert T.clean_query("HELLO WORLD") == "hello world" and T.clean_query('hello"world') == 'hello""world'
    with pytest.raises(EngineError) as e:
        T.clean_query("  ")
    assert e.value.code == "invalid_query"
    body = "x\nCo-authored-by: Bob <b@x>\nco-AUTHORED-by: Bob <b@x>\nCo-authored-by: broken\nCo-authored-by: <c@x>"
    assert [tuple(c) for c in one(spark, T.coauthors(F.lit(body)))] == [("Bob", "b@x")]


def test_log_parser(spark):
    def record(sha, parents, body, diff):
        return "\x1f".join([sha, "Al", "a@x", "Al", "a@x", "10", "20", "feat: s", parents, body]) + "\x03\n\n" + diff

    logs = [record("aa11", "", "", "M\tsrc/a.rs\nA\tdocs/b.md\n\n3\t1\tsrc/a.rs\n10\t0\tdocs/b.md\n"), record("bb22", "aa11 cc33", "Co-authored-by: Bob <b@x>", ":100644 100644 a b R100\told.rs\tsrc/new.rs\n\n-\t-\tlogo.png\n4\t2\tsrc/{old.rs => new.rs}\n")]
    got = {r["sha"]: r for r in L.parse_log(spark.createDataFrame([(x,) for x in logs], "value string")).collect()}
    assert [tuple(f) for f in got["aa11"]["files"]] == [("src/a.rs", "M", 3, 1), ("docs/b.md", "A", 10, 0)]
    assert got["bb22"]["parents"] == ["aa11", "cc33"]
    assert [tuple(f) for f in got["bb22"]["files"]] == [("src/new.rs", "R", 4, 2), ("logo.png", "M", 0, 0)]
    with pytest.raises(Exception, match="malformed log record"):
        L.parse_log(spark.createDataFrame([("a\x1fb\x1fc",)], "value string")).collect()
    assert L.parse_log(spark.createDataFrame([], "value string")).count() == 0


def test_config_and_mailmap():
    c = L.load_config("[search]\ndefault_limit = 7", "[ownership]\ntop_n = 2")
    assert c["search"]["default_limit"] == 7 and c["search"]["soft_cap"] == 1000 and c["ownership"]["top_n"] == 2
    with pytest.raises(EngineError):
        L.load_config("[nope]\nx = 1")
    assert L.mailmap_rules("Ann <a@x> Old Ann <o@x>\n<b@x> <c@x> # note\n") == [("Old Ann", "o@x", "Ann", "a@x", None), (None, "c@x", None, "b@x", None)]
    assert L.override_rules('[[override]]\nname = "A"\nemail = "a@x"\ncanonical_name = "B"\ncanonical_email = "b@x"\nis_bot = true') == [("A", "a@x", "B", "b@x", True)]
    text = L.config_text("", "search.bm25.subject", "7.5")
    text = L.config_text(text, "tui.theme", "dark")
    assert L.load_config(text)["search"]["bm25"]["subject"] == 7.5 and L.config_get(L.load_config(text), "tui.theme") == "dark" and ("search.default_limit", 50) in L.config_entries(L.load_config(text))
    for key, value in (("nope.x", "1"), ("search.default_limit", "many"), ("ownership.include_bots", "1")):
        with pytest.raises(EngineError) as e:
            L.config_text(text, key, value)
        assert e.value.code == "config"


def test_bm25_equals_sqlite(spark):
    rng = random.Random(4)
    vocab = ["retry", "cache", "fix", "auth", "café", "token", "open"]
    docs = [(str(i), *(" ".join(rng.choices(vocab, k=rng.randint(0, 9))) for _ in range(4))) for i in range(40)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(sha unindexed, subject, body, expanded, paths, tokenize=\"unicode61 remove_diacritics 2\")")
    db.executemany("insert into f values (?,?,?,?,?)", docs)
    df = spark.createDataFrame(docs, "sha string, subject string, body string, expanded string, paths string")
    for q in ("retry", "cache fix", '"open cache"', "au*", "subject:token", "cafe"):
        want = dict(db.execute("select sha, bm25(f, 0, 4.0, 1.0, 1.5, 2.0) from f where f match ?", (q,)).fetchall())
        got = {r["sha"]: r["bm25"] for r in S.bm25(df, "sha", S.parse(q), S.WEIGHTS).collect()}
        assert got.keys() == want.keys(), q
        for k in want:
            assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_stored_postings_equal_sqlite(spark, tmp_path):
    rng = random.Random(14)
    vocab = ["retry", "retries", "cache", "fix", "auth", "café", "token", "open"]
    docs = [(str(i), *(" ".join(rng.choices(vocab, k=rng.randint(0, 9))) for _ in range(4))) for i in range(60)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(sha unindexed, subject, body, expanded, paths, tokenize=\"unicode61 remove_diacritics 2\")")
    db.executemany("insert into f values (?,?,?,?,?)", docs)
    df = spark.createDataFrame(docs, "sha string, subject string, body string, expanded string, paths string")
    S.write_postings(S.inverted(df, "sha", list(S.WEIGHTS)), str(tmp_path / "p"), "sha")
    post = spark.read.parquet(str(tmp_path / "p"))
    n, tokens = S.corpus(df, list(S.WEIGHTS)).first()
    for q in ("retry", "cache fix", '"open cache"', '"open ret*"', "au*", "re* token", "subject:token", 'body:"fix fix"', "cafe", "nothing"):
        want = dict(db.execute("select sha, bm25(f, 0, 4.0, 1.0, 1.5, 2.0) from f where f match ?", (q.replace('ret*"', 'ret" *'),)).fetchall())
        got = {r["sha"]: r["bm25"] for r in S.looked_up(post, "sha", S.parse(q), S.WEIGHTS, n, tokens).collect()}
        if q == '"open ret*"':  # a star within quotes is no prefix
            want = dict(db.execute("select sha, bm25(f, 0, 4.0, 1.0, 1.5, 2.0) from f where f match '\"open ret\"'").fetchall())
        assert got.keys() == want.keys(), q
        for k in want:
            assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_reverts_merge_refs(spark):
    sha = ["a" * 40, "b" * 40, "c" * 40]
    c = spark.createDataFrame([(sha[0], "x", "", 100), (sha[1], 'Revert "x"', f"This reverts commit {sha[0][:9]}.", 200), (sha[2], "again", f"this reverts commit {sha[0]}", 300)], "sha string, subject string, body string, committed_at long")
    assert [tuple(r) for r in G.reverts(c).collect()] == [(sha[0], sha[2])]
    old = spark.createDataFrame([("1", "old name", 5), ("2", "n", 6)], "sha string, author_name string, files long")
    new = spark.createDataFrame([("2", "changed", 9), ("2", "changed", 9), ("3", "n3", 1)], "sha string, author_name string, files long")
    want = [("1", "old name", 5), ("2", "n", 9), ("3", "n3", 1)]
    got = G.merge_commits(old, new)
    assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, G.merge_commits(got, new).collect())) == want
    refs = spark.createDataFrame([(n, "1", "branch") for n in ("refs/heads/a", "refs/tags/t", "refs/stash", "refs/notes/n", "refs/pull/1/head", "refs/keep/x", "refs/replace/y")], "name string, sha string, ref_type string")
    assert {r["name"] for r in G.included_refs(refs).collect()} == {"refs/heads/a", "refs/tags/t"}


def test_sha_lookup(spark):
    c = spark.createDataFrame([("abcd1234",), ("abcd5678",), ("ffff0000",)], "sha string")
    assert S.sha_lookup(c, "FFFF").first()["sha"] == "ffff0000"
    for prefix, code in (("abcd", "sha_ambiguous_prefix"), ("0000", "sha_not_found"), ("xyz!", "invalid_ref")):
        with pytest.raises(EngineError) as e:
            S.sha_lookup(c, prefix)
        assert e.value.code == code


def test_identities(spark):
    rows = [("Ann Lee", "a@x", 0), ("ann  lee", "b@x", 100), ("ann lee", "c@x", 100 + 400 * 86400), ("Ann Lee", "1+a@users.noreply.github.com", 0), ("bot[bot]", "z@x", 5)]
    c = spark.createDataFrame(rows, "author_name string, author_email string, committed_at long")
    got = {r["email"]: r["identity"] for r in I.resolve(c).collect()}
    assert got["a@x"] == got["b@x"] == "a@x" and got["c@x"] == "c@x" and got["1+a@users.noreply.github.com"].startswith("1+a")
    alias, people = I.resolved(c)
    assert {r["identity"] for r in I.report(people).collect()} == {"a@x", "c@x", "1+a@users.noreply.github.com"} and people.count() == 4 and alias.count() == 5
    assert sorted(tuple(r) for r in I.authors_of(alias, people, "B@x").collect()) == [("Ann Lee", "a@x"), ("ann  lee", "b@x")]


def test_identity_layers(spark):
    body = "Co-authored-by: Carl <carl@x>\n"
    rows = [("Ann", "ann@old", "Ann", "ann@old", 0, body), ("Ann B.", "ann@new", "CI", "ci@x", 10, ""), ("Dee", "dee@x", "Dee", "dee@x", 20, body), ("Helper", "h@x", "Helper", "h@x", 30, "")]
    c = spark.createDataFrame([("%040x" % i, *r) for i, r in enumerate(rows)], "sha string, author_name string, author_email string, committer_name string, committer_email string, committed_at long, body string")
    over = spark.createDataFrame([("Dee", "dee@x", "Ann", "ann@new", None), ("Helper", "h@x", "Helper", "h@x", True)], I.RULES)
    mail = spark.createDataFrame(L.mailmap_rules("Ann <ann@new> <ann@old>\nWrong <wrong@x> <dee@x>\n"), I.RULES)
    alias, people = I.resolved(c, over, mail, bots=["ci@x"])
    of = {(r["name"], r["email"]): r["identity"] for r in alias.collect()}
    assert of["Ann", "ann@old"] == of["Ann B.", "ann@new"] == of["Dee", "dee@x"] == "ann@new"  # an override comes before the mail map
    flags = {r["identity"]: (r["is_bot"], r["commit_count"], r["alias_count"]) for r in people.collect()}
    assert flags == {"ann@new": (False, 3, 3), "carl@x": (False, 0, 1), "ci@x": (True, 0, 1), "h@x": (True, 1, 1)}
    assert sorted((r["sha"][-1], r["identity"]) for r in I.coauthors(c, alias).collect()) == [("0", "carl@x"), ("2", "carl@x")]


def test_metrics(spark):
    v = spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40, 50)], "x double")
    assert tuple(M.nearest_ranks(v, "x", 50, 100, 0).first()) == (30.0, 50.0, 10.0)
    rng = random.Random(3)
    many = [rng.randint(-500, 500) for _ in range(3000)]
    got = M.nearest_ranks(spark.createDataFrame([(x,) for x in many], "x int"), "x", 1, 33, 95, 99.9).first()
    assert list(got) == [sorted(many)[max(math.ceil(len(many) * p / 100), 1) - 1] for p in (1, 33, 95, 99.9)]
    r = spark.createDataFrame([(["a", "b", "c"], "c")], "l array<string>, e string")
    assert tuple(r.agg(M.precision_at_k("l", F.col("e"), 2), M.precision_at_k("l", F.col("e"), 3), M.mrr("l", F.col("e"))).first()) == pytest.approx((0.0, 1.0, 1 / 3))
    assert r.where("false").agg(M.precision_at_k("l", F.col("e"), 3)).first()[0] == 0.0


def test_stories_and_tags(spark):
    h = 3600
    c = spark.createDataFrame([("a", 0, "x@x", "feat: add a"), ("b", 5 * h, "y@x", "feat: add b"), ("c", 40 * h, "z@x", "other"), ("d", 41 * h, "z@x", "fix"), ("e", 42 * h, "z@x", "")], "sha string, committed_at long, author_email string, subject string")
    f = spark.createDataFrame([(s, "src/x.py") for s in "abcde"] + [("b", "docs/y.md")], "sha string, path string")
    tags = spark.createDataFrame([("refs/tags/v1", "d", 41 * h)], "name string, sha string, tagged_at long")
    member = R.members(c, f, tags)
    assert {r["sha"]: (r["story"], r["reason"]) for r in member.collect()} == {"a": ("a", "start"), "b": ("a", "time"), "c": ("c", "start"), "d": ("c", "author+time"), "e": ("e", "start")}
    got = {r["story"]: r for r in R.stories(member, c, f).collect()}
    assert got["a"]["title"] == "add src" and got["c"]["title"] == "2 commits to src" and got["a"]["top_paths"] == ["src", "docs"] and got["a"]["authors"] == ["x@x", "y@x"]
    assert (got["a"]["first_at"], got["a"]["last_at"], got["a"]["coherence"], got["a"]["coherent"]) == (0, 5 * h, 1.0, True)
    assert {r["sha"]: r["tag_gap"] for r in A.nearest_tag(c, tags).collect()} == {"a": 41 * h, "b": 36 * h, "c": h, "d": 0, "e": h}


def _story_by_hand(rows, tags, window, need_author):
    """(sha -> story) by trying every open story for every commit; rows (sha, at, author, directories)."""
    out, open_, stretch = {}, [], None
    for sha, at, author, dirs in sorted(rows, key=lambda r: (r[1], r[0])):
        here = min((t for t in tags if t >= at), default=None)
        if here != stretch:
            open_, stretch = [], here
        fits = []
        for s in open_:
            counts = {}
            for _sha, _at, _who, ds in s["rows"]:
                for d in ds:
                    counts[d] = counts.get(d, 0) + 1
            top = sorted(counts, key=lambda d: (-counts[d], d))[:5]
            last = max(r[1] for r in s["rows"])
            same = any(r[2] == author for r in s["rows"])
            if set(dirs) & set(top) and (same or (not need_author and at - last <= window)):
                fits.append((-last, s["id"], s))
        if fits:
            s = min(fits, key=lambda x: x[:2])[2]
        else:
            s = {"id": sha, "rows": []}
            open_.append(s)
        s["rows"].append((sha, at, author, dirs))
        out[sha] = s["id"]
    return out


@pytest.mark.parametrize("need_author", [False, True])
def test_stories_equal_brute_force(spark, need_author):
    rng = random.Random(21)
    rows = []
    for i in range(400):
        dirs = sorted({rng.choice("abcdefghij") for _ in range(rng.choice([0, 1, 1, 2, 3]))})
        rows.append((f"{rng.randrange(1 << 40):010x}", rng.randrange(90) * 12 * 3600, f"dev{rng.randrange(6)}", dirs))
    tags = [12 * 3600 * x for x in (9, 30, 31, 60)]
    c = spark.createDataFrame([(s, at, who.upper() + "@x") for s, at, who, _d in rows], "sha string, committed_at long, author_email string").repartition(5)
    f = spark.createDataFrame([(s, f"{d}/f{i}") for s, _at, _w, ds in rows for d in ds for i in range(2)], "sha string, path string")
    t = spark.createDataFrame([(f"refs/tags/{x}", "s", x) for x in tags], "name string, sha string, tagged_at long")
    got = {r["sha"]: r["story"] for r in R.members(c, f, t, 24, need_author).collect()}
    assert got == _story_by_hand(rows, tags, 24 * 3600, need_author)


def test_as_of_equals_brute_force(spark):
    rng = random.Random(2)
    rows, marks = [(i, rng.randrange(5000)) for i in range(500)], [rng.randrange(800, 4000) for _ in range(40)]
    got = as_of(spark.createDataFrame(rows, "i long, at long"), "at", spark.createDataFrame([(m,) for m in marks], "m long"), "m", width=300).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["prev"] == max((m for m in marks if m <= r["at"]), default=None) and r["next"] == min((m for m in marks if m >= r["at"]), default=None)
    assert as_of(spark.createDataFrame(rows, "i long, at long"), "at", spark.createDataFrame([], "m long"), "m").where("prev is null and next is null").count() == len(rows)


def test_nearest_tag_is_linear_in_a_hot_bucket(spark):
    """All commits and tags of one month: the windows run once over them, from either end."""
    n = 150_000
    c = spark.range(n).selectExpr("cast(id as string) as sha", "id as committed_at")
    tags = spark.range(0, n, 2).selectExpr("'t' as name", "'s' as sha", "id as tagged_at")
    plan = A.nearest_tag(c, tags)._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in plan.replace(" ", "").lower()
    assert A.nearest_tag(c, tags).agg(F.sum("tag_gap")).first()[0] == n // 2


@pytest.mark.parametrize("block", [1000, 3])
def test_cochange_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(A, "PAIR_BLOCK", block)
    rng = random.Random(5)
    rows = [(str(i), f"p{p}") for i in range(60) for p in rng.sample(range(14), rng.randint(0, 12))]
    want = {}
    for i in {r[0] for r in rows}:
        own = sorted({p for s, p in rows if s == i})
        for a in own:
            for b in own:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    got = {(r["path_a"], r["path_b"]): r["together"] for r in A.cochange(spark.createDataFrame(rows + rows[:9], "sha string, path string"), 18).collect()}
    assert got == {k: n for k, n in want.items() if n >= 18} and got


def _expanded_by_hand(subject, body, dirs, cap):
    s = subject + ("\n" + body if body else "") + "".join(" " + d for d in dirs)
    for text in [subject, body, *dirs]:
        for ident in re.findall(r"[a-zA-Z][a-zA-Z0-9_-]*", text):
            if len(s.encode()) >= cap:
                break
            if len(ident) < 3:
                continue
            words = [w.lower() for w in re.split("[_-]", re.sub("([a-z0-9])([A-Z])", r"\1_\2", ident)) if w]
            forms = [words[0] + "".join(w[0].upper() + w[1:] for w in words[1:]), "_".join(words), "-".join(words)]
            for item in [v for v in forms if v != ident.lower()] + [p for p in re.split("[_-]", ident) if len(p) >= 3]:
                if len(s.encode()) + len(item) + 1 < cap:
                    s += " " + item
    return s


def test_search_documents(spark):
    rng = random.Random(6)
    words = ["fooBarBaz", "snake_case_id", "kebab-case", "HTTPServer", "x", "ab", "é", "plain", "a1B2", "日本", "__"]
    rows = []
    for i in range(120):
        subject, body = " ".join(rng.choices(words, k=rng.randint(1, 6))), " ".join(rng.choices(words, k=rng.choice([0, 3, 300, 520])))
        rows.append((f"{i:040x}", subject, body, [f"{d}/x" for d in rng.sample(["src", "my_dir", "docsApi"], rng.randint(0, 3))]))
    c = spark.createDataFrame([r[:3] for r in rows], "sha string, subject string, body string")
    f = spark.createDataFrame([(r[0], p) for r in rows for p in r[3]] + [("0" * 40, "é" * 1500)], "sha string, path string")
    got = {r["sha"]: r for r in G.search_documents(c, f).collect()}
    for sha, subject, body, paths in rows[1:]:
        assert got[sha]["expanded"] == _expanded_by_hand(subject, body, sorted({p.split("/")[0] for p in paths}), 4096)
    assert {len(got[r[0]]["expanded"].encode()) > 4000 for r in rows} == {True, False}
    cut = got["0" * 40]["paths"]
    assert cut.endswith("…") and 2046 <= len(cut[:-1].encode()) <= 2048


def test_tokens_fold_marks_as_sqlite(spark):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(t, tokenize=\"unicode61 remove_diacritics 2\")")
    db.execute("create virtual table v using fts5vocab(f, instance)")
    texts = ["Cafe\u0301s ve\u0301lo", "Café Ünïcödé", "ạ Ṫest ḿ", "snake_case a-b", "Straße ÉCOLE", "x² 12e3"]
    for t in texts:
        db.execute("insert into f values (?)", (t,))
    want = {}
    for term, doc, _col, at in db.execute("select * from v"):
        want.setdefault(doc, []).append((at, term))
    df = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", T.tokens(F.col("t")).alias("w")).collect():
        assert r["w"] == [t for _at, t in sorted(want[r["i"]])], texts[r["i"] - 1]


def test_query_parser():
    terms = S.parse('Foo "bar baz" qu* subject:fix a-b')
    assert [(t.words, t.prefix, t.column) for t in terms] == [(["foo"], False, None), (["bar", "baz"], False, None), (["qu"], True, None), (["fix"], False, "subject"), (["a", "b"], False, None)]
    with pytest.raises(EngineError):
        S.parse("!!!")


def test_glob():
    for glob, path, want in [("**/*.rs", "a/b.rs", True), ("**/*.rs", "b.rs", True), ("docs/**", "docs/a/b", True), ("docs/**", "docs", False), ("*.{a,b}", "x/y.b", True), ("a?c", "abc", True), ("[!a]b", "cb", True), ("[!a]b", "ab", False)]:
        assert bool(re.fullmatch(T.glob_regex(glob), path)) == want, glob


def test_stream_merges_batches(spark, tmp_path):
    from commitscope.streaming.incremental import index_stream

    schema = "sha string, author_name string, files long"
    src, table = str(tmp_path / "in"), str(tmp_path / "t")
    spark.createDataFrame([("1", "a", 1), ("1", "a", 1)], schema).write.parquet(src)
    index_stream(spark.readStream.schema(schema).parquet(src), table, str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([("1", "z", 2), ("2", "b", 3)], schema).write.mode("append").parquet(src)
    index_stream(spark.readStream.schema(schema).parquet(src), table, str(tmp_path / "c")).awaitTermination()
    assert sorted(map(tuple, spark.read.schema(schema).parquet(f"{table}/generation=1").collect())) == [("1", "a", 2), ("2", "b", 3)]


def test_identity_name_merge_over_the_whole_history(spark):
    sf, year = "/root/testdata/sf0.001", 365 * 86400
    rows = catalogue._renamed(history(spark, sf)).select("author_name", "author_email", "committed_at").collect()
    assert {r["author_email"].lower() for r in rows} == {r[0].lower() for r in history(spark, sf).commits.select("author_email").collect()}

    def identities(gap):
        group, last, known = {r["author_email"].lower(): r["author_email"].lower() for r in rows}, {}, set()
        for at, email, name in sorted((r["committed_at"], r["author_email"].lower(), " ".join(r["author_name"].lower().split())) for r in rows):
            if (name, email) not in known and name in last and at - last[name][0] <= gap:
                x, y = sorted((group[email], group[last[name][1]]))
                group = {e: x if g == y else g for e, g in group.items()}
            known.add((name, email))
            last[name] = (at, email)
        return group

    got = {r["email"]: r["identity"] for r in catalogue.QUERIES["identity_name_merge_365d"](spark, sf).collect()}
    assert got == identities(year)
    none, every = identities(-(10**12)), identities(10**12)
    assert len(set(every.values())) < len(set(got.values())) < len(set(none.values()))  # the gap decides


def test_reachability_has_no_depth(spark):
    sf = "/root/testdata/sf0.001"
    rows = history(spark, sf).commits.select("k", "sha", "parents").collect()
    up, of = {r["sha"]: r["parents"] for r in rows}, {r["k"]: r["sha"] for r in rows}

    def reach(start):
        seen, stack = set(), [start]
        while stack:
            at = stack.pop()
            if at in up and at not in seen:
                seen.add(at)
                stack += up[at]
        return seen

    run = lambda name: sorted(r["sha"] for r in catalogue.QUERIES[name](spark, sf).collect())
    last = of[max(of)]
    assert run("dag_reachability") == sorted(reach(of[200]))
    assert run("dag_reachability_full") == sorted(reach(last)) and len(reach(last)) > 1000
    assert run("range_commits_wide") == sorted(reach(last) - reach(of[180])) and len(reach(last) - reach(of[180])) > 1000
    assert run("range_commits_between") == sorted(reach(of[200]) - reach(of[180]))


def test_streams_drop_late_events_and_keep_visits(spark, tmp_path):
    from datetime import datetime, timedelta

    from commitscope.streaming import incremental as X

    day0 = datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    event = lambda i, hours, user=1: (i, day0 + timedelta(hours=hours), user, "view", 1.0)
    batches = [[event(1, 0), event(1, 0), event(2, 1), event(3, 30, 2)], [event(4, 100)], [event(5, 2), event(6, 101), event(7, 200)], [event(8, 400, 3)]]

    def played(name, build):
        src = str(tmp_path / name)
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
            query = build(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-c")).option("path", str(tmp_path / f"{name}-o"))
            query.trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / f"{name}-o")).collect()

    counted = {(r["start"] - day0) // timedelta(days=1): r["n"] for r in played("t", lambda s: X.tumbling(s, late="1 day"))}
    assert counted[0] == 3 and counted[1] == 1 and counted[4] == 2  # event 5 came after the watermark had passed day 0
    assert sorted(r["event_id"] for r in played("d", lambda s: X.distinct_events(s, "1 day"))) == [1, 2, 3, 4, 6, 7, 8]
    visits = sorted((r["user_id"], (r["start"] - day0) // timedelta(hours=1), (r["last"] - day0) // timedelta(hours=1), r["n"]) for r in played("v", lambda s: X.visits(s, "6 hours", "1 day")))
    assert visits[:4] == [(1, 0, 1, 3), (1, 100, 101, 2), (1, 200, 200, 1), (2, 30, 30, 1)]


def test_delta_and_moved_references(spark):
    from commitscope.streaming import incremental as X

    refs = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, sha string")
    mark = spark.createDataFrame([("a", "1"), ("b", "9"), ("gone", "4")], "name string, sha string")
    assert sorted(map(tuple, X.moved(refs, mark).collect())) == [("b", "2", "9"), ("c", "3", None)]
    commits = spark.createDataFrame([("1", "x"), ("2", "y"), ("2", "y")], "sha string, subject string")
    assert [tuple(r) for r in X.delta(commits, spark.createDataFrame([("1",)], "sha string")).collect()] == [("2", "y")]


def test_a_name_of_very_many_references_meets_in_no_one_task(spark):
    refs = spark.range(3000).selectExpr("'refs/heads/m' as name", "concat('c', id) as sha", "'branch' as ref_type")
    refs = refs.union(spark.createDataFrame([("refs/heads/m", "t", "tag"), ("refs/pull/1/head", "c1", "branch"), ("refs/tags/x", "c2", "tag"), ("refs/tags/x", "c2", "tag")], "name string, sha string, ref_type string"))
    kept = G.included_refs(refs)
    assert kept.count() == 3001 and kept.where("sha = 't'").isEmpty()
    tasks = kept.groupBy(F.spark_partition_id()).count().collect()
    assert "Window" not in kept._jdf.queryExecution().toString() and sum(r["count"] for r in tasks) == 3001


def test_pairs_travel_by_numbers_and_sweeping_commits_keep_all(spark, monkeypatch):
    monkeypatch.setattr(A, "PAIR_BLOCK", 3)
    rows = [(f"c{c}", f"p{p}") for c, paths in enumerate([range(8), range(5, 9), [1, 2], [1, 2, 2], []]) for p in paths]
    got = A.cochange(spark.createDataFrame(rows, "sha string, path string"), least=2)
    sets, want = [{p for c, p in rows if c == f"c{k}"} for k in range(4)], {}
    for s in sets:
        for a in s:
            for b in s:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    assert {tuple(r) for r in got.collect()} == {(a, b, n) for (a, b), n in want.items() if n >= 2}
    assert not re.search(r"hashpartitioning\(path_a#\d+, path_b#\d+|hashpartitioning\(path#\d+, path#\d+", got._jdf.queryExecution().toString())

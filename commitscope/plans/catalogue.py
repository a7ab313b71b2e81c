"""Registered queries over the driver's tables, each with SQL for an independent engine where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import text as T
from ..operators import analytics as A
from ..operators import identity as I
from ..operators import ingest as G
from ..operators import metrics as M
from ..operators import reach as C
from ..operators import search as S
from ..operators import stories as R
from ..operators.classify import COUNTERS as CATEGORY_COUNTERS
from ..operators.classify import classify, patterns
from ..operators.graph import checkpointed, shared_path
from ..sources import gitlog as L
from ..streaming import incremental as X
from .history import SQL as H
from .history import commits_with_files, history

#: The history's last commit time; "now" is never the wall clock.
NOW_SQL = "(select max(committed_at) from commits)"
PREFIX = "ab1"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, base: str = H):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (base + (", " if sql.lstrip().startswith("x_") else "") + sql) if base else sql
        return f

    return keep


def _now(h) -> int:
    if h.now is None:
        h.now = h.commits.agg(F.max("committed_at")).first()[0]
    return h.now


def _r(c, alias):
    return F.round(c, 6).alias(alias)


def _join(col):
    return F.array_join(col, ",")


@query("select sha, array_to_string(parents, ',') as parents, author_name, author_email, committed_at, subject, body from commits")
def scan_commits(spark, d):
    return history(spark, d).commits.select("sha", _join("parents").alias("parents"), "author_name", "author_email", "committed_at", "subject", "body")


@query("select sha, len(parents) as parent_count, len(parents) >= 2 as is_merge, len(parents) = 0 as is_root from commits")
def topology(spark, d):
    return G.topology(history(spark, d).commits)


@query("select sha, path, status, insertions, deletions from files")
def file_changes(spark, d):
    return history(spark, d).files.drop("k")


TOP = "case when strpos(path, '/') > 1 then split_part(path, '/', 1) else '.' end"
TOTALS = f"""x_t as (select sha, sum(insertions) as i, sum(deletions) as x, count(*) as n, list_sort(list(distinct {TOP})) as dirs from files group by sha),
x_totals as (select c.sha, cast(coalesce(i, 0) as bigint) as insertions, cast(coalesce(x, 0) as bigint) as deletions, cast(coalesce(n, 0) as bigint) as file_count,
  coalesce(array_to_string(dirs, ','), '') as dirs_touched, cast(coalesce(len(dirs), 0) as bigint) as dir_count from commits c left join x_t t on c.sha = t.sha)"""


@query(TOTALS + " select * from x_totals")
def commit_totals(spark, d):
    h = history(spark, d)
    return G.totals(h.commits, h.files)


def _category_sql(path="path"):
    whens = " ".join(f"when regexp_matches({path}, '{p}') then '{c}'" for c, p in patterns())
    return f"case {whens} else 'code' end"


KINDS = f"x_kinds as (select path, {_category_sql()} as category from (select distinct path from files))"


@query(KINDS + " select path, category from x_kinds")
def classify_paths(spark, d):
    return history(spark, d).files.select("path").distinct().select("path", classify(F.col("path")).alias("category"))


COUNTERS = ", ".join(f"cast(count(*) filter (category = '{c}') as bigint) as n_{c}" for c in CATEGORY_COUNTERS)


@query(KINDS + f", x_counts as (select sha, {COUNTERS} from files join x_kinds using (path) group by sha) select * from x_counts")
def category_counters(spark, d):
    return G.category_counters(history(spark, d).files)


@query(KINDS + f" select {TOP} as dir, case when count(distinct category) = 1 then min(category) end as category from x_kinds group by 1")
def classify_homogeneous(spark, d):
    kinds = history(spark, d).files.select("path").distinct().select("path", classify(F.col("path")).alias("category"))
    return kinds.groupBy(T.top_dir(F.col("path")).alias("dir")).agg(F.when(F.count_distinct("category") == 1, F.min("category")).alias("category"))


@query(r"select sha, regexp_replace(subject, '^[a-z]+(\([^)]+\))?:\s+', '') as subject from commits")
def conventional_prefix_strip(spark, d):
    return history(spark, d).commits.select("sha", T.strip_prefix(F.col("subject")).alias("subject"))


@query(r"select sha, regexp_extract(body, '^Co-authored-by: ([^<]*) <', 1) as name, regexp_extract(body, '<([^>]*)>', 1) as email from commits where body like 'Co-authored-by:%'")
def coauthor_trailers(spark, d):
    return history(spark, d).commits.select("sha", F.explode(T.coauthors(F.col("body"))).alias("c")).select("sha", "c.name", "c.email")


@query(r"""select p, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(p, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[_-]'), lambda w: lower(w)), lambda w: w <> ''), ' ') as words
from (select distinct replace(p_name, ' ', '_') || 'Of' || p_brand as p from part)""", base="")
def code_token_words(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("Of"), "p_brand").alias("p")).distinct()
    return p.select("p", F.array_join(T.words(F.col("p")), " ").alias("words"))


def _items_sql(text):
    words = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(i, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[_-]'), lambda w: lower(w)), lambda w: w <> '')"
    camel = f"{words}[1] || array_to_string(list_transform({words}[2:], lambda w: upper(w[1]) || w[2:]), '')"
    variants = f"list_filter([{camel}, array_to_string({words}, '_'), array_to_string({words}, '-')], lambda v: v <> lower(i) and v <> '')"
    parts = "list_filter(regexp_split_to_array(i, '[_-]'), lambda p: len(p) >= 3)"
    return f"flatten(list_transform(list_filter(regexp_extract_all({text}, '[a-zA-Z][a-zA-Z0-9_-]*'), lambda i: len(i) >= 3), lambda i: list_concat({variants}, {parts})))"


#: The commits' search documents. None of these texts comes near the bounds of 4096 and 2048 bytes, which unit tests cover.
DOCS = rf"""x_per as (select sha, list_sort(list(distinct {TOP})) as dirs, array_to_string(list_sort(list(path)), ' ') as paths from files group by sha),
x_in as (select sha, subject, body, coalesce(dirs, []) as dirs, coalesce(paths, '') as paths from commits left join x_per using (sha)),
x_it as (select *, list_concat({_items_sql('subject')}, {_items_sql('body')}, flatten(list_transform(dirs, lambda d: {_items_sql('d')}))) as items from x_in),
x_search as (select sha, regexp_replace(subject, '^[a-z]+(\([^)]+\))?:\s+', '') as subject, body,
  subject || case when body <> '' then chr(10) || body else '' end || array_to_string(list_transform(dirs, lambda d: ' ' || d), '') || case when len(items) > 0 then ' ' || array_to_string(items, ' ') else '' end as expanded, paths from x_it)"""


@query(DOCS + " select * from x_search")
def search_documents(spark, d):
    h = history(spark, d)
    return G.search_documents(h.commits, h.files)


REV = r"(regexp_matches(subject, '^Revert\b') or regexp_matches(body, '(?i)This reverts commit [0-9a-f]{7,64}'))"


@query(f"select sha, {REV} as is_revert from commits")
def revert_detect(spark, d):
    return history(spark, d).commits.select("sha", T.is_revert(F.col("subject"), F.col("body")).alias("is_revert"))


REVERTS = r"""x_by as (select sha as by_sha, committed_at as by_at, lower(regexp_extract(body, '(?i)This reverts commit ([0-9a-f]{7,64})', 1)) as prefix from commits where body like 'This reverts%'),
x_rev as (select t.sha, arg_max(by_sha, (by_at, by_sha)) as reverted_by from x_by join commits t on substr(t.sha, 1, 7) = substr(prefix, 1, 7) and starts_with(t.sha, prefix) and t.sha <> by_sha and abs(t.committed_at - by_at) <= 30 * 86400 group by t.sha)"""


@query(REVERTS + " select * from x_rev")
def revert_backlink(spark, d):
    return G.reverts(history(spark, d).commits)


@query("select name, ref_type, count(*) as n from refs where name not like 'refs/pull/%' group by all")
def refs_included(spark, d):
    return G.included_refs(history(spark, d).refs).groupBy("name", "ref_type").agg(F.count(F.lit(1)).alias("n"))


def _index(h):
    return S.Index(h.commits, h.files, h.refs)


def _filtered(spark, d, f):
    return S.filtered(_index(history(spark, d)), f).select("sha")


@query("select sha from commits where sha in (select sha from refs where name = 'refs/heads/f')")
def branch_filter_semi(spark, d):
    return _filtered(spark, d, S.Filters(branch="f"))


def _renamed(h):
    """Names that a few e-mails share, each for one year of its own, so that gaps between them last days or years.

    Four neighbours of a nation (``dev0`` to ``dev3`` and so on) sign as their team in the year 1992 + 3 n mod 7 of
    their number n, and with their own names in all others.
    """
    n = F.regexp_extract("author_email", r"^dev(\d+)@", 1).cast("int")
    team = F.concat(F.lit("Team "), F.floor(n / 4).cast("string"), F.lit(" "), F.regexp_extract("author_email", r"@(.*)$", 1))
    own = F.year(F.timestamp_seconds("committed_at")) == 1992 + n * 3 % 7
    return h.commits.withColumn("author_name", F.when(own, team).otherwise(F.col("author_name")))


#: The same names, the links by name within a year of the last sight, and the components of these links.
MERGED = r"""x_n as (select sha, lower(author_email) as email, author_name, committed_at as t, cast(regexp_extract(author_email, '^dev(\d+)@', 1) as integer) as n, regexp_extract(author_email, '@(.*)$', 1) as domain from commits),
x_named as (select sha, email, t, lower(trim(regexp_replace(case when year(make_timestamp(t * 1000000)) = 1992 + n * 3 % 7 then 'Team ' || n // 4 || ' ' || domain else author_name end, '\s+', ' ', 'g'))) as name from x_n),
x_seen as (select distinct name, email, t from x_named),
x_first as (select name, email, min(t) as t from x_seen group by 1, 2),
x_lag as (select name, email, t, lag(t) over w as last_at, lag(email) over w as last_email from x_seen window w as (partition by name order by t, email)),
x_link as (select email as a, last_email as b from x_lag semi join x_first using (name, email, t) where t - last_at <= 365 * 86400 and last_email <> email),
x_both as (select a, b from x_link union select b, a from x_link),
x_reach(email, other) as (select distinct email, email from x_seen union select r.email, b from x_reach r join x_both on a = r.other),
x_identity as (select email, min(other) as identity from x_reach group by email)"""


@query(MERGED + " select sha from x_named where email in (select email from x_identity where identity = (select identity from x_identity where email = 'dev9@nation_17.example'))")
def author_filter_semi(spark, d):
    """The commits of a person under all of the person's e-mails."""
    h = history(spark, d)
    h.commits = _renamed(h)
    index = _index(h)
    index.aliases, index.identities = I.resolved(h.commits)
    return S.filtered(index, S.Filters(author="Dev9@Nation_17.example")).select("sha")


@query("select sha from commits where sha in (select sha from files where starts_with(lower(path), 'src/net'))")
def path_prefix_filter(spark, d):
    return _filtered(spark, d, S.Filters(path="SRC/net"))


@query("select sha from commits where committed_at between 820454400 and 852076799")
def since_until_filter(spark, d):
    return _filtered(spark, d, S.Filters(since=T.resolve_time("1996-01-01"), until=T.resolve_time("1996-12-31", until=True)))


@query(f"select sha, subject from commits where starts_with(sha, '{PREFIX}')")
def sha_prefix_lookup(spark, d):
    return history(spark, d).commits.where(F.col("sha").startswith(PREFIX)).select("sha", "subject")


@query("select substr(sha, 1, 4) as prefix, count(*) as n from commits group by 1 having count(*) > 1")
def ambiguous_prefixes(spark, d):
    return history(spark, d).commits.groupBy(F.substring("sha", 1, 4).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("select sha from commits where sha not in (select sha from refs where name not like 'refs/pull/%')")
def unreachable_commits_anti(spark, d):
    h = history(spark, d)
    return G.unreachable(h.commits, G.included_refs(h.refs)).select("sha")


@query("x_e as (select sha, unnest(parents) as parent from commits), x_r(sha) as (select sha1('commit:200') union select parent from x_r join x_e using (sha)) select sha from x_r")
def dag_reachability(spark, d):
    """All ancestors of one commit, at any depth."""
    c = history(spark, d).commits
    return G.reachable(*G.chains(c), c.sparkSession.range(1).select(F.sha1(F.lit("commit:200"))).first()[0])


@query("select sha, k as generation from commits")
def first_parent_generation(spark, d):
    return G.first_parent_line(history(spark, d).commits)


REACH = "x_e as (select sha, unnest(parents) as parent from commits), x_a(sha) as (select sha1('commit:180') union select parent from x_a join x_e using (sha)), x_b(sha) as (select sha1('commit:200') union select parent from x_b join x_e using (sha))"


@query(REACH + " select sha from x_b where sha not in (select sha from x_a)")
def range_commits_between(spark, d):
    c = history(spark, d).commits
    a, b = c.sparkSession.range(1).select(F.sha1(F.lit("commit:180")), F.sha1(F.lit("commit:200"))).first()
    return G.range_between(c, a, b)


def _ends(c) -> tuple[str, str]:
    """An old commit and the newest one, whatever the scale."""
    return c.sparkSession.range(1).select(F.sha1(F.lit("commit:180"))).first()[0], c.agg(F.max_by("sha", "k")).first()[0]


@query("select sha from commits")
def dag_reachability_full(spark, d):
    """All ancestors of the newest commit. Each commit's first parent is the one before it, which is what the SQL says; a recursive query would walk one level a commit."""
    c = history(spark, d).commits
    return G.reachable(*G.chains(c), _ends(c)[1])


@query("select sha from commits where k > 180")
def range_commits_wide(spark, d):
    """``A..B`` over almost the whole history."""
    c = history(spark, d).commits
    return G.range_between(c, *_ends(c))


TIPS = """x_tips as (select max(k) as k, 'refs/heads/' || lower(state) as name, 'branch' as ref_type from commits group by state
  union all select k, 'refs/tags/t' || k, 'tag' from commits where k % 5000 = 0)"""


@query(TIPS + " select c.sha, t.name, t.ref_type from commits c join x_tips t on c.k <= t.k")
def commit_refs_membership(spark, d):
    """Every reference that reaches a commit: three branches and some tags. Each commit reaches all before it, which is what the SQL says."""
    h = history(spark, d)
    state = h.refs.where("ref_type = 'branch'").join(spark.read.parquet(f"{d}/orders.parquet").select(F.sha1(F.concat(F.lit("commit:"), F.col("o_orderkey").cast("string"))).alias("sha"), "o_orderkey", "o_orderstatus"), "sha", "right")
    tips = state.groupBy(F.lower("o_orderstatus").alias("s")).agg(F.max_by("sha", "o_orderkey").alias("sha")).select(F.concat(F.lit("refs/heads/"), F.col("s")).alias("name"), "sha", F.lit("branch").alias("ref_type"))
    tips = tips.union(h.commits.where("k % 5000 = 0").select(F.concat(F.lit("refs/tags/t"), F.col("k").cast("string")), "sha", F.lit("tag")))
    return C.membership(h.commits, tips)


ALIAS = r"""x_alias as (select author_name, author_email, count(*) as commits, min(committed_at) as first_at, max(committed_at) as last_at,
  lower(author_email) like '%[bot]@users.noreply.github.com' or trim(author_name) like '%[bot]' as is_bot from commits group by 1, 2)"""


@query(ALIAS + " select * from x_alias")
def bot_detection(spark, d):
    return I.aliases(history(spark, d).commits)


@query(ALIAS + " select lower(author_email) as email, count(*) as aliases, cast(sum(commits) as bigint) as commits, bool_or(is_bot) as is_bot from x_alias group by 1")
def identity_email_merge(spark, d):
    return I.email_clusters(I.aliases(history(spark, d).commits))


@query(MERGED + " select email, identity from x_identity")
def identity_name_merge_365d(spark, d):
    return I.resolve(_renamed(history(spark, d)))


@query(r"""x_who as (select author_name as name, author_email as email, true as own, committed_at as t from commits
  union all select regexp_extract(body, '^Co-authored-by: ([^<]*) <', 1), regexp_extract(body, '<([^>]*)>', 1), false, committed_at from commits where body like 'Co-authored-by:%'),
x_alias as (select name, email, count(*) filter (own) as commits, min(t) as first_at, max(t) as last_at, trim(name) like '%[bot]' as is_bot from x_who group by 1, 2)
select lower(email) as identity, arg_max(name, (commits, last_at, email, name)) as canonical_name, arg_max(email, (commits, last_at, email, name)) as canonical_email, bool_or(is_bot) as is_bot, count(*) as alias_count,
  cast(sum(commits) as bigint) as commit_count, min(first_at) as first_seen_at, max(last_at) as last_seen_at from x_alias group by 1 having not bool_or(is_bot)""")
def identities_report(spark, d):
    """No two e-mails of these share a name, so an identity is an e-mail; ``identity_name_merge_365d`` has the links."""
    return I.report(I.resolved(history(spark, d).commits)[1])


FOLD = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')"
POST = f"x_docs as (select doc_id, {FOLD} as toks from documents where text is not null), x_post as (select doc_id, unnest(toks) as term from x_docs), x_len as (select doc_id, cast(len(toks) as bigint) as d from x_docs), x_stat as (select count(*) as n, avg(d) as a from x_len)"


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").where("text is not null")


@query("with " + POST + " select doc_id, d as n_tokens, len(list_distinct(toks)) as n_terms from x_docs join x_len using (doc_id)", base="")
def tokenise_documents(spark, d):
    t = _docs(spark, d).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


@query("with " + POST + " select term, count(distinct doc_id) as df, count(*) as cf from x_post group by term", base="")
def postings_df_stats(spark, d):
    per = S.postings(_docs(spark, d), "doc_id", ["text"]).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    return per.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _bm25_sql(words):
    parts = " union all ".join(f"select {i} as i, doc_id, count(*) as f from x_post where term = '{w}' group by doc_id" for i, w in enumerate(words))
    return f"""with {POST}, x_f as ({parts}), x_df as (select i, count(*) as df from x_f group by i),
x_idf as (select i, case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end as idf from x_df, x_stat)
select doc_id, round(-sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / a))), 6) as bm25 from x_f join x_idf using (i) join x_len using (doc_id), x_stat group by doc_id having count(*) = {len(words)}"""


def _bm25(spark, d, text):
    return S.bm25(_docs(spark, d), "doc_id", S.parse(text), {"text": 1.0}).select("doc_id", _r("bm25", "bm25"))


@query(_bm25_sql(["ention"]), base="")
def bm25_single_term(spark, d):
    return _bm25(spark, d, "ention")


@query(_bm25_sql(["the", "and", "worthless"]), base="")
def bm25_multi_term(spark, d):
    return _bm25(spark, d, "the and worthless")


@query("with " + POST + ", x_pos as (select doc_id, unnest(toks) as term, generate_subscripts(toks, 1) as pos from x_docs) select a.doc_id, count(*) as n from x_pos a join x_pos b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.term = 'of' and b.term = 'the' group by 1", base="")
def phrase_match(spark, d):
    post = S.postings(_docs(spark, d), "doc_id", ["text"])
    return S.matches(post, "doc_id", S.parse('"of the"')[0]).select("doc_id", F.col("tf").alias("n"))


@query("with " + POST + " select doc_id, count(*) as n from x_post where starts_with(term, 'worth') group by 1", base="")
def prefix_match(spark, d):
    return S.matches(S.postings(_docs(spark, d), "doc_id", ["text"]), "doc_id", S.parse("worth*")[0]).select("doc_id", F.col("tf").alias("n"))


@query("with " + POST + """, x_hit as (select item_id, unnest(list_distinct(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+'))) as term from benchmark),
x_df as (select term, count(distinct doc_id) as df from x_post group by term), x_rare as (select item_id, term, df from x_hit join x_df using (term)),
x_top as (select item_id, term, df, row_number() over (partition by item_id order by df, term) as r from x_rare)
select item_id, term, df from x_top where r <= 3""", base="")
def rarest_terms(spark, d):
    df = postings_df_stats(spark, d).select("term", "df")
    terms = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    return terms.join(df, "term").withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy("df", "term"))).where("r <= 3").select("item_id", "term", "df")


@query(f"select sha, round(pow(0.5, greatest({NOW_SQL} - committed_at, 0) / (180 * 86400.0)), 6) as recency from commits")
def recency_decay(spark, d):
    h = history(spark, d)
    return h.commits.select("sha", _r(T.recency(F.col("committed_at"), _now(h)), "recency"))


FULL = "case when strpos(path, '/') > 1 then regexp_replace(path, '/[^/]*$', '') else '.' end"


@query(f"select sha, max(case when d = 'src' or starts_with(d, 'src/') then 1.0::double when strpos(d, '/') = 0 and d <> '.' then 0.5 else 0.0 end) as relevance from (select sha, {FULL} as d from files) group by sha")
def path_relevance(spark, d):
    per = history(spark, d).files.groupBy("sha").agg(F.collect_set(T.full_dir(F.col("path"))).alias("dirs"))
    return per.select("sha", T.path_relevance(F.col("dirs"), "src").alias("relevance"))


def _commit_docs(h):
    return G.search_documents(h.commits, h.files)


def _search(spark, d, q):
    h = history(spark, d)
    out = S.search(_commit_docs(h), _index(h), q, _now(h))
    return out.select("sha", *[_r(c, c) for c in ("lexical", "path_relevance", "recency", "score")], "total_available")


def _weighted_sql(words):
    """Scores of the commits that hold all words, over the four weighted columns."""
    toks = ", ".join(f"regexp_extract_all(strip_accents(lower({c})), '[\\p{{L}}\\p{{N}}]+') as t_{c}" for c in S.WEIGHTS)
    freq = ", ".join(" + ".join(f"{w} * len(list_filter(t_{c}, lambda x: x = '{word}'))" for c, w in S.WEIGHTS.items()) + f" as f{i}" for i, word in enumerate(words))
    size = " + ".join(f"len(t_{c})" for c in S.WEIGHTS)
    idf = ", ".join(f"greatest(case when ln((count(*) - count(*) filter (f{i} > 0) + 0.5) / (count(*) filter (f{i} > 0) + 0.5)) <= 0 then 1e-6 else ln((count(*) - count(*) filter (f{i} > 0) + 0.5) / (count(*) filter (f{i} > 0) + 0.5)) end, 1e-6) as i{i}" for i in range(len(words)))
    score = " + ".join(f"i{i} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * d / a))" for i in range(len(words)))
    return f"""{DOCS}, x_toks as (select sha, {toks} from x_search), x_freq as (select sha, {size} as d, {freq} from x_toks),
x_stat as (select avg(d) as a, {idf} from x_freq), x_bm25 as (select sha, -({score}) as bm25 from x_freq, x_stat where {' and '.join(f'f{i} > 0' for i in range(len(words)))})"""


def _ranked_sql(words, where, prefix, limit):
    near = f"case when d = '{prefix}' or starts_with(d, '{prefix}/') then 1.0 when strpos(d, '/') = 0 and d <> '.' then 0.5 else 0.0 end"
    return f"""{_weighted_sql(words)}, x_near as (select sha, max({near}) as path_relevance from (select sha, {FULL} as d from files) group by sha),
x_hit as (select c.sha, committed_at, 1 / (1 + abs(bm25)) as lexical, coalesce(path_relevance, 0.0) as path_relevance, pow(0.5, greatest({NOW_SQL} - committed_at, 0) / (180 * 86400.0)) as recency
  from commits c join x_bm25 using (sha) left join x_near using (sha) where {where}),
x_ranked as (select *, 0.50 * lexical + 0.30 * path_relevance + 0.20 * recency as score, count(*) over () as total_available from x_hit)
select sha, round(lexical, 6) as lexical, round(cast(path_relevance as double), 6) as path_relevance, round(recency, 6) as recency, round(score, 6) as score, total_available from x_ranked order by x_ranked.score desc, committed_at desc, sha limit {limit}"""


IN_SRC = "c.sha in (select sha from files where starts_with(lower(path), 'src'))"


@query(_weighted_sql(["urgent", "feat"]) + " select sha, round(bm25, 6) as bm25 from x_bm25")
def bm25_weighted_fields(spark, d):
    h = history(spark, d)
    return S.bm25(_commit_docs(h), "sha", S.parse("urgent feat"), S.WEIGHTS).select("sha", _r("bm25", "bm25"))


@query(_weighted_sql(["urgent", "feat"]) + " select sha, round(bm25, 6) as bm25 from x_bm25")
def bm25_stored_postings(spark, d):
    """The same scores from the inverted index that an engine stores."""
    h = history(spark, d)
    docs, columns = checkpointed(_commit_docs(h)), list(S.WEIGHTS)
    n, tokens = S.corpus(docs, columns).first()
    return S.looked_up(S.inverted(docs, "sha", columns), "sha", S.parse("urgent feat"), S.WEIGHTS, n, tokens).select("sha", _r("bm25", "bm25"))


BATCH = ["urgent feat", "high", "low docs src"]


def _batch_sql():
    """One set of scores a query, over the same documents."""
    each = [_weighted_sql(q.split()).removeprefix(DOCS + ", ") for q in BATCH]
    for i, sql in enumerate(each):
        for name in ("x_toks", "x_freq", "x_stat", "x_bm25"):
            sql = sql.replace(name, f"{name}{i}")
        each[i] = sql
    ranked = " union all ".join(f"select {i} as query, sha, bm25 from x_bm25{i}" for i in range(len(BATCH)))
    return f"""{DOCS}, {", ".join(each)}, x_all as ({ranked}), x_scored as (
  select query, c.sha, committed_at, 0.50 / (1 + abs(bm25)) + 0.20 * pow(0.5, greatest({NOW_SQL} - committed_at, 0) / (180 * 86400.0)) as score, count(*) over (partition by query) as total_available from x_all join commits c using (sha))
select query, rank, sha, round(score, 6) as score, total_available from (select *, row_number() over (partition by query order by score desc, committed_at desc, sha) as rank from x_scored) where rank <= 40"""


@query(_batch_sql())
def search_batch(spark, d):
    """Many searches over stored postings in one job, each one's best hits."""
    h = history(spark, d)
    docs, columns = checkpointed(_commit_docs(h)), list(S.WEIGHTS)
    n, tokens = S.corpus(docs, columns).first()
    scored = checkpointed(S.looked_up_many(S.inverted(docs, "sha", columns), "sha", {i: S.parse(q) for i, q in enumerate(BATCH)}, S.WEIGHTS, n, tokens))
    return S.ranked_many(scored, _index(h), S.Query("", S.Filters(), 40), _now(h)).select("query", F.col("rank").cast("long").alias("rank"), "sha", _r("score", "score"), "total_available")


@query(_ranked_sql(["urgent"], IN_SRC, "src", 50))
def blended_search_topk(spark, d):
    return _search(spark, d, S.Query("urgent", S.Filters(path="src"), 50))


@query(_ranked_sql(["high"], IN_SRC + " and committed_at >= 820454400 and c.sha in (select sha from refs where name = 'refs/heads/o')", "src", 100))
def search_with_all_filters(spark, d):
    return _search(spark, d, S.Query("high", S.Filters(path="src", since=T.resolve_time("1996-01-01"), branch="o"), 100))


@query(_weighted_sql(["low"]) + " select count(*) as total_available from x_bm25")
def search_total_available(spark, d):
    """The number of hits before the limit, which is 1 here."""
    return _search(spark, d, S.Query("low", S.Filters(), 1)).select("total_available")


@query("with " + POST + r""", x_f as (select doc_id, count(*) as f from x_post where term = 'ention' group by doc_id), x_idf as (select greatest(ln((max(n) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) as idf from x_f, x_stat),
x_lex as (select doc_id as id, 1 / (1 + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / a))) as lexical, case when source = 'src1' then 1.0 else 0.0 end as path_relevance, pow(0.5, doc_id / 180.0) as recency
  from x_f join x_len using (doc_id) join documents using (doc_id), x_idf, x_stat),
x_q as (select embedding as e from embeddings where vec_id = 0),
x_sem as (select vec_id as id, greatest(list_cosine_similarity(list_transform(embedding, lambda x: x::double), list_transform(e, lambda x: x::double)), 0) as semantic from embeddings, x_q)
select id, round(0.50 * coalesce(semantic, 0) + 0.20 * coalesce(lexical, 0) + 0.15 * coalesce(path_relevance, 0) + 0.15 * coalesce(recency, 0), 6) as score from x_lex full join x_sem using (id)""", base="")
def hybrid_blend(spark, d):
    """Documents by words and by the embedding of their number, blended."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    lex = S.bm25(docs.where("text is not null"), "doc_id", S.parse("ention"), {"text": 1.0}).join(docs.select("doc_id", "source"), "doc_id")
    lex = lex.select(F.col("doc_id").alias("id"), S.lexical_factor(F.col("bm25")).alias("lexical"), F.when(F.col("source") == "src1", 1.0).otherwise(0.0).alias("path_relevance"), F.pow(F.lit(0.5), F.col("doc_id") / 180.0).alias("recency"))
    near = _cosine(spark, d).select(F.col("vec_id").alias("id"), F.greatest("cosine", F.lit(0.0)).alias("semantic"))
    return S.hybrid(lex, near, "id").select("id", _r("score", "score"))


@query("x_r as (select sha from commits where k > 180) select (select count(*) from x_r) as commits, (select count(distinct author_email) from commits where k > 180) as authors, (select count(distinct path) from files where k > 180) as files, (select cast(sum(insertions) as bigint) from files where k > 180) as insertions, (select cast(sum(deletions) as bigint) from files where k > 180) as deletions")
def between_summary(spark, d):
    """Totals of ``A..B`` over the history's graph."""
    h = history(spark, d)
    return A.between(h.commits, h.files, G.range_between(h.commits, *_ends(h.commits)))


STATS = f"x_stats as (select path, count(*) as commit_count, count(distinct author_email) as unique_authors, cast(count(*) filter ({REV}) as bigint) as revert_count, max(committed_at) as last_touched from files join commits using (sha) where committed_at > {NOW_SQL} - 90 * 86400 group by path)"


@query(STATS + " select * from x_stats")
def path_stats_90d(spark, d):
    h = history(spark, d)
    return A.path_stats(h.commits, h.files, _now(h))


@query(STATS + " select path, commit_count, unique_authors, revert_count, last_touched from x_stats order by commit_count desc, path limit 20")
def hotspots_top20(spark, d):
    return path_stats_90d(spark, d).orderBy(F.desc("commit_count"), "path").limit(20)


@query("select a.path as path_a, b.path as path_b, count(*) as together from files a join files b on a.sha = b.sha and a.path < b.path group by 1, 2 having count(*) >= 2")
def cochange_pairs(spark, d):
    return A.cochange(history(spark, d).files, least=2)


@query(f"""x_w as (select sha, lower(author_email) as owner, pow(0.5, ({NOW_SQL} - committed_at) / (365 * 86400.0)) as w from commits where author_name not like '%[bot]'
  union all select sha, lower(regexp_extract(body, '<([^>]*)>', 1)), 0.5 * pow(0.5, ({NOW_SQL} - committed_at) / (365 * 86400.0)) from commits where body like 'Co-authored-by:%'),
x_s as (select dir, owner, sum(w) as weight from x_w join (select distinct sha, {TOP} as dir from files) using (sha) group by 1, 2),
x_r as (select *, row_number() over (partition by dir order by round(weight, 9) desc, owner) as rank from x_s) select dir, owner, round(weight, 6) as weight, rank from x_r where rank <= 5""")
def ownership_top5(spark, d):
    h = history(spark, d)
    return A.ownership(h.commits, h.files, _now(h)).select("dir", "owner", _r("weight", "weight"), "rank")


TAGS = "x_tags as (select distinct committed_at as tag_at from refs join commits using (sha) where name like 'refs/tags/%')"
GAP = TAGS + """, x_times as (select distinct committed_at as c from commits), x_prev as (select c, max(tag_at) as p from x_times left join x_tags on tag_at <= c group by c), x_next as (select c, min(tag_at) as q from x_times left join x_tags on tag_at >= c group by c),
x_gap as (select sha, least(committed_at - p, q - committed_at) as tag_gap from commits join x_prev a on a.c = committed_at join x_next b on b.c = committed_at)"""


@query(GAP + " select * from x_gap")
def nearest_tag(spark, d):
    h = history(spark, d)
    return A.nearest_tag(h.commits, G.tags(h.refs, h.commits))


RISK = f"""{TOTALS}, {KINDS}, x_counts as (select sha, {COUNTERS} from files join x_kinds using (path) group by sha), {STATS}, {REVERTS}, {GAP},
x_churn as (select sha, max(commit_count) as churn from files join x_stats using (path) group by sha),
x_fac as (select c.sha, c.k, least(file_count / 20.0, 1) as f_size, least(dir_count / 5.0, 1) as f_spread, case when coalesce(n_infra, 0) + coalesce(n_ci, 0) + coalesce(n_config, 0) > 0 then 1.0 else 0.0 end as f_sensitive,
  case when coalesce(n_code, 0) = 0 then 0.0 else 1 - least(coalesce(n_test, 0) / cast(greatest(n_code, 1) as double), 1) end as f_untested, least(coalesce(churn, 0) / 50.0, 1) as f_churn,
  case when {REV} or reverted_by is not null then 1.0 else 0.0 end as f_revert, coalesce(greatest(0, 1 - tag_gap / (7.0 * 86400)), 0) as f_release
  from commits c join x_totals using (sha) left join x_counts using (sha) left join x_churn using (sha) left join x_rev using (sha) left join x_gap using (sha)),
x_risk as (select *, round(least(0.20 * f_size + 0.15 * f_spread + 0.20 * f_sensitive + 0.15 * f_untested + 0.15 * f_churn + 0.10 * f_revert + 0.05 * f_release, 1), 6) as risk_score from x_fac)"""
LABEL = "case when risk_score < 0.34 then 'low' when risk_score < 0.67 then 'medium' else 'high' end as risk_label"


def _risk(spark, d, only=None):
    h = history(spark, d)
    # the factors read both tables many times, each time other columns: they are joined from the driver's tables once
    h.commits, h.files = checkpointed(h.commits.drop("parents", "author_name")), checkpointed(h.files.select("sha", "path", "insertions", "deletions"))
    return A.risk(h.commits, h.files, G.tags(h.refs, h.commits), G.reverts(h.commits), _now(h), only=only(h) if only else None)


@query(RISK + f" select sha, risk_score, {LABEL} from x_risk")
def risk_scores(spark, d):
    return _risk(spark, d).select("sha", "risk_score", "risk_label")


@query(RISK + " select sha, " + ", ".join(f"round(cast(f_{k} as double), 6) as f_{k}" for k in A.RISK) + " from x_risk")
def risk_factors(spark, d):
    return _risk(spark, d).select("sha", *[_r(f"f_{k}", f"f_{k}") for k in A.RISK])


@query(RISK + f" select sha, risk_score, {LABEL} from x_risk order by x_risk.risk_score desc, sha limit 50")
def risk_ranked(spark, d):
    return _risk(spark, d).select("sha", "risk_score", "risk_label").orderBy(F.desc("risk_score"), "sha").limit(50)


@query(RISK + f" select sha, risk_score, {LABEL}, round(f_churn, 6) as f_churn from x_risk where k = 97")
def explain_commit(spark, d):
    """One commit's risk, for which only what shares its paths is read."""
    return _risk(spark, d, lambda h: h.commits.where("k = 97").select("sha")).select("sha", "risk_score", "risk_label", _r("f_churn", "f_churn"))


def _stories(spark, d):
    h = history(spark, d)
    return h, R.members(h.commits, h.files, G.tags(h.refs, h.commits))


@query()
def story_members(spark, d):
    """The rule is a fold over commits in order, which SQL does not say; a plain fold in the tests gives the same."""
    return _stories(spark, d)[1]


@query()
def story_titles(spark, d):
    h, member = _stories(spark, d)
    return R.stories(member, h.commits, h.files).select("story", "title", "first_at", "last_at", "commit_count", "author_count", F.array_join("top_paths", ",").alias("top_paths"), _r("coherence", "coherence"), "coherent")


@query(rf"""x_m as (select sha, committed_at, author_email, subject, sha1('commit:' || (k - k % 7)) as story from commits),
x_w as (select *, regexp_split_to_array(regexp_replace(subject, '^[a-z]+(\([^)]+\))?:\s+', ''), '\s+') as words from x_m),
x_base as (select story, count(*) as commit_count, count(distinct lower(author_email)) as author_count, min(committed_at) as first_at, max(committed_at) as last_at, min(words) as lo, max(words) as hi from x_w group by story),
x_len as (select *, least(len(lo), len(hi)) as most, coalesce(nullif(list_position(list_transform(generate_series(1, least(len(lo), len(hi))), lambda i: lo[i] = hi[i]), false), 0) - 1, least(len(lo), len(hi))) as n from x_base),
x_d as (select distinct sha, {TOP} as dir from files), x_touch as (select story, sha, dir from x_m join x_d using (sha)),
x_top as (select story, list(dir order by n desc, dir)[1:5] as top from (select story, dir, count(*) as n from x_touch group by 1, 2) group by story),
x_share as (select story, avg(share) as coherence from (select story, sha, avg(cast(list_contains(top, dir) as double)) as share from x_touch join x_top using (story) group by 1, 2) group by story)
select story, case when n > 0 then array_to_string(lo[1:n], ' ') || ' ' || coalesce(top[1], '.') else commit_count || ' commits to ' || coalesce(top[1], '.') end as title, first_at, last_at, commit_count, author_count,
  coalesce(array_to_string(top, ','), '') as top_paths, round(coalesce(coherence, 1.0), 6) as coherence, coalesce(coherence, 1.0) >= 0.5 as coherent
from x_len left join x_top using (story) left join x_share using (story)""")
def story_titles_of_sevens(spark, d):
    """Titles, paths and coherence of stories whose members a plain rule gives: seven commits in a row."""
    h = history(spark, d)
    member = h.commits.select("sha", F.sha1(F.concat(F.lit("commit:"), (F.col("k") - F.col("k") % 7).cast("string"))).alias("story"))
    return R.stories(member, h.commits, h.files).select("story", "title", "first_at", "last_at", "commit_count", "author_count", F.array_join("top_paths", ",").alias("top_paths"), _r("coherence", "coherence"), "coherent")


@query("select sha, subject from commits")
def dedup_commits(spark, d):
    c = history(spark, d).commits.select("sha", "subject")
    return G.one_each(c.union(c))


@query("select sha, case when k % 2 = 0 then 'new ' || subject else subject end as subject, case when k % 2 = 0 and k % 3 = 0 then 'new' else author_name end as author_name from commits")
def upsert_merge(spark, d):
    """Commits seen again with another subject and author: the subject changes, the author of a known commit stays."""
    c = history(spark, d).commits.select("k", "sha", "subject", "author_name")
    old = c.where("k % 3 <> 0").drop("k")
    new = c.where("k % 2 = 0").select("sha", F.concat(F.lit("new "), "subject").alias("subject"), F.lit("new").alias("author_name"))
    return G.merge_commits(old.union(c.where("k % 3 = 0 and k % 2 <> 0").drop("k")), new.union(new))


@query(REVERTS + ", " + KINDS + f""", x_counts as (select sha, {COUNTERS} from files join x_kinds using (path) group by sha),
x_tips as (select max(k) as k from commits union all select k from commits where k % 5000 = 0), x_who as (select lower(author_email) as email, count(*) as n from commits group by 1)
select sha, subject, coalesce(n_code, 0) as n_code, coalesce(n_test, 0) as n_test, reverted_by, (select count(*) from x_tips t where t.k >= c.k) as refs, x_who.n as author_commits
from commits c left join x_rev using (sha) left join x_counts using (sha) join x_who on email = lower(author_email)""")
def incremental_equals_cold(spark, d):
    """An index of the first nine tenths of the history, then a delta: its tables are those of the whole history, which is what the SQL reads."""
    h = history(spark, d)
    files = h.files.groupBy("sha").agg(F.collect_list(F.struct("path", "status", "insertions", "deletions")).alias("files"))
    commits = h.commits.join(files, "sha", "left").withColumn("files", F.coalesce("files", F.array().cast(files.schema["files"].dataType)))
    last = h.commits.agg(F.max("k")).first()[0]
    first = last * 9 // 10
    e = Engine(spark, shared_path(spark, "engines"))
    tips = lambda upto: h.commits.where((F.col("k") <= upto) & ((F.col("k") % 5000 == 0) | (F.col("k") == upto))).select(
        F.explode(F.expr(f"array_compact(array(if(k % 5000 = 0, concat('refs/tags/t', k), null), if(k = {upto}, 'refs/heads/main', null)))")).alias("name"), "sha"
    ).withColumn("ref_type", F.when(F.col("name") == "refs/heads/main", "branch").otherwise("tag"))
    # the delta also brings back commits that are known already
    for low, high in ((-1, first), (first - 100, last)):
        e.index(commits.where((F.col("k") > low) & (F.col("k") <= high)).drop("k"), tips(high))
    refs = e.ref_counts()
    out = e.table("commits").select("sha", "subject", "author_email").join(e.table("counters").select("sha", "n_code", "n_test"), "sha", "left").join(e.table("reverts"), "sha", "left").join(refs, "sha", "left")
    who = e.table("aliases").groupBy(F.lower("email").alias("email")).agg(F.sum("commits").alias("author_commits"))
    out = out.join(who, F.lower("author_email") == F.col("email"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_code", "n_test", "refs")]
    return out.select("sha", "subject", *zero, "reverted_by", "author_commits")


@query("select sha from commits where k % 10 >= 7")
def incremental_delta(spark, d):
    c = history(spark, d).commits
    return X.delta(c.select("sha").union(c.select("sha")), c.where("k % 10 < 7")).select("sha")


@query("x_a as (select distinct author_name, author_email from commits) select (select count(*) from commits) as commits, (select count(*) from x_a) as aliases, (select count(distinct lower(author_email)) from commits) as emails, (select count(distinct name) from refs where name not like 'refs/pull/%') as refs, (select count(*) from files) as files")
def status_counts(spark, d):
    h = history(spark, d)
    alias = I.aliases(h.commits)
    counts = [(h.commits, F.count(F.lit(1)), "commits"), (alias, F.count(F.lit(1)), "aliases"), (alias, F.count_distinct(F.lower("author_email")), "emails"), (G.included_refs(h.refs), F.count_distinct("name"), "refs"), (h.files, F.count(F.lit(1)), "files")]
    out = None
    for df, n, name in counts:
        one = df.agg(n.alias(name))
        out = one if out is None else out.join(F.broadcast(one))  # one row each
    return out


@query("select sha, array_to_string(parents, ' ') as parents, committed_at, subject, body, coalesce(n, 0) as file_count, coalesce(i, 0) as insertions, coalesce(x, 0) as deletions from commits left join (select sha, count(*) as n, cast(sum(insertions) as bigint) as i, cast(sum(deletions) as bigint) as x from files group by sha) using (sha)")
def parse_log_records(spark, d):
    """The history written as an exported log and parsed again."""
    at = F.col("committed_at").cast("string")
    head = F.concat_ws(L.FIELD, "sha", "author_name", "author_email", "author_name", "author_email", at, at, "subject", F.array_join("parents", " "), "body")
    section = lambda *c: F.array_join(F.transform("files", lambda f: F.concat_ws("\t", *[f[x] for x in c])), "\n")
    diff = F.concat(section("status", "path"), F.lit("\n\n"), section("insertions", "deletions", "path"), F.lit("\n"))
    log = commits_with_files(spark, d).select(F.concat(head, F.lit(L.END + "\n\n"), F.coalesce(diff, F.lit(""))).alias("value"))
    total = lambda c: F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + f[c]).alias(c)
    return L.parse_log(log).select("sha", F.array_join("parents", " ").alias("parents"), "committed_at", "subject", "body", F.size("files").cast("long").alias("file_count"), total("insertions"), total("deletions"))


@query("select count(*) as commit_count, count(distinct author_email) as author_count, min(committed_at) as first_at, max(committed_at) as last_at, arg_max(sha, (committed_at, sha)) as last_sha from commits")
def repo_stats(spark, d):
    return A.repo_stats(history(spark, d).commits)


@query("select quantile_disc(o_totalprice, 0.5) as p50, quantile_disc(o_totalprice, 0.95) as p95, quantile_disc(o_totalprice, 0.99) as p99 from orders", base="")
def percentile_nearest_rank(spark, d):
    return M.nearest_ranks(spark.read.parquet(f"{d}/orders.parquet"), "o_totalprice", 50, 95, 99)


RANKED = """with c as (select user_id, event_type, count(*) as n, max(event_id) as last from events group by 1, 2),
u as (select user_id, list(event_type order by n desc, event_type) as ranked, arg_max(event_type, last) as expected from c group by 1)"""


def _ranked_types(spark, d):
    """Each user's event types by frequency, and the type of the user's last event."""
    c = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "event_type")))
    return c.groupBy("user_id").agg(F.transform(order, lambda x: x["event_type"]).alias("ranked"), F.max_by("event_type", "last").alias("expected"))


@query(RANKED + " select round(avg(case when list_contains(ranked[1:2], expected) then 1.0 else 0.0 end), 6) as precision from u", base="")
def precision_at_k(spark, d):
    return _ranked_types(spark, d).agg(_r(M.precision_at_k("ranked", F.col("expected"), 2), "precision"))


@query(RANKED + " select round(avg(1.0 / list_position(ranked, expected)), 6) as mrr from u", base="")
def mrr(spark, d):
    return _ranked_types(spark, d).agg(_r(M.mrr("ranked", F.col("expected")), "mrr"))


@query(f"x_d as (select k, list(distinct {TOP}) as dirs from files group by k) select a.k, round(len(list_intersect(a.dirs, b.dirs)) / cast(len(list_distinct(list_concat(a.dirs, b.dirs))) as double), 6) as jaccard from x_d a join x_d b on b.k = a.k + 1")
def jaccard_sets(spark, d):
    """Directories of each commit against those of the next."""
    dirs = history(spark, d).files.groupBy("k").agg(F.collect_set(T.top_dir(F.col("path"))).alias("dirs"))
    after = dirs.select((F.col("k") - 1).alias("k"), F.col("dirs").alias("next"))
    return dirs.join(after, "k").select("k", _r(M.jaccard("dirs", "next"), "jaccard"))


@query("""with v as (select quality = 1 as g, cast(n_chars as double) as x from labels join documents using (doc_id)),
r as (select g, (select count(*) from v b where b.x < v.x) + ((select count(*) from v b where b.x = v.x) + 1) / 2.0 as rank from v),
t as (select sum(pow(c, 3) - c) as ties from (select count(*) as c from v group by x)),
s as (select sum(rank) filter (g) as r, cast(count(*) filter (g) as double) as n1, cast(count(*) as double) as n from r),
u as (select r - n1 * (n1 + 1) / 2 as u, n1, n - n1 as n2, n, ties from s, t)
select round(u, 6) as u, round((u - n1 * n2 / 2 - sign(u - n1 * n2 / 2) * 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))), 6) as z from u""", base="")
def mann_whitney_quality(spark, d):
    x = spark.read.parquet(f"{d}/labels.parquet").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("n_chars").cast("double").alias("x")), "doc_id")
    return M.mann_whitney(x.select("x", (F.col("quality") == 1).alias("g")), "x", "g").select(_r("u", "u"), _r("z", "z"))


@query("with q as (select embedding as e from embeddings where vec_id = 0) select vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::double), list_transform(e, lambda x: x::double)), 6) as cosine from embeddings, q", base="")
def semantic_cosine(spark, d):
    return _cosine(spark, d).select("vec_id", _r("cosine", "cosine"))


def _cosine(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    q = e.where("vec_id = 0").select("embedding").first()[0]
    return e.select("vec_id", S.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in q])).alias("cosine"))


@query("with q as (select embedding as e from embeddings where vec_id = 0) select vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::double), list_transform(e, lambda x: x::double)), 6) as cosine from embeddings, q order by list_cosine_similarity(list_transform(embedding, lambda x: x::double), list_transform(e, lambda x: x::double)) desc, vec_id limit 20", base="")
def cosine_topk(spark, d):
    return _cosine(spark, d).orderBy(F.desc("cosine"), "vec_id").limit(20).select("vec_id", _r("cosine", "cosine"))


@query("select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2", base="")
def events_tumbling(spark, d):
    t = X.tumbling(spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    return t.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", _r("total", "total"))


@query("with w as (select time_bucket(interval 6 hours, ts) - to_hours(6 * i) as start, event_type from events, (values (0), (1), (2), (3)) v(i)) select start, event_type, count(*) as n from w group by 1, 2", base="")
def events_sliding(spark, d):
    t = X.sliding(spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    return t.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts, new desc rows unbounded preceding) as no from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, no""", base="")
def events_sessions(spark, d):
    t = X.sessions(spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    return t.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("select event_id, event_type from events", base="")
def dedup_events(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type")
    return X.distinct_events(e.union(e))

"""Full-text search: postings with positions, BM25 with column weights, phrases, prefixes, blended ranking."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import text as T
from .graph import checkpointed
from .identity import authors_of

WEIGHTS = {"subject": 4.0, "body": 1.0, "expanded": 1.5, "paths": 2.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
BLEND = {"lexical": 0.50, "path": 0.30, "recency": 0.20}
HYBRID = {"semantic": 0.50, "lexical": 0.20, "path": 0.15, "recency": 0.15}
MOST = 10_000


@dataclass
class Filters:
    """Conditions on commits; ``identity``, ``story``, ``risk_label`` and the times of authorship are the older, exact ones."""

    path: str | None = None
    author: str | None = None
    since: int | None = None
    until: int | None = None
    branch: str | None = None
    author_contains: str | None = None
    identity: str | None = None
    story: str | None = None
    risk_label: str | None = None
    authored_since: int | None = None
    authored_until: int | None = None


@dataclass
class Index:
    """What filters look at beside the commits: ``refs`` (sha, name) by membership, ``aliases`` and ``identities``, ``stories`` (sha, story), ``risk`` (sha, risk_label)."""

    commits: DataFrame
    files: DataFrame
    refs: DataFrame
    aliases: DataFrame | None = None
    identities: DataFrame | None = None
    stories: DataFrame | None = None
    risk: DataFrame | None = None


@dataclass
class Term:
    """Words in a row (one: a plain term); the last may be a prefix; optionally in one column."""

    words: list[str]
    prefix: bool = False
    column: str | None = None


@dataclass
class Query:
    text: str
    filters: Filters = field(default_factory=Filters)
    limit: int = 50


def parse(text: str) -> list[Term]:
    """Terms that must all match: words, "phrases", prefix*, column:term; punctuation only separates words."""
    T.clean_query(text)  # an error where nothing is asked
    out = []
    for column, phrase, bare in re.findall(r'(?:(subject|body|expanded|paths):)?(?:"([^"]*)"|([^\s"]+))', text.replace("\0", "").lower()):
        words = re.findall(r"[^\W_]+", T.folded(phrase or bare))
        if words:
            out.append(Term(words, bare.endswith("*"), column or None))
    if not out:
        raise EngineError("invalid_query", "no search term")
    return out


def postings(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(key, col, term, pos)``; one scan of the texts, nothing is gathered."""
    each = [F.transform(T.tokens(F.coalesce(F.col(c), F.lit(""))), _entry(c)) for c in columns]
    return docs.select(key, F.explode(F.concat(*each)).alias("t")).select(key, "t.col", "t.term", "t.pos")


def _entry(column: str):
    return lambda w, i: F.struct(F.lit(column).alias("col"), w.alias("term"), i.alias("pos"))


def tokenise(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The key and each column's tokens in order: what a stored index keeps, so that a query reads no text."""
    return docs.select(key, *[T.tokens(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns])


def matches(post: DataFrame, key: str, term: Term) -> DataFrame:
    """``(key, col, tf)`` of one term; a phrase matches where its words stand side by side in one column."""
    if term.column:
        post = post.where(F.col("col") == term.column)
    last = term.words[-1]
    is_last = F.col("term").startswith(last) if term.prefix else F.col("term") == last
    if len(term.words) == 1:
        return post.where(is_last).groupBy(key, "col").agg(F.count(F.lit(1)).alias("tf"))
    words = F.array(*[F.lit(w) for w in term.words[:-1]])
    hit = post.where(F.col("term").isin(term.words[:-1]) | is_last)
    at = F.transform(F.sequence(F.lit(0), F.lit(len(term.words) - 2)), lambda i: F.when(F.get(words, i) == F.col("term"), i))
    slots = F.filter(F.concat(at, F.array(F.when(is_last, len(term.words) - 1))), lambda i: i.isNotNull())
    starts = hit.select(key, "col", "pos", F.explode(slots).alias("slot")).groupBy(key, "col", (F.col("pos") - F.col("slot")).alias("start")).agg(F.count_distinct("slot").alias("n"))
    return starts.where(F.col("n") == len(term.words)).groupBy(key, "col").agg(F.count(F.lit(1)).alias("tf"))


def _tf(tokens, term: Term):
    """How often a term's words stand in a row in an array of tokens."""
    n = len(term.words)

    def here(x, at):
        found = None
        for j, w in enumerate(term.words):
            word = x if j == 0 else F.get(tokens, at + j)
            hit = word.startswith(w) if term.prefix and j == n - 1 else word == w
            found = hit if found is None else found & hit
        return found

    return F.size(F.filter(tokens, here))


def bm25(docs: DataFrame, key: str, terms: list[Term], weights: dict[str, float]) -> DataFrame:
    """``(key, bm25)`` of the documents that match every term; more negative is better.

    Corpus statistics cover all documents, whatever filters follow.
    """
    return score(tokenise(docs, key, list(weights)), key, terms, weights)


def score(tokens: DataFrame, key: str, terms: list[Term], weights: dict[str, float]) -> DataFrame:
    """``bm25`` over token arrays: one pass without a shuffle leaves a length and the terms' frequencies a document.

    The statistics (one row) and the scores come from these narrow rows.
    """
    where = [[c for c in weights if term.column in (None, c)] for term in terms]
    freq = [sum((F.lit(float(weights[c])) * _tf(F.col(c), term) for c in cs), F.lit(0.0)) for term, cs in zip(terms, where)]
    size = sum((F.size(c) for c in weights), F.lit(0)).cast("long")
    rows = checkpointed(tokens.select(key, size.alias("d"), *[f.alias(f"f{i}") for i, f in enumerate(freq)]))
    n, avg, *df = rows.agg(F.count(F.lit(1)), F.avg("d"), *[F.count_if(F.col(f"f{i}") > 0) for i in range(len(terms))]).first()
    return _bm25_of(rows, key, n, avg or 0.0, df)


def inverted(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(term, key, size, hits)``: one row per term and document, hits = (col, positions) of its columns, size = the document's tokens in all columns.

    Sorted by term within ranges of terms when written (see ``write_postings``), so a query reads the row groups of its
    terms only. Grouping is within a document, on both sides of no shuffle that a hot term could fill.
    """
    toks = [T.tokens(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    rows = docs.select(key, *[t.alias(c) for t, c in zip(toks, columns)])
    each = F.concat(*[F.transform(c, _entry(c)) for c in columns])
    one = rows.select(key, sum((F.size(c) for c in columns), F.lit(0)).alias("size"), F.explode(each).alias("t"))
    per = one.groupBy(key, "size", "t.term", "t.col").agg(F.sort_array(F.collect_list("t.pos")).alias("positions"))
    return per.groupBy("term", key, "size").agg(F.sort_array(F.collect_list(F.struct("col", "positions"))).alias("hits"))


def corpus(docs: DataFrame, columns: list[str]) -> DataFrame:
    """One row: number of documents and their tokens."""
    size = sum((F.size(T.tokens(F.coalesce(F.col(c), F.lit("")))) for c in columns), F.lit(0)).cast("long")
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(size), F.lit(0)).alias("tokens"))


#: Small row groups and pages, so that a query reads little beside its terms.
POSTINGS = {"parquet.block.size": 8 << 20, "parquet.page.size": 128 << 10}


def live(post: DataFrame, stale: DataFrame, key: str) -> DataFrame:
    """The postings of segments (column ``part``) without those that a later segment replaced: of a document in ``stale`` (key, upto), all before ``upto``."""
    return post.join(stale.withColumnRenamed("upto", "_upto"), key, "left").where(F.col("_upto").isNull() | (F.col("part") >= F.col("_upto"))).drop("_upto")


def write_postings(post: DataFrame, path: str, key: str) -> None:
    """The postings in ranges of (term, key), sorted: a hot term spans several files, and statistics of files and row groups skip the others."""
    post.repartitionByRange("term", key).sortWithinPartitions("term", key).write.mode("overwrite").options(**POSTINGS).parquet(path)


def looked_up(post: DataFrame, key: str, terms: list[Term], weights: dict[str, float], documents: int, tokens: int, keep=None, matched: list | None = None) -> DataFrame:
    """``(key, bm25)`` over stored postings: reads the query's terms only; document frequencies are counted before any filter.

    ``keep`` may hold the terms' frequencies by document, which the count and the scores share; left out, they are written. ``matched`` is given the
    number of documents in which all terms occur, from the same count.
    """
    words = sorted({w for t in terms for w in (t.words[:-1] if t.prefix else t.words)})
    wanted = F.col("term").isin(words) if words else F.lit(False)
    for t in terms:
        if t.prefix:
            wanted = wanted | F.col("term").startswith(t.words[-1])
    rows = post.where(wanted).groupBy(key).agg(F.first("size").alias("d"), F.flatten(F.collect_list(F.transform("hits", lambda h: F.struct(h["col"].alias("col"), F.col("term").alias("term"), h["positions"].alias("positions"))))).alias("h"))

    def places(i, term, column):
        # positions of a phrase's i-th word in a column
        last = term.prefix and i == len(term.words) - 1
        hit = lambda x: (x["col"] == column) & (x["term"].startswith(term.words[i]) if last else x["term"] == term.words[i])
        return F.flatten(F.transform(F.filter("h", hit), lambda x: x["positions"]))

    freq = []
    for term in terms:
        total = F.lit(0.0)
        for column in [c for c in weights if term.column in (None, c)]:
            at = places(0, term, column)
            for i in range(1, len(term.words)):
                more = places(i, term, column)
                at = F.array_intersect(F.transform(at, lambda p: p + 1), more)
            total = total + F.lit(float(weights[column])) * F.size(at)
        freq.append(total)
    rows = rows.select(key, "d", *[f.alias(f"f{i}") for i, f in enumerate(freq)])
    rows = keep(rows) if keep else checkpointed(rows)
    every = F.expr(" and ".join(f"f{i} > 0" for i in range(len(terms))))
    *df, both = rows.agg(*[F.count_if(F.col(f"f{i}") > 0) for i in range(len(terms))], F.count_if(every)).first()
    if matched is not None:
        matched.append(both)
    return _bm25_of(rows, key, documents, tokens / documents if documents else 0.0, df)


def looked_up_many(post: DataFrame, key: str, asked: dict[int, list[Term]], weights: dict[str, float], documents: int, tokens: int) -> DataFrame:
    """``(query, key, bm25)`` of many queries at once: each posting is read once, whatever number of them want it.

    The queries' words (broadcast: the caller's list) meet the postings; prefixes meet them by their first letters. A
    query's frequencies by term give its document frequencies and, where all its terms occur, its scores.
    """
    spark = post.sparkSession
    words = [(q, i, j, len(t.words), w, t.prefix and j == len(t.words) - 1, t.column) for q, terms in asked.items() for i, t in enumerate(terms) for j, w in enumerate(t.words)]
    wanted = F.broadcast(spark.createDataFrame(words, "query int, no int, place int, words int, word string, prefix boolean, only string"))
    plain, starts = sorted({w[4] for w in words if not w[5]}), sorted({w[4] for w in words if w[5]})
    hits = post.where(F.col("term").isin(plain)).join(wanted.where("not prefix"), F.col("term") == F.col("word"))
    if starts:
        firsts = F.array(*[F.when(F.length("term") >= n, F.substring("term", 1, n)) for n in sorted({len(w) for w in starts})])
        begun = post.withColumn("first", F.explode(F.filter(firsts, lambda x: x.isin(starts)))).join(wanted.where("prefix"), F.col("first") == F.col("word")).drop("first")
        hits = hits.unionByName(begun)
    hits = hits.withColumn("hits", F.filter("hits", lambda h: F.col("only").isNull() | (h["col"] == F.col("only"))))
    per = ["query", "no", key]
    count = lambda c: F.aggregate(F.filter("hits", lambda h: h["col"] == c), F.lit(0), lambda a, h: a + F.size(h["positions"]))
    one = [F.sum(count(c)).alias(f"n_{c}") for c in weights]
    freq = hits.where("words = 1").groupBy(*per).agg(F.first("size").alias("d"), *one)
    if any(len(t.words) > 1 for terms in asked.values() for t in terms):
        spots = hits.where("words > 1").select(*per, "size", "place", "words", F.explode("hits").alias("h")).select(*per, "size", "place", "words", "h.col", F.explode("h.positions").alias("pos"))
        rows = spots.groupBy(*per, "size", "words", "col", (F.col("pos") - F.col("place")).alias("start")).agg(F.count_distinct("place").alias("met")).where("met = words")
        freq = freq.unionByName(rows.groupBy(*per).agg(F.first("size").alias("d"), *[F.count_if(F.col("col") == c).alias(f"n_{c}") for c in weights]))
    f = sum((F.lit(float(w)) * F.col(f"n_{c}") for c, w in weights.items()), F.lit(0.0))
    freq = checkpointed(freq.select(*per, "d", f.alias("f")).where("f > 0"))
    raw = F.log((F.lit(float(documents)) - F.col("m") + 0.5) / (F.col("m") + 0.5))
    idf = freq.groupBy("query", "no").agg(F.count(F.lit(1)).alias("m")).select("query", "no", F.when(raw > 0, raw).otherwise(LEAST_IDF).alias("idf"))
    average = tokens / documents if documents and tokens else 1.0
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("d") / F.lit(average)))
    # one row a term of a query; its parts are added up in the query's order
    scored = freq.join(F.broadcast(idf), ["query", "no"]).groupBy("query", key).agg(F.sort_array(F.collect_list(F.struct("no", part.alias("part")))).alias("parts"))
    sizes = F.broadcast(spark.createDataFrame([(q, len(terms)) for q, terms in asked.items()], "query int, terms int"))
    total = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["part"])
    return scored.join(sizes, "query").where(F.size("parts") == F.col("terms")).select("query", key, (-total).alias("bm25"))


def _bm25_of(rows: DataFrame, key: str, n: int, average: float, df: list[int]) -> DataFrame:
    """``(key, bm25)`` of the rows (key, d, f0, f1, ...) in which every term occurs."""
    total = F.lit(0.0)
    for i, m in enumerate(df):
        raw = math.log((n - m + 0.5) / (m + 0.5))
        f = F.col(f"f{i}")
        total = total + F.lit(raw if raw > 0 else LEAST_IDF) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("d") / F.lit(average or 1.0)))
    return rows.where(" and ".join(f"f{i} > 0" for i in range(len(df)))).select(key, (-total).alias("bm25"))


def lexical_factor(bm25_col, monotone: bool = False):
    """1 / (1 + |bm25|), or with ``monotone`` |bm25| / (1 + |bm25|), which grows with the match."""
    a = F.abs(bm25_col)
    return a / (1 + a) if monotone else 1 / (1 + a)


def filtered(index: Index, f: Filters) -> DataFrame:
    """Commits that pass the filters, before any scoring; each is a semi join or a pushed-down predicate.

    An author is an e-mail; it stands for the identities that have it as canonical or alias e-mail, so for commits
    under all of their names. A branch keeps every commit that it reaches.
    """
    commits = index.commits
    if f.since is not None:
        commits = commits.where(F.col("committed_at") >= f.since)
    if f.until is not None:
        commits = commits.where(F.col("committed_at") <= f.until)
    if f.authored_since is not None:
        commits = commits.where(F.col("authored_at") >= f.authored_since)
    if f.authored_until is not None:
        commits = commits.where(F.col("authored_at") <= f.authored_until)
    own = [F.col("name").alias("author_name"), F.col("email").alias("author_email")]
    if f.author:
        commits = commits.join(authors_of(index.aliases, index.identities, f.author).select(*own), ["author_name", "author_email"], "left_semi")
    if f.identity:
        commits = commits.join(index.aliases.where(F.col("identity") == f.identity).select(*own), ["author_name", "author_email"], "left_semi")
    if f.author_contains:
        part = F.lit(f.author_contains.lower())
        commits = commits.where(F.contains(F.lower("author_email"), part) | F.contains(F.lower("author_name"), part))
    if f.path:
        commits = commits.join(index.files.where(F.lower("path").startswith(f.path.lower())).select("sha"), "sha", "left_semi")
    if f.branch:
        commits = commits.join(index.refs.where(F.col("name") == T.branch_ref(f.branch)).select("sha"), "sha", "left_semi")
    if f.story:
        commits = commits.join(index.stories.where(F.col("story") == f.story).select("sha"), "sha", "left_semi")
    if f.risk_label:
        commits = commits.join(index.risk.where(F.col("risk_label") == f.risk_label).select("sha"), "sha", "left_semi")
    return commits


def search(docs: DataFrame, index: Index, q: Query, now: int, monotone: bool = False, half_life: float = 180.0) -> DataFrame:
    """Hits with all factors, best first, ``total_available`` before the limit on every row."""
    return ranked(bm25(docs, "sha", parse(q.text), WEIGHTS), index, q, now, monotone, half_life)


def ranked(scored: DataFrame, index: Index, q: Query, now: int, monotone: bool = False, half_life: float = 180.0, total: int | None = None) -> DataFrame:
    """The blend of scored commits with path relevance and recency; see ``search``. ``total``: the number of hits, where it is known."""
    if not 0 < q.limit <= MOST:
        raise EngineError("limit_too_large", f"limit must be 1 to {MOST}")
    hits = _factors(filtered(index, q.filters).join(scored, "sha"), scored, index, q, now, monotone, half_life)
    hits = hits.withColumn("score", blend(BLEND, lexical="lexical", path="path_relevance", recency="recency"))
    return _best(hits, q, total)


def ranked_many(scored: DataFrame, index: Index, q: Query, now: int, monotone: bool = False, half_life: float = 180.0) -> DataFrame:
    """``ranked`` for many queries (query, sha, bm25) with the same filters and limit: each one's best by ``rank``, and its ``total_available``."""
    if not 0 < q.limit <= MOST:
        raise EngineError("limit_too_large", f"limit must be 1 to {MOST}")
    hits = _factors(filtered(index, q.filters).join(scored, "sha"), scored, index, q, now, monotone, half_life, "query")
    hits = hits.withColumn("score", blend(BLEND, lexical="lexical", path="path_relevance", recency="recency"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("committed_at"), "sha")
    total = hits.groupBy("query").agg(F.count(F.lit(1)).alias("total_available"))
    # Spark keeps each task's first rows of a query before they meet, so no task sees all hits of one
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= q.limit).join(F.broadcast(total), "query")


def ranked_hybrid(scored: DataFrame, near: DataFrame, index: Index, q: Query, now: int, monotone: bool = False, half_life: float = 180.0) -> DataFrame:
    """As ``ranked``, over the commits of either side: scored ones and ``near`` (sha, semantic); a side that lacks a commit counts 0."""
    if not 0 < q.limit <= MOST:
        raise EngineError("limit_too_large", f"limit must be 1 to {MOST}")
    both = scored.join(near, "sha", "full")
    hits = filtered(index, q.filters).join(both, "sha")
    hits = _factors(hits, both, index, q, now, monotone, half_life, F.coalesce("semantic", F.lit(0.0)).alias("semantic"))
    return _best(hits.withColumn("score", blend(HYBRID, semantic="semantic", lexical="lexical", path="path_relevance", recency="recency")), q)


def _factors(hits: DataFrame, found: DataFrame, index: Index, q: Query, now: int, monotone: bool, half_life: float, *more) -> DataFrame:
    if q.filters.path:
        dirs = index.files.join(found.select("sha"), "sha", "left_semi").groupBy("sha").agg(F.collect_set(T.full_dir(F.col("path"))).alias("dirs"))
        hits = hits.join(dirs, "sha", "left")
    else:
        hits = hits.withColumn("dirs", F.lit(None).cast("array<string>"))
    lexical, path = F.coalesce(lexical_factor(F.col("bm25"), monotone), F.lit(0.0)), T.path_relevance(F.coalesce("dirs", F.array().cast("array<string>")), q.filters.path)
    recent = T.recency(F.col("committed_at"), now, half_life)
    more = [*more, *(c for c in ("author_email",) if c in hits.columns)]
    return hits.select("sha", "subject", F.col("author_name").alias("author"), "committed_at", lexical.alias("lexical"), path.alias("path_relevance"), recent.alias("recency"), *more)


def _best(hits: DataFrame, q: Query, total: int | None = None) -> DataFrame:
    # the number of hits needs neither the factors nor a sort: Spark leaves both out of this count
    total = hits.count() if total is None else total
    return hits.orderBy(F.desc("score"), F.desc("committed_at"), "sha").limit(q.limit).withColumn("total_available", F.lit(total).cast("long"))


def with_identities(hits: DataFrame, aliases: DataFrame, identities: DataFrame, *order) -> DataFrame:
    """Shown hits under the canonical names of their authors, with ``identity``; an author who is not known keeps the raw name."""
    of = aliases.select(F.col("name").alias("author"), F.col("email").alias("author_email"), "identity").join(identities.select("identity", "canonical_name"), "identity")
    out = hits.join(of, ["author", "author_email"], "left").withColumn("author", F.coalesce("canonical_name", "author"))
    return out.select(*[c for c in hits.columns if c != "author_email"], "identity").orderBy(*order)


def blend(weights: dict[str, float], **columns: str):
    """Weighted sum of factor columns."""
    return sum((F.lit(w) * F.col(columns[k]) for k, w in weights.items()), F.lit(0.0))


def hybrid(lexical: DataFrame, semantic: DataFrame, key: str) -> DataFrame:
    """Rows of either side with the ``score`` that is the blend of ``lexical`` (key, lexical, path_relevance, recency) and ``semantic`` (key, semantic); what a side lacks is 0."""
    both = lexical.join(semantic, key, "full")
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("semantic", "lexical", "path_relevance", "recency")]
    return both.select(key, *zero).withColumn("score", blend(HYBRID, semantic="semantic", lexical="lexical", path="path_relevance", recency="recency"))


def sha_lookup(commits: DataFrame, prefix: str) -> DataFrame:
    """The one commit whose hash starts with ``prefix``; none or several are errors with the true count."""
    prefix = prefix.lower()
    if not re.fullmatch(r"[0-9a-f]{4,40}", prefix):
        raise EngineError("invalid_ref", "not a hash prefix")
    hit = commits.where(F.col("sha").startswith(prefix))
    n = hit.count()
    if n != 1:
        raise EngineError("sha_not_found" if n == 0 else "sha_ambiguous_prefix", f"{n} commits match {prefix}", count=n)
    return hit


def cosine(a, b):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))

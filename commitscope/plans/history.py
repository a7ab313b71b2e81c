"""A commit history derived from the driver's tables, the same view in Spark and in SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIRS = ["src", "src/net", "tests", "docs", "db/migrations", "infra/k8s", ".github/workflows", "config", "assets", "node_modules/x", "lib", ""]
SUFFIXES = [".rs", ".md", ".toml", "_test.go", ".png", ".sql", ".tf", ".ts"]
PREFIXES = ["feat: ", "fix(core): ", "docs: ", "chore: ", ""]


def _pick(values: list[str], index: str) -> str:
    return "case " + index + " " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


#: Expressions that both engines read alike.
EXPR = {
    "name": "case when c_custkey % 2 = 1 then upper(c_name) else c_name end || case when c_custkey % 40 = 0 then '[bot]' else '' end",
    "email": "'dev' || c_custkey % 100 || '@' || lower(n_name) || '.example'",
    "path": f"case when p_partkey % 12 = 11 then '' else {_pick(DIRS, 'p_partkey % 12')} || '/' end || replace(p_name, ' ', '_') || '_' || p_partkey || {_pick(SUFFIXES, 'p_size % 8')}",
}


@dataclass
class History:
    commits: DataFrame  # k, sha, parents, author_name, author_email, committed_at, subject, body
    files: DataFrame  # k, sha, path, status, insertions, deletions
    refs: DataFrame  # name, sha, ref_type
    now: int | None = None


def _sha(k):
    return F.sha1(F.concat(F.lit("commit:"), k.cast("string")))


FILE = ["path", "status", "insertions", "deletions"]


def _hit(t) -> DataFrame:
    part = t("part").select("p_partkey", F.expr(EXPR["path"]).alias("path"), "p_name")
    line = t("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber", "l_returnflag")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey"))


def _files(hit: DataFrame, *more) -> DataFrame:
    files = hit.groupBy(F.col("l_orderkey").alias("k"), "path").agg(
        F.sum("l_quantity").cast("long").alias("insertions"), F.sum("l_linenumber").cast("long").alias("deletions"), F.max("l_returnflag").alias("flag"), *more
    )
    return files.withColumn("status", F.expr("case flag when 'R' then 'R' when 'N' then 'M' else 'A' end")).drop("flag")


def history(spark: SparkSession, sf_dir: str) -> History:
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    hit = _hit(t)
    files = _files(hit).select("k", _sha(F.col("k")).alias("sha"), *FILE)
    first = hit.groupBy("l_orderkey").agg(F.min_by("p_name", "l_partkey").alias("first_part"))
    base = _base(t)
    k = F.col("o_orderkey")
    one = base.select(k.alias("k"), _sha(k).alias("sha"), F.col("o_orderstatus").alias("state"))  # no reference needs a commit's subject
    refs = (
        one.where("k % 10 <> 9").select(F.concat(F.lit("refs/heads/"), F.lower("state")).alias("name"), "sha", F.lit("branch").alias("ref_type"))
        .union(one.where("k % 100 = 0").select(F.concat(F.lit("refs/tags/v"), (F.col("k") / 100).cast("long").cast("string")), "sha", F.lit("tag")))
        .union(one.where("k % 333 = 0").select(F.concat(F.lit("refs/pull/"), F.col("k").cast("string"), F.lit("/head")), "sha", F.lit("remote_branch")))
    )
    return History(_commits(base, first), files, refs)


def commits_with_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history's commits, each with the array ``files`` (null: none): lines meet their parts once and move to their commits once."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    hit = _hit(t).repartition("l_orderkey")  # both groupings follow from it
    files = _files(hit, F.min_by("p_name", "l_partkey").alias("p_name"), F.min("l_partkey").alias("l_partkey"))
    whole = files.groupBy(F.col("k").alias("l_orderkey")).agg(F.min_by("p_name", "l_partkey").alias("first_part"), F.collect_list(F.struct(*FILE)).alias("files"))
    return _commits(_base(t), whole, "files")


def _base(t) -> DataFrame:
    who = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.expr(EXPR["name"]).alias("author_name"), F.expr(EXPR["email"]).alias("author_email"))
    return t("orders").join(who, F.col("o_custkey") == F.col("c_custkey"))


def _commits(base: DataFrame, first: DataFrame, *more: str) -> DataFrame:
    k = F.col("o_orderkey")
    commits = base.join(first, k == F.col("l_orderkey"), "left")
    subject = F.concat(F.expr(_pick(PREFIXES, "o_orderkey % 5")), F.col("o_orderpriority"), F.lit(" "), F.coalesce("first_part", F.lit("none")))
    parents = F.when(k == 0, F.array().cast("array<string>")).when((k % 50 == 0) & (k >= 7), F.array(_sha(k - 1), _sha(k - 7))).otherwise(F.array(_sha(k - 1)))
    body = (
        F.when((k % 97 == 0) & (k >= 3), F.concat(F.lit("This reverts commit "), _sha(k - 3), F.lit(".")))
        .when(k % 11 == 0, F.concat(F.lit("Co-authored-by: Dev "), (k % 30).cast("string"), F.lit(" <dev"), (k % 30).cast("string"), F.lit("@co.example>")))
        .otherwise("")
    )
    return commits.select(
        k.alias("k"), _sha(k).alias("sha"), parents.alias("parents"), "author_name", "author_email", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("committed_at"),
        F.when(k % 97 == 0, F.concat(F.lit('Revert "'), subject, F.lit('"'))).otherwise(subject).alias("subject"), body.alias("body"), *more,
    )


#: The same view for an SQL engine that has the driver's tables; starts a WITH clause.
SQL = f"""with recursive part_path as (select p_partkey, p_name, {EXPR['path']} as path from part),
hit as (select l_orderkey, l_partkey, l_quantity, l_linenumber, l_returnflag, path, p_name from lineitem join part_path on l_partkey = p_partkey),
files as (select l_orderkey as k, sha1('commit:' || l_orderkey) as sha, path,
  case max(l_returnflag) when 'R' then 'R' when 'N' then 'M' else 'A' end as status,
  cast(sum(l_quantity) as bigint) as insertions, cast(sum(l_linenumber) as bigint) as deletions from hit group by l_orderkey, path),
firsts as (select l_orderkey, arg_min(p_name, l_partkey) as first_part from hit group by l_orderkey),
base as (select o_orderkey as k, o_orderstatus as state, o_orderdate, {EXPR['name']} as author_name, {EXPR['email']} as author_email,
  {_pick(PREFIXES, 'o_orderkey % 5')} || o_orderpriority || ' ' || coalesce(first_part, 'none') as plain
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey left join firsts on o_orderkey = l_orderkey),
commits as (select k, state, sha1('commit:' || k) as sha, author_name, author_email, cast(epoch(o_orderdate) as bigint) as committed_at,
  case when k = 0 then [] when k % 50 = 0 and k >= 7 then [sha1('commit:' || (k - 1)), sha1('commit:' || (k - 7))] else [sha1('commit:' || (k - 1))] end as parents,
  case when k % 97 = 0 then 'Revert "' || plain || '"' else plain end as subject,
  case when k % 97 = 0 and k >= 3 then 'This reverts commit ' || sha1('commit:' || (k - 3)) || '.'
    when k % 11 = 0 then 'Co-authored-by: Dev ' || k % 30 || ' <dev' || k % 30 || '@co.example>' else '' end as body from base),
refs as (select 'refs/heads/' || lower(state) as name, sha, 'branch' as ref_type from commits where k % 10 <> 9
  union all select 'refs/tags/v' || k // 100, sha, 'tag' from commits where k % 100 = 0
  union all select 'refs/pull/' || k || '/head', sha, 'remote_branch' from commits where k % 333 = 0)
"""

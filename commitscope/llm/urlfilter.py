"""URL filter with redirect equivalence, in DataFrame operations only.

Rules (host, path, verdict) decide urls directly; the longest fitting rule wins. Redirects, refreshes and canonical
links make urls equivalent: pages and link targets are nodes, named by their url without scheme, fragment and tracking
parameters. Connected components over these edges carry decisions to aliases: a component with an explicitly allowed
member is allowed, else one with a blocked member is blocked, else allowed. A url's own rule always stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

#: Fixed values of the query: (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = r"(?:utm_[a-z]+|gclid|fbclid|ref)"


def host_of(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; no ``://`` or null: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^(?:(?!://).)*+://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url):
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*+://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url):
    """Host, path and query without tracking parameters; null where the url has no host."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"(?i)^{TRACKING}(?:=|$)")), "&")
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    return F.when(host_of(url) != "", F.concat(host_of(url), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _rule(host, path, rules):
    """(rule, verdict) of the longest fitting rule; of equally long ones the first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(reversed(rules), key=lambda r: len(r[1]) + len(r[2])):  # the last that fits stays
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _absolute(target, url, host):
    """A link target as an absolute url; relative ones belong to the page's host."""
    target = F.trim(F.replace(target, F.lit("&amp;"), F.lit("&")))
    base = F.concat(F.regexp_extract(url, r"(?s)^((?:(?!://).)*+://)", 1), host)
    folder = F.regexp_replace(F.when(path_of(url) == "", "/").otherwise(path_of(url)), r"[^/]*$", "")
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(base, target))
        .when(target != "", F.concat(base, folder, target))
    )


def page_links(html):
    """Targets of canonical links and of refreshes in a page: attributes in any order, quoted either way, tags of any length.

    A ``>`` within a value in quotes (after ``=``) ends no tag; a quote that nothing closes is a letter like any other. The
    next such tag's begin ends a tag that is never closed, so no page is read over and over.
    """
    tags = F.regexp_extract_all(html, F.lit(r"""(?i)(<(?:link|meta)\b(?:[^<>=]++|<(?!(?:link|meta)\b)|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>)"""), 1)
    canonical = F.filter(tags, lambda t: t.rlike(r"(?i)^<link\b") & t.rlike(r"""(?i)\brel\s*=\s*["']?\s*canonical\b"""))
    refresh = F.filter(tags, lambda t: t.rlike(r"(?i)^<meta\b") & t.rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?\s*refresh\b"""))
    return F.filter(
        F.concat(
            F.transform(canonical, lambda t: F.regexp_extract(t, r"""(?i)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", 0)),
            F.transform(refresh, lambda t: F.regexp_extract(t, r"""(?i)\burl\s*=\s*['"]?([^"'>\s]+)""", 0)),
        ),
        lambda t: t != "",
    )


def _target(attribute):
    return F.regexp_replace(F.regexp_replace(attribute, r"""(?i)^(?:href|url)\s*=\s*["']?""", ""), r"""["']$""", "")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, decided_by)``, one row per page.

    ``redirects`` may hold further edges (from_url, to_url). Null urls have empty host and path, no rule and no
    aliases; they are allowed, as is everything without a decision. Null html has no links. Repeated rows keep their
    number; an empty table gives an empty result. A hot host is not a key of any shuffle.
    """
    url = F.col("url")
    base = written(
        pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"), F.transform(page_links(F.col("html")), lambda t: node_of(_absolute(_target(t), url, host_of(url)))).alias("to")),
        "url-pages",
    ).withColumn("own", _rule(F.col("host"), F.col("path"), rules))
    edges = base.where(F.size("to") > 0).select(F.col("node").alias("a"), F.explode("to").alias("b"))
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("from_url")), node_of(F.col("to_url"))))
    component = connected_components(edges)
    # a decision is a node's: link targets that are no pages of the table count too, by their own rules
    known = base.where("node is not null").groupBy("node").agg(F.max(F.col("own.verdict") == "allow").alias("allow"), F.max(F.col("own.verdict") == "block").alias("block"))
    host, path = F.regexp_extract("node", r"^([^/]*)", 1), F.regexp_extract("node", r"(?s)^[^/]*([^?]*)", 1)
    linked = component.withColumn("own", _rule(host, path, rules)).join(known, "node", "left")
    votes = linked.groupBy("component").agg(
        F.max(F.coalesce("allow", F.lit(False)) | F.coalesce(F.col("own.verdict") == "allow", F.lit(False))).alias("allow"),
        F.max(F.coalesce("block", F.lit(False)) | F.coalesce(F.col("own.verdict") == "block", F.lit(False))).alias("block"),
    )
    alone = known.join(component, "node", "left_anti").select("node", F.coalesce("allow", F.lit(False)).alias("allow"), F.coalesce("block", F.lit(False)).alias("block"))
    decision = component.join(votes, "component").select("node", "allow", "block").union(alone)
    by_alias = F.when(F.col("allow"), "allow").when(F.col("block"), "block")
    return base.join(decision, "node", "left").select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce(F.col("own.verdict"), by_alias, F.lit("allow")).alias("verdict"),
        F.when(F.col("own").isNotNull(), "rule").when(by_alias.isNotNull(), "alias").otherwise("default").alias("decided_by"),
    )

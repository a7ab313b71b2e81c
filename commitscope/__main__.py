"""Command line: ``python -m commitscope [--index FOLDER] COMMAND``; prints JSON, or lines for ``search --text``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .engine import Engine, hits_json, hits_text, limit_of
from .errors import EngineError, success
from .sources.git import Git, index_path

REFS = "name string, sha string, ref_type string"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="commitscope")
    p.add_argument("--index", help="folder of the index; left out, that of the repository")
    p.add_argument("--repo", default=".", help="work tree of the repository")
    p.add_argument("--config", action="append", default=[], help="TOML file; later ones win")
    p.add_argument("--overrides", help="TOML file with [[override]] tables of identities")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("index")
    c.add_argument("log", nargs="?", help="exported log; left out, the repository's own")
    c.add_argument("refs", nargs="?", help="tab-separated name, hash, type (branch, remote_branch, tag)")
    for flag in ("--rebuild", "--dry-run", "--no-wait", "--progress"):
        c.add_argument(flag, action="store_true")
    c = sub.add_parser("search")
    c.add_argument("query")
    c.add_argument("--limit", type=int)
    for flag in ("--path", "--author", "--since", "--until", "--branch", "--vector"):
        c.add_argument(flag)
    c.add_argument("--text", action="store_true")
    sub.add_parser("status")
    sub.add_parser("backfill")
    sub.add_parser("reclassify")
    c = sub.add_parser("identities")
    c.add_argument("--include-bots", action="store_true")
    c = sub.add_parser("classify")
    c.add_argument("glob", nargs="?")
    c.add_argument("--explain", metavar="HASH")
    for name in ("story", "risk"):
        c = sub.add_parser(name)
        for flag in ("--since", "--until", "--path"):
            c.add_argument(flag)
        c.add_argument("--limit", type=int, default=50)
    c = sub.add_parser("hotspots")
    c.add_argument("path", nargs="?", default="")
    c.add_argument("--limit", type=int, default=20)
    sub.add_parser("explain").add_argument("commit")
    c = sub.add_parser("between")
    c.add_argument("a")
    c.add_argument("b")
    c = sub.add_parser("show")
    c.add_argument("commit")
    c.add_argument("--stat", action="store_true")
    c = sub.add_parser("setup-embeddings")
    c.add_argument("vectors", help="Parquet table with sha and embedding")
    c.add_argument("--model", required=True)
    c = sub.add_parser("config")
    c.add_argument("action", choices=["get", "set", "list"])
    c.add_argument("key", nargs="?")
    c.add_argument("value", nargs="?")
    return p


def _text(path: str | None) -> str:
    if not path:
        return ""
    with open(path, encoding="utf-8") as f:
        return f.read()


def run(spark, argv: list[str]) -> str:
    args = parser().parse_args(argv)
    git = Git(args.repo)
    folder = args.index or "file://" + index_path(git)
    mailmap = os.path.join(args.repo, ".mailmap")
    e = Engine(spark, folder, *map(_text, args.config), mailmap=_text(mailmap if os.path.exists(mailmap) else None), overrides=_text(args.overrides))
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]  # noqa: E731 - reports with a limit, or files of one commit
    match args.command:
        case "index":
            tell = (lambda stage, done, of: print(f"{stage} {done}/{of}", file=sys.stderr)) if args.progress else None
            if args.log:
                if not args.refs:
                    raise EngineError("config", "an exported log needs its references")
                out = e.index(args.log, spark.read.csv(args.refs, sep="\t", schema=REFS), args.rebuild, args.dry_run, not args.no_wait, progress=tell)
            else:
                out = e.index_repository(git, args.rebuild, args.dry_run, not args.no_wait, tell)
        case "search":
            vector = json.loads(_text(args.vector)) if args.vector else None
            hits = e.search(args.query, limit_of(args.limit, not args.text, e.config), args.path, args.author, args.since, args.until, args.branch, vector=vector)
            return hits_text(hits) if args.text else hits_json(hits)
        case "status":
            out = e.status()
        case "backfill":
            out = e.backfill()
        case "reclassify":
            out = {"commits_changed": e.reclassify()}
        case "identities":
            # the report lists every identity, so its length is theirs
            shown = [r.asDict() for r in e.identities(args.include_bots).toLocalIterator()]
            out = {**e.identity_counts(), "identities": shown}
        case "classify":
            if bool(args.glob) == bool(args.explain):
                raise EngineError("config", "classify takes a glob or --explain")
            if args.explain:
                files = rows(e.classify_explain(args.explain))
                out = {"sha": files[0]["sha"] if files else e.commit(args.explain)["sha"], "files": files}
            else:
                listed = None if args.index else spark.createDataFrame([(p,) for p in git.ls_files()], "path string")
                hit, category = e.classify_glob(listed, args.glob)
                out = {"glob": args.glob, "matched_files": rows(hit), "category": category}
        case "story":
            out = {"stories": rows(e.story(args.since, args.until, args.path, args.limit))}
        case "risk":
            out = {"commits": rows(e.risk(args.since, args.until, args.path, args.limit))}
        case "hotspots":
            out = {k: rows(v) for k, v in e.hotspots(args.path, args.limit).items()}
        case "explain":
            out = e.explain(args.commit)
        case "between":
            out = e.between(args.a, args.b)
        case "show":
            return git.show(git.rev_parse(args.commit), args.stat)
        case "setup-embeddings":
            out = {"vectors": e.setup_embeddings(spark.read.parquet(args.vectors), args.model), "model": args.model}
        case "config":
            if args.action != "list" and not args.key or args.action == "set" and args.value is None:
                raise EngineError("config", f"config {args.action} needs more arguments")
            if args.action == "set":
                e.config_set(args.key, args.value)
            out = dict(e.config_list()) if args.action == "list" else {args.key: e.config_get(args.key)}
    return json.dumps(success(out), ensure_ascii=False)


def main() -> int:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("commitscope").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        print(run(spark, sys.argv[1:]))
    except EngineError as e:
        print(json.dumps(e.envelope(), ensure_ascii=False))
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""A thin command line over the API: search, lines, index, update, db, config, status, direct."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from trawl.functions.display import exec_command, highlight, long_line
from trawl.model import Case, Layers, Options, PathMode, SearchRequest, Sort
from trawl.operators.index import ContentIndex
from trawl.operators.lines import render, search_lines
from trawl.operators.overlay import overlay_length
from trawl.operators.search import Indexed, indexed_search, search, uses_index
from trawl.sources.build import build, counters
from trawl.sources.files import direct_scan
from trawl.sources.store import Database, FileStore, Registry, Settings, SnapshotStore, index_path, status
from trawl.streaming.changes import Overlay, capture, current, watch


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("trawl")
    p.add_argument("--home", help="folder of registry, settings and snapshots, shared by all executors; on a single machine ~/.trawl")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search")
    s.add_argument("query")
    for flag in ("-i", "-s", "--regex", "--filename", "--content", "--basename", "--count", "--null", "--direct", "--hidden"):
        s.add_argument(flag, action="store_true")
    s.add_argument("-l", "--long", action="store_true")
    s.add_argument("-n", "--line-number", action="store_true")
    s.add_argument("-C", "--context", type=int)
    for flag in ("-e", "-t", "-E", "-g"):
        s.add_argument(flag, action="append", default=[])
    s.add_argument("-d", "--depth", type=int)
    s.add_argument("-x", "--exec")
    for flag in ("--scope", "--db", "--expr"):
        s.add_argument(flag)
    s.add_argument("--limit", type=int)
    s.add_argument("--max-results", type=int)
    s.add_argument("--sort", choices=[x.value for x in Sort], default="default")
    s.add_argument("--color", choices=["auto", "always", "never"], default="auto")
    i = sub.add_parser("index")
    i.add_argument("root")
    i.add_argument("--name", default="default")
    i.add_argument("--skip", action="append", default=[])
    i.add_argument("--max-file-size", type=int)
    for flag in ("--force", "--no-content", "--no-index", "--one-file-system", "--hidden"):
        i.add_argument(flag, action="store_true")
    d = sub.add_parser("db")
    d.add_argument("action", choices=["add", "remove", "list"])
    d.add_argument("name", nargs="?")
    d.add_argument("root", nargs="?")
    c = sub.add_parser("config")
    c.add_argument("action", choices=["show", "add", "remove", "list"])
    c.add_argument("pattern", nargs="?")
    sub.add_parser("status")
    u = sub.add_parser("update", help="take up what has changed on disk since the last build")
    u.add_argument("name")
    return p


def request_of(a: argparse.Namespace) -> SearchRequest:
    if a.filename and a.content:
        raise SystemExit("--filename and --content exclude each other")
    case = Case.SENSITIVE if a.s else Case.INSENSITIVE if a.i else Case.SMART
    layers = Layers.FILENAME if a.filename else Layers.CONTENT if a.content else Layers.BOTH
    opts = Options(case=case, layers=layers, path_mode=PathMode.BASENAME if a.basename else PathMode.FULL, sort=Sort(a.sort), regex=a.regex, ext=tuple(a.e), types=tuple(a.t), exclude=tuple(a.E), glob=tuple(a.g), depth=a.depth, expr=a.expr, max_results=a.max_results)
    return SearchRequest(a.query, a.scope, a.limit, a.db, opts)


def print_search(spark: SparkSession, a: argparse.Namespace, store: FileStore, out, ignore: list[str]) -> None:
    registry, request = Registry.load(store, f"{a.home}/registry.json"), request_of(a)
    if a.direct:
        roots = [r.root for r in registry.records if a.db in (None, r.name)]
        results = [direct_scan(spark, r, a.query, request.opts, a.scope, ignore, a.hidden) for r in roots]
    else:
        chosen = [registry.get(a.db)] if a.db else registry.records
        results, databases = [], []
        for r in chosen:
            snapshots, over = SnapshotStore(spark, r.path), Overlay(spark, f"{r.path}/overlay")
            if (cold := snapshots.snapshot()) is None:
                continue
            changes = over.state() if over.pointer()["deltas"] else None
            results.append(cold.drop("gate") if changes is None else current(over, cold, db=r.name))
            path = index_path(snapshots.manifest()["version"])
            if store.exists(path):
                databases.append(Indexed(r.name, ContentIndex(spark, path), changes))
    if not results:
        raise SystemExit("nothing is indexed yet")
    files = results[0]
    for more in results[1:]:
        files = files.unionByName(more)
    if not a.direct and (a.line_number or a.context is not None):
        hits = search_lines(files, request, a.context)
        if a.count:
            print(hits.count(), file=out)
            return
        for r in render(hits, a.context is not None).orderBy("path", "line_no").toLocalIterator():
            print(r["rendered"], file=out)
        return
    if a.direct and request.cap is not None:
        files = files.limit(request.cap)
    found = files if a.direct else indexed_search(databases, request) if uses_index(request) and len(databases) == len(results) else search(files, request, unique=len(results) == 1)
    if a.count:
        print(found.count(), file=out)
        return
    shown = highlight(F.col("path"), a.query, request.opts.case.sensitive(a.query)) if a.color == "always" or (a.color == "auto" and out.isatty()) else F.col("path")
    if a.exec:
        text = exec_command(a.exec, F.col("path"))
    else:
        text = F.col("path") if a.null else long_line(F.col("kind"), F.col("size"), shown, F.col("is_dir")) if a.long else shown
    for r in found.select(text.alias("line")).toLocalIterator():
        print(r["line"], end="\0" if a.null else "\n", file=out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("trawl").getOrCreate()
    if not a.home:
        if not spark.sparkContext.master.startswith("local"):
            raise SystemExit("--home must name a folder that all executors share")
        a.home = os.path.expanduser("~/.trawl")
    store = FileStore(spark)
    registry_file, settings_file = f"{a.home}/registry.json", f"{a.home}/settings.json"
    registry, settings = Registry.load(store, registry_file), Settings.load(store, settings_file)
    if a.command == "search":
        print_search(spark, a, store, out, settings.ignore)
    elif a.command == "index":
        at = f"{a.home}/snapshots/{a.name}"
        if a.one_file_system:
            print("--one-file-system has no meaning here: object stores have no mounts", file=sys.stderr)
        extra = {"cap": a.max_file_size} if a.max_file_size else {}
        made = build(spark, a.root, SnapshotStore(spark, at), a.force, db=a.name, skip=tuple(a.skip), ignore=settings.ignore, hidden=a.hidden, content=not a.no_content, index=not (a.no_content or a.no_index), **extra)
        if made is None:
            raise SystemExit("another build is running")
        print(counters(made), file=out)
        registry.upsert(Database(a.name, a.root, at))
        registry.save(store, registry_file)
    elif a.command == "update":
        r = registry.get(a.name)
        snapshots, over, log = SnapshotStore(spark, r.path), Overlay(spark, f"{r.path}/overlay"), f"{r.path}/log"
        if (cold := snapshots.snapshot()) is None:
            raise SystemExit("nothing is indexed yet")
        capture(spark, r.root, current(over, cold, db=r.name), log, own=(a.home,), ignore=settings.ignore)
        watch(spark, log, f"{r.path}/overlay", cold=r.path, once=True).awaitTermination()
        print(overlay_length(over.state()).first()["paths"], "changed paths", file=out)
    elif a.command == "db":
        if a.action == "add":
            registry.upsert(Database(a.name, a.root, f"{a.home}/snapshots/{a.name}"))
            registry.save(store, registry_file)
        elif a.action == "remove":
            registry.remove(a.name)
            registry.save(store, registry_file)
        else:
            for r in registry.records:
                print(f"{r.name}\t{r.root}\t{r.path}", file=out)
    elif a.command == "config":
        if a.action in ("add", "remove"):
            (settings.add if a.action == "add" else settings.remove)(a.pattern)
            settings.save(store, settings_file)
        else:
            print("\n".join(settings.ignore), file=out)
    else:
        for r in status(spark, registry.records).collect():
            print("\t".join(str(x) for x in r), file=out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""Walks of a directory tree on the executors: what a build takes, without reading contents.

A task lists the directories it is given and what lies below them, up to DIRECTORIES of them, and hands the rest back;
the next round deals those out. Skipped, hidden and ignored directories are never entered. The rules of ignore files go
down the tree with the directories, so a directory knows those above it and no others.
"""

from __future__ import annotations

import functools
import json
import os
import re
import stat
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.patterns import IgnoreRule, ignore_rule
from trawl.sources.store import scratch

IGNORE_FILES = (".gitignore", ".ignore")
#: Directories that no build enters.
SKIP_DIRS = ("node_modules", "target", "build", "dist", ".next", "__pycache__", ".venv")
#: Directories that a task lists for each one given to it, at most.
DIRECTORIES = 500
FOUND = "path string, is_dir boolean, size bigint, mtime bigint, regular boolean, denied boolean, rules string"
_ARROW = pa.schema([("path", pa.string()), ("is_dir", pa.bool_()), ("size", pa.int64()), ("mtime", pa.int64()), ("regular", pa.bool_()), ("denied", pa.bool_()), ("rules", pa.string())])


def file_system(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root if "://" in root else f"file://{root}")


def is_walkable(root: str) -> bool:
    """Whether the executors can open the store themselves; others are left to Spark's readers."""
    try:
        file_system(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, NotImplementedError, OSError):
        return False
    return True


def anchored(line: str, inner: str) -> str | None:
    """A line of the ignore file in the directory ``inner`` (relative to the root) as a pattern over the whole tree."""
    line, sign = line.strip(), ""
    if line.startswith("!"):
        line, sign = line[1:], "!"
    if not line or line.startswith("#"):
        return None
    if inner:
        line = f"/{inner}{line}" if line.startswith("/") else f"/{inner}/{line}" if "/" in line.rstrip("/") else f"/{inner}/**/{line}"
    return sign + line


@functools.lru_cache(maxsize=20_000)
def _compiled(pattern: str, root: str) -> tuple[re.Pattern, IgnoreRule] | None:
    rule = ignore_rule(pattern, root)
    return (re.compile(rule.regex.replace(r"\z", r"\Z")), rule) if rule else None


def is_ignored(relative: str, is_dir: bool, patterns: tuple[tuple[str, str], ...]) -> bool:
    """Whether the last pattern that matches the path says so; directories above it are judged when they are listed."""
    for pattern, root in reversed(patterns):
        found = _compiled(pattern, root)
        if found and (is_dir or not found[1].dirs_only) and found[0].match(relative):
            return not found[1].keep
    return False


def _entries(store: pafs.FileSystem, path: str) -> list[tuple[str, bool, int, int, bool]]:
    """(name, is_dir, size, mtime, regular) of a directory's entries; links are not followed."""
    if isinstance(store, pafs.LocalFileSystem):
        out = []
        with os.scandir(path) as found:
            for e in found:
                try:
                    s = e.stat(follow_symlinks=False)
                    out.append((e.name, stat.S_ISDIR(s.st_mode), s.st_size, int(s.st_mtime), stat.S_ISREG(s.st_mode)))
                except OSError:
                    out.append((e.name, False, 0, 0, False))
        return sorted(x for x in out if x[0].isprintable() or _is_text(x[0]))
    infos = store.get_file_info(pafs.FileSelector(path, recursive=False))
    return sorted((i.base_name, i.type == pafs.FileType.Directory, i.size or 0, (i.mtime_ns or 0) // 1_000_000_000, i.type == pafs.FileType.File) for i in infos)


def _is_text(name: str) -> bool:
    """Names that are not valid UTF-8 are passed over."""
    try:
        name.encode()
    except UnicodeEncodeError:
        return False
    return True


def _ignore_lines(store: pafs.FileSystem, path: str, names: set[str]) -> list[str]:
    out = []
    for name in IGNORE_FILES:
        if name in names:
            try:
                with store.open_input_stream(f"{path}/{name}") as f:
                    out += f.read().decode("utf-8", "replace").splitlines()
            except OSError:
                continue
    return out


def _walk(root: str, skip: frozenset, fixed: tuple[str, ...], hidden: bool, use_ignore_files: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(root)
        base = base.rstrip("/")
        for batch in batches:
            for first, inherited in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                waiting, listed = deque([(first, json.loads(inherited))]), 0
                while waiting and listed < DIRECTORIES:
                    at, rules = waiting.popleft()
                    listed += 1
                    try:
                        entries = _entries(store, at)
                    except PermissionError:
                        rows.append((at, True, 0, 0, False, True, None))
                        continue
                    except OSError:  # gone since it was listed
                        continue
                    if use_ignore_files:
                        inner = at[len(base) :].strip("/")
                        rules = rules + [p for line in _ignore_lines(store, at, {e[0] for e in entries}) if (p := anchored(line, inner))]
                    patterns = tuple((p, "/") for p in rules) + tuple((p, base or "/") for p in fixed)
                    for name, is_dir, size, mtime, regular in entries:
                        path = f"{at.rstrip('/')}/{name}"
                        if (is_dir and name in skip) or (name.startswith(".") and not hidden) or is_ignored(path[len(base) :].lstrip("/"), is_dir, patterns):
                            continue
                        rows.append((path, is_dir, size, mtime, regular, False, None))
                        if is_dir:
                            waiting.append((path, rules))
                rows += [(path, True, 0, 0, False, None, json.dumps(rules)) for path, rules in waiting]  # for the next round
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

    return run


def walk(spark: SparkSession, root: str, skip: tuple[str, ...] = (), ignore: list[str] | None = None, hidden: bool = False, use_ignore_files: bool = True, skip_list: tuple[str, ...] = SKIP_DIRS) -> DataFrame:
    """What a build takes of the tree under root: path, is_dir, size, mtime, regular, denied.

    ``denied`` rows are directories that may not be listed; they stand beside the directory's own row. Explicit ignore
    patterns come after those of ignore files, and so win. The root itself is no row.
    """
    _, base = file_system(root)
    frontier = spark.createDataFrame([(base.rstrip("/") or "/", "[]")], "path string, rules string")
    run = _walk(root, frozenset((*skip_list, *skip)), tuple(ignore or []), hidden, use_ignore_files)
    rounds: list[str] = []
    tasks = 1
    while tasks:
        rounds.append(scratch(spark, "walk"))
        frontier.repartition(tasks).mapInArrow(run, FOUND).write.parquet(rounds[-1])
        frontier = spark.read.schema(FOUND).parquet(rounds[-1]).filter("denied IS NULL").select("path", "rules")
        tasks = min(frontier.count(), 16 * spark.sparkContext.defaultParallelism)
    return spark.read.schema(FOUND).parquet(*rounds).filter("denied IS NOT NULL").drop("rules")

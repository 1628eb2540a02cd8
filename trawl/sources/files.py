"""Files from a file system: the text gate, what is skipped, and scans of a tree with contents."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.patterns import IgnoreRule, ignore_rule, ignored
from trawl.functions.text import trigram_count
from trawl.sources.walk import SKIP_DIRS, file_system, is_walkable, walk

SIZE_CAP, NUL_WINDOW, TRIGRAM_LIMIT = 1_048_576, 8192, 20_000
#: Bytes of contents that a task reads, about.
READ = 64 << 20


def gate(size: Column, data: Column, cap: int = SIZE_CAP, trigram_limit: int = TRIGRAM_LIMIT, window: int = NUL_WINDOW) -> Column:
    """text, binary, large or unreadable: over the cap; a NUL in the first bytes; too many distinct trigrams.

    It looks at the bytes alone, so data of any encoding gets its verdict. Trigrams are counted only where there are
    bytes enough for so many.
    """
    nul = F.contains(F.substring(data, 1, window), F.lit(b"\x00"))
    many = (F.octet_length(data) > trigram_limit + 2) & (trigram_count(data) > trigram_limit)
    return F.when(data.isNull(), "unreadable").when(size > cap, "large").when(nul, "binary").when(many, "binary").otherwise("text")


def lossy(data: Column) -> Column:
    """Bytes as text; what is not valid UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def in_skipped_dir(path: Column, is_dir: Column, names: tuple[str, ...] = SKIP_DIRS) -> Column:
    """Whether a directory on the way (or the path itself, if one) has one of the exact names."""
    parts = F.split(path, "/")
    above = F.when(is_dir, parts).otherwise(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))
    return F.arrays_overlap(above, F.array(*map(F.lit, names))) if names else F.lit(False)


def is_hidden(relative: Column) -> Column:
    return relative.rlike(r"(^|/)\.[^/]")


def kept(relative: Column, is_dir: Column, skip: tuple[str, ...] = (), rules: list[IgnoreRule] | None = None, hidden: bool = False) -> Column:
    """Whether a build takes the path: default and extra skip lists, ignore patterns, hidden names."""
    tests = [~in_skipped_dir(relative, is_dir, tuple(dict.fromkeys((*SKIP_DIRS, *skip)))), ~ignored(relative, is_dir, rules or [])]
    if not hidden:
        tests.append(~is_hidden(relative))
    return reduce(and_, tests)


def compile_ignores(patterns: list[str], root: str) -> list[IgnoreRule]:
    return [r for p in patterns if (r := ignore_rule(p, root))]


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, mtime, size of all files under root; contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return raw.select(_plain("path").alias("path"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"))


def _plain(column: str) -> Column:
    return F.regexp_replace(column, r"^[a-z0-9]+:(//[^/]*)?", "")


def directories(files: DataFrame, root: str) -> DataFrame:
    """Directory rows (path, is_dir, size 0, mtime of the newest file below) derived from the files' paths."""
    top = root.rstrip("/")
    inner = F.split(F.substr(F.col("path"), F.lit(len(top) + 2)), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(inner) - 1), lambda n: F.concat(F.lit(top + "/"), F.array_join(F.slice(inner, F.lit(1), n), "/")))
    rows = files.select("mtime", inner.alias("i"), "path").filter(F.size("i") > 1).select("mtime", F.explode(above).alias("path"))
    return rows.groupBy("path").agg(F.max("mtime").alias("mtime")).select("path", F.lit(True).alias("is_dir"), F.lit(0).cast("bigint").alias("size"), "mtime")


def _read_files(root: str):
    def run(batches):
        store, _ = file_system(root)
        for batch in batches:
            data = []
            for path in batch.column(0).to_pylist():
                try:
                    with store.open_input_stream(path) as f:
                        data.append(f.read())
                except OSError:
                    data.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], [*batch.schema.names, "data"])

    return run


def with_contents(spark: SparkSession, root: str, walked: DataFrame, cap: int = SIZE_CAP) -> DataFrame:
    """Rows of a walk with content and gate: (path, is_dir, size, mtime, content, gate); content only of text.

    Files over the cap are never read. Only paths are dealt out, by the bytes to be read; contents stay where they are
    read.
    """
    none = F.lit(None).cast("string")
    rows = walked.filter("NOT denied")
    read = rows.filter((F.col("size") <= cap) & F.col("regular")).select("path", "size", "mtime")
    held = read.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    tasks = max(1, min(held["n"], max(spark.sparkContext.defaultParallelism, -(-(held["bytes"] or 0) // READ))))
    found = read.repartition(tasks).mapInArrow(_read_files(root), "path string, size bigint, mtime bigint, data binary")
    verdict = gate(F.col("size"), F.col("data"), cap)
    texts = found.select("path", F.lit(False).alias("is_dir"), "size", "mtime", "data", verdict.alias("gate")).select("path", "is_dir", "size", "mtime", F.when(F.col("gate") == "text", lossy(F.col("data"))).alias("content"), "gate")
    reason = F.when(F.col("is_dir"), none).when(F.col("size") > cap, "large").otherwise("unreadable")
    rest = rows.filter(~((F.col("size") <= cap) & F.col("regular"))).select("path", "is_dir", "size", "mtime", none.alias("content"), reason.alias("gate"))
    return texts.unionByName(rest)


def _by_reader(spark: SparkSession, root: str, cap: int, skip: tuple, ignore: list[str], hidden: bool, content: bool) -> DataFrame:
    """A scan through Spark's own file reader, for stores that only it can open: empty files and names with a leading dot
    or underscore are not seen, nor are ignore files."""
    top, no, none = root.rstrip("/"), F.lit(False), F.lit(None).cast("string")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    raw = raw.select(_plain("path").alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("content").alias("data"))
    inner_top = _plain_root(top)
    columns = ("path", no.alias("is_dir"), "size", "mtime")
    if content:
        small = raw.filter(F.col("size") <= cap).select(*columns, gate(F.col("size"), F.col("data"), cap).alias("gate"), "data")
        found = small.select("path", "is_dir", "size", "mtime", F.when(F.col("gate") == "text", lossy(F.col("data"))).alias("content"), "gate")
        found = found.unionByName(raw.filter(F.col("size") > cap).select(*columns, none.alias("content"), F.lit("large").alias("gate")))
    else:
        found = raw.select(*columns, none.alias("content"), none.alias("gate"))
    dirs = directories(raw.select("path", "mtime"), inner_top).select("path", "is_dir", "size", "mtime", none.alias("content"), none.alias("gate"))
    relative = F.substr(F.col("path"), F.lit(len(inner_top) + 2))
    return found.unionByName(dirs).filter(kept(relative, F.col("is_dir"), skip, compile_ignores(ignore, inner_top), hidden))


def _plain_root(root: str) -> str:
    return re.sub(r"^[a-z0-9]+:(//[^/]*)?", "", root)


def scan(spark: SparkSession, root: str, db: str = "default", cap: int = SIZE_CAP, skip: tuple[str, ...] = (), ignore: list[str] | None = None, hidden: bool = False, content: bool = True, use_ignore_files: bool = True, walked: DataFrame | None = None) -> DataFrame:
    """All files and directories under root as files(..., gate): content only where the gate says text.

    The tree is listed on the executors (or taken from ``walked``) and its small files are read there; bytes of any
    encoding are taken. One row per path, without a shuffle of contents.
    """
    none = F.lit(None).cast("string")
    if walked is None and not is_walkable(root):
        out = _by_reader(spark, root, cap, skip, ignore or [], hidden, content)
    else:
        walked = walk(spark, root, skip, ignore, hidden, use_ignore_files) if walked is None else walked
        if content:
            out = with_contents(spark, root, walked, cap)
        else:
            out = walked.filter("NOT denied").select("path", "is_dir", "size", "mtime", none.alias("content"), none.alias("gate"))
    return out.select(F.lit(db).alias("db"), "path", "is_dir", "size", "mtime", "content", "gate")


def build_report(scanned: DataFrame) -> DataFrame:
    """One row: filename_docs, content_docs, denied (unknown here), skipped_binary, skipped_large."""
    count = lambda g: F.count_if(F.col("gate") == g)
    return scanned.agg(F.count(F.lit(1)).alias("filename_docs"), count("text").alias("content_docs"), F.lit(None).cast("bigint").alias("denied"), count("binary").alias("skipped_binary"), count("large").alias("skipped_large"))


def direct_scan(spark: SparkSession, root: str, query: str, opts=None, scope: str | None = None, ignore: list[str] | None = None, hidden: bool = False) -> DataFrame:
    """Search over a fresh listing: substring of the path by the request's case, and path filters; size and mtime are 0.

    Hidden and ignored names are left out, the build's skip list is not asked. An empty query finds nothing.
    """
    from trawl.model import Options
    from trawl.operators.filters import path_filter

    opts = opts or Options()
    if is_walkable(root):
        listed = walk(spark, root, ignore=ignore, hidden=hidden, skip_list=()).filter("NOT denied").select("path", "is_dir")
    else:
        listed = list_files(spark, root).select("path", F.lit(False).alias("is_dir"))
    found = F.col("path").contains(query) if opts.case.sensitive(query) else F.lower("path").contains(query.lower())
    hits = listed.filter(found if query else F.lit(False)).filter(path_filter(opts, scope))
    zero = F.lit(0).cast("bigint")
    return hits.select("path", "is_dir", zero.alias("size"), zero.alias("mtime"), F.lit("filename").alias("kind"))

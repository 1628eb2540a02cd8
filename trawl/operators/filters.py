"""Filters on paths, each a Column; all hold together."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.patterns import glob_match
from trawl.functions.text import depth, extension, strip_dot
from trawl.model import Options

#: The extensions of each category.
TYPES = {
    "code": "rs go py js mjs cjs ts jsx tsx c h cpp cc cxx hpp hh java kt kts scala rb pl pm php swift m mm sh bash zsh fish lua r jl ex exs erl hs lhs ml mli clj cljs cljc vim el lisp scm sql",
    "docs": "md markdown rst txt tex adoc asciidoc org pdf",
    "config": "toml yaml yml json json5 ini cfg conf xml env",
    "web": "html htm css scss sass less vue svelte",
    "archive": "zip tar gz tgz bz2 xz zst 7z rar lz",
    "media": "png jpg jpeg gif bmp tiff tif svg ico webp mp3 wav flac aac ogg mp4 mkv webm avi mov m4a m4v",
}


def type_extensions(category: str) -> list[str]:
    return TYPES.get(category, "").split()


def types_table(spark: SparkSession) -> DataFrame:
    """The categories as a small table (category, ext), for semi-joins."""
    return spark.createDataFrame([(k, e) for k in TYPES for e in type_extensions(k)], "category string, ext string")


def in_scope(path: Column, scope: str | None) -> Column:
    """Whether path lies in the subtree of scope, by whole components; no scope takes all."""
    if not scope:
        return F.lit(True)
    plain = lambda c: F.regexp_replace(F.regexp_replace(strip_dot(c), r"/(\./)+", "/"), r"/{2,}", "/")
    own = "/".join(x for k, x in enumerate(scope.split("/")) if x not in ("", ".") or (k == 0 and x == ""))
    if own in ("", "."):
        return F.lit(True) if not scope.startswith("/") else path.startswith("/")
    bare = plain(path)
    return (bare == own) | bare.startswith(own + "/")


def any_glob(path: Column, globs: tuple[str, ...], by_byte: bool = False) -> Column:
    return reduce(or_, [glob_match(path, g, by_byte) | glob_match(strip_dot(path), g, by_byte) for g in globs])


def path_filter(opts: Options, scope: str | None = None, path: Column | None = None) -> Column:
    """Scope, extensions, types, excluded and included globs, and depth, together."""
    path = F.col("path") if path is None else path
    keep = in_scope(path, scope)
    if opts.ext:
        keep = keep & extension(path).isin(list(opts.ext))
    if opts.types:
        keep = keep & extension(path).isin([e for t in opts.types for e in type_extensions(t)] or [None])
    if opts.exclude:
        keep = keep & ~any_glob(path, opts.exclude, opts.byte_glob)
    if opts.glob:
        keep = keep & any_glob(path, opts.glob, opts.byte_glob)
    if opts.depth is not None:
        keep = keep & (depth(path) <= opts.depth)
    return F.coalesce(keep, F.lit(False))

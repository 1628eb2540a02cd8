"""Schemas, enumerations and request objects."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("db", T.StringType()), T.StructField("path", T.StringType()), T.StructField("is_dir", T.BooleanType()),
    T.StructField("size", T.LongType()), T.StructField("mtime", T.LongType()), T.StructField("content", T.StringType()),
])
CHANGES = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("path", T.StringType()), T.StructField("is_dir", T.BooleanType()),
    T.StructField("size", T.LongType()), T.StructField("mtime", T.LongType()), T.StructField("content", T.StringType()),
])


class Case(str, Enum):
    SMART, INSENSITIVE, SENSITIVE = "smart", "insensitive", "sensitive"

    def sensitive(self, pattern: str) -> bool:
        """Smart: sensitive if the raw pattern has an ASCII capital."""
        if self is Case.SMART:
            return any("A" <= c <= "Z" for c in pattern)
        return self is Case.SENSITIVE


class Layers(str, Enum):
    BOTH, FILENAME, CONTENT = "both", "filename", "content"


class PathMode(str, Enum):
    FULL, BASENAME = "full", "basename"


class Sort(str, Enum):
    DEFAULT, PATH, KIND, NONE = "default", "path", "kind", "none"


@dataclass(frozen=True)
class Options:
    case: Case = Case.SMART
    layers: Layers = Layers.BOTH
    path_mode: PathMode = PathMode.FULL
    sort: Sort = Sort.DEFAULT
    regex: bool = False
    raw: bool = False
    boolean_content: bool = False
    ext: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    glob: tuple[str, ...] = ()
    byte_glob: bool = False
    depth: int | None = None
    expr: str | None = None
    max_results: int | None = None


@dataclass(frozen=True)
class SearchRequest:
    query: str
    scope: str | None = None
    limit: int | None = None
    db: str | None = None
    opts: Options = field(default_factory=Options)

    @property
    def cap(self) -> int | None:
        return self.opts.max_results if self.opts.max_results is not None else self.limit

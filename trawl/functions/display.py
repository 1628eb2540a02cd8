"""Output formatting as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RED, RESET = "\x1b[1;31m", "\x1b[0m"
FRESH_BUILD, STALE_BUILD, FRESH_STATUS = 60, 7 * 86_400, 86_400


def humansize(size: Column) -> Column:
    """Bytes below 1 K, then one decimal (ties to even) in K, M, G, T; negative counts as 0."""
    n = F.greatest(size.cast("bigint"), F.lit(0))
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit("B")))
    for power, unit in enumerate("KMG", 1):
        out = out.when(n < 1024 ** (power + 1), F.format_string("%.1f" + unit, F.bround(n / float(1024**power), 1)))
    return out.otherwise(F.format_string("%.1fT", F.bround(n / float(1024**4), 1)))


def kind_marker(kind: Column) -> Column:
    return F.when(kind == "filename", "[f]").when(kind == "content", "[c]").otherwise("[b]")


def kind_weight(kind: Column) -> Column:
    return F.when(kind == "both", 0).when(kind == "content", 1).otherwise(2)


def highlight(path: Column, query: str, sensitive: bool = False) -> Column:
    """path with the first occurrence of query in bold red; unchanged where lower-casing changes its byte length."""
    if not query:
        return path
    where = path if sensitive else F.lower(path)
    needle = query if sensitive else query.lower()
    at = F.instr(where, needle)
    painted = F.concat(F.substring(path, F.lit(1), at - 1), F.lit(RED), F.substring(path, at, F.lit(len(needle))), F.lit(RESET), F.substring(path, at + len(needle), F.length(path)))
    safe = F.lit(True) if sensitive else F.octet_length(where) == F.octet_length(path)
    return F.when((at > 0) & safe, painted).otherwise(path)


def long_line(kind: Column, size: Column, shown: Column, is_dir: Column) -> Column:
    return F.concat(kind_marker(kind), F.lit("\t"), humansize(size), F.lit("\t"), shown, F.when(is_dir, "/").otherwise(""))


def exec_command(template: str, path: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{}"), path)


def build_state(age: Column) -> Column:
    """fresh below a minute (a rebuild is skipped), stale above seven days (a search warns), else usable."""
    return F.when(age.isNull(), "missing").when(age < FRESH_BUILD, "fresh").when(age > STALE_BUILD, "stale").otherwise("usable")


def status_state(age: Column, indexing: Column) -> Column:
    return F.when(indexing, "indexing").when(age.isNull(), "missing").when(age < FRESH_STATUS, "fresh").otherwise("stale")

"""Path and text helpers as Columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_fold(c: Column) -> Column:
    """A-Z to a-z, nothing else: the fold of the content layer."""
    return F.translate(c, UPPER, LOWER)


def fold_needle(query: str) -> str:
    return "".join(LOWER[UPPER.index(c)] if c in UPPER else c for c in query.lower())


def strip_dot(path: Column) -> Column:
    return F.regexp_replace(path, r"^\./", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the name; empty for dot files and names without a dot."""
    return F.regexp_extract(path, r"(?s)[^/]\.([^./]*)\z", 1)


def depth(path: Column) -> Column:
    """Slashes in the path without a leading ./ ; the first slash of an absolute path counts."""
    bare = strip_dot(path)
    return F.length(bare) - F.length(F.replace(bare, F.lit("/"), F.lit("")))


def bytes_view(c: Column) -> Column:
    """One character per UTF-8 byte."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def distinct_trigrams(data: bytes) -> np.ndarray:
    """Distinct runs of three bytes of the data with A-Z folded, as numbers in order; none below three bytes."""
    codes = np.frombuffer(data.lower(), np.uint8).astype(np.int32)  # bytes.lower folds A-Z alone
    if len(codes) < 3:
        return np.zeros(0, np.int32)
    return np.unique(codes[:-2] << 16 | codes[1:-1] << 8 | codes[2:])


@F.arrow_udf(T.IntegerType())
def _trigram_count(data: pa.Array) -> pa.Array:
    return pa.array([None if x is None else len(distinct_trigrams(x)) for x in data.to_pylist()], pa.int32())


def trigram_count(data: Column) -> Column:
    """Number of distinct trigrams of the bytes, A-Z folded; null stays null.

    Sorting numbers in Arrow batches takes a tenth of the time of a string expression with a hash of substrings.
    """
    return _trigram_count(data)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _trigrams(text: pa.Array) -> pa.Array:
    return pa.array([None if x is None else distinct_trigrams(x.encode()) for x in text.to_pylist()], pa.list_(pa.int32()))


def trigrams(text: Column) -> Column:
    """Numbers of the distinct trigrams of a text's UTF-8 bytes, A-Z folded; empty below three bytes."""
    return _trigrams(text)


def trigram_key(trigram: Column) -> Column:
    """Six hex digits of a trigram's number."""
    return F.lpad(F.hex(trigram), 6, "0")


def needle_trigrams(folded: str) -> list[str]:
    """Hex keys of the distinct trigrams of a folded needle."""
    data = folded.encode()
    return sorted({data[i : i + 3].hex().upper() for i in range(len(data) - 2)})


def lines(content: Column) -> Column:
    """The lines of a text without their line feeds; a final line feed starts no further line."""
    parts = F.split(content, "\n", -1)
    return F.when(content.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def required_literal(pattern: str, sensitive: bool) -> str | None:
    """The longest run of characters that every match of the regular expression holds, or None.

    Patterns with alternation, groups or flags have none here; a character under a quantifier that allows zero times
    breaks a run. Without regard to case, characters whose case variants lie outside a-z break a run too. Of runs of one
    length the first counts.
    """
    if any(c in pattern for c in "|("):
        return None
    runs, run, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            e = pattern[i + 1 : i + 2]
            i += 2
            if not e or e.isalnum() or not e.isascii():
                runs.append(run)
                run = ""
                # \\x{..}, \\u...., \\p{..} and others take what follows
                if e not in tuple("wWdDsSbBAzZntrfv"):
                    return max(runs, key=len) or None
                continue
            c = e
        elif c == "[":
            close = pattern.find("]", i + (3 if pattern[i + 1 : i + 2] == "^" else 2))
            if close < 0 or "[" in pattern[i + 1 : close] or "\\" in pattern[i + 1 : close]:
                return max([*runs, run], key=len) or None
            runs.append(run)
            run, i = "", close + 1
            continue
        elif c in ".^$":
            runs.append(run)
            run, i = "", i + 1
            continue
        elif c in "*?{+":
            if c != "+":
                run = run[:-1]
            runs.append(run)
            run = ""
            i = pattern.find("}", i) + 1 if c == "{" and "}" in pattern[i:] else i + 1
            continue
        else:
            i += 1
        if sensitive or (c.isascii() and c not in "iIkKsS"):
            run += c if sensitive else c.lower()
        else:
            runs.append(run)
            run = ""
    return max([*runs, run], key=len) or None

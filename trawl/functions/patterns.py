"""Globs, regular expressions and ignore patterns, translated to Java regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawl.functions.text import bytes_view


def quote(text: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}&#~\-])", r"\\\1", text)


def glob_regex(glob: str) -> str:
    """``*`` is any run, slashes too; ``?`` one character; the rest stands for itself; the whole string matches."""
    return r"(?s)\A" + "".join(".*" if c == "*" else "." if c == "?" else quote(c) for c in re.sub(r"\*+", "*", glob)) + r"\z"


def glob_match(c: Column, glob: str, by_byte: bool = False) -> Column:
    """by_byte: ``?`` takes one byte, so it can't match a multibyte character alone."""
    if by_byte:
        return bytes_view(c).rlike(glob_regex(glob.encode().decode("latin-1")))
    return c.rlike(glob_regex(glob))


_POSIX = {"alpha": r"\p{IsAlphabetic}", "digit": "0-9", "alnum": r"\p{IsAlphabetic}0-9", "upper": "A-Z", "lower": "a-z", "space": r"\s", "word": r"\w", "punct": r"\p{Punct}", "xdigit": "0-9A-Fa-f", "cntrl": r"\p{Cntrl}", "blank": r" \t", "print": r"\p{Print}", "graph": r"\p{Graph}"}


def java_regex(pattern: str, sensitive: bool) -> str:
    """A linear-time-dialect pattern in Java's dialect: Unicode classes, ``$`` at the very end, no look-around.

    Raises ValueError for what the query dialect does not have.
    """
    out, i, n, in_class, multiline = [], 0, len(pattern), 0, False
    while i < n:
        c = pattern[i]
        if c == "\\":
            if i + 1 == n:
                raise ValueError("the pattern ends in a backslash")
            e = pattern[i + 1]
            if e.isdigit() or e in "kGZXRhHVE":
                raise ValueError(f"\\{e} is not supported")
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            posix = re.match(r"\[:(\^?)(\w+):\]", pattern[i:])
            if posix and posix[2] in _POSIX:
                out.append(f"[^{_POSIX[posix[2]]}]" if posix[1] else _POSIX[posix[2]])
                i += posix.end()
                continue
            if c == "[":
                in_class += 1
            elif c == "]":
                in_class -= 1
            out.append(c)
        elif c == "[":
            in_class = 1
            head = re.match(r"\[\^?\]?", pattern[i:])[0]
            out.append(head.replace("]", r"\]"))
            i += len(head)
            continue
        elif c == "(" and pattern.startswith("(?", i):
            if re.match(r"\(\?(?:[=!>]|<[=!])", pattern[i:]):
                raise ValueError("look-around and atomic groups are not supported")
            flags = re.match(r"\(\?([a-zA-Z]*)(-[a-zA-Z]+)?[:)]", pattern[i:])
            if flags and "m" in flags[1]:
                multiline = True
            if pattern.startswith("(?P<", i):
                out.append("(?<")
                i += 4
                continue
            out.append(c)
        elif c == "$" and not multiline:
            out.append(r"\z")
        elif c == "+" and out and re.search(r"(?<!\\)[*+?}]$", "".join(out[-2:])):
            raise ValueError("possessive quantifiers are not supported")
        else:
            out.append(c)
        i += 1
    if in_class:
        raise ValueError("a character class is not closed")
    body = "".join(out)
    try:
        re.compile(re.sub(r"\\[pP](\{[^}]*\}|\w)", "x", body).replace(r"\z", "$").replace("(?<", "(?P<"))
    except re.error as e:
        if "global flags" not in str(e) and "inline flags" not in str(e) and "unknown extension" not in str(e):
            raise ValueError(f"bad pattern: {e}") from e
    return ("(?dU)" if sensitive else "(?dUi)") + body


@dataclass(frozen=True)
class IgnoreRule:
    regex: str
    keep: bool
    dirs_only: bool


def ignore_rule(pattern: str, root: str = "/") -> IgnoreRule | None:
    """One ignore pattern as a rule over paths relative to root; None where it can match nothing or is malformed.

    A pattern with a slash before its end is anchored at root; an absolute path under root becomes anchored, one
    outside is dropped. ``*`` and ``?`` stay within a name, ``**`` spans names, a final slash means directories.
    """
    p = pattern.strip()
    if not p or p.startswith("#"):
        return None
    keep = p.startswith("!")
    p = p[1:] if keep else p
    base = root.rstrip("/") + "/"
    if p.startswith("/") and base != "/":
        if (p + "/").startswith(base):
            p = "/" + p[len(base) :]
        else:
            return None
    dirs_only = p.endswith("/") and p != "/"
    p = p.rstrip("/") if dirs_only else p
    anchored = "/" in p
    p = p.lstrip("/")
    if not p:
        return None
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i) and (i == 0 or p[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif p[i:] == "**" and i and p[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif p[i] == "*":
            while i < len(p) and p[i] == "*":
                i += 1
            out += "[^/]*"
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[":
            end = p.find("]", i + 2)
            if end < 0:
                return None
            body = p[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out, i = out + "[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]", end + 1
        elif p[i] == "\\" and i + 1 < len(p):
            out, i = out + quote(p[i + 1]), i + 2
        else:
            out, i = out + quote(p[i]), i + 1
    return IgnoreRule(r"(?s)\A" + ("" if anchored else "(?:.*/)?") + out + r"\z", keep, dirs_only)


def ignored(relative: Column, is_dir: Column, rules: list[IgnoreRule]) -> Column:
    """Whether the path or any directory above it is ignored: for each, the last rule that matches decides."""
    if not rules:
        return F.lit(False)
    parts = F.split(relative, "/")

    def verdict(i: Column) -> Column:
        prefix, directory = F.array_join(F.slice(parts, F.lit(1), i), "/"), (i < F.size(parts)) | is_dir
        out = None
        for rule in reversed(rules):
            hit = prefix.rlike(rule.regex) & (directory if rule.dirs_only else F.lit(True))
            out = F.when(hit, not rule.keep) if out is None else out.when(hit, not rule.keep)
        return out.otherwise(False)

    return F.exists(F.sequence(F.lit(1), F.size(parts)), verdict)

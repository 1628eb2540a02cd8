"""Find-style expressions: -name, -path, -size, -newer with ! -a -o and parentheses, compiled to a predicate."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawl.functions.patterns import glob_match
from trawl.functions.text import basename

UNITS = {"": 1, "c": 1, "k": 1024, "M": 1024**2, "G": 1024**3}
LARGEST = 2**63 - 1
NOT, AND, OR = ("!", "-not"), ("-a", "-and"), ("-o", "-or")


@dataclass(frozen=True)
class Test:
    name: str
    value: str


@dataclass(frozen=True)
class Node:
    kind: str  # not, and, or
    parts: tuple


def parse_size(text: str) -> tuple[str, int]:
    """(comparison, bytes) of ``[+|-]N[c|k|M|G]``; products stop at the largest 64-bit number."""
    m = re.fullmatch(r"([+-]?)(\d+)([ckMG]?)", text)
    if not m:
        raise ValueError(f"bad size {text!r}")
    return {"+": ">", "-": "<", "": "="}[m[1]], min(int(m[2]) * UNITS[m[3]], LARGEST)


def _bare(token: str) -> str:
    return token[1:-1] if len(token) >= 2 and token[0] == token[-1] and token[0] in "'\"" else token


class _Reader:
    def __init__(self, source: str):
        self.items = source.split()[::-1]

    def next(self) -> str | None:
        return self.items[-1] if self.items else None

    def joined(self, below: Callable, kind: str, signs: tuple, more: Callable[[str | None], bool]):
        parts = [below()]
        while self.next() in signs or more(self.next()):
            if self.next() in signs:
                self.items.pop()
            parts.append(below())
        return parts[0] if len(parts) == 1 else Node(kind, tuple(parts))

    def either(self):
        return self.joined(self.both, "or", OR, lambda t: False)

    def both(self):
        starts = lambda t: t is not None and t not in OR and (t == "(" or t in NOT or t.startswith("-"))
        return self.joined(self.factor, "and", AND, starts)

    def factor(self):
        if not self.items:
            raise ValueError("the expression ends early")
        word = self.items.pop()
        if word in NOT:
            return Node("not", (self.factor(),))
        if word == "(":
            node = self.either()
            if self.next() != ")":
                raise ValueError("a parenthesis is not closed")
            self.items.pop()
            return node
        if word not in ("-name", "-path", "-size", "-newer"):
            raise ValueError(f"unknown predicate {word!r}")
        if not self.items:
            raise ValueError(f"{word} needs an argument")
        value = _bare(self.items.pop())
        if word == "-size":
            parse_size(value)
        return Test(word[1:], value)


def parse(source: str):
    """The expression's tree; raises ValueError where it is no expression."""
    reader = _Reader(source)
    node = reader.either()
    if reader.items:
        raise ValueError(f"unexpected {reader.items[-1]!r}")
    return node


def references(node) -> set[str]:
    """The files whose times -newer compares with."""
    if isinstance(node, Test):
        return {node.value} if node.name == "newer" else set()
    return set().union(*map(references, node.parts))


def column(node, mtimes: dict[str, int], by_byte: bool = False) -> Column:
    """The predicate over path, size and mtime; unknown values are false before any negation."""
    if isinstance(node, Node):
        parts = [column(x, mtimes, by_byte) for x in node.parts]
        if node.kind == "not":
            return ~parts[0]
        out = parts[0]
        for part in parts[1:]:
            out = out & part if node.kind == "and" else out | part
        return out
    if node.name == "name":
        test = glob_match(basename(F.col("path")), node.value, by_byte)
    elif node.name == "path":
        test = glob_match(F.col("path"), node.value, by_byte)
    elif node.name == "size":
        sign, n = parse_size(node.value)
        size = F.col("size")
        test = size > n if sign == ">" else size < n if sign == "<" else size == n
    else:
        at = mtimes.get(node.value)
        test = F.col("mtime") > at if at is not None else F.lit(False)
    return F.coalesce(test, F.lit(False))

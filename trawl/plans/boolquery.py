"""Boolean queries: words, NOT, AND (also by adjacency), OR and parentheses, compiled to a predicate."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column


@dataclass(frozen=True)
class Term:
    word: str

    def text(self) -> str:
        return self.word

    def column(self, term: Callable[[str], Column]) -> Column:
        return term(self.word)


@dataclass(frozen=True)
class Not:
    of: object

    def text(self) -> str:
        return f"NOT ({self.of.text()})"

    def column(self, term: Callable[[str], Column]) -> Column:
        return ~self.of.column(term)


@dataclass(frozen=True)
class Both:
    left: object
    right: object

    def text(self) -> str:
        return f"({self.left.text()}) AND ({self.right.text()})"

    def column(self, term: Callable[[str], Column]) -> Column:
        return self.left.column(term) & self.right.column(term)


@dataclass(frozen=True)
class Either:
    left: object
    right: object

    def text(self) -> str:
        return f"({self.left.text()}) OR ({self.right.text()})"

    def column(self, term: Callable[[str], Column]) -> Column:
        return self.left.column(term) | self.right.column(term)


class _Malformed(Exception):
    pass


def tokens(query: str) -> list[str]:
    return re.findall(r"[()]|[^\s()]+", query)


class _Reader:
    """Operator precedence: each level folds the operands of the next tighter one."""

    def __init__(self, items: list[str]):
        self.items = items[::-1]

    def next_is(self, *values: str) -> bool:
        return bool(self.items) and self.items[-1] in values

    def disjunction(self):
        node = self.conjunction()
        while self.next_is("OR"):
            self.items.pop()
            node = Either(node, self.conjunction())
        return node

    def conjunction(self):
        node = self.operand()
        while self.items and not self.next_is("OR", ")"):
            if self.next_is("AND"):
                self.items.pop()
            node = Both(node, self.operand())
        return node

    def operand(self):
        if not self.items:
            raise _Malformed
        word = self.items.pop()
        if word == "NOT":
            return Not(self.operand())
        if word == "(":
            node = self.disjunction()
            if not self.next_is(")"):
                raise _Malformed
            self.items.pop()
            return node
        if word in (")", "AND", "OR"):
            raise _Malformed
        return Term(word)


def parse(query: str):
    """The query's tree, or None where it is malformed (it is then one literal)."""
    reader = _Reader(tokens(query))
    try:
        node = reader.disjunction()
    except _Malformed:
        return None
    return None if reader.items else node

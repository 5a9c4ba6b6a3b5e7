"""The graph query language as text.

    MATCH (v[:Kind]) (-[:type[*[min][..[max]]]]->(v[:Kind]))*
    [WHERE v.field op value (AND ...)*] RETURN item (, item)* [ORDER BY item [ASC|DESC]] [LIMIT n]

An item is ``v.field`` or one of COUNT, SUM, AVG, MIN, MAX, COLLECT over one;
COUNT also takes ``*``.  Keywords are in any case.  Strings stand in either quote,
without escapes.  As an extension, names in backquotes may hold any character,
so kinds and types with hyphens can be written.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import NamedTuple

#: Fixed value: the most hops of a variable-length pattern.
MOST_HOPS = 10
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX", "COLLECT")


class QuerySyntaxError(ValueError):
    """The text is not a query; the message says where."""


class Node(NamedTuple):
    var: str
    kind: str | None


class Hop(NamedTuple):
    type: str
    low: int
    high: int
    node: Node

    @property
    def fixed(self) -> bool:
        return self.low == self.high == 1 and not self.starred

    starred: bool = False


class Item(NamedTuple):
    """``v.field``, under an aggregate if there is one; ``COUNT(*)`` has the variable ``*``."""

    var: str
    field: str
    aggregate: str | None = None

    @property
    def title(self) -> str:
        if self.aggregate is None:
            return f"{self.var}.{self.field}"
        return f"{self.aggregate}({'*' if self.var == '*' else f'{self.var}.{self.field}'})"


class Test(NamedTuple):
    item: Item
    op: str
    value: str


@dataclass(frozen=True)
class Statement:
    start: Node
    hops: tuple[Hop, ...]
    tests: tuple[Test, ...]
    items: tuple[Item, ...]
    order: Item | None
    descending: bool
    limit: int | None


_LEXEMES = re.compile(
    r"""(?P<space>[ \t\r\n]+)|'(?P<single>[^']*)'|"(?P<double>[^"]*)"|`(?P<quoted>[^`]+)`|(?P<number>[0-9][0-9.\-]*)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<sign>->|[=!<>]=?|[()\[\],.:*\-])"""
)
_HOPS = re.compile(r"(\d+)?(\.\.)?(\d+)?")


class _Reader:
    """A cursor over (class, text) pairs; strings and quoted names count as their own classes."""

    def __init__(self, text: str):
        self.items: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _LEXEMES.match(text, at)
            if m is None:
                raise QuerySyntaxError(f"cannot read {text[at : at + 10]!r} at {at}")
            kind = m.lastgroup or ""
            if kind != "space":
                self.items.append(({"single": "text", "double": "text", "quoted": "name!"}.get(kind, kind), m.group(kind)))
            at = m.end()
        self.at = 0

    def sees(self, *words: str) -> bool:
        """Whether the signs or keywords ``words`` come next."""
        for k, word in enumerate(words):
            kind, text = self.items[self.at + k] if self.at + k < len(self.items) else ("end", "")
            if kind not in ("sign", "name") or text.upper() != word:
                return False
        return True

    def takes(self, *words: str) -> bool:
        found = self.sees(*words)
        self.at += len(words) * found
        return found

    def must(self, *words: str) -> None:
        if not self.takes(*words):
            raise QuerySyntaxError(f"expected {' '.join(words)}, found {self.rest()!r}")

    def one(self, *kinds: str) -> str:
        if self.at < len(self.items) and self.items[self.at][0] in kinds:
            self.at += 1
            return self.items[self.at - 1][1]
        raise QuerySyntaxError(f"expected a {kinds[0]}, found {self.rest()!r}")

    def rest(self) -> str:
        return self.items[self.at][1] if self.at < len(self.items) else "the end"


def _node(r: _Reader) -> Node:
    r.must("(")
    var = r.one("name")
    kind = r.one("name", "name!") if r.takes(":") else None
    r.must(")")
    return Node(var, kind)


def _hop(r: _Reader) -> Hop:
    r.must("[", ":")
    kind = r.one("name", "name!")
    low = high = 1
    starred = r.takes("*")
    if starred:
        # The range's digits and dots come as one number, or as dots and a number.
        text = ""
        while r.takes("."):
            text += "."
        if r.items[r.at : r.at + 1] and r.items[r.at][0] == "number":
            text += r.one("number")
        m = _HOPS.fullmatch(text)
        if m is None:
            raise QuerySyntaxError(f"{text!r} is no range of hops")
        first, dots, last = m.groups()
        held = lambda n: min(max(int(n), 1), MOST_HOPS)
        low = held(first) if first else 1
        high = held(last) if last else (MOST_HOPS if dots or not first else low)
    r.must("]", "->")
    return Hop(kind, low, high, _node(r), starred)


def _item(r: _Reader) -> Item:
    for name in AGGREGATES:
        if r.takes(name, "("):
            if name == "COUNT" and r.takes("*", ")"):
                return Item("*", "", name)
            inner = _field(r)
            r.must(")")
            return Item(inner.var, inner.field, name)
    return _field(r)


def _field(r: _Reader) -> Item:
    var = r.one("name")
    r.must(".")
    return Item(var, r.one("name"))


def _test(r: _Reader) -> Test:
    item = _field(r)
    for op in ("=", "!=", ">=", "<=", ">", "<", "CONTAINS", "IN"):
        if r.takes(op):
            return Test(item, op, r.one("text", "number", "name"))
    raise QuerySyntaxError(f"expected a comparison, found {r.rest()!r}")


def parse(text: str) -> Statement:
    """The syntax tree of ``text``; QuerySyntaxError if it is none."""
    r = _Reader(text)
    r.must("MATCH")
    start, hops = _node(r), []
    while r.takes("-"):
        hops.append(_hop(r))
    tests = []
    if r.takes("WHERE"):
        tests.append(_test(r))
        while r.takes("AND"):
            tests.append(_test(r))
    r.must("RETURN")
    items = [_item(r)]
    while r.takes(","):
        items.append(_item(r))
    order, descending = None, False
    if r.takes("ORDER", "BY"):
        order = _item(r)
        descending = r.takes("DESC")
        if not descending:
            r.takes("ASC")
    limit = None
    if r.takes("LIMIT"):
        digits = r.one("number")
        if not digits.isdigit():
            raise QuerySyntaxError(f"{digits!r} is no limit")
        limit = int(digits)
    if r.at < len(r.items):
        raise QuerySyntaxError(f"unexpected {r.rest()!r} after the query")
    return Statement(start, tuple(hops), tuple(tests), tuple(items), order, descending, limit)

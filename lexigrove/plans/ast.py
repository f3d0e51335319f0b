"""Expressions of the region algebra."""

from __future__ import annotations

from dataclasses import dataclass


class Node:
    """An expression; each gives intervals of tokens of which none holds another."""


@dataclass(frozen=True)
class Term(Node):
    """One token; ``$`` before it asks for its stem, * and ? are wildcards."""

    text: str


@dataclass(frozen=True)
class Phrase(Node):
    words: tuple[str, ...]


@dataclass(frozen=True)
class Or(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class And(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class FromTo(Node):
    start: Node
    end: Node


@dataclass(frozen=True)
class Contains(Node):
    """``inner`` tells which side is filtered by: outer > inner, or with ``within`` inner < outer; ``negate`` turns it round."""

    kept: Node
    other: Node
    within: bool = False
    negate: bool = False


@dataclass(frozen=True)
class Width(Node):
    """All intervals of so many tokens."""

    tokens: int


@dataclass(frozen=True)
class Span(Node):
    """``kept`` with a length between ``least`` and ``most`` tokens (None: no bound); what containment in a Width means."""

    kept: Node
    least: int | None = None
    most: int | None = None


@dataclass(frozen=True)
class Position(Node):
    at: int


@dataclass(frozen=True)
class Files(Node):
    """Whole documents that meet a restriction; ``field`` None: all of them."""

    field: str | None = None
    op: str = "="
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Empty(Node):
    pass

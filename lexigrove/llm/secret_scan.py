"""Secrets: patterns that a trigram index narrows down.

Each rule's pattern gives a Boolean query over trigrams that every match must hold. Blocks of documents get an
inverted index (postings of the trigrams that the queries name), a query intersects and unites postings, and the
pattern runs on candidates alone. A rule whose pattern has no trigram that all matches hold scans its block fully.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.common import map_batches


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    accept: Callable[[re.Match], bool] = lambda m: True
    flags: int = re.ASCII


#: The base rules, in the order in which spans that start together are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 6, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 20),
    # Runs of 24 or more; shorter ones would be dropped.
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+"),
)
#: Further rules, listed after the base ones: published formats of keys and tokens.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("github", r"gh[opusr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)


# A query is True (everything may match), a trigram, or ("and" | "or", parts). Trigrams are folded to lower case.
Query = bool | str | tuple


def _and(parts: Iterable[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(parts: Iterable[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return True if True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _grams(text: str) -> Query:
    return _and(text[i : i + 3] for i in range(len(text) - 2))


#: So many strings at most are followed side by side while a pattern is read.
STRINGS = 64


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """The trigrams that every match of ``pattern`` holds, as a Boolean query."""

    def read(items) -> tuple[frozenset[str] | None, Query]:
        """The exact folded strings that ``items`` can match (None: too many), and a query that all matches satisfy."""
        exact: frozenset[str] | None = frozenset([""])
        queries: list[Query] = []
        for op, arg in items:
            part, query = one(op, arg)
            if exact is not None and part is not None and len(exact) * len(part) <= STRINGS:
                exact = frozenset(a + b for a in exact for b in part)
                continue
            if exact is not None:
                queries.append(_or(_grams(s) for s in exact))
            queries.append(query)
            exact = part
        whole = exact if not queries else None
        if exact is not None:
            queries.append(_or(_grams(s) for s in exact))
        return whole, _and(queries)

    def one(op, arg) -> tuple[frozenset[str] | None, Query]:
        if op is C.LITERAL:
            return frozenset([chr(arg).lower()]), True
        if op is C.IN and all(x[0] is C.LITERAL for x in arg):
            return frozenset(chr(x[1]).lower() for x in arg), True
        if op is C.SUBPATTERN:
            return read(arg[3])
        if op is C.ATOMIC_GROUP:
            return read(arg)
        if op is C.BRANCH:
            read_ = [read(b) for b in arg[1]]
            exact = [e for e, _ in read_]
            return (frozenset().union(*exact) if None not in exact and sum(map(len, exact)) <= STRINGS else None), _or(q for _, q in read_)
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, inner = arg
            exact, query = read(inner)
            if least == 0:
                return (exact | {""} if most == 1 and exact is not None else None), True
            return (exact if least == most == 1 else None), query
        if op in (C.ASSERT, C.ASSERT_NOT, C.AT):
            return frozenset([""]), True
        return None, True

    exact, query = read(_parser.parse(pattern, flags))
    return query


def trigrams(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def candidates(query: Query, postings: dict[str, frozenset[int]], everything: frozenset[int]) -> frozenset[int]:
    if query is True:
        return everything
    if isinstance(query, str):
        return postings[query]
    parts = [candidates(q, postings, everything) for q in query[1]]
    return frozenset.intersection(*sorted(parts, key=len)) if query[0] == "and" else frozenset().union(*parts)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = [(k, r, re.compile(r.pattern, r.flags), trigram_query(r.pattern, r.flags)) for k, r in enumerate(rules)]
        self.grams = sorted(set().union(*(trigrams(q) for *_, q in self.rules)))

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text of a block: (start, rule's number, end), in order."""
        folded = [t.lower() for t in texts]
        postings = {g: frozenset(i for i, t in enumerate(folded) if g in t) for g in self.grams}
        everything = frozenset(i for i, t in enumerate(texts) if t)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, rule, pattern, query in self.rules:
            for i in candidates(query, postings, everything):
                out[i] += [(m.start(), k, m.end()) for m in pattern.finditer(texts[i]) if rule.accept(m)]
        return [sorted(x) for x in out]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_<kind> of each base rule, base and spans (kind:start:end, comma-joined).

    Spans are in code points, end exclusive. Null and empty texts have none. Repeated rows each give a row; null ids
    pass through; other columns are ignored.
    """
    names = [r.kind for r in (*base, *more)]
    scanner: list[Scanner] = []

    def each(batch: pa.RecordBatch) -> Iterable[tuple]:
        if not scanner:
            scanner.append(Scanner((*base, *more)))
        texts = [t or "" for t in batch[1].to_pylist()]
        for i, spans in zip(batch[0].to_pylist(), scanner[0].scan(texts), strict=True):
            shown = [(k, f"{names[k]}:{s}:{e}") for s, k, e in spans]
            yield i, *(sum(k == j for k, _ in shown) for j in range(len(base))), ",".join(x for k, x in shown if k < len(base)), ",".join(x for _, x in shown)

    counts = [f"n_{r.kind}" for r in base]
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in counts), ("base", pa.string()), ("spans", pa.string())])
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), each, schema, "doc_id long, " + "".join(f"{c} long, " for c in counts) + "base string, spans string")

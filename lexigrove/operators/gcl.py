"""Expressions of the region algebra as DataFrames."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.functions.stem import stem, stem_udf
from lexigrove.operators import extents
from lexigrove.plans import ast
from lexigrove.plans.parser import parse
from lexigrove.plans.rules import rewrite
from lexigrove.sources.corpus import Corpus

#: Columns of the documents table that restrictions refer to.
FIELDS = {"filetype": "lang", "filepath": "source", "filesize": "n_chars"}


def _words(node: ast.Node) -> list[str]:
    """The words of an expression that are looked up as they are."""
    match node:
        case ast.Term(text):
            return [] if set(text) & set("*?$") or text in ("<file!>", "</file!>") else [text]
        case ast.Phrase(words):
            return [] if any(set(w) & set("*?$") for w in words) else list(words)
        case ast.Or(parts) | ast.And(parts):
            return [w for p in parts for w in _words(p)]
        case ast.FromTo(a, b) | ast.Contains(a, b):
            return _words(a) + _words(b)
        case ast.Span(kept):
            return _words(kept)
    return []


class Engine:
    """Evaluates expressions over a corpus. Equal subexpressions share one DataFrame."""

    def __init__(self, corpus: Corpus, macros: dict[str, str] | None = None, fields: dict[str, str] | None = None) -> None:
        self.corpus, self.macros, self.fields = corpus, macros or {}, fields or FIELDS
        self._known: dict[ast.Node, DataFrame] = {}

    def counted(self) -> Engine:
        """The same over the corpus's counts in tables."""
        return Engine(self.corpus.counts, self.macros, self.fields)

    def gathered(self, *queries: str) -> Engine:
        """The same over one scan for all plain words of ``queries``."""
        words = dict.fromkeys(w for q in queries for w in _words(rewrite(parse(q, self.macros))))
        return Engine(self.corpus.holding(*words), self.macros, self.fields) if words else self

    def query(self, text: str) -> DataFrame:
        """doc_id, s, e of all matches."""
        return self.extents(rewrite(parse(text, self.macros)))

    def gcl(self, text: str, count: int = 20) -> DataFrame:
        """The first ``count`` matches by document and place."""
        return self.query(text).orderBy("doc_id", "s").limit(count)

    def extents(self, node: ast.Node) -> DataFrame:
        if node not in self._known:
            self._known[node] = self._extents(node)
        return self._known[node]

    def _extents(self, node: ast.Node) -> DataFrame:
        match node:
            case ast.Term(text):
                return self.term(text)
            case ast.Phrase(words):
                if any(set(w) & set("*?$") for w in words):
                    lists = [self.term(w).select("doc_id", F.col("s").alias("pos"), F.lit(f"{k}").alias("term")) for k, w in enumerate(words)]
                    union = lists[0]
                    for x in lists[1:]:
                        union = union.unionByName(x)
                    return extents.phrase(union, tuple(str(k) for k in range(len(words))))
                return extents.phrase(self.corpus.terms(*words), words)
            case ast.Or(parts):
                plain = [p.text for p in parts if isinstance(p, ast.Term) and not set(p.text) & set("*?$") and p.text[-2:] != "!>"]
                if len(plain) == len(parts):  # points never hold each other: one scan, no minimality
                    return self._points(self.corpus.terms(*plain))
                return extents.either(*map(self.extents, parts))
            case ast.And(parts):
                return extents.both(*map(self.extents, parts))
            case ast.FromTo(ast.Term("<file!>"), ast.Term("</file!>")):
                return self.extents(ast.Files())
            case ast.FromTo(start, end):
                return extents.from_to(self.extents(start), self.extents(end))
            case ast.Contains(kept, other, within, negate):
                return extents.contains(self.extents(kept), self.extents(other), within, negate)
            case ast.Span(kept, least, most):
                out = self.extents(kept)
                out = out if least is None else out.where(F.col("e") - F.col("s") + 1 >= least)
                return out if most is None else out.where(F.col("e") - F.col("s") + 1 <= most)
            case ast.Width(n):
                return extents.width(self.corpus.doc_stats, n)
            case ast.Position(at):
                return self.corpus.doc_stats.where(F.col("dl") > at).select("doc_id", F.lit(at).cast("long").alias("s"), F.lit(at).cast("long").alias("e"))
            case ast.Files():
                return self.files(node)
        return self.corpus.doc_stats.where(F.lit(False)).select("doc_id", F.col("dl").alias("s"), F.col("dl").alias("e"))

    @staticmethod
    def _points(postings: DataFrame) -> DataFrame:
        return postings.select("doc_id", F.col("pos").alias("s"), F.col("pos").alias("e"))

    def term(self, text: str) -> DataFrame:
        """Points of one token; $word and word$ match by stem; * and ? need two literal characters before them."""
        if text in ("<file!>", "</file!>"):
            files = self.extents(ast.Files())
            at = "s" if text == "<file!>" else "e"
            return files.select("doc_id", F.col(at).alias("s"), F.col(at).alias("e"))
        if text.startswith("$") or text.endswith("$"):
            return self._points(self.stemmed(text.strip("$")))
        if set(text) & set("*?"):
            prefix = re.match(r"[^*?]*", text)[0]
            if len(prefix) < 2:
                raise ValueError(f"{text!r} needs two characters before its first wildcard")
            pattern = "^(?:" + fnmatch.translate(text).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z") + ")$"
            return self._points(self.corpus.postings.where(F.col("term").startswith(prefix) & F.col("term").rlike(pattern)))
        return self._points(self.corpus.terms(text))

    def stemmed(self, word: str) -> DataFrame:
        """Postings of all terms with the stem of ``word``; each distinct term is stemmed once."""
        wanted = stem(word)
        terms = self.corpus.postings.where(F.col("term").startswith(wanted[:2])).select("term").distinct()
        alike = terms.where(stem_udf("term") == wanted)
        return self.corpus.postings.where(F.col("term").startswith(wanted[:2])).join(alike, "term", "left_semi").select("doc_id", "pos", "term")

    def files(self, node: ast.Files) -> DataFrame:
        """Whole documents; the restriction is a filter that reaches the scan."""
        docs = self.corpus.docs
        if node.field:
            column = F.col(self.fields[node.field])
            if node.field == "filesize":
                n = float(node.values[0])
                near = F.abs(column - n) <= 1e-6
                test = {"=": near, "==": near, ">": (column > n) & ~near, ">=": (column > n) | near, "<": (column < n) & ~near, "<=": (column < n) | near}[node.op]
            elif node.field == "filepath":
                pattern = node.values[0]
                name = column if pattern.startswith("/") else F.element_at(F.split(column, "/"), -1)
                test = name.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$")
            else:
                test = column.isin(*node.values)
            docs = docs.where(test)
        return Corpus(docs, self.corpus.markup, self.corpus._words).doc_stats.where("dl > 0").select("doc_id", F.lit(0).cast("long").alias("s"), (F.col("dl") - 1).alias("e"))

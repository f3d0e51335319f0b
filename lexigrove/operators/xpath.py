"""XPath over marked-up documents.

Elements come from tag tokens: an opening tag is closed by the next closing tag of its level. Each element knows its
parent's start, so child and parent steps are equi-joins; ancestor and descendant steps are one sort of a document's
elements, like containment in the region algebra.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrove.sources.corpus import Corpus

#: Tags that no closing tag follows.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
COLUMNS = ("doc_id", "s", "e", "level", "name", "parent")


def elements(corpus: Corpus) -> DataFrame:
    """doc_id, s, e, level, name, parent (the start of the enclosing element, -1 at the top)."""
    void = [f"<{v}>" for v in VOID] + [f"</{v}>" for v in VOID]
    tags = corpus.postings.where(F.col("term").startswith("<") & ~F.col("term").isin(*void) & ~F.col("term").contains("!"))
    doc = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    close = F.col("term").startswith("</")
    depth = F.sum(F.when(close, -1).otherwise(1)).over(doc)
    # An opening tag and its closing tag have the same level: the depth inside the element.
    levelled = tags.withColumn("__close", close).withColumn("__depth", depth).withColumn("level", F.col("__depth") + F.col("__close").cast("int"))
    pair = Window.partitionBy("doc_id", "level").orderBy("pos")
    found = levelled.withColumn("e", F.lead("pos").over(pair)).withColumn("__next", F.lead("__close").over(pair)).where("not __close and __next and level > 0")
    named = found.select("doc_id", F.col("pos").alias("s"), "e", F.col("level").cast("int").alias("level"), F.regexp_replace("term", "[<>]", "").alias("name"))
    # The parent is the last element one level up that began before.
    parents = named.select("doc_id", F.col("level").alias("__up"), F.col("s").alias("__s"))
    union = named.select(*("doc_id", "s", "e", "level", "name"), F.lit(1).alias("__k"), (F.col("level") - 1).alias("__l")).unionByName(parents.select("doc_id", F.col("__s").alias("s"), F.lit(None).cast("long").alias("e"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("__k"), F.col("__up").alias("__l")))
    last = F.last(F.when(F.col("__k") == 0, F.col("s")), ignorenulls=True).over(Window.partitionBy("doc_id", "__l").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return union.withColumn("parent", F.coalesce(last, F.lit(-1).cast("long"))).where("__k = 1").select(*COLUMNS)


@dataclass(frozen=True)
class Step:
    axis: str
    test: str
    predicates: tuple[str, ...] = ()


AXES = ("self", "parent", "ancestor", "ancestor-or-self", "child", "descendant", "descendant-or-self", "attribute")


def parse(path: str) -> tuple[Step, ...]:
    """Steps of a path from the top; // . .. @name and axis::test[predicate] are known."""
    text = re.sub(r'^doc\("[^"]*"\)', "", path.strip())
    steps: list[Step] = []
    for part in _split(text.removeprefix("/"), "/"):
        if part == "":
            steps.append(Step("descendant-or-self", "node()"))
            continue
        m = re.fullmatch(r"(?:([a-z-]+)::|(@))?([\w*.:()-]+?)((?:\[.*\])?)", part, re.DOTALL)
        if not m:
            raise ValueError(f"unknown step {part!r}")
        axis, test, rest = m[1] or ("attribute" if m[2] else "child"), m[3], m[4]
        if test in (".", ".."):
            axis, test = ("self", "node()") if test == "." else ("parent", "node()")
        predicates = tuple(p[:-1] for p in _split(rest[1:], "[") if p) if rest else ()
        steps.append(Step(axis, test.lower(), predicates))
    return tuple(steps)


def _split(text: str, mark: str) -> list[str]:
    """Parts of ``text`` between marks outside quotes and brackets."""
    out, depth, quoted, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quoted:
            quoted = "" if c == quoted else quoted
        elif c in "'\"":
            quoted = c
        elif c == mark and depth == 0:
            out.append(text[start:i])
            start = i + 1
        elif c in "[(":
            depth += 1
        elif c in "])" and depth:
            depth -= 1
    return [*out, text[start:]]


class XPath:
    def __init__(self, corpus: Corpus) -> None:
        self.corpus, self.elements = corpus, elements(corpus)

    def query(self, path: str) -> DataFrame:
        """doc_id, s, e, level, name, parent of the elements that ``path`` selects."""
        context: DataFrame | None = None
        for step in parse(path):
            context = self._step(context, step)
        return (self.elements if context is None else context).select(*COLUMNS)

    def _step(self, context: DataFrame | None, step: Step) -> DataFrame:
        """``context`` None: the root of each document, which isn't an element."""
        if step.axis not in AXES or step.axis == "attribute":
            return self.elements.where(F.lit(False))
        if context is None:
            if step.axis in ("parent", "ancestor", "ancestor-or-self", "self"):
                found = self.elements.where(F.lit(False)) if step.test != "node()" else None
                return found if found is not None else self.elements.where("parent = -1").withColumn("parent", F.lit(-2).cast("long"))
            if step.axis == "descendant-or-self" and step.test == "node()":
                return self._rooted()
            found = self.elements.where("parent = -1") if step.axis == "child" else self.elements
        else:
            found = self._axis(context, step.axis)
        if step.test not in ("*", "node()"):
            found = found.where(F.col("name") == step.test)
        elif step.test == "*":
            found = found.where("name is not null")
        for predicate in step.predicates:
            found = self._predicate(found, predicate, step.axis)
        return found

    def _rooted(self) -> DataFrame:
        """All elements and, for each document, a nameless root before them."""
        root = self.elements.groupBy("doc_id").agg(F.max("e").alias("e")).select("doc_id", F.lit(-1).cast("long").alias("s"), (F.col("e") + 1).alias("e"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("name"), F.lit(-2).cast("long").alias("parent"))
        return self.elements.select(*COLUMNS).unionByName(root)

    def _axis(self, context: DataFrame, axis: str) -> DataFrame:
        c = context.select("doc_id", "s", "e").distinct()
        every = self.elements
        match axis:
            case "self":
                return context.select(*COLUMNS).distinct()
            case "child":
                return every.join(c.select("doc_id", F.col("s").alias("parent")), ["doc_id", "parent"], "left_semi").select(*COLUMNS)
            case "parent":
                return every.join(context.select("doc_id", F.col("parent").alias("s")).distinct(), ["doc_id", "s"], "left_semi").select(*COLUMNS)
        tagged = every.select(*COLUMNS, F.lit(0).alias("k")).unionByName(c.select("doc_id", "s", "e", F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("parent"), F.lit(1).alias("k")))
        own = -1 if not axis.endswith("-or-self") else 0
        if axis.startswith("descendant"):
            reach = F.max(F.when(F.col("k") == 1, F.col("e"))).over(Window.partitionBy("doc_id").orderBy("s").rangeBetween(Window.unboundedPreceding, own))
            test: Column = F.col("__r") >= F.col("e")
        else:
            reach = F.min(F.when(F.col("k") == 1, F.col("e"))).over(Window.partitionBy("doc_id").orderBy(F.desc("s")).rangeBetween(Window.unboundedPreceding, own))
            test = F.col("__r") <= F.col("e")
        return tagged.withColumn("__r", reach).where((F.col("k") == 0) & test).select(*COLUMNS)

    def _predicate(self, found: DataFrame, text: str, axis: str) -> DataFrame:
        """Positions, existence, and comparisons joined by and, or, not(); paths are relative to the element."""
        group = Window.partitionBy("doc_id", "parent")
        backward = axis.startswith(("ancestor", "parent"))
        order = F.desc("s") if backward else F.asc("s")
        rows = found.select(*COLUMNS).withColumn("__p", F.row_number().over(group.orderBy(order))).withColumn("__last", F.count("*").over(group))
        value: list[tuple[str, DataFrame]] = []

        def term(x: str) -> Column:
            x = x.strip()
            if re.fullmatch(r"-?\d+(\.\d+)?", x):
                return F.lit(float(x))
            if re.fullmatch(r"'[^']*'|\"[^\"]*\"", x):
                return F.lit(x[1:-1])
            m = re.fullmatch(r"([a-z-]+)\((.*)\)", x, re.DOTALL)
            if m and m[1] in ("position", "last", "true", "false", "count", "not", "string", "contains", "starts-with", "string-length", "concat"):
                arguments = [a for a in _split(m[2], ",") if a.strip()]
                match m[1]:
                    case "position":
                        return F.col("__p").cast("double")
                    case "last":
                        return F.col("__last").cast("double")
                    case "true" | "false":
                        return F.lit(m[1] == "true")
                    case "not":
                        return ~boolean(m[2])
                    case "count":
                        return F.coalesce(related(arguments[0], "n"), F.lit(0)).cast("double")
                    case "string":
                        return F.coalesce(related(arguments[0] if arguments else ".", "t"), F.lit(""))
                    case "concat":
                        return F.concat(*map(string, arguments))
                    case "contains":
                        return string(arguments[0]).contains(string(arguments[1]))
                    case "starts-with":
                        return string(arguments[0]).startswith(string(arguments[1]))
                    case _:
                        return F.length(string(arguments[0])).cast("double")
            return F.coalesce(related(x, "t"), F.lit(""))

        def string(x: str) -> Column:
            return term(x).cast("string")

        def related(path: str, what: str) -> Column:
            name = f"__v{len(value)}"
            value.append((name, self._values(rows, path, what)))
            return F.col(name)

        def boolean(x: str) -> Column:
            for word, join in ((" or ", "__or__"), (" and ", "__and__")):
                parts = _words(x, word)
                if len(parts) > 1:
                    out = boolean(parts[0])
                    for p in parts[1:]:
                        out = getattr(out, join)(boolean(p))
                    return out
            m = re.fullmatch(r"(.*?)\s*(!=|<=|>=|=|<|>)\s*(.*)", x, re.DOTALL)
            if m:
                a, b = term(m[1]), term(m[3])
                if re.search(r"^\s*-?\d", m[3]) or re.search(r"^\s*-?\d", m[1]):
                    a, b = a.try_cast("double"), b.try_cast("double")
                return F.coalesce({"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[m[2]], F.lit(False))
            if re.fullmatch(r"\s*\d+\s*", x):
                return F.col("__p") == int(x)
            if re.fullmatch(r"\s*last\(\)\s*", x):
                return F.col("__p") == F.col("__last")
            if re.fullmatch(r"\s*(not|true|false|contains|starts-with)\(.*\)\s*", x, re.DOTALL):
                return term(x)
            return F.coalesce(related(x, "n"), F.lit(0)) > 0

        test = boolean(text)
        for name, values in value:
            rows = rows.join(values.withColumnRenamed("v", name), ["doc_id", "s"], "left")
        return rows.where(test).select(*COLUMNS)

    def _values(self, rows: DataFrame, path: str, what: str) -> DataFrame:
        """doc_id, s, v: for each row the number of elements on a relative path of child steps, or the first one's text."""
        at = rows.select("doc_id", F.col("s").alias("__c"), "s", "e", "level", "name", "parent")
        for step in [] if path.strip() in (".", "") else parse(path.strip().removeprefix("./")):
            if step.axis != "child" or step.predicates:
                raise ValueError(f"{path!r}: predicates take child steps without predicates of their own")
            base = at.select("doc_id", "__c", F.col("s").alias("parent"))
            at = self.elements.join(base, ["doc_id", "parent"])
            at = at if step.test in ("*", "node()") else at.where(F.col("name") == step.test)
        if what == "n":
            return at.groupBy("doc_id", F.col("__c").alias("s")).agg(F.count("*").alias("v"))
        first = at.groupBy("doc_id", "__c").agg(F.min_by(F.struct("s", "e"), "s").alias("x")).join(self.corpus.tokens, "doc_id")
        words = F.filter(F.slice("tokens", (F.col("x.s") + 1).cast("int"), (F.col("x.e") - F.col("x.s") + 1).cast("int")), lambda t: ~t.startswith("<"))
        return first.select("doc_id", F.col("__c").alias("s"), F.array_join(words, " ").alias("v"))

    def path_of(self, found: DataFrame) -> DataFrame:
        """doc_id, s, path: where each element stands, as name[k]/name[k]...; one step up at a time."""
        numbered = self.elements.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "parent", "name").orderBy("s"))).select("doc_id", F.col("s").alias("__s"), "parent", F.concat("name", F.lit("["), F.col("k").cast("string"), F.lit("]")).alias("part"))
        depth = found.agg(F.max("level")).first()[0] or 0
        rows = found.select("doc_id", "s", F.col("s").alias("__s"), F.lit("").alias("path"))
        for _ in range(depth):
            rows = rows.join(numbered, ["doc_id", "__s"], "left").select("doc_id", "s", F.coalesce("parent", F.lit(-1)).alias("__s"), F.when(F.col("part").isNull(), F.col("path")).otherwise(F.concat_ws("/", F.col("part"), F.when(F.col("path") != "", F.col("path")))).alias("path"))
        return rows.select("doc_id", "s", "path")


def _words(text: str, word: str) -> list[str]:
    """Parts of ``text`` between ``word`` outside quotes and brackets."""
    out, start, i, depth, quoted = [], 0, 0, 0, ""
    while i < len(text):
        c = text[i]
        if quoted:
            quoted = "" if c == quoted else quoted
        elif c in "'\"":
            quoted = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif depth == 0 and text.startswith(word, i):
            out.append(text[start:i])
            start = i + len(word)
            i = start - 1
        i += 1
    return [*out, text[start:]]

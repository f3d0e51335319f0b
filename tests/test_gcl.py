"""The region algebra against a model on sets of intervals, and the parser."""

import random

import pytest

from lexigrove.functions.stem import stem
from lexigrove.operators import extents as x
from lexigrove.operators.gcl import Engine
from lexigrove.plans import ast
from lexigrove.plans.parser import ParseError, parse
from lexigrove.plans.rules import rewrite
from lexigrove.sources.corpus import Corpus


def minimal(found):
    found = set(found)
    return sorted(a for a in found if not any(b != a and a[0] <= b[0] and b[1] <= a[1] for b in found))


def model(op, a, b):
    inside = lambda p, q: q[0] <= p[0] and p[1] <= q[1]
    match op:
        case "or":
            return minimal(a + b)
        case "and":
            return minimal((min(p[0], q[0]), max(p[1], q[1])) for p in a for q in b)
        case "from_to":
            return minimal((p[0], q[1]) for p in a for q in b if p[1] < q[0])
        case ">":
            return [p for p in a if any(inside(q, p) for q in b)]
        case "<":
            return [p for p in a if any(inside(p, q) for q in b)]
        case "/>":
            return [p for p in a if not any(inside(q, p) for q in b)]
        case "/<":
            return [p for p in a if not any(inside(p, q) for q in b)]


def test_operators_equal_the_model(spark):
    rng = random.Random(4)
    docs = {}
    for d in range(150):
        docs[d] = [minimal((s := rng.randrange(40), s + rng.choice([0, 0, 1, 3, 9])) for _ in range(rng.randint(0, 9))) for _ in range(2)]
    frames = [spark.createDataFrame([(d, *p) for d, lists in docs.items() for p in lists[k]], "doc_id long, s long, e long") for k in range(2)]
    a, b = frames
    plans = {"or": x.either(a, b), "and": x.both(a, b), "from_to": x.from_to(a, b), ">": x.contains(a, b), "<": x.contains(a, b, within=True), "/>": x.contains(a, b, negate=True), "/<": x.contains(a, b, within=True, negate=True)}
    for op, plan in plans.items():
        want = sorted((d, *p) for d, (p0, p1) in docs.items() for p in model(op, p0, p1))
        assert sorted(map(tuple, plan.collect())) == want, op


def test_queries_on_text(spark):
    docs = spark.createDataFrame([(1, "To be or not to be", "en", "a/b.txt", 18), (2, "informed retrieval of information", "de", "x.md", 33), (3, None, "en", "n", 0), (4, "", "en", "n", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    engine = Engine(Corpus(docs), {"DOCS": '("<file!>".."</file!>")'})
    found = lambda q: sorted(map(tuple, engine.query(q).collect()))
    assert found('"to"^"be"') == [(1, 0, 1), (1, 1, 4), (1, 4, 5)]
    assert found('"to be"') == [(1, 0, 1), (1, 4, 5)]
    assert found('("to".."be")<[2]') == [(1, 0, 1), (1, 4, 5)]
    assert found('"inform*"') == [(2, 0, 0), (2, 3, 3)] == found('"$inform"')
    assert found('$DOCS>"or"') == [(1, 0, 5)]
    assert found("{filetype in de, fr}") == [(2, 0, 3)] == found("{filesize > 20}") == found("{filepath = *.md}")
    assert found('[5]') == [(1, 0, 4), (1, 1, 5)]
    assert found("3") == [(1, 3, 3), (2, 3, 3)]
    assert found('""') == [] == found('"nothing"^"to"')
    assert found('"to"+"be"') == [(1, 0, 0), (1, 1, 1), (1, 4, 4), (1, 5, 5)]
    assert found('"to"/<("or".."be")') == [(1, 0, 0)]


def test_parser_binds_to_the_right():
    t = {c: ast.Term(c) for c in "abc"}
    assert parse('"a"+"b"^"c"') == ast.Or((t["a"], ast.And((t["b"], t["c"]))))
    assert parse('"a">"b"<"c"') == ast.Contains(t["a"], ast.Contains(t["b"], t["c"], within=True))
    assert parse('("a" or "b") AND "c"') == ast.And((ast.Or((t["a"], t["b"])), t["c"]))
    assert rewrite(parse('"a"^("b"^"c")')) == ast.And((t["a"], t["b"], t["c"]))
    assert rewrite(parse('("a"^"b")/>[3]')) == ast.Span(ast.And((t["a"], t["b"])), None, 2)
    assert rewrite(parse('"a">[2]')) == ast.Empty()
    for bad in ("", '"a"^', '("a"', '"a" "b"', '"a")', "a"):
        with pytest.raises(ParseError):
            parse(bad)


def test_stems():
    words = {"information": "inform", "retrieval": "retriev", "flown": "fly", "relational": "relat", "hopping": "hop", "caresses": "caress", "ponies": "poni", "generalization": "gener", "x9": "x9"}
    assert {w: stem(w) for w in words} == words

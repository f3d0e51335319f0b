"""Passages, feedback and stems against plain loops."""

import math
import random
import re

from lexigrove.functions.stem import stem
from lexigrove.operators import feedback
from lexigrove.operators.gcl import Engine
from lexigrove.operators.passages import best_run
from lexigrove.operators.rank import Ranking
from lexigrove.queries import QUERIES
from lexigrove.session import table
from lexigrove.sources.corpus import Corpus


def plain_run(o, c, k1=1.2, b=0.75):
    best = (0.0, 0, 0)
    w = [x * math.log(c["n"] / d) for x, d in zip(c["w"], c["df"], strict=True)]
    for i in range(len(o)):
        for j in range(i, len(o)):
            part = o[i : j + 1]
            end = max(x[1] for x in part)
            norm = k1 * ((1 - b) + b * (end - o[i][0] + 1) / c["avgdl"])
            tf = {k: sum(x[2] == k for x in part) for k in dict.fromkeys(x[2] for x in part)}
            best = max(best, (sum(w[k] * k1 * f / (norm + f) for k, f in tf.items()), -o[i][0], -end))
    return best[0], -best[1], -best[2]


def test_best_run_tries_all_ends():
    rng = random.Random(5)
    c = {"n": 1000.0, "avgdl": 400.0, "df": [9.0, 80.0, 500.0], "w": [1.0, 2.0, 1.0]}
    dense = [(k, k, 2) for k in range(100)] + [(100, 100, 0)]
    assert best_run(dense, 101.0, c) == plain_run(dense, c) and best_run(dense, 101.0, c)[2] == 100
    for n in (1, 2, 30, 90, 130):
        for gap in (1, 4, 30):
            at = [0]
            for _ in range(n - 1):
                at.append(at[-1] + rng.randint(1, gap))
            o = [(s, s + rng.randint(0, 2), rng.choice([0, 1, 2, 2, 2])) for s in at]
            assert best_run(o, 1.0, c) == plain_run(o, c)


def test_feedback_uses_all_relevant_documents(spark):
    texts = ["plain"] * 16 + ["zebra"] * 14 + ["public other"] * 40
    engine = Engine(Corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    qrels = spark.createDataFrame([(1, k, int(k < 30)) for k in range(70)], "topic int, doc_id long, judgement int")
    assert {r.doc_id for r in feedback.relevance_feedback(engine, '"nothing"', qrels, count=100).collect()} == set(range(30))


def test_links_vote_once_and_by_their_anchors(spark):
    engine = Engine(Corpus(spark.createDataFrame([(k, t) for k, t in enumerate(["red fox", "red fox", "fox", "none", "none", "none"])], "doc_id long, text string")))
    r = Ranking(engine, '"red", "fox"')
    ranked = spark.createDataFrame([(0, 4.0), (1, 2.0), (2, 1.0)], "doc_id long, score double")
    links = spark.createDataFrame([(0, "b", "Red foxes!"), (0, "b", "here"), (0, "c", "fox"), (1, "c", "no"), (2, "c", "red fox"), (5, "b", "red fox")], "doc_id long, url string, anchor string")
    urls = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "doc_id long, url string")
    red, fox = math.log(6 / 2), (1 + math.log(6 / 3)) / 2
    votes = {0: 0.0, 1: 0.1 + 0.9 * 1.3, 2: 0.1 + 0.9 * (fox / (red + fox)) ** 2 + 0.5 * 0.98 * 0.1}
    want = {k: round(score * (1 + math.log(1 + votes[k])), 5) for k, score in ((0, 4.0), (1, 2.0), (2, 1.0))}
    assert {x.doc_id: x.score for x in feedback.rerank_links(r, ranked, links, urls).collect()} == want


def test_all_terms_are_stemmed(spark):
    d = "/root/testdata/sf0.001"
    words = {w.lower() for r in table(spark, d, "documents").select("text").collect() for w in re.findall("[A-Za-z0-9]{1,19}", r.text or "")}
    number = re.compile("^.?[0-9]")
    terms = {w for w in words if not (number.search(w) and (len(w) > 8 or (len(w) > 7 and w[0] > "1")))}
    found = QUERIES["l_stems"](spark, d).collect()
    assert len(found) == len(terms) > 500 and {r.term: r.stem for r in found} == {w: stem(w) for w in terms}

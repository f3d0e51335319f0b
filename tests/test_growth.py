"""What queries read and move: texts are taken apart once, and what is cut or shortened gives the same rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexigrove.functions.tokens import tokens
from lexigrove.operators import count, prune
from lexigrove.operators.gcl import Engine
from lexigrove.operators.rank import Ranking
from lexigrove.queries import QUERIES
from lexigrove.sources import corpus as module
from lexigrove.sources.corpus import Corpus

SF = "/root/testdata/sf0.001"
#: Queries whose result reads tables of counts or places, not the texts again.
READ_ONCE = [
    "f_feedback_qrels",
    "d_surrogates",
    "d_keywords",
    "d_surrogate_cosine",
    "d_term_centric",
    "d_document_centric",
    "f_feedback_kld",
    "f_rerank_bayes",
    "f_rerank_kld",
    "r_vector_space",
    "c_vector_lengths",
    "c_kl_divergence",
    "f_feedback_okapi",
    "d_discretised",
    "f_terms_kld",
    "f_synonyms",
    "r_bm25_containers",
    "c_mixture",
    "r_bm25f_pages",
]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", READ_ONCE)
def test_texts_are_taken_apart_once(spark, name):
    assert "regexp_extract_all" not in plan(QUERIES[name](spark, SF))


def test_decorated_ranking_reads_only_texts_of_its_rows(spark):
    # Names and texts of the ranked documents; ranking, lengths and matches come from one table of places.
    assert plan(QUERIES["r_bm25_decorated"](spark, SF)).count("FileScan parquet [doc_id#") <= 9
    assert "[a-z0-9]{1,19}" not in plan(QUERIES["r_bm25_decorated"](spark, SF))


def test_no_other_character_becomes_a_letter(spark):
    # One character of each code point (but U+FEFF, which decode() drops) between two letters: only ASCII ones join them.
    rows = spark.range(1, 0x110000).where("(id < 55296 or id > 57343) and id <> 65279").select(F.col("id"), F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    joined = rows.where(F.size(tokens(F.concat(F.lit("A"), "c", F.lit("B")))) == 1).select("id")
    assert {r.id for r in joined.collect()} == {*range(48, 58), *range(65, 91), *range(97, 123)}


def test_counts_of_repeated_and_null_ids(spark):
    texts = [(1, "b a a"), (1, "a c"), (2, "x"), (None, "a"), (None, "a b"), (3, None), (4, "")]
    c = Corpus(spark.createDataFrame(texts, "doc_id long, text string"))
    plain = Counter((i, w) for i, t in texts for w in (t or "").split())
    for of in (c, c.counts):
        assert {(r.doc_id, r.term): r.tf for r in of.tf_table.collect()} == plain
        assert sorted((r.doc_id, r.term, r.tf, r.dl) for r in of.tf_lengths.collect()) == sorted((i, w, n, dl) for (i, w), n in plain.items() if i for dl in ((3, 2) if i == 1 else (1,)))
        assert {r.term: (r.tf, r.df) for r in of.lm.collect()} == {"a": (5, 2), "b": (2, 2), "c": (1, 1), "x": (1, 1)}
        assert {r.term: r.tf for r in of.frequencies.collect()} == {"a": 5, "b": 2, "c": 1, "x": 1}
    assert c.counts.stats.first() == c.stats.first()


@pytest.mark.parametrize("head", [0.5, 20, 10**9])
def test_frequent_terms_are_broadcast_and_rare_ones_joined(spark, monkeypatch, head):
    monkeypatch.setattr(module, "HEAD", head)
    c = Corpus.documents(spark, SF).counts
    lm = c.lm.select("term", "df")
    assert sorted(c.with_terms(c.tf_table, lm).collect()) == sorted(c.tf_table.join(lm, "term").collect())


def test_terms_are_cut_before_rows_move(spark):
    for frame in (prune.surrogates(Corpus.documents(spark, SF)), prune.keywords(Corpus.documents(spark, SF))):
        assert "WindowGroupLimit" in plan(frame) and "BroadcastHashJoin" in plan(frame)


def test_term_centric_equals_a_plain_loop(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("aabbbccde") for _ in range(rng.randint(1, 30))) for _ in range(60)]
    c = Corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    avg = sum(len(t.split()) for t in texts) / 60
    impact = {(i, w): round(n * 2.2 / (n + 1.2 * (0.5 + 0.5 * len(t.split()) / avg)), 9) for i, t in enumerate(texts) for w, n in Counter(t.split()).items()}
    best = {w: sorted((x for (_, v), x in impact.items() if v == w), reverse=True) for w in "abcde"}
    want = {(i, w) for (i, w), x in impact.items() if len(best[w]) < 40 or x >= 0.9 * best[w][39]}
    assert {(r.doc_id, r.term) for r in prune.term_centric(c, 40, 0.9).collect()} == want and len(want) < len(impact)


def test_matches_in_overlapping_containers(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("stxyz") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    e = Engine(Corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    box, by = '"s"^"t"', ['"x"', '"y z"', '"x"^"z"']
    r = Ranking(e.gathered(box, *by), ", ".join(by), container=box)
    boxes = [(x.doc_id, x.s, x.e) for x in e.query(box).collect()]
    found = [[(x.doc_id, x.s, x.e) for x in e.query(q).collect()] for q in by]
    want = {(d, s, z): tuple(float(sum(i == d and s <= a and b <= z for i, a, b in f)) for f in found) for d, s, z in boxes}
    rows = r.counted().collect()
    assert len(rows) == len(boxes) and {(x.doc_id, x.s, x.e): (x.tf0, x.tf1, x.tf2) for x in rows} == want
    assert "SortMergeJoin" not in plan(r.counted()) and "BroadcastHashJoin" not in plan(r.counted())


def test_mixture_without_counts_of_documents(spark):
    c = Corpus.documents(spark, SF)
    p, q = Corpus(c.docs.where("lang = 'en'")), c
    assert sorted(count.lm_mix(p.frequencies, q.frequencies, 0.7).collect()) == sorted(count.lm_mix(p.lm, q.lm, 0.7).collect())
    assert count.kl_divergence(p.frequencies, q.frequencies).collect() == count.kl_divergence(p.lm, q.lm).collect()

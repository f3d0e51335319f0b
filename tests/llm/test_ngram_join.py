"""The exact join against all pairs."""

import random
import re

import numpy as np
from lexigrove.llm import ngram_join as j


def plain_set(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < size else {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows):
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                label[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        least[find(x)] = min(least.get(find(x), i), i)
    return sorted((i, len(sets[x]), least[find(x)]) for x, (i, _) in enumerate(rows))


def test_signatures_meet_for_all_similar_sets():
    rng = np.random.default_rng(5)
    for _ in range(3000):
        n = int(rng.integers(1, 60)) if rng.random() < 0.8 else int(rng.integers(60, 400))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = a[rng.random(len(a)) > rng.random() * 0.2]
        b = np.unique(np.concatenate([b, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + len(a) // 5))).astype(np.uint64)]))
        if len(b) and j.similar(a, b) and not np.array_equal(a, b):
            assert len(np.intersect1d(j.signatures(a), j.signatures(b))), (a, b)


def words(rng, n):
    return [rng.choice(["ab", "cd", "ef", "gh"]) + str(rng.randint(0, 400)) for _ in range(n)]


def test_groups_equal_all_pairs(spark):
    rng = random.Random(11)
    rows, passage = [], words(rng, 40)
    for _ in range(60):
        base = words(rng, rng.choice([1, 3, 5, 8, 12, 20, 40, 90, 150])) + (passage if rng.random() < 0.4 else [])
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(["XY", "zw"]) + str(rng.randint(0, 99))
            rows.append((len(rows), rng.choice([" ", "\n", "  "]).join(copy)))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n int").repartition(4)
    assert sorted(map(tuple, j.groups(docs).collect())) == brute(rows)


def test_odd_rows(spark):
    rows = [(3, "a b c d e f"), (7, "A b C d e f"), (7, "A b C d e f"), (5, None), (6, ""), (8, " \n "), (None, "a b c d e f"), (None, "x"), (9, "x y " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, j.groups(docs).collect()), key=str)
    assert got == sorted([(3, 2, 3), (7, 2, 3), (7, 2, 3), (5, 0, 5), (6, 0, 6), (8, 0, 8), (None, 2, 3), (None, 1, None), (9, 1, 9)], key=str)
    assert j.groups(docs.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in j.keep_one(docs).collect()) == ["3", "5", "6", "8", "9", "None"]


def test_clashing_columns_and_long_texts(spark):
    rng = random.Random(2)
    long = words(rng, 60_000)
    rows = [(1, " ".join(long)), (2, " ".join([*long[:30_000], "odd", *long[30_000:]])), (3, " ".join(long[:200]))]
    docs = spark.createDataFrame([(i, t, "r", 7, "x") for i, t in rows], "doc_id long, text string, rid string, gone int, row string")
    kept = j.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.rid, r.gone, r.row) for r in kept.collect()) == [(1, "r", 7, "x"), (3, "r", 7, "x")]
    assert j.keep_one(docs.limit(0)).count() == 0

"""Substring dedup against a plain loop over all units."""

import random

from lexigrove.llm import substring_dedup as s


def plain_units(text, reach=s.REACH, blocks=s.BLOCKS):
    """(start, end, words) of each unit, by loops; the local hash is the operator's own."""
    words = [(m.start(), s.word_hash(m.group().lower().encode())) for m in __import__("re").finditer(r"[^\x20\x09-\x0d]+", text)]
    words = [w for w in words if w[1]]
    h = [w for _, w in words]
    local = [int(s._mix(s.np.array([a], s.np.uint64) * s.np.uint64(0x9E3779B97F4A7C15) + s.np.uint64(b))[0]) for a, b in zip(h, [0, *h], strict=False)]
    cuts = [0] if h else []
    for p in range(reach + 1, len(h) - reach):
        if all(local[p] < local[p - k] and local[p] <= local[p + k] for k in range(1, reach + 1)):
            cuts.append(p)
    size = min(blocks, len(cuts))
    ends = [*cuts, len(h)]
    at = [*(w[0] for w in words), len(text)]
    return [(at[ends[k]], at[ends[k + size]], tuple(h[ends[k] : ends[k + size]])) for k in range(len(cuts) - size + 1)] if h else []


def brute(rows):
    """doc_id, start, end of what goes; ``rows`` in the order of their ids."""
    seen, out = set(), []
    for i, text in rows:
        run = None
        for start, end, words in [*plain_units(text or ""), (1 << 40, 0, None)]:
            if words is not None and words not in seen:
                seen.add(words)
                continue
            if run and start > run[1]:
                out.append((i, *run))
                run = None
            if words is not None:
                run = (run[0] if run else start, end)
    return sorted(out)


def words(rng, n):
    return [rng.choice(["ab", "Cd", "ef", "Gh,"]) + str(rng.randint(0, 400)) + rng.choice(["", "", ".", "!"]) for _ in range(n)]


def test_units_equal_plain_loops():
    rng = random.Random(5)
    texts = ["", " ", "a", "- !", "İ ß Σ. x", "of " * 300, "a b " * 200] + [rng.choice([" ", "\n", " - ", "  "]).join(words(rng, rng.randint(0, 120))) for _ in range(60)]
    for reach, blocks in ((4, 3), (2, 1), (3, 2)):
        got = s.text_units(texts, reach, blocks)
        for k, text in enumerate(texts):
            mine = got["text"] == k
            assert list(zip(got["start"][mine].tolist(), got["end"][mine].tolist(), strict=True)) == [u[:2] for u in plain_units(text, reach, blocks)], text


def test_removed_passages_equal_a_loop(spark):
    rng = random.Random(3)
    passages = [" ".join(words(rng, rng.choice([8, 30, 60]))) for _ in range(12)]
    rows = [(i, " ".join(part for _ in range(rng.randint(0, 4)) for part in (" ".join(words(rng, rng.randint(0, 30))), rng.choice(passages)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert len(want) > 40
    assert sorted((r.doc_id, r.start, r.end) for r in s.repeats(docs).collect()) == want
    texts = dict(rows)
    for r in s.remove(docs).collect():
        left, at = "", 0
        for i, start, end in want:
            if i == r.doc_id:
                left, at = left + texts[i][at:start], end
        assert r.text == left + texts[r.doc_id][at:]


def test_passages_that_begin_and_end_inside_sentences(spark):
    rng = random.Random(8)
    own = lambda n: " ".join(words(rng, n))
    rows = []
    for k in range(40):
        passage = own(51)
        rows += [(2 * k, f"{own(30)} {passage} {own(30)}"), (2 * k + 1, f"{own(17)} {passage} {own(9)}\n{own(5)}")]
    rows += [(1000 + k, own(60) + "\nOf. That. All rights reserved by the owners of this text.\n" + own(20)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id for r in s.repeats(docs).collect()}
    assert len(found & {2 * k + 1 for k in range(40)}) >= 36 and not found - {2 * k + 1 for k in range(40)}


def test_odd_rows(spark):
    passage = " ".join(f"word{k}" for k in range(50)) + "."
    rows = [(1, "Head. " + passage), (2, passage + " Tail."), (2, passage + " Tail."), (3, None), (4, ""), (None, passage), (None, passage), (5, "é" * 50_000), (6, " .\n")]
    docs = spark.createDataFrame([(i, t, 0, "x", 1, 2) for i, t in rows], "doc_id long, text string, row int, h1 string, __kept int, rid int")
    out = [(r.doc_id, r.text, [tuple(k) for k in r["__kept"]]) for r in s.remove(docs).collect()]
    n = len(passage)
    assert (1, "Head. " + passage, [(0, n + 6)]) in out and len(out) == len(rows)
    assert (3, None, [(0, 0)]) in out and (4, "", [(0, 0)]) in out and (6, " .\n", [(0, 3)]) in out
    assert sorted(len(x[1]) for x in out if x[0] == 2)[0] == 0
    assert sorted(len(x[1]) for x in out if x[0] is None)[0] == 0
    assert s.remove(docs).columns == ["doc_id", "text", "row", "h1", "rid", "__kept"]
    assert s.repeats(docs.limit(0)).count() == s.remove(docs.limit(0)).count() == 0

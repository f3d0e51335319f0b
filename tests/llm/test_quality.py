"""Quality rules, exact dedup, URL filter and neighbour votes against plain versions."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

from lexigrove.llm import exact_dedup, quality_knn, quality_rules, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_base_rules(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "b", "é", "# ", " ", "\n", "\t", "\x0b", "\u00a0", "||", "x y z x y\n"]) for _ in range(rng.randint(0, 80))) for _ in range(300)] + [None, "", "one", "the end of it all " * 4000]
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, __w string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 300, 3)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (not r.base_failed and r.score >= quality_rules.THRESHOLD)
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_rules_without_rows_or_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality_rules.judge(docs, labels).collect()] == [0.0]
    assert quality_rules.judge(docs.limit(0), labels).count() == 0


def test_exact_groups(spark):
    rng = random.Random(3)
    long = " ".join(rng.choice(["gamma", "alpha", "zeta"]) for _ in range(20_000))
    pool = ["", "a", "A", "a ", "a\n", long, long + "x", "x" + long, "é" * 9000]
    rows = [(i, rng.choice(pool)) for i in range(60)] + [(60, None), (5, "dup"), (5, "dup"), (None, "a"), (None, "only")]
    docs = spark.createDataFrame([(i, t, b"") for i, t in rows], "doc_id long, text string, digest binary")
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = [(i, keep := max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    got = [tuple(r) for r in exact_dedup.exact_groups(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sorted(map(str, ((r.doc_id, r.text or "") for r in exact_dedup.drop_copies(docs).collect()))) == sorted(map(str, {(w[1], t or "") for w, (_, t) in zip(want, rows, strict=True)}))
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_what_is_put_in_front_moves_no_other_chunk(spark):
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, "x" * 500 + text), (3, "some words in front " + text)], "doc_id long, text string")
    chunks = {r.doc_id: [bytes(c.digest) for c in r.chunks] for r in exact_dedup.recipes(docs, "doc_id", "text", exact_dedup.CHUNK_WORDS).collect()}
    assert 100 < len(chunks[1]) < 250
    assert len(set(chunks[1]) & set(chunks[2])) >= len(chunks[1]) - 1 and len(set(chunks[1]) & set(chunks[3])) >= len(chunks[1]) - 1


def test_copies_with_clashing_columns(spark):
    rows = [(1, "a", 0, "p"), (2, "a", 1, "q"), (3, None, 2, "r"), (4, "", 3, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __kept_id int, sha string")
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and sorted(tuple(r) for r in left.collect()) == [rows[1], rows[3]]
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0


def plain_rule(host, path):
    fits = [(len(h) + len(p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls(spark):
    urls = ["http://A.Example.org/es/1?x", "https://x.com/fr/2#y", "ftp://com/de/", "//nothing", None, "", "http://example.org/en/12", "http://example.org", "http://b.net/p?q=://z/", "x://y://z/w", "http://com.net/fr/1", "http://b.net/" + "long/" * 3000, "http://b.net/p?q=://z/"] + [f"http://h{i % 7}.example.{('org', 'com', 'net')[i % 3]}/{('fr', 'de', 'en')[i % 5 % 3]}/{i}" for i in range(120)]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    parts = {}
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        parts[i] = ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")
        assert (got[i].host, got[i].path) == parts[i], u
        rule, verdict = plain_rule(*parts[i])
        assert got[i].rule == rule and got[i].verdict in ("allow", "block") and (verdict is None or got[i].verdict == verdict)
    # The method's scores, by hand: interpolated counts of each context length.
    seen = {v: Counter() for v in ("allow", "block")}
    distinct = {(h + p, plain_rule(h, p)[1]) for h, p in parts.values() if h + p}
    for url, verdict in distinct:
        padded = url_filter.START * url_filter.ORDER + url
        for j in range(len(url)):
            if verdict and zlib.crc32(url.encode()) % url_filter.FOLDS:
                for k in range(url_filter.ORDER + 1):
                    gram = padded[j + url_filter.ORDER - k : j + url_filter.ORDER + 1]
                    seen[verdict][k, gram] += 1
                    seen[verdict][k, gram[:-1], "ctx"] += 1
    for i, (h, p) in parts.items():
        url, total = h + p, 0.0
        padded = url_filter.START * url_filter.ORDER + url
        for j in range(len(url)):
            logs = []
            for v in ("allow", "block"):
                x = 1 / url_filter.ALPHABET
                for k in range(url_filter.ORDER + 1):
                    gram = padded[j + url_filter.ORDER - k : j + url_filter.ORDER + 1]
                    x = (seen[v][k, gram] + url_filter.SMOOTHING * x) / (seen[v][k, gram[:-1], "ctx"] + url_filter.SMOOTHING)
                logs.append(math.log(x))
            total += logs[0] - logs[1]
        assert abs(got[i].score - (total / len(url) if url else 0)) < 1e-6
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_neighbours(spark):
    table = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    labels = table("labels")
    got = {r.doc_id: r for r in quality_knn.score(table("documents"), labels).collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(p == q for p, q in held) / len(held) > 0.9
    odd = spark.createDataFrame([(1, None, 3), (None, "", 4), (2, "x" * 100_000, 5)], "doc_id long, text string, quality int")
    assert len({r.score for r in quality_knn.score(odd, labels).collect()[:2]}) == 1
    assert all(r.score == 0.5 for r in quality_knn.score(odd, labels.limit(0)).collect())


def test_labelled_documents_stay_off_the_driver(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat(id, if(id % 2 = 1, ' some good words ', '!! $$ '), hash(id)) as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    tracemalloc.start()
    try:
        scores = quality_knn.score(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # 3000 labelled documents of 4096 counts; their 16-bit counts alone are 25 MB, the projection and vectors 1.4 MB
    assert peak < 12_000_000
    assert all(r.predicted == r.doc_id % 2 for r in scores.collect() if r.held_out)


def test_votes_equal_a_plain_loop():
    rng = quality_knn.np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcd "), 60)) for _ in range(80)]
    idf = rng.random(quality_knn.FEATURES) + 0.5
    labels = [int(k % 3 == 0) for k in range(50)] + [0, 1]
    known = [*texts[:50], texts[0], texts[0]]  # equally near voters
    voters = quality_knn.Voters([quality_knn.counts(t) for t in known], labels, idf, 0.7)
    weight = 0.7 / 0.3 * labels.count(0) / labels.count(1)
    for text, got in zip(texts, voters.score(texts), strict=True):
        x = quality_knn.unit((quality_knn.features(quality_knn.counts(text)[None], voters.idf) - voters.mean) @ voters.axes)[0]
        cosines = [float(x @ v) for v in voters.vectors]
        near = sorted(range(len(known)), key=lambda k: (-round(cosines[k], 5), k))[: quality_knn.NEIGHBOURS]
        votes = [max(cosines[k], 0) ** quality_knn.POWER * (weight if labels[k] else 1) for k in near]
        assert abs(got - sum(v * labels[k] for v, k in zip(votes, near, strict=True)) / sum(votes)) < 0.02


def test_ratio_scores_equal_a_plain_loop(spark):
    rng = random.Random(12)
    docs = [(i, " ".join(rng.choice(["ab", "cd", "ef", "gh", "ij"][: 5 if i % 2 else 3]) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 4)] + [(i, 1, 0) for i in range(1, 40, 3)], "doc_id long, quality int, toxic int")
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    grams = lambda t: [*(w := t.split()), *zip(w, w[1:], strict=False)]
    raw, target = Counter(), Counter()
    for i, t in docs:
        raw.update(grams(t))
        target.update(grams(t) if i in good else [])
    b, p = quality_rules.BUCKETS, quality_rules.PSEUDO
    shift = math.log(sum(raw.values()) + p * b) - math.log(sum(target.values()) + p * b)
    for r in quality_rules.judge(frame, labels).collect():
        own = grams(docs[r.doc_id][1])
        want = sum(math.log(target[g] + p) - math.log(raw[g] + p) + shift for g in own) / len(own) if own else 0
        assert abs(r.score - want) < 1e-6  # 30 features of 32,768 buckets: no two share one

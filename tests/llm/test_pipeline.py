"""The pipeline against plain versions of its stages, one after another."""

import math
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import xxhash
from lexigrove.llm import pii
from lexigrove.llm import quality_rules as q
from tokenizers import Tokenizer

from tests.llm.test_ngram_join import brute as groups
from tests.llm.test_quality import WORD, counts

SF = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def buckets(text):
    """Hashes as Spark's xxhash64 makes them."""
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
    pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(h, h[1:], strict=False)]
    return [signed(x) % q.BUCKETS for x in (*h, *pairs)]


def good(rows, trusted):
    raw, target = Counter(), Counter()
    features = {i: buckets(t) for i, t in rows}
    for i, f in features.items():
        raw.update(f)
        target.update(f if i in trusted else [])
    shift = math.log(sum(raw.values()) + q.PSEUDO * q.BUCKETS) - math.log(sum(target.values()) + q.PSEUDO * q.BUCKETS)
    out = []
    for i, t in rows:
        n, *_, repeated = counts(t)
        f = features[i]
        score = sum(math.log(target[b] + q.PSEUDO) - math.log(raw[b] + q.PSEUDO) + shift for b in f) / len(f) if f else 0
        if n >= q.LEAST_WORDS and 100 * repeated <= q.MOST_REPEATED * n and score >= q.THRESHOLD:
            out.append((i, t))
    return out


def sanitised(rows):
    base = [pii.base_spans(t) for _, t in rows]
    entities = [{(k, t[s:e]) for s, k, e in b} for (_, t), b in zip(rows, base, strict=True)]
    terms = [pii.term_hashes(t) for _, t in rows]
    n_e, n_t = Counter(e for x in entities for e in x), Counter(t for x in terms for t in x)
    n_et = Counter((e, t) for x, y in zip(entities, terms, strict=True) for e in x for t in y)
    out = []
    for (i, text), b, x, y in zip(rows, base, entities, terms, strict=True):
        found = {}
        for e in x:
            ic = math.log2(len(rows) / n_e[e])
            for t in y if ic > 0 else ():
                ratio = math.log2(n_et[e, t] * len(rows) / (n_e[e] * n_t[t]))
                if ratio >= pii.GENERALISE * ic - 1e-12:
                    found[t] = found.get(t, False) or ratio >= pii.REMOVE * ic - 1e-12
        out.append((i, pii.sanitised(text, b, found) if b else text))
    return out


def test_pipeline_equals_plain_stages(spark):
    table = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    rows = [(r.doc_id, r.text) for r in table("documents").collect()]
    trusted = {r.doc_id for r in table("labels").collect() if r.quality == 1 and not r.toxic}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "ngram_join", "pii", "packing"]
    left = good(rows, trusted)
    assert 0 < len(left) < len(rows)
    last = {t: i for i, t in sorted(left)}
    left = [(i, t) for i, t in left if last[t] == i]
    stays = {i for i, _, component in groups(left) if component == i}
    left = sanitised([(i, t) for i, t in left if i in stays])
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = []
    for i, t in left:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        want += [(i, p, a, len(c := ids[a : a + 2048]), zlib.crc32(np.array(c, "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), 2048))]
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and len(used) <= -(-sum(used.values()) // 2048) + 1

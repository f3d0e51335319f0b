"""BPE and packing against the tokenizers library, and the packing plan."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
from lexigrove.llm import bpe, packing
from pyspark.sql import functions as F
from tokenizers import Tokenizer

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = [" ", "\n", "  ", " \n", "\t", "a", "É", "ß", "12", "'s", "'", "<|endoftext|>", "\x00", "\x1d", "\u3000", "!?", "\u0301", "Σ", "\r\n", "中", "the", "x" * 9, "İ", "ﬁ", "🙂"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_byte_bpe_equals_the_library():
    library, own = Tokenizer.from_file(BYTE), bpe.ByteBpe(BYTE)
    for text in texts(4000):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(own.encode(text)) == want, text
        assert own.decode(own.encode(text)) == library.decode(want, skip_special_tokens=False), text


def test_long_word():
    own = bpe.ByteBpe(BYTE)
    word = "ab" * 100_000
    assert own.decode(own.encode(word)) == word


def test_word_ids_equal_the_library():
    library, own = Tokenizer.from_file(WORD), packing.WordIds(WORD)
    for text in texts(4000, 2):
        assert ids(own.encode(text)) == library.encode(text, add_special_tokens=False).ids, text


def test_words_that_skip_the_normaliser_equal_the_library():
    library, own = Tokenizer.from_file(WORD), packing.WordIds(WORD)
    low = [chr(c) for c in range(0x250)]
    for text in [*low, *(f"a{c}{c}b {c}a?" for c in low), "".join(c for c in low if c.isalpha()), "éauxelleç $$$ a\x00b\x7f", "it's 'S \u00b2\u00bd"]:
        assert ids(own.encode(text)) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_many_words_take_little_memory():
    own = packing.WordIds(WORD)
    tracemalloc.start()
    for k in range(0, 500_000, 1000):
        own.encode(" ".join("".join(chr(97 + (x >> s & 15)) for s in (0, 4, 8, 12, 16)) for x in range(k, k + 1000)))
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 70_000_000, most


def test_round_trip_of_tables(spark):
    rows = [(1, "Hello world"), (2, None), (3, ""), (None, "x"), (1, "Hello world"), (4, "é\n" * 30_000)]
    docs = spark.createDataFrame([(i, t, b"") for i, t in rows], "doc_id long, text string, ids binary")
    got = bpe.round_trip(docs, BYTE).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in got) == sorted((str(i), t or "") for i, t in rows)
    coded = bpe.encode(docs, BYTE)
    assert sorted(r.text for r in bpe.decode(coded, BYTE).collect()) == sorted(t or "" for _, t in rows)
    assert bpe.encode(docs.limit(0), BYTE).count() == 0


def test_plan_uses_everything_once_and_little_room():
    rng = random.Random(4)
    for capacity in (10, 64, 2048):
        counts: dict[int, int] = {}
        for _ in range(3000):
            n = min(capacity, max(1, int(rng.lognormvariate(capacity**0.5 / 8 + 1, 1))))
            counts[n] = counts.get(n, 0) + 1
        used: dict[int, int] = {}
        bins = 0
        for bin_, times in packing.plan(counts, capacity):
            assert 0 < sum(n * k for n, k in bin_.items()) <= capacity
            bins += times
            for n, k in bin_.items():
                used[n] = used.get(n, 0) + k * times
        assert used == counts
        assert bins <= 1.02 * sum(n * c for n, c in counts.items()) / capacity + 2


def test_packed_table(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["apple", "thinorsh", "x,", "Δδ"]) for _ in range(rng.choice([0, 3, 40, 400, 2500])))) for i in range(60)] + [(7, None), (None, "a"), (8, "dup"), (8, "dup")]
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, length string").repartition(3)
    packed = packing.pack(packing.pieces(docs, WORD).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("crc"))).collect()
    library = Tokenizer.from_file(WORD)
    want = []
    for i, t in rows:
        all_ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, p, a, len(c := all_ids[a : a + 2048]), zlib.crc32(np.array(c, "<u4").tobytes())) for p, a in enumerate(range(0, len(all_ids), 2048))]
    assert sorted(map(str, ((r.doc_id, r.piece, r.start, r.length, r.crc) for r in packed))) == sorted(map(str, want))
    bins: dict[int, list] = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in packed)
    assert len(bins) <= -(-total // 2048) + 1
    assert packing.pack(packing.pieces(docs.limit(0), WORD)).count() == 0
    assert hashlib.sha256(b"").hexdigest()


def test_packing_keeps_clashing_columns(spark):
    pieces = spark.createDataFrame([(i, 0, 1 + i % 7, "g", 5, 6) for i in range(50)], "doc_id long, piece int, length int, group string, rank int, n int")
    packed = packing.pack(pieces, 10)
    assert packed.columns == [*pieces.columns, "sequence_id", "offset"]
    assert sorted(tuple(r)[:6] for r in packed.collect()) == sorted(map(tuple, pieces.collect()))

"""Best-fit packing of token sequences by minimum bin slack.

The plan needs only how many pieces there are of each length, a table of at most ``capacity`` rows. For each bin,
a bitset subset-sum over the lengths that remain finds the fullest combination beside the longest remaining piece.
The same combination is then repeated as long as all its lengths last, so the number of combinations is bounded by
the capacity too, not by the data. Pieces find their places by their rank within their length.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from array import array
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from lexigrove.llm.bpe import byte_alphabet
from lexigrove.llm.common import Memo, map_batches
from lexigrove.session import Shelf

#: Tokens of a sequence, and the id that ends each document.
CAPACITY, END_ID = 2048, 0
#: Ranks are counted in groups of at least so many pieces of a length, and in about so many groups in all.
GROUP_ROWS, GROUPS = 200, 4096


#: Marks that commonly follow a word.
PUNCTUATION = frozenset(".,;:!?")
#: Runs and words whose ids a worker remembers, in each of two generations. Workers live on after a task, beside others.
REMEMBERED = 200_000


class WordIds:
    """Ids by the tokenizers library, remembered for each word and each run of characters between white space.

    The vocabulary's tokenizer drops white space and none of its words reaches over any, so a text's ids are those
    of its runs, one after another. A word is a run too, so one cache does for both.
    """

    #: Fixed value: how this vocabulary's tokenizer cuts a text into words.
    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
    #: Characters that str.split() drops and the tokenizer doesn't.
    SEPARATORS = re.compile("[\x1c-\x1f]")

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = {t: array("I", [self.tokenizer.token_to_id(t)]).tobytes() for t in added}
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")")
        self.characters = {b: c for c, b in byte_alphabet().items()}
        self.run = Memo(self._run, REMEMBERED)

    def _encoded(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """A word as WORDS cuts it. The model alone does for ASCII and for Latin letters, which the normaliser leaves as they are."""
        if word.isascii() and word.isalnum():
            return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        if word.isascii() or (word.isalpha() and max(word) < "\u0250"):  # its bytes, as the vocabulary writes them
            return array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.characters))]).tobytes()
        return self._encoded(word)

    def _run(self, run: str) -> bytes:
        if run.isalpha():  # one word
            return self._word(run)
        if run[-1] in PUNCTUATION and run[:-1].isalpha():  # one word and a mark
            return self.run[run[:-1]] + self.run[run[-1]]
        words = self.WORDS.findall(run)
        return self._word(run) if words == [run] else b"".join([self.run[w] for w in words])

    def _plain(self, text: str) -> bytes:
        if self.SEPARATORS.search(text):
            return self._encoded(text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # Lower-casing goes by single characters: no final sigma.
        return b"".join(map(self.run.__getitem__, text.replace("Σ", "σ").lower().split()))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; an added token's own text becomes that token."""
        if not any(t in text for t in self.added):
            return self._plain(text)
        return b"".join(self.added[part] if part in self.added else self._plain(part) for part in self.cut_added.split(text))


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids: a row for each piece of each row of ``docs``.

    A document is its text's ids and END_ID; a null text counts as empty, so it is one piece of length 1. Only
    longer documents are cut, into pieces of ``capacity``, the last one perhaps shorter. Repeated rows and null ids
    give pieces of their own.
    """
    end = array("I", [END_ID]).tobytes()

    def each(batch: pa.RecordBatch) -> Iterable[tuple]:
        words = word_ids(path)
        for i, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
            ids = words.encode(text or "") + end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                yield i, piece, at // 4, len(part) // 4, part

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), each, schema, "doc_id long, piece int, start long, length long, ids binary")


def fullest(remaining: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of each length fill ``room`` best: subset sums as bits, longer pieces first."""
    sums, full, trail = 1, (1 << (room + 1)) - 1, []
    for length in sorted((n for n, c in remaining.items() if c and n <= room), reverse=True):
        trail.append((length, sums))
        most = min(remaining[length], room // length)
        step = 1
        while most:  # multiples 1, 2, 4, ... and the rest reach every number of pieces up to most
            step = min(step, most)
            sums |= (sums << (step * length)) & full
            most -= step
            step *= 2
        if sums >> room & 1:
            break
    total, chosen = sums.bit_length() - 1, {}
    for length, before in reversed(trail):
        count = 0
        while not before >> total & 1:
            total -= length
            count += 1
        if count:
            chosen[length] = count
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths, each with how many sequences it fills; together they use up ``counts``."""
    remaining, out = {n: c for n, c in counts.items() if c > 0}, []
    while remaining:
        longest = max(remaining)
        remaining[longest] -= 1
        bin_ = fullest(remaining, capacity - longest)
        remaining[longest] += 1
        bin_[longest] = bin_.get(longest, 0) + 1
        times = min(remaining[n] // k for n, k in bin_.items())
        out.append((bin_, times))
        for n, k in bin_.items():
            remaining[n] -= k * times
            if not remaining[n]:
                del remaining[n]
    return out


def places(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces a sequence, first sequence, first offset) for each use of a length."""
    used, sequence, out = dict.fromkeys(counts, 0), 0, []
    for bin_, times in plan(counts, capacity):
        offset = 0
        for n, k in sorted(bin_.items(), reverse=True):
            out.append((n, used[n], used[n] + k * times, k, sequence, offset))
            used[n] += k * times
            offset += n * k
        sequence += times
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (length between 1 and ``capacity``) with sequence_id and offset; offsets have no gaps.

    ``order`` only decides which of equally long pieces goes where; ties and nulls in it do no harm. An empty table
    gives an empty result; other columns pass through, but for older ones named sequence_id or offset. The driver gets counts by length, at most ``capacity`` rows.
    """
    spark = pieces.sparkSession
    shelf = Shelf(spark, "packing")
    rows = shelf.put(pieces.select(F.struct(*(F.col(c) for c in pieces.columns)).alias("piece"), F.col("length").cast("long").alias("n")))
    counts = {r["n"]: r["c"] for r in rows.groupBy("n").agg(F.count("*").alias("c")).collect()}
    each = max(GROUP_ROWS, sum(counts.values()) // GROUPS)
    groups = spark.createDataFrame([(n, -(-c // each)) for n, c in counts.items()], "n long, groups long")
    keys = [F.col("piece").getField(c) for c in order]
    dealt = rows.join(F.broadcast(groups), "n").withColumn("group", F.pmod(F.xxhash64(*keys), "groups")).drop("groups")
    sizes = dealt.groupBy("n", "group").agg(F.count("*").alias("c")).collect()  # at most GROUPS + capacity rows
    first: list[tuple[int, int, int]] = []
    so_far = dict.fromkeys(counts, 0)
    for n, group, c in sorted(map(tuple, sizes)):
        first.append((n, group, so_far[n]))
        so_far[n] += c
    firsts = spark.createDataFrame(first, "n long, group long, first long")
    there = spark.createDataFrame(places(counts, capacity), "m long, from long, to long, k long, sequence long, offset long")
    within = Window.partitionBy("n", "group").orderBy(*keys)
    return (
        dealt.withColumn("rank", F.row_number().over(within) - 1)
        .join(F.broadcast(firsts), ["n", "group"])
        .withColumn("rank", F.col("rank") + F.col("first"))
        .join(F.broadcast(there), (F.col("n") == F.col("m")) & (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to")))
        .withColumn("at", F.col("rank") - F.col("from"))
        .select(
            *(F.col("piece").getField(c).alias(c) for c in pieces.columns if c not in ("sequence_id", "offset")),
            (F.col("sequence") + F.floor(F.col("at") / F.col("k"))).cast("long").alias("sequence_id"),
            (F.col("offset") + F.col("at") % F.col("k") * F.col("n")).alias("offset"),
        )
    )

"""Byte-level BPE encoding and decoding.

Encoding keeps the symbols of a word in a doubly linked list and the possible merges in a priority queue of ranks;
an entry whose symbols have changed meanwhile is stale and skipped. Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import functools
import heapq
import json
from array import array
from collections.abc import Iterable
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.common import Memo, map_batches

#: Fixed value: how this vocabulary's tokenizer cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: White space other than single blanks and single newlines between other characters needs the whole pattern.
UNUSUAL = regex.compile(r"[\x00\p{White_Space}--[ \n]]|[ \n][ \n]|[ \n]\Z", regex.V1)


#: Marks that commonly follow a word.
PUNCTUATION = frozenset(".,;:!?")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: itself, or the next one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge_symbols(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Applies the merges of ``ranks`` ((left, right) -> (rank, merged)), lowest rank first, then leftmost."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = list(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    queue = []
    for i in range(n - 1):
        found = ranks.get((symbols[i], symbols[i + 1]))
        if found:
            queue.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
    heapq.heapify(queue)
    while queue:
        _, i, left, right, merged = heapq.heappop(queue)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue
        symbols[i], symbols[j] = merged, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            found = ranks.get((merged, symbols[k]))
            if found:
                heapq.heappush(queue, (found[0], i, merged, symbols[k], found[1]))
        h = before[i]
        if h >= 0:
            found = ranks.get((symbols[h], merged))
            if found:
                heapq.heappush(queue, (found[0], h, symbols[h], merged, found[1]))
    return [s for s in symbols if s >= 0]


class ByteBpe:
    """A vocabulary file of the tokenizers library, read as byte-level BPE."""

    def __init__(self, path: str) -> None:
        file = json.loads(Path(path).read_text(encoding="utf-8"))
        alphabet = byte_alphabet()
        vocab: dict[str, int] = file["model"]["vocab"]
        added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.strings: list[bytes] = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for token, i in vocab.items():
            self.strings[i] = bytes(alphabet[c] for c in token)
        for token, i in added.items():
            self.strings[i] = token.encode()
        self.first = [0] * 256
        for c, b in alphabet.items():
            self.first[b] = vocab[c]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"])
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.added = {t: array("I", [i]).tobytes() for t, i in added.items()}
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")")
        self.words = regex.compile(WORDS)
        self.word = Memo(self._word)
        self.segment = Memo(self._segment)

    def _word(self, word: str) -> bytes:
        first = self.first
        return array("I", merge_symbols([first[b] for b in word.encode()], self.ranks)).tobytes()

    def _segment(self, text: str) -> bytes:
        body = text[1:] if text[:1] == " " else text
        if body.isalpha():  # one word
            return self.word[text]
        if body and body[-1] in PUNCTUATION and body[:-1].isalpha():  # one word and a mark
            return self.word[text[:-1]] + self.word[text[-1]]
        return b"".join([self.word[w] for w in self.words.findall(text)])

    def _plain(self, text: str) -> bytes:
        if UNUSUAL.search(text):
            return self._segment(text)
        # No word of WORDS reaches over a place before a single blank, or beside a single newline.
        return b"".join(map(self.segment.__getitem__, text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; an added token's own text becomes that token."""
        if not any(t in text for t in self.added):
            return self._plain(text)
        return b"".join(self.added[part] if part in self.added else self._plain(part) for part in self.cut_added.split(text))

    def decode(self, ids: bytes) -> str:
        """Concatenated vocabulary strings; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (binary, little-endian unsigned 32-bit). A null text counts as empty
    and has no ids; null and repeated ids pass through; an empty table gives an empty result."""

    def each(batch: pa.RecordBatch) -> Iterable[tuple]:
        bpe = codec(path)
        for i, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
            yield i, bpe.encode(text or "")

    return map_batches(_two(docs, id_col, text_col), each, pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())]), "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of a table of doc_id and ids. Null ids give an empty text."""

    def each(batch: pa.RecordBatch) -> Iterable[tuple]:
        bpe = codec(path)
        for i, ids in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
            yield i, bpe.decode(ids or b"")

    return map_batches(encoded.select("doc_id", "ids"), each, pa.schema([("doc_id", pa.int64()), ("text", pa.string())]), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() and decode() of each text in one pass: doc_id, ids, decoded."""

    def each(batch: pa.RecordBatch) -> Iterable[tuple]:
        bpe = codec(path)
        for i, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
            ids = bpe.encode(text or "")
            yield i, ids, bpe.decode(ids)

    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
    return map_batches(_two(docs, id_col, text_col), each, schema, "doc_id long, ids binary, decoded string")


def _two(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

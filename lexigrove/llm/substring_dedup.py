"""Substring dedup: paragraphs that follow the content, hashed and grouped over the whole corpus.

Words are normalised: lower-cased, without what is no letter, digit or underscore. A text is cut into blocks before
each word whose local hash (of it and the word before) is the least among ``reach`` words on either side. So a cut
depends on a few words around it only, and a passage that is copied into the middle of a sentence is cut like its source
but for its edges. A unit is a paragraph of ``blocks`` blocks in a row, one from each block on; a shorter text is one
unit. Of equal units the earliest ranked occurrence (by document id, then row, then place) stays, and all later ones
are removed, however long they are. Offsets are those of the original text, in code points.

Lines as units would miss passages that begin and end within sentences, and short lines ("Of.") are in most documents.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrove.llm.common import Memo, bit_filter, in_filter, map_arrow
from lexigrove.session import Shelf

#: Words on either side that a cut is the least of; blocks of a unit. Blocks are about 2 * REACH + 1 words long.
REACH, BLOCKS = 4, 3
#: Bits of the filter for digests that come again; its size is fixed, and a full filter only saves less work.
FILTER_BITS = 1 << 23
#: From here on, numbers stand for rows without an id.
NO_ID = 1 << 62
NO_WORD = re.compile(r"\W+")
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> np.uint64(33))) * _A
    x = (x ^ (x >> np.uint64(33))) * _B
    return x ^ (x >> np.uint64(33))


def word_hash(word: bytes) -> int:
    """Of a lower-cased word; 0 if it holds no letter, digit or underscore."""
    plain = NO_WORD.sub("", word.decode())
    return xxhash.xxh3_64_intdigest(plain) if plain else 0


_words = Memo(word_hash, 100_000)


def _shifted(x: np.ndarray, k: int) -> np.ndarray:
    """x[p + k] at p; what is beyond the ends is never looked at."""
    return np.roll(x, -k)


def text_units(texts: list[str], reach: int = REACH, blocks: int = BLOCKS) -> dict[str, np.ndarray]:
    """text (its number), start, end, first and last word, h1, h2 (a 128-bit hash) of each unit of each text, in order.

    A unit ends where the word after it starts, or with the text.
    """
    joined = "\n".join(texts)
    hashes = np.fromiter(map(_words.__getitem__, joined.lower().encode().split()), np.uint64)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    blank = (points == 32) | ((points >= 9) & (points <= 13))  # what bytes are split at
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))[hashes != 0] if len(points) else np.zeros(0, np.int64)
    h = hashes[hashes != 0]
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(lengths + 1) - lengths - 1  # of each text in the joined one
    of = np.searchsorted(begins, starts, side="right") - 1  # the text of each word
    if not len(h):
        return {k: np.zeros(0, np.int64) for k in ("text", "start", "end", "first", "last", "h1", "h2")}
    place = np.arange(len(h))
    head = np.searchsorted(of, np.arange(len(texts)))[of]  # the first word of its text
    tail = np.searchsorted(of, np.arange(len(texts)), side="right")[of]
    local = _mix(h * np.uint64(0x9E3779B97F4A7C15) + np.concatenate(([np.uint64(0)], h[:-1])))
    cut = (place - reach > head) & (place + reach < tail)
    for k in range(1, reach + 1):
        cut &= (local < _shifted(local, -k)) & (local <= _shifted(local, k))
    first = np.flatnonzero(cut | (place == head))  # of each block
    last = np.append(first[1:], len(h))  # the word after it
    inside = (place - np.repeat(first, last - first)).astype(np.uint64)
    sums = [np.add.reduceat(_mix(h + _mix(inside + np.uint64(salt))), first) for salt in (1, 1 << 40)]
    text = of[first]
    n = np.searchsorted(text, text, side="right") - np.searchsorted(text, text)  # blocks of its text
    number = np.arange(len(first)) - np.searchsorted(text, text)
    size = np.minimum(n, blocks)
    is_unit = np.flatnonzero(number + size <= n)
    h1, h2 = (_mix(s[is_unit] + size[is_unit].astype(np.uint64)) for s in sums)
    for k in range(1, blocks):
        more = size[is_unit] > k
        at = np.minimum(is_unit + k, len(first) - 1)
        h1, h2 = (np.where(more, _mix(x * np.uint64(0x9E3779B97F4A7C15) + s[at]), x) for x, s in zip((h1, h2), sums, strict=True))
    after = last[is_unit + size[is_unit] - 1]
    own = text[is_unit]
    whole = after == tail[first[is_unit]]
    end = np.where(whole, lengths[own], starts[np.minimum(after, len(h) - 1)] - begins[own])
    return {"text": own, "start": starts[first[is_unit]] - begins[own], "end": end, "first": first[is_unit] - head[first[is_unit]], "last": after - head[first[is_unit]], "h1": h1.view(np.int64), "h2": h2.view(np.int64)}


def _digests(rows: DataFrame, reach: int, blocks: int) -> DataFrame:
    """rid, h1, h2 of each unit of ``rows`` (rid, text)."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        units = text_units([t or "" for t in batch[1].to_pylist()], reach, blocks)
        return pa.RecordBatch.from_arrays([batch[0].take(pa.array(units["text"])), pa.array(units["h1"]), pa.array(units["h2"])], ["rid", "h1", "h2"])

    return map_arrow(rows.select("rid", "text"), each, "rid long, h1 long, h2 long")


def _places(rows: DataFrame, again: DataFrame, reach: int, blocks: int) -> DataFrame:
    """rid, row, start, end, first, last, h1, h2 of units of ``rows`` (rid, row, text) that ``again`` may hold."""
    there = bit_filter(again.select(F.pmod("h1", F.lit(FILTER_BITS)).alias("b")), FILTER_BITS)
    names = ("start", "end", "first", "last", "h1", "h2")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        units = text_units([t or "" for t in batch[2].to_pylist()], reach, blocks)
        known = in_filter(there.value, units["h1"] % FILTER_BITS)
        of = pa.array(units["text"][known])
        return pa.RecordBatch.from_arrays([batch[0].take(of), batch[1].take(of), *(pa.array(units[k][known].astype(np.int64)) for k in names)], ["rid", "row", *names])

    return map_arrow(rows.select("rid", "row", "text"), each, ", ".join(f"{k} long" for k in ("rid", "row", *names)))


def _runs(shelf: Shelf, rows: DataFrame, reach: int, blocks: int) -> DataFrame:
    """row, rid, start, end, words, units, keep_rid of what is removed from ``rows`` (rid, row, text)."""
    rows = rows.where("length(text) > 0")
    # Counts and first documents are combined before they move; a unit that half of all documents share is one row.
    again = shelf.put(_digests(rows, reach, blocks).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("rid").alias("keep_rid")).where("n > 1").drop("n"))
    # Both sides of the join are plain tables, so that a digest which many documents share is split between tasks.
    found = shelf.put(_places(rows, again, reach, blocks).join(again, ["h1", "h2"]))
    shelf.drop(again)
    within = Window.partitionBy("rid", "row").orderBy("start")
    first = F.row_number().over(Window.partitionBy("rid", "h1", "h2").orderBy("row", "start")) == 1
    before = F.max("end").over(within.rowsBetween(Window.unboundedPreceding, -1))
    return (
        found.repartition("rid")
        .withColumn("stays", first & (F.col("rid") == F.col("keep_rid")))
        .where("not stays")
        .withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1))
        .withColumn("island", F.sum("new").over(within))
        .groupBy("rid", "row", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("last") - F.min("first")).cast("int").alias("words"), F.count("*").alias("units"), F.min("keep_rid").alias("keep_rid"))
        .drop("island")
    )


def _rid(id_col: str, text_col: str) -> Column:
    """The id, or a number of the text's own for rows without one, which rank last."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(F.col(text_col).cast("string")), 3))


def _id(rid: str) -> Column:
    return F.when(F.col(rid) < F.lit(NO_ID), F.col(rid))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, blocks: int = BLOCKS) -> DataFrame:
    """A row for each removed passage: doc_id, start, end, words, units, keep_id (the first document that keeps a unit of it).

    Null and empty texts, and texts without a word, have no units. A repeated row is a later occurrence of all its
    units. A row without an id ranks last, and its doc_id or keep_id is null. An empty table gives an empty result;
    other columns are ignored.
    """
    rows = docs.select(_rid(id_col, text_col).alias("rid"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    runs = _runs(Shelf(docs.sparkSession, "repeats"), rows, reach, blocks)
    return runs.select(_id("rid").alias("doc_id"), "start", "end", "words", "units", _id("keep_rid").alias("keep_id"))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, blocks: int = BLOCKS) -> DataFrame:
    """``docs`` without repeated passages, and __kept: the (start, end) of what stays, in the original text.

    Nulls, repeated rows and empty tables as in ``repeats``; all rows and columns stay. A column __kept of ``docs``
    gives way to the new one.
    """
    shelf = Shelf(docs.sparkSession, "substring-dedup")
    rows = shelf.put(docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("doc"), _rid(id_col, text_col).alias("rid"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text")))
    gone = _runs(shelf, rows.select("rid", "row", "text"), reach, blocks).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("gone"))
    joined = rows.join(gone, "row", "left")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("gone", lambda g: g["end"]))
    starts = F.concat(F.transform("gone", lambda g: g["start"]), F.array(F.length("text").cast("long")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("end")))
    kept = F.when(F.col("gone").isNull(), whole).otherwise(F.filter(F.zip_with(ends, starts, lambda s, e: F.struct(s.alias("start"), e.alias("end"))), lambda k: k["start"] < k["end"]))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform("kept", lambda k: F.substr(F.col("text"), (k["start"] + 1).cast("int"), (k["end"] - k["start"]).cast("int"))), ""))
    columns = [text.alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns if c != "__kept"]
    return joined.withColumn("kept", kept).select(*columns, F.col("kept").alias("__kept"))

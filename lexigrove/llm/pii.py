"""Personal data: fixed patterns, and terms that reveal what the patterns protect.

Entities are the values that the patterns find. Over the whole corpus, the number of documents that hold an entity
(n_e), a term (n_t) and both (n_et) gives the entity's information content IC(e) = -log2(n_e / N) and the pointwise
mutual information PMI(e, t) = log2(n_et * N / (n_e * n_t)). A term with PMI(e, t) >= ``generalise`` * IC(e) says so
much of e that it is generalised in documents that hold e; at ``remove`` * IC(e) it is removed. That holds for entities of
any support: a term that is in no other document than an entity's only one tells all of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexigrove.llm.common import bit_filter, in_filter, map_arrow, map_batches
from lexigrove.session import Shelf

#: Kinds in the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone")
#: The domain of an address, from its @; four numbers with dots; digits with single separators; a number from its +.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A text without any of these characters holds none of the kinds.
MAY_HOLD = "[0-9@]"
TERM = re.compile(r"[^\W\d_]{4,}")
#: Shares of an entity's information at which a term is generalised or removed.
GENERALISE, REMOVE = 0.95, 1.0
#: Bits of the filter for terms that may matter; its size is fixed, and a full filter only saves less work.
FILTER_BITS = 1 << 22


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of what the patterns find, in order; a kind's spans don't overlap."""
    out, end = [], 0
    for m in DOMAIN.finditer(text):
        at = start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            end = m.end()
            out.append((start, 0, end))
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def listed(spans: Iterable[tuple[int, int, int]]) -> str:
    names = (*KINDS, "term")
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def term_hashes(text: str) -> np.ndarray:
    """_hash() of each distinct term."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, set(TERM.findall(text.lower()))), np.uint64)
    return (hashes ^ np.uint64(1 << 63)).view(np.int64)


def term_spans(text: str, terms: dict[int, bool], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Occurrences of the terms outside base spans; kind 4. One sweep over both, which come in order of their starts."""
    out, ahead, covered = [], iter(base), 0
    span = next(ahead, None)
    for m in TERM.finditer(text):
        while span and span[0] < m.end():
            covered = max(covered, span[2])
            span = next(ahead, None)
        if covered <= m.start() and _hash(m.group().lower()) in terms:
            out.append((m.start(), 4, m.end()))
    return out


def sanitised(text: str, base: list[tuple[int, int, int]], terms: dict[int, bool]) -> str:
    """``text`` with kinds in place of what was found; a term is generalised to [TERM], or removed where its value is true."""
    out, at = [], 0
    for s, k, e in sorted([*base, *term_spans(text, terms, base)], key=lambda x: (x[0], -x[2])):
        if s < at:
            if e > at:  # the rest of a span that overlaps
                at = e
            continue
        out += [text[at:s], "" if k == 4 and terms[_hash(text[s:e].lower())] else f"[{KINDS[k].upper()}]" if k < 4 else "[TERM]"]
        at = e
    return "".join([*out, text[at:]])


def _with_base(rows: DataFrame) -> DataFrame:
    """``rows`` (doc, text) with n0..n3 (spans of each kind), base (as text) and entities (hashes of distinct values)."""
    added = pa.schema([*(pa.field(f"n{k}", pa.int64()) for k in range(4)), pa.field("base", pa.string()), pa.field("entities", pa.list_(pa.int64()))])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in added]
        for text in batch[1].to_pylist():
            spans = base_spans(text)
            for k in range(4):
                columns[k].append(sum(x[1] == k for x in spans))
            columns[4].append(listed(spans))
            columns[5].append(sorted({_hash(f"{k}:{text[s:e]}") for s, k, e in spans}))
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, f.type) for c, f in zip(columns, added, strict=True))], schema=pa.schema([*batch.schema, *added]))

    kinds = [*(T.StructField(f"n{k}", T.LongType()) for k in range(4)), T.StructField("base", T.StringType()), T.StructField("entities", T.ArrayType(T.LongType()))]
    return map_arrow(rows, each, T.StructType([*rows.schema.fields, *kinds]))


def _term_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """n_t over all of ``texts``, for ``terms`` and a few others that the fixed-size filter lets through."""
    there = bit_filter(terms.select(F.pmod("term", F.lit(FILTER_BITS)).alias("b")), FILTER_BITS)

    def each(batch: pa.RecordBatch) -> Iterable[tuple]:
        found = [term_hashes(text) for text in batch[0].to_pylist() if text]
        terms, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
        known = in_filter(there.value, terms % FILTER_BITS)
        yield from zip(terms[known].tolist(), counts[known].tolist(), strict=True)

    counted = map_batches(texts, each, pa.schema([("term", pa.int64()), ("n", pa.int64())]), "term long, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosing(shelf: Shelf, texts: DataFrame, held: DataFrame, generalise: float, remove: float) -> DataFrame:
    """row, terms (map of term hash to whether it is removed) for rows of ``held`` with terms that reveal their entities.

    A pair passes only if n_et / n_t >= (n_e / N) ** (1 - generalise), and n_et <= n_e, so n_t is at most
    n_e * (N / n_e) ** (1 - generalise). Terms above that bound leave each text before any pair is made. Entities that
    are in the same documents have the same ratios with every term; they count as one.
    """
    n = float(texts.count())
    with_entities = held.where(F.size("entities") > 0)
    entries = with_entities.select("row", F.explode("entities").alias("entity"))
    # Which documents hold an entity: their number and two hashes, 128 bits, of the set of them.
    sets = shelf.put(entries.groupBy("entity").agg(F.count("*").alias("n_e"), F.bit_xor(F.xxhash64("row")).alias("c1"), F.bit_xor(F.xxhash64(F.lit("2"), "row")).alias("c2")))
    most_terms = F.col("n_e") * F.pow(F.lit(n) / F.col("n_e"), F.lit(1 - generalise)) * (1 + 1e-9)
    classes = shelf.put(entries.join(sets, "entity").where(F.col("n_e") < n).select("row", "c1", "c2", "n_e", most_terms.alias("most")).distinct())
    rows = classes.groupBy("row").agg(F.max("most").alias("row_most"))

    def each(batch: pa.RecordBatch) -> Iterable[tuple]:
        for row, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
            for t in term_hashes(text).tolist():
                yield row, t

    terms = shelf.put(map_batches(with_entities.select("row", "text"), each, pa.schema([("row", pa.int64()), ("term", pa.int64())]), "row long, term long"))
    # A term is in no fewer documents than in those with entities.
    least = shelf.put(terms.groupBy("term").agg(F.count("*").alias("least")))
    rare = shelf.put(terms.join(least, "term").join(rows, "row").where("least <= row_most").select("row", "term"))
    counted = shelf.put(_term_counts(texts, rare.select("term").distinct()))
    pairs = shelf.put(rare.join(counted, "term").join(classes, "row").where("n_t <= most").select("row", "term", "n_t", "c1", "c2", "n_e"))
    shelf.drop(sets, classes, terms, least, rare, counted)
    ic = F.log2(F.lit(max(n, 1.0)) / F.col("n_e"))  # equals the ratio to the last bit where n_et = n_t
    ratio = F.log2(F.col("n_et") * F.lit(n) / (F.col("n_e") * F.col("n_t")))
    seen = pairs.groupBy("c1", "c2", "n_e", "term", "n_t").agg(F.count("*").alias("n_et"))
    revealed = shelf.put(seen.where(ratio >= generalise * ic).select("c1", "c2", "term", (ratio >= remove * ic).alias("gone")))
    found = shelf.put(pairs.join(revealed, ["c1", "c2", "term"]).groupBy("row", "term").agg(F.max("gone").alias("gone")).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "gone"))).alias("terms")))
    shelf.drop(pairs, revealed)
    return found


def _found(docs: DataFrame, text_col: str, generalise: float, remove: float) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` (doc, text) that hold nothing, and the others with their base spans and terms."""
    shelf = Shelf(docs.sparkSession, "pii")
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("doc"), F.col(text_col).cast("string").alias("text"))
    may = F.coalesce(F.col("text").rlike(MAY_HOLD), F.lit(False))
    held = shelf.put(_with_base(rows.where(may)).withColumn("row", F.monotonically_increasing_id()))
    terms = disclosing(shelf, rows.select("text"), held, generalise, remove)
    return rows.where(~may), held.join(terms, "row", "left")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base (spans as text), spans (all, as text).

    Spans are kind:start:end in code points, end exclusive. Null and empty texts have none. Repeated rows each give
    a row and each count as a document; null ids pass through; other columns are ignored; an empty table gives an
    empty result.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    without, held = _found(narrow, "text", generalise, remove)

    def each(batch: pa.RecordBatch) -> Iterable[tuple]:
        for text, terms, base, i, *counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            spans = base_spans(text) if terms else []
            yield i, *counts, base, listed(sorted([*spans, *term_spans(text, dict(terms), spans)])) if terms else base

    names = [f"n_{k}" for k in KINDS]
    schema = pa.schema([("doc_id", _arrow_type(narrow)), *((x, pa.int64()) for x in names), ("base", pa.string()), ("spans", pa.string())])
    shown = held.select("text", "terms", "base", "doc.doc_id", *(f"n{k}" for k in range(4)))
    kinds = T.StructType([narrow.schema["doc_id"], *(T.StructField(x, T.LongType()) for x in names), T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())])
    nothing = without.select("doc.doc_id", *(F.lit(0).cast("long").alias(x) for x in names), F.lit("").alias("base"), F.lit("").alias("spans"))
    return nothing.unionByName(map_batches(shown, each, schema, kinds))


def _arrow_type(docs: DataFrame) -> pa.DataType:
    return to_arrow_type(docs.schema["doc_id"].dataType)


def sanitise(docs: DataFrame, text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``docs`` with sanitised texts; all rows and columns stay, whatever the columns are called.

    Null and empty texts stay as they are. Repeated rows each count as a document and get the same text. An empty
    table stays empty.
    """
    without, held = _found(docs, text_col, generalise, remove)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text, terms in zip(batch[1].to_pylist(), batch[2].to_pylist(), strict=True):
            base = base_spans(text)
            texts.append(sanitised(text, base, dict(terms or [])) if base else text)
        return pa.RecordBatch.from_arrays([batch[0], pa.array(texts, pa.string())], names=["doc", "text"])

    shown = held.select("doc", "text", "terms")
    done = map_arrow(shown, each, T.StructType(shown.schema.fields[:2]))
    return without.unionByName(done).select(*(F.col("text").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns))

"""Documents whose sets of word shingles have a Jaccard similarity of at least a threshold, exactly.

Sets are partitioned by hashing shingles into segments. Sets r and s with |r| <= |s| and similarity >= t differ in at
most H = (1 - t) / (1 + t) * (|r| + |s|) shingles, so with more than H segments some segment is the same in both.
A scheme covers a band of sizes for the smaller set and what sizes the larger one may then have; a set joins the
schemes in which it may be either. What a set indexes is allocated by cost:

- an empty segment costs a collision with every other set that has it empty, and is given no signature;
- other segments are given the signature of their shingles;
- a set with so many empty segments that the pigeonhole argument might fail also indexes each segment's
  one-deletion neighbourhood, which finds segments that differ by one shingle;
- a set of which H / 2 segments hold nearly all shingles might share no signature even so (see ``bare``), and meets
  others of that kind in one bucket of its scheme.

A segment's signature is a sum of hashed shingles, so a deletion is one subtraction. Equal signatures only make
candidates; those are verified on the sets themselves.

Sets that are equal are one node. The hub of a bucket is the member that meets most others over all its buckets: of a
group of copies that is the original, as edits take copies out of buckets. Every node is compared with the hubs of its
buckets, which settles groups of copies in about as many comparisons as they have members. Only where the others in a
bucket are not one component by then are its pairs looked at, in blocks of bounded size. An exact bound on the symmetric
difference (the number of bits that differ between parity bitmaps, which grow with the sets) comes before verification.

What a step leaves is written to the shared folder and dropped when its successor is written.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrove.llm.common import OUT_ROWS, bit_filter, in_filter, map_arrow, map_batches, packed
from lexigrove.session import Shelf

#: Words of a shingle; the threshold in hundredths.
SHINGLE, PERCENT = 5, 80
#: Segments for each shingle of a scheme's largest smaller set, beyond the pigeonhole's least number.
SEGMENTS = 0.28
#: The least bits of a parity bitmap; members of a mixed bucket that meet at once; bytes of bitmaps compared at once.
BITS, BLOCK, COMPARED = 1024, 2000, 1 << 24
#: Pairs that a task remembers, so as not to give them again for each bucket they share.
SEEN = 500_000
#: Bits of the filter for documents whose sets are needed; its size is fixed, and a full filter only saves less work.
FILTER_BITS = 1 << 23
#: From here on, numbers stand for rows without an id.
NO_ID = 1 << 62
_M = np.uint64(0xFF51AFD7ED558CCD)
_N = np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> np.uint64(33))) * _M
    x = (x ^ (x >> np.uint64(33))) * _N
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, len(h) if len(h) < size else size, np.uint64)
    for k in range(min(size, len(h))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def batch_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """shingles() of each text; the hashing runs over the whole batch at once."""
    words = [(t or "").encode().lower().split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(lengths.sum()))
    ends = np.cumsum(lengths)
    out: list[np.ndarray] = []
    n = max(0, len(flat) - size + 1)
    rolled = np.full(n, size, np.uint64)
    for k in range(size):
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + flat[k : k + n])
    for text, length, end in zip(texts, lengths.tolist(), ends.tolist(), strict=True):
        if length < size:
            out.append(shingles(text, size))
            continue
        s = np.sort(rolled[end - length : end - size + 1])
        out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
    return out


@functools.cache
def bands(percent: int) -> list[tuple[int, int, int, int]]:
    """(smallest, largest smaller set, H, segments) of each scheme."""
    t, out, least = percent / 100, [], 1
    while least < 1 << 40:
        most = max(least, math.ceil(least / t) - 1)
        largest = most * 100 // percent  # of a set that is similar to one of size most
        h = (most + largest) * (100 - percent) // (100 + percent)
        out.append((least, most, h, max(h + 1, math.ceil(SEGMENTS * most))))
        least = most + 1
    return out


@functools.cache
def schemes(n: int, percent: int) -> tuple[int, ...]:
    """Numbers of the schemes that a set of size ``n`` belongs to."""
    return tuple(k for k, (least, most, _, _) in enumerate(bands(percent)) if least <= n <= most * 100 // percent)


def bare(counts: np.ndarray, h: int, percent: int) -> bool:
    """Whether a set with so many shingles in each segment might share no other signature with a similar one.

    Let two similar sets share none. Then all their filled segments differ. A segment with one difference would be
    found by its deletion, unless it is empty in one of the sets. So shingles that both have are in segments with two
    differences or more, of which there are at most h / 2; and they are at least ``percent`` hundredths of either set.
    """
    most = np.sort(counts)[::-1][: h // 2].sum()
    return bool(100 * most >= percent * counts.sum())


def batch_signatures(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The signatures (int64) that the sets index, and for each the number of its set."""
    uses = [(i, k) for i, s in enumerate(sets) for k in schemes(len(s), percent) if bands(percent)[k][2]]  # without differences only equal sets are similar
    if not uses:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.array([i for i, _ in uses], np.int64)
    h = np.array([bands(percent)[k][2] for _, k in uses], np.int64)
    m = np.array([bands(percent)[k][3] for _, k in uses], np.int64)
    salt = (np.array([k + 1 for _, k in uses], np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    use = np.repeat(np.arange(len(uses)), [len(sets[i]) for i, _ in uses])
    first = np.cumsum(m) - m
    token = mix(np.concatenate([sets[i] for i, _ in uses]) + salt[use])
    segment = first[use] + ((token >> np.uint64(32)) * m[use].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    count = np.bincount(segment, minlength=int(m.sum()))
    sums = np.zeros(len(count), np.uint64)
    np.add.at(sums, segment, token)
    of = np.repeat(np.arange(len(uses)), m)  # the use that a segment belongs to
    names = mix((np.arange(len(count)) - first[of]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + salt[of])
    filled = count > 0
    n = np.bincount(of[filled], minlength=len(uses))
    parts, owners = [mix(sums[filled] ^ names[filled])], [owner[of[filled]]]
    # Perhaps all segments that are the same are empty: segments with several shingles index their neighbourhood.
    near = (n <= h)[use] & (count[segment] > 1)
    parts.append(mix((sums[segment[near]] - token[near]) ^ names[segment[near]]))
    owners.append(owner[use[near]])
    last = np.array([u for u in np.flatnonzero(n <= h) if bare(count[first[u] : first[u] + m[u]], int(h[u]), percent)], np.int64)
    parts.append(mix(salt[last] ^ np.uint64(0x5851F42D4C957F2D)))
    owners.append(owner[last])
    return np.concatenate(parts).view(np.int64), np.concatenate(owners)


def signatures(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The signatures of one set."""
    return np.unique(batch_signatures([s], percent)[0])


def parity(s: np.ndarray) -> bytes:
    """Bits that an odd number of the set's hashes map to; they differ in no more places than the sets have differences."""
    width = max(BITS, 1 << (2 * len(s) - 1).bit_length()) if len(s) else BITS
    bits = np.bincount((mix(s) % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """The parity bitmap in ``size`` bytes, a power of two no larger than it is, as 64-bit words."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, size // 8), axis=0)


def differences(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """In how many bits each two bitmaps differ, in the narrower one's size."""
    return np.array([np.bitwise_count(folded(x, w := min(len(x), len(y))) ^ folded(y, w)).sum() for x, y in zip(a, b, strict=True)], np.int64)


def possible(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)


def most_differences(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    return (na + nb) * (100 - percent) // (100 + percent)


def key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name the set."""
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _rid(id_col: str, text_col: str) -> Column:
    """The id, or a number of the text's own for rows without one."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(F.col(text_col).cast("string")), 3))


def _longs(names: str, more: tuple[tuple[str, pa.DataType, str], ...] = ()) -> tuple[pa.Schema, str]:
    fields = [*((n, pa.int64(), "long") for n in names.split()), *more]
    return pa.schema([(n, t) for n, t, _ in fields]), ", ".join(f"{n} {s}" for n, _, s in fields)


def nodes(rows: DataFrame) -> DataFrame:
    """rid, n, k1, k2, bits of each row: its set's size, name and parity bitmap."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = batch_sets(batch[1].to_pylist())
        keys = [key(s) for s in sets]
        columns = [batch[0], pa.array([len(s) for s in sets], pa.int64()), *(pa.array([k[x] for k in keys], pa.int64()) for x in (0, 1)), pa.array([parity(s) for s in sets], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["rid", "n", "k1", "k2", "bits"])

    return map_arrow(rows, each, "rid long, n long, k1 long, k2 long, bits binary")


def indexed(rows: DataFrame, percent: int) -> DataFrame:
    """sig, node: the signatures of each set. A batch gives those of equal sets once."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = {key(s)[0]: s for s in batch_sets(batch[1].to_pylist()) if len(s)}
        sigs, owner = batch_signatures(list(sets.values()), percent)
        return pa.RecordBatch.from_arrays([pa.array(sigs), pa.array(np.fromiter(sets, np.int64, len(sets))[owner])], ["sig", "node"])

    return map_arrow(rows, each, "sig long, node long")


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rid, set of the rows whose rid is in ``wanted`` (and of a few others)."""
    there = bit_filter(wanted.select(F.pmod(F.xxhash64("rid"), F.lit(FILTER_BITS)).alias("b")), FILTER_BITS)

    def each(batch: pa.RecordBatch) -> Iterable[tuple]:
        known = in_filter(there.value, batch[2].to_numpy(zero_copy_only=False))
        for k in np.flatnonzero(known).tolist():
            yield batch[0][k].as_py(), shingles(batch[1][k].as_py()).tobytes()

    hashed = rows.select("rid", "text", F.pmod(F.xxhash64("rid"), F.lit(FILTER_BITS)).alias("b"))
    return map_batches(hashed, each, *_longs("rid", (("set", pa.binary(), "binary"),)))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, ok of ``pairs`` (a, b as rid), by the sets themselves."""
    left = sets.select(F.col("rid").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("rid").alias("b"), F.col("set").alias("set_b"))

    def each(batch: pa.RecordBatch) -> Iterable[tuple]:
        last, held = None, None
        for a, b, x, y in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2], batch[3], strict=True):
            if last is None or a != last:  # rows come sorted by a, as the join has left them
                last, held = a, np.frombuffer(x.as_buffer(), np.uint64)
            yield a, b, similar(held, np.frombuffer(y.as_buffer(), np.uint64), percent)

    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b")
    return map_batches(joined, each, *_longs("a b", (("ok", pa.bool_(), "boolean"),)))


def _judged(shelf: Shelf, rows: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """a, b, ok of distinct ``pairs``; the sets are made anew for the rows that pairs name."""
    wanted = shelf.put(pairs.select(F.col("a").alias("rid")).union(pairs.select(F.col("b").alias("rid"))).distinct())
    # Rows that share an id may hold different texts; an id stands for the text of the class that it represents.
    sets = shelf.put(_sets(rows, wanted).join(wanted, "rid", "left_semi").distinct())
    judged = shelf.put(verified(pairs, sets, percent).groupBy("a", "b").agg(F.bool_or("ok").alias("ok")))
    shelf.drop(wanted, sets)
    return judged


def _possible(pairs: DataFrame, percent: int) -> DataFrame:
    """hub, node, a, b, maybe of ``pairs`` (with na, nb, bits_a, bits_b): false where sizes or parity bits rule a link out."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        na, nb = (np.asarray(batch[k].to_numpy(zero_copy_only=False), np.int64) for k in (4, 5))
        differ = differences(batch[6].to_pylist(), batch[7].to_pylist())
        maybe = (differ <= most_differences(na, nb, percent)) & possible(na, nb, percent)
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(maybe)], ["hub", "node", "a", "b", "maybe"])

    return map_arrow(pairs.select("hub", "node", "a", "b", "na", "nb", "bits_a", "bits_b"), each, "hub long, node long, a long, b long, maybe boolean")


def components(shelf: Shelf, edges: DataFrame) -> DataFrame:
    """node, label: the least node that edges (a, b) reach; nodes without edges are left out.

    Large-star and small-star steps by turns; each is a few joins on what is left of the edges.
    """
    edges = shelf.put(edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x <> y").distinct())
    while True:
        both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("m", "x"))
        large = shelf.put(both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct())
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.explode(F.array(F.struct(F.col("y").alias("x"), F.col("m").alias("y")), F.struct("x", F.col("m").alias("y")))).alias("e")).select("e.*").where("x <> y").distinct()
        after = shelf.put(small)
        same = after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty()
        shelf.drop(large, edges)
        edges = after
        if same:
            return after.select(F.col("x").alias("node"), F.col("y").alias("label")).unionByName(after.select(F.col("y").alias("node"), F.col("y").alias("label")).distinct())


def _starred(shelf: Shelf, rows: DataFrame, percent: int) -> DataFrame:
    """sig, hub, node: of each bucket with several nodes, the hub and each other node."""
    bucket = Window.partitionBy("sig").orderBy("node")
    apart = shelf.put(
        indexed(rows, percent)
        .withColumn("before", F.lag("node").over(bucket))
        .withColumn("least", F.first("node").over(bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .where("before is not null and node <> before")
        .select("sig", "least", "node")
    )
    members = shelf.put(apart.select("sig", "node").union(apart.groupBy("sig").agg(F.min("least").alias("node")).select("sig", "node")))
    others = apart.groupBy("sig").agg(F.count("*").alias("others"))
    met = members.join(others, "sig").groupBy("node").agg(F.sum("others").alias("met"))
    hubs = members.join(met, "node").groupBy("sig").agg(F.max(F.struct("met", "node"))["node"].alias("hub"))
    starred = shelf.put(members.join(hubs, "sig").where("node <> hub").select("sig", "hub", "node"))
    shelf.drop(apart, members)
    return starred


def _mixed_pairs(starred: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of mixed buckets that sizes and parity bits leave possible. A bucket is mixed if nodes beside its
    hub, with which all were compared, are in different components (``known``: node, rid, n, bits, label)."""
    mixed = starred.join(known.select("node", "label"), "node").groupBy("sig").agg(F.count("*").alias("c"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("sig", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    # Each block meets itself and every other one: a row goes to as many cells as there are blocks.
    dealt = starred.join(mixed, "sig").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("sig", "node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block").join(known, "node")
    cells = cells.select("sig", "i", "j", "block", "rid", "label", "n", "bits").repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")

    def pairs_of(run: list[tuple]) -> Iterator[tuple[int, int]]:
        block, rid, label, n = (np.array(c, np.int64) for c in list(zip(*run, strict=True))[3:7])
        if len(set(label.tolist())) < 2:
            return
        size = min(len(r[7]) for r in run)
        bits, across = np.stack([folded(r[7], size) for r in run]), run[0][1] != run[0][2]
        for at in range(0, len(run), 64):
            part = slice(at, at + 64)
            meet = (label[part, None] != label[None, :]) & (rid[part, None] < rid[None, :]) & possible(n[part, None], n[None, :], percent)
            if across:
                meet &= block[part, None] != block[None, :]
            xs, ys = np.nonzero(meet)
            xs += at
            for k in range(0, len(xs), step := max(1, COMPARED // size)):
                x, y = xs[k : k + step], ys[k : k + step]
                near = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= most_differences(n[x], n[y], percent)
                yield from zip(rid[x[near]].tolist(), rid[y[near]].tolist(), strict=True)

    schema, text = _longs("a b")

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        seen: set[tuple[int, int]] = set()
        out: list[tuple[int, int]] = []
        for _, cell in groupby(rows, key=lambda row: row[:3]):
            for pair in pairs_of(list(cell)):
                if pair not in seen:
                    seen.add(pair)
                    out.append(pair)
                if len(out) >= OUT_ROWS:
                    yield packed(out, schema)
                    out = []
                if len(seen) >= SEEN:
                    seen.clear()
        if out:
            yield packed(out, schema)

    return cells.mapInArrow(run_all, text).distinct()


def _labelled(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """rid, n, label of each row: the label is the least rid of its group."""
    shelf = Shelf(docs.sparkSession, "ngram-join")
    rows = docs.select(_rid(id_col, text_col).alias("rid"), F.col(text_col).cast("string").alias("text"))
    named = shelf.put(nodes(rows))
    classes = shelf.put(named.where("n > 0").groupBy("k1", "k2").agg(F.min("rid").alias("rid"), F.any_value("n").alias("n"), F.any_value("bits").alias("bits")))
    starred = _starred(shelf, rows, percent)
    node = classes.select(F.col("k1").alias("node"), F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    hub = classes.select(F.col("k1").alias("hub"), F.col("rid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    edges = shelf.put(_possible(starred.select("hub", "node").distinct().join(node, "node").join(hub, "hub"), percent))
    judged = _judged(shelf, rows, edges.where("maybe").select("a", "b").distinct(), percent)
    links = judged.where("ok").select("a", "b")
    labels = shelf.put(components(shelf, links))
    known = shelf.put(classes.join(labels.withColumnRenamed("node", "rid"), "rid", "left").select(F.col("k1").alias("node"), "rid", "n", "bits", F.coalesce("label", "rid").alias("label")))
    tried = edges.select("a", "b").union(edges.select("b", "a"))
    more = shelf.put(_mixed_pairs(starred, known, percent).join(tried, ["a", "b"], "left_anti"))
    shelf.drop(starred, edges, known)
    if not more.isEmpty():
        further = _judged(shelf, rows, more, percent).where("ok").select("a", "b")
        if not further.isEmpty():
            shelf.drop(labels)
            labels = shelf.put(components(shelf, links.union(further)))
    whole = shelf.put(classes.join(labels.withColumnRenamed("node", "rid"), "rid", "left").select("k1", "k2", F.coalesce("label", "rid").alias("label")))
    shelf.drop(more, judged, labels, classes)
    return named.join(whole, ["k1", "k2"], "left").select("rid", "n", F.when(F.col("n") == 0, F.col("rid")).otherwise(F.col("label")).alias("label"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the least id that links reach, its own included).

    A null, empty or blank text has no shingles and is linked with nothing. Repeated rows each give a row. A row
    without an id takes part in its group; its component_id is null where no row of the group has an id. An empty
    table gives an empty result; other columns of ``docs`` are ignored.
    """
    shown = {c: F.when(F.col(c) < F.lit(NO_ID), F.col(c)) for c in ("rid", "label")}
    return _labelled(docs, id_col, text_col, percent).select(shown["rid"].alias("doc_id"), F.col("n").alias("n_shingles"), shown["label"].alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with the row of the least id of each group, and all columns.

    A row without an id goes if any other text of its group stays; rows that share both id and group stay together.
    """
    gone = Shelf(docs.sparkSession, "ngram-gone").put(_labelled(docs, id_col, text_col, percent).where("rid <> label").select(F.col("rid").alias("gone")).distinct())
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), _rid(id_col, text_col).alias("rid"))
    return rows.join(gone, F.col("rid") == F.col("gone"), "left_anti").select("row.*")

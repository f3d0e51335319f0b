"""Quality by nearest-neighbour voting in a latent-semantic space.

Texts become hashed byte-trigram counts, damped, weighted by inverse document frequency over the whole corpus, and
projected on the leading singular vectors of a bounded sample of labelled documents. One task of an executor finds
these, so that the driver holds only the projection and the sample's vectors, which are broadcast. Each document gets
its exact cosines with all of them, block by block, and its nearest neighbours' labels vote with weights that grow with
similarity.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.common import map_batches

#: Hashed features; dimensions of the latent space; labelled documents of each label in the sample (by hash of the
#: id), so that 2 * SAMPLE * (FEATURES + 2 * SAMPLE) numbers bound the work of the task that fits the space, and
#: (2 * SAMPLE + FEATURES) * DIMENSIONS what comes to the driver and is broadcast.
FEATURES, DIMENSIONS, SAMPLE = 4096, 48, 1500
#: Neighbours that vote; the power of similarity in a vote's weight; documents multiplied at once.
NEIGHBOURS, POWER, BLOCK = 15, 4.0, 256
#: Rows whose crc32(id as text) mod FOLDS is 0 are held out; scores from CUTOFF predict label 1.
FOLDS, CUTOFF = 5, 0.3


def counts(text: str) -> np.ndarray:
    """Counts of hashed byte trigrams of the text between two newlines; digits count as one character."""
    raw = np.frombuffer(b"\n" + text.encode("utf-8", "replace") + b"\n", np.uint8).astype(np.uint32)
    if len(raw) < 4:
        return np.zeros(FEATURES, np.float32)
    grams = (raw[:-2] * np.uint32(65536) + raw[1:-1] * np.uint32(256) + raw[2:]) * np.uint32(2654435761)
    return np.bincount(grams >> np.uint32(20), minlength=FEATURES).astype(np.float32)


def features(counted: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A unit row for each row of counts, or a row of zeros where there are none."""
    x = np.log1p(counted)
    x *= idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x /= np.where(norm > 0, norm, 1)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(norm > 0, norm, 1)).astype(np.float32)


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0


class Voters:
    """The labelled vectors and the projection that made them.

    ``share`` is that of label 1 among all labelled documents. A sample that holds both labels alike lets each vote of
    label 1 count as many times more as label 1 is commoner.
    """

    def __init__(self, counted: list[np.ndarray], labels: list[int], idf: np.ndarray, share: float) -> None:
        self.idf, self.labels = idf.astype(np.float32), np.asarray(labels, np.float32)
        centred = features(np.stack(counted), self.idf) if counted else np.zeros((0, FEATURES), np.float32)
        self.mean = centred.mean(axis=0) if len(centred) else np.zeros(FEATURES, np.float32)
        centred -= self.mean
        values, vectors = np.linalg.eigh(centred @ centred.T) if len(centred) else (np.zeros(0), np.zeros((0, 0)))
        top = np.argsort(values)[::-1][:DIMENSIONS]
        top = top[values[top] > 1e-9] if len(top) else top
        self.axes = (centred.T @ vectors[:, top] / np.sqrt(values[top])).astype(np.float32) if len(top) else np.zeros((FEATURES, 1), np.float32)
        self.vectors = unit(centred @ self.axes) if len(centred) else np.zeros((0, self.axes.shape[1]), np.float32)
        n = np.array([(self.labels == q).sum() for q in (0, 1)])
        weight = share / (1 - share) * n[0] / n[1] if n.all() and 0 < share < 1 else 1.0
        self.vote = np.where(self.labels == 1, np.float32(weight), np.float32(1))
        self.prior = float((self.vote * self.labels).sum() / self.vote.sum()) if len(labels) else 0.5

    def score(self, texts: list[str]) -> list[float]:
        """Weighted share of label 1 among the nearest; without a similar voter the share of all.

        Of equally near voters beyond the last place, those with the least ids vote.
        """
        if not len(self.labels):
            return [self.prior] * len(texts)
        out = []
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(texts), BLOCK):
            x = features(np.stack([counts(t) for t in texts[at : at + BLOCK]]), self.idf)
            empty = ~x.any(axis=1)
            cosines = unit((x - self.mean) @ self.axes) @ self.vectors.T
            last = -np.partition(-cosines, k - 1, axis=1)[:, k - 1 : k]
            nearer, level = cosines > last, cosines == last
            near = nearer | (level & (np.cumsum(level, axis=1) <= k - nearer.sum(axis=1, keepdims=True)))
            weight = np.where(near, np.clip(cosines, 0, None) ** POWER * self.vote, 0)
            total = weight.sum(axis=1)
            score = np.where(total > 0, (weight * self.labels).sum(axis=1) / np.where(total > 0, total, 1), self.prior)
            out += np.where(empty, self.prior, np.clip(score, 0, 1)).round(6).tolist()
        return out


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, size: int) -> tuple[DataFrame, float]:
    """Id, label and counts (i, q, c) of at most ``size`` labelled documents of each label outside the held-out fold,
    chosen by the hash of the id, and the share of label 1 among all labelled ones outside it.

    A document labelled both 0 and 1 counts as 1. Of rows that share an id, one (with the greatest counts) is taken; so
    there are at most 2 * size rows of FEATURES 16-bit numbers.
    """
    usable = labels.where("quality in (0, 1) and doc_id is not null").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) != 0)
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = usable.agg(F.avg("quality")).first()[0]
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = [usable.where(F.col("quality") == q).orderBy(*order).limit(size) for q in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]).withColumnRenamed("doc_id", "__id"))

    def each(batch: pa.RecordBatch) -> Iterable[tuple]:
        for i, q, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield i, q, np.minimum(counts(text or ""), 65535).astype("<u2").tobytes()

    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("__text")).join(ids, F.col("__doc") == F.col("__id"))
    counted = map_batches(rows.select(F.col("__doc").cast("long"), "quality", "__text"), each, pa.schema([("i", pa.int64()), ("q", pa.int32()), ("c", pa.binary())]), "i long, q int, c binary")
    return counted.groupBy("i", "q").agg(F.max("c").alias("c")), 0.5 if share is None else float(share)


def fitted(picked: DataFrame, idf: np.ndarray, share: float) -> Voters:
    """The voters of a sample, made by one task; its rows do not pass through the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        if rows:
            voters = Voters([np.frombuffer(c, "<u2") for *_, c in rows], [q for _, q, _ in rows], idf, share)
            yield pa.record_batch([pa.array([pickle.dumps(voters)], pa.binary())], names=["voters"])

    made = picked.repartition(1).mapInArrow(run, "voters binary").collect()
    return pickle.loads(made[0].voters) if made else Voters([], [], idf, share)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many documents each feature is, and the number of documents; over all of ``docs``."""

    def each(batch: pa.RecordBatch) -> Iterable[tuple]:
        seen = np.zeros(FEATURES, np.int64)
        texts = batch[0].to_pylist()
        for text in texts:
            seen += counts(text or "") > 0
        yield -1, len(texts)
        yield from ((int(k), int(seen[k])) for k in np.flatnonzero(seen))

    summed = map_batches(docs.select(F.col(text_col).cast("string").alias("text")), each, pa.schema([("k", pa.int64()), ("n", pa.int64())]), "k long, n long")
    df, n = np.zeros(FEATURES), 0
    for k, c in summed.groupBy("k").agg(F.sum("n")).collect():  # at most FEATURES + 1 rows
        if k < 0:
            n = c
        else:
            df[k] = c
    return df, n


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts get the weighted share of label 1 in the sample. A null id is not held out. Repeated rows
    each give a row; other columns are ignored, whatever their names; without labels every score is 0.5; an empty table
    gives an empty result. Ties between neighbours and doubly labelled documents: see ``Voters.score`` and ``sample``.
    """
    df, n = document_frequencies(docs, text_col)
    picked, share = sample(docs, labels, id_col, text_col, size)
    voters = docs.sparkSession.sparkContext.broadcast(fitted(picked, np.log((1 + n) / (1 + df)) + 0.1, share))

    def each(batch: pa.RecordBatch) -> Iterable[tuple]:
        ids = batch[0].to_pylist()
        for i, s in zip(ids, voters.value.score([t or "" for t in batch[1].to_pylist()]), strict=True):
            yield i, i is not None and held_out(i), s, int(s >= CUTOFF)

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), each, schema, "doc_id long, held_out boolean, score double, predicted int")

"""Models that look at where matches lie: passages, cover density, proximity.

A document's matches are sorted and read once. They go to Python in Arrow batches, one row a document, so no document
is split and none is joined with itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.operators.rank import B, K1, Ranking

Occurrence = tuple[int, int, int]  # start, end, scorer


def _documents(r: Ranking) -> DataFrame:
    """doc_id, dl, occurrences (s, e, k sorted)."""
    lists = [r.engine.query(s.text).select("doc_id", F.struct("s", "e", F.lit(k).alias("k")).alias("o")) for k, s in enumerate(r.scorers)]
    found = lists[0]
    for x in lists[1:]:
        found = found.unionByName(x)
    grouped = found.groupBy("doc_id").agg(F.array_sort(F.collect_list("o")).alias("o"))
    return r.engine.corpus.doc_stats.join(grouped, "doc_id").select("doc_id", F.col("dl").cast("double").alias("dl"), "o")


def _collection(r: Ranking) -> dict:
    """n, avgdl, total, df and cf of each scorer; one row."""
    row = r.counted().agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"), F.sum("dl").alias("total"), *(F.sum(F.when(F.col(f"tf{k}") > 0, 1.0).otherwise(0.0)).alias(f"df{k}") for k in range(r.n)), *(F.sum(f"tf{k}").alias(f"cf{k}") for k in range(r.n))).first()
    return {"n": row["n"] or 0.0, "avgdl": row["avgdl"] or 1.0, "total": row["total"] or 1.0, "df": [row[f"df{k}"] or 0.0 for k in range(r.n)], "cf": [row[f"cf{k}"] or 0.0 for k in range(r.n)], "w": [s.weight for s in r.scorers]}


def by_document(r: Ranking, score: Callable[[list[Occurrence], float, dict], tuple[float, int, int]], count: int = 20) -> DataFrame:
    """doc_id, score, p_s, p_e of the best ``count`` documents; ``score`` gives score and passage of one document."""
    stats = _collection(r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, dl, o in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                value, s, e = score([(x["s"], x["e"], x["k"]) for x in o], dl, stats)
                if round(value, 5) > 0:
                    rows.append((d, round(value, 5), s, e))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=["doc_id", "score", "p_s", "p_e"])

    return _documents(r).mapInArrow(run, "doc_id long, score double, p_s long, p_e long").orderBy(F.desc("score"), "doc_id").limit(count)


def covers(o: list[Occurrence], wanted: set[int] | None = None) -> list[tuple[int, int, set[int]]]:
    """For each subset size, the shortest intervals that hold that many different scorers: (start, end, scorers)."""
    out = []
    o = [x for x in o if wanted is None or x[2] in wanted]
    last: dict[int, tuple[int, int]] = {}
    for s, e, k in o:
        last[k] = (s, e)
        recent = sorted(last.items(), key=lambda x: -x[1][0])
        held: set[int] = set()
        for j, (start, _) in recent:
            held = held | {j}
            out.append((start, e, set(held)))
    return out


def best_passage(o: list[Occurrence], dl: float, c: dict) -> tuple[float, int, int]:
    """For each cover, the sum of ln(total/cf) w less the sum of w times ln(length): the best one."""
    best = (0.0, 0, 0)
    for s, e, ks in covers(o):
        w = sum(c["w"][k] * math.log(c["total"] / max(c["cf"][k], 1.0)) for k in ks)
        value = w - sum(c["w"][k] for k in ks) * math.log(e - s + 1)
        best = max(best, (value, -s, -e))
    return best[0], -best[1], -best[2]


def best_run(o: list[Occurrence], dl: float, c: dict, k1: float = K1, b: float = B) -> tuple[float, int, int]:
    """The best run of neighbouring matches by W k1 tf / (K + tf), K from the run's length.

    All ends are tried up to where even all matches that are left, at no more length, would score less than the best.
    """
    w = [x * math.log(c["n"] / d) if d else 0.0 for x, d in zip(c["w"], c["df"], strict=True)]
    left: dict[int, int] = {}
    for _, _, k in o:
        left[k] = left.get(k, 0) + 1
    best = (0.0, 0, 0)
    for i in range(len(o)):
        tf: dict[int, int] = {}
        end = o[i][1]
        for j in range(i, len(o)):
            _, e, k = o[j]
            tf[k] = tf.get(k, 0) + 1
            end = max(end, e)
            norm = k1 * ((1 - b) + b * (end - o[i][0] + 1) / c["avgdl"])
            best = max(best, (sum(w[x] * k1 * f / (norm + f) for x, f in tf.items()), -o[i][0], -end))
            if sum(max(w[x], 0.0) * k1 * f / (norm + f) for x, f in left.items()) < best[0] * (1 - 1e-9):
                break
        left[o[i][2]] -= 1
    return best[0], -best[1], -best[2]


def cover_density(o: list[Occurrence], dl: float, c: dict, k: int = 16) -> tuple[float, int, int]:
    """10000 times the bits of the best subset that is there (rarer scorers are higher bits), and its covers' density."""
    order = sorted(range(len(c["w"])), key=lambda j: (c["cf"][j], j), reverse=True)
    bit = {j: 1 << i for i, j in enumerate(order)}
    wanted = {x[2] for x in o}
    found = [x for x in covers(o, wanted) if x[2] == wanted]
    shortest = [x for x in found if not any(y is not x and x[0] <= y[0] and y[1] <= x[1] and (y[1] - y[0]) < (x[1] - x[0]) for y in found)]
    density = sum(100 * min(1.0, k / (e - s + 1)) for s, e, _ in {(s, e, 0) for s, e, _ in shortest})
    s, e = min(((e - s, s, e) for s, e, _ in shortest), default=(0, 0, 0))[1:]
    return 10_000 * sum(bit[j] for j in wanted) + min(9999.9, density), s, e


def _bm25_weights(c: dict) -> list[float]:
    out = []
    for w, df in zip(c["w"], c["df"], strict=True):
        x = 0.0 if df < 1 or df > c["n"] - 1 else w * math.log(c["n"] / df)
        out.append(x + 0.5 * (1 - x) if x < 1 else x)
    return out


def _bm25(o: list[Occurrence], dl: float, c: dict, w: list[float], k1: float = K1, b: float = B) -> tuple[float, float]:
    norm = k1 * ((1 - b) + b * dl / c["avgdl"])
    tf: dict[int, int] = {}
    for x in o:
        tf[x[2]] = tf.get(x[2], 0) + 1
    return sum(w[k] * (k1 + 1) * f / (norm + f) for k, f in tf.items()), norm


def proximity(o: list[Occurrence], dl: float, c: dict, k1: float = K1) -> tuple[float, int, int]:
    """BM25 and a bonus for different scorers near each other: each neighbour at distance d adds its weight over d^2."""
    w = _bm25_weights(c)
    score, norm = _bm25(o, dl, c, w)
    ordered = sorted(w, reverse=True)
    threshold = (ordered[2] if len(ordered) >= 3 else ordered[-1]) - 0.001
    near = [0.0] * len(w)
    for (s0, _, a), (s1, _, b) in zip(o, o[1:], strict=False):
        if a != b and s1 > s0:
            near[a] += w[b] / (s1 - s0) ** 2 if w[b] >= threshold else 0.0
            near[b] += w[a] / (s1 - s0) ** 2 if w[a] >= threshold else 0.0
    return score + sum(min(1.0, w[k]) * (k1 + 1) * p / (norm + p) for k, p in enumerate(near)), o[0][0], o[-1][1]


def neighbours(o: list[Occurrence], dl: float, c: dict, decay: float = 1.5) -> tuple[float, int, int]:
    """BM25 and, for each scorer, a fifth of its weight times how near the others come: min(1, decay^-(gap - 1))."""
    w = _bm25_weights(c)
    score, _ = _bm25(o, dl, c, w)
    closest: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}
    for i, (s, _, k) in enumerate(o):
        for j, at in last.items():
            if j != k:
                gap = max(1, s - o[at][0] - (i - at - 1))
                closest[j, k] = closest[k, j] = min(closest.get((j, k), gap), gap)
        last[k] = i
    total = sum(w) or 1.0
    bonus = sum(0.2 * w[i] * w[k] * min(1.0, decay ** -(d - 1)) / total for (i, k), d in closest.items())
    return score + bonus, o[0][0], o[-1][1]


def desktop(o: list[Occurrence], dl: float, c: dict, lookback: int = 4, near: int = 12) -> tuple[float, int, int]:
    """proximity(), with the passage of up to ``lookback`` matches, each within ``near`` tokens of the next, that weighs most."""
    w = _bm25_weights(c)
    best = (0.0, 0, 0)
    for i in range(len(o)):
        j, held = i, {o[i][2]}
        while j > 0 and i - j < lookback and o[j][0] - o[j - 1][0] <= near:
            j -= 1
            held.add(o[j][2])
        best = max(best, (sum(w[k] for k in held), -o[j][0], -o[i][1]))
    return proximity(o, dl, c)[0], -best[1], -best[2]


def distance_pairs(o: list[Occurrence], dl: float, c: dict, mu: float = 1000.0) -> tuple[float, int, int]:
    """Dirichlet likelihood; with several scorers in a document, that of pairs by their least distance instead."""
    p = [(max(f, 1.0) + 0.5) / c["total"] for f in c["cf"]]
    kinds = {x[2] for x in o}
    if len(kinds) == 1:
        k = o[0][2]
        return c["w"][k] * (math.log((len(o) + mu * p[k]) / (dl + mu)) - math.log(p[k])), o[0][0], o[-1][1]
    value, last = 0.0, {}
    least: dict[tuple[int, int], int] = {}
    for s, _, k in o:
        for j, at in last.items():
            if j != k:
                pair = (min(j, k), max(j, k))
                least[pair] = min(least.get(pair, s - at), s - at)
        last[k] = s
    for (j, k), d in least.items():
        value += (c["w"][j] + c["w"][k]) * max(0.0, -math.log(p[j]) - math.log(p[k]) - math.log(max(1, d))) / (2 * len(kinds))
    return value, o[0][0], o[-1][1]


MODELS = {"qap": best_passage, "qap2": best_run, "cdr": cover_density, "bm25tp": proximity, "np": neighbours, "desktop": desktop, "experimental": distance_pairs}

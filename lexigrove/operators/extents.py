"""Region algebra over intervals: DataFrames of (doc_id, s, e), both ends included, none holding another.

Every operator works within a document, so one hash partitioning by doc_id serves a whole expression, and each takes
one sort of a document's intervals: no interval is joined with another by range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COLUMNS = ("doc_id", "s", "e")


def minimal(found: DataFrame) -> DataFrame:
    """Drops repeated intervals and those that hold another one."""
    later = Window.partitionBy("doc_id").orderBy(F.desc("s"), "e").rowsBetween(Window.unboundedPreceding, -1)
    return found.select(*COLUMNS).distinct().withColumn("__m", F.min("e").over(later)).where("__m is null or e < __m").drop("__m")


def phrase(postings: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """Consecutive positions of the words. ``postings``: doc_id, pos, term of these words at least."""
    n = len(words)
    at = reduce(lambda a, b: a | b, (F.col("term") == w for w in set(words)))
    # Each word votes for the starts that it fits; a start with n votes is a match.
    starts = F.array(*(F.when(F.col("term") == w, F.col("pos") - k) for k, w in enumerate(words)))
    votes = postings.where(at).select("doc_id", F.explode(starts).alias("s")).where("s is not null")
    return votes.groupBy("doc_id", "s").agg(F.count("*").alias("n")).where(F.col("n") == n).select("doc_id", "s", (F.col("s") + (n - 1)).alias("e"))


def either(*lists: DataFrame) -> DataFrame:
    return minimal(reduce(DataFrame.unionByName, (x.select(*COLUMNS) for x in lists)))


def _tagged(*lists: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, (x.select(*COLUMNS, F.lit(k).alias("k")) for k, x in enumerate(lists)))


def both(*lists: DataFrame) -> DataFrame:
    """The shortest intervals that cover one of each list: for each end, the latest starts of all lists so far."""
    until = Window.partitionBy("doc_id").orderBy("e").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = [F.max(F.when(F.col("k") == k, F.col("s"))).over(until).alias(f"__l{k}") for k in range(len(lists))]
    rows = _tagged(*lists).select("doc_id", "e", *last)
    known = reduce(lambda a, b: a & b, (F.col(f"__l{k}").isNotNull() for k in range(len(lists))))
    return minimal(rows.where(known).select("doc_id", F.least(*(f"__l{k}" for k in range(len(lists)))).alias("s"), "e"))


def from_to(start: DataFrame, end: DataFrame) -> DataFrame:
    """The shortest intervals from a start to an end that begins after it: for each end, the last start before it."""
    rows = _tagged(start, end).withColumn("__at", F.when(F.col("k") == 0, F.col("e")).otherwise(F.col("s")))
    before = Window.partitionBy("doc_id").orderBy("__at", F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = rows.withColumn("__s", F.max(F.when(F.col("k") == 0, F.col("s"))).over(before))
    return minimal(opened.where("k = 1 and __s is not null").select("doc_id", F.col("__s").alias("s"), "e"))


def contains(kept: DataFrame, other: DataFrame, within: bool = False, negate: bool = False) -> DataFrame:
    """Of ``kept``, the intervals that hold one of ``other`` (``within``: that lie in one), or with ``negate`` the rest."""
    rows = _tagged(kept, other)
    if within:
        reach = F.max(F.when(F.col("k") == 1, F.col("e"))).over(Window.partitionBy("doc_id").orderBy("s").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        test: Column = F.col("__r") >= F.col("e")
    else:
        reach = F.min(F.when(F.col("k") == 1, F.col("e"))).over(Window.partitionBy("doc_id").orderBy(F.desc("s")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        test = F.col("__r") <= F.col("e")
    test = F.coalesce(test, F.lit(False))
    return rows.withColumn("__r", reach).where((F.col("k") == 0) & (~test if negate else test)).select(*COLUMNS)


def width(doc_stats: DataFrame, n: int) -> DataFrame:
    """All intervals of ``n`` tokens."""
    return doc_stats.where(F.col("dl") >= n).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("dl") - n)).alias("s")).select("doc_id", "s", (F.col("s") + (n - 1)).alias("e")).where(F.lit(n > 0))


def first_after(found: DataFrame, pos: int, by: str = "s") -> DataFrame:
    """For each document the first interval with a start (``by`` 'e': an end) from ``pos`` on."""
    return found.where(F.col(by) >= pos).groupBy("doc_id").agg(F.min_by(F.struct("s", "e"), by).alias("x")).select("doc_id", "x.*")


def last_before(found: DataFrame, pos: int, by: str = "s") -> DataFrame:
    """For each document the last interval with a start (``by`` 'e': an end) up to ``pos``."""
    return found.where(F.col(by) <= pos).groupBy("doc_id").agg(F.max_by(F.struct("s", "e"), by).alias("x")).select("doc_id", "x.*")


def nth(found: DataFrame, n: int) -> DataFrame:
    """For each document its n-th interval, counted from 0."""
    return found.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy("s"))).where(F.col("__n") == n + 1).drop("__n")

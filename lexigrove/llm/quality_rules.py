"""Quality rules and a hashed n-gram log-likelihood ratio, with DataFrame operations only.

Words and pairs of words are hashed to a fixed number of buckets. Two smoothed multinomials over the buckets, one of
trusted documents and one of all documents, give each feature a log-likelihood ratio; its mean over a document's
features is the score, and every document is held against the same threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the multinomials; pseudo-count of each; labelled documents that are trusted at most (by hash of the id).
BUCKETS, PSEUDO, TRUSTED = 1 << 15, 0.5, 20_000
#: A document whose mean log-likelihood ratio is lower is rejected.
THRESHOLD = -0.13
#: Fixed values of the base rules.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
SYMBOLS = "#*$%&|<>"
SPACE = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE, -1), "")


def with_features(docs: DataFrame, text_col: str, **keep: Column) -> DataFrame:
    """Columns of ``keep``, with __text, __h (hashes of words) and __features (buckets of words and pairs of words).

    Each step is a projection of its own, so that no array is worked out anew for every element of another one.
    """
    hashed = docs.select(*(c.alias(k) for k, c in keep.items()), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).withColumn("__h", F.transform(_words(F.col("__text")), lambda w: F.xxhash64(w)))
    pairs = F.zip_with(F.slice("__h", 1, F.greatest(F.size("__h") - 1, F.lit(0))), F.slice("__h", 2, F.greatest(F.size("__h") - 1, F.lit(0))), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)).cast("int"))
    return hashed.withColumn("__features", F.concat(F.transform("__h", lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")), pairs))


def base_counts(rows: DataFrame) -> DataFrame:
    """``rows`` of with_features with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.col("__text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = (
        rows.withColumn("n_words", F.size("__h").cast("long"))
        .withColumn("word_chars", F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
        .withColumn("__lines", lines)
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .withColumn("__w", F.expr(f"if(size(__h) < {WINDOW}, array(), transform(sequence(0, size(__h) - {WINDOW}), i -> xxhash64({', '.join(f'__h[i + {k}]' for k in range(WINDOW))})))"))
        # Only texts in which a window comes again need its places: sorted by hash, equal windows are neighbours.
        .withColumn("__s", F.expr("if(size(array_distinct(__w)) = size(__w), null, array_sort(transform(__w, (h, i) -> struct(h, i))))"))
        .withColumn("__d", F.expr("array_sort(transform(filter(__s, (x, j) -> coalesce(get(__s, j - 1).h = x.h, false) or coalesce(get(__s, j + 1).h = x.h, false)), x -> x.i))"))
    )
    covered = F.expr(f"aggregate(__d, struct(-{WINDOW} as at, 0L as n), (a, i) -> struct(i as at, a.n + least({WINDOW}, i - a.at) as n), a -> a.n)")
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


def trusted_ids(labels: DataFrame, limit: int = TRUSTED) -> DataFrame:
    """At most ``limit`` ids of documents labelled good and not toxic, chosen by the hash of the id."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TRUSTED) -> list[float]:
    """The log-likelihood ratio of each bucket; counts of the raw corpus are over all documents."""
    trusted = trusted_ids(labels, limit).select(F.col("doc_id").alias("__trusted"))
    words = docs.select(F.col(id_col).alias("__id"), _words(F.coalesce(F.col(text_col), F.lit(""))).alias("__w")).join(F.broadcast(trusted), F.col("__id") == F.col("__trusted"), "left")
    pairs = words.select(F.col("__trusted").isNotNull().cast("long").alias("__t"), F.explode(F.arrays_zip(F.col("__w").alias("a"), F.slice("__w", 2, F.greatest(F.size("__w") - 1, F.lit(0))).alias("b"))).alias("p"))
    # The same buckets as in with_features, in generated code: a word's, and its pair's unless it is the last.
    one = F.pmod(F.xxhash64("p.a"), F.lit(BUCKETS)).cast("int")
    two = F.when(F.col("p.b").isNotNull(), F.pmod(F.xxhash64(F.xxhash64("p.a"), F.xxhash64("p.b")), F.lit(BUCKETS)).cast("int"))
    counted = (
        pairs.select("__t", F.explode(F.array(one, two)).alias("__b"))
        .where("__b is not null")
        .groupBy("__b")
        .agg(F.count("*").alias("raw"), F.sum("__t").alias("target"))
        .collect()  # at most BUCKETS rows
    )
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for b, r, t in counted:
        raw[b], target[b] = r, t
    if not any(target):
        return [0.0] * BUCKETS
    shift = math.log(sum(raw) + PSEUDO * BUCKETS) - math.log(sum(target) + PSEUDO * BUCKETS)
    return [math.log(t + PSEUDO) - math.log(r + PSEUDO) + shift for r, t in zip(raw, target, strict=True)]


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    A null or empty text has no words, so the base rules reject it; its score is 0. Without trusted documents all
    scores are 0. Repeated rows each give a row and each count in the corpus; null ids pass through and are never
    trusted; other columns are ignored; an empty table gives an empty result.
    """
    table = _literal(weights(docs, labels, id_col, text_col))
    rows = base_counts(with_features(docs, text_col, doc_id=F.col(id_col)))
    return _judged(rows, table, threshold).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def _literal(values: list[float]) -> Column:
    """One constant array; as text, since a column for each element takes long to build."""
    return F.split(F.lit(",".join(f"{v:.9f}" for v in values)), ",").cast("array<double>")


def _judged(rows: DataFrame, table: Column, threshold: float) -> DataFrame:
    total = F.aggregate("__features", F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    return (
        rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
        .withColumn("score", F.coalesce(F.round(total / F.when(F.size("__features") > 0, F.size("__features")), 9), F.lit(0.0)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that judge() keeps, with their columns."""
    table = _literal(weights(docs, labels, id_col, text_col))
    row = F.struct(*(F.col(c) for c in docs.columns))
    rows = base_counts(with_features(docs, text_col, __row=row))
    # A number for each row keeps the optimizer from moving the condition, and with it copies of all that it is made
    # of, down through the projections.
    return _judged(rows, table, threshold).withColumn("__number", F.monotonically_increasing_id()).where("kept and __number >= 0").select("__row.*")

"""Static pruning of postings, impacts, document surrogates and feature export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrove.operators.count import encode_tf
from lexigrove.session import cut
from lexigrove.sources.corpus import Corpus


def _with_stats(corpus: Corpus) -> DataFrame:
    """tf_table with dl, cf, df, n, avgdl, total."""
    corpus = corpus.counts
    lm = corpus.lm.select("term", F.col("tf").alias("cf"), "df")
    return corpus.with_terms(corpus.tf_lengths, lm).crossJoin(F.broadcast(corpus.stats))  # one row


def document_centric(corpus: Corpus, k: int = 4, share: float = 0.1) -> DataFrame:
    """doc_id, term, tf: of each document the max(k, int(terms * share + 1)) terms with the greatest tf (ln(tf/dl) + ln(total/cf)).

    A term with df <= 1 or cf <= 2 has next to no weight.
    """
    rare = (F.col("df") <= 1) | (F.col("cf") <= 2)
    score = F.when(rare, 0.001).otherwise(F.col("tf") * (F.ln(F.col("tf") / F.col("dl")) + F.round(F.ln(F.col("total") / F.col("cf")), 3)))
    doc = Window.partitionBy("doc_id")
    rows = _with_stats(corpus).withColumn("__n", F.count("*").over(doc)).withColumn("__r", F.row_number().over(doc.orderBy(F.desc(F.round(score, 9)), "term")))
    return rows.where(F.col("__r") <= F.greatest(F.lit(k), F.floor(F.col("__n") * share + 1))).select("doc_id", "term", "tf")


def impacts(corpus: Corpus, k1: float = 1.2, b: float = 0.5) -> DataFrame:
    """doc_id, term, tf, impact: the part of a BM25 score that is the document's own."""
    norm = k1 * ((1 - b) + b * F.col("dl") / F.col("avgdl"))
    corpus = corpus.counts
    return corpus.tf_lengths.crossJoin(F.broadcast(corpus.stats)).select("doc_id", "term", "tf", F.round(F.col("tf") * (k1 + 1) / (F.col("tf") + norm), 9).alias("impact"))  # one row


def term_centric(corpus: Corpus, k: int = 10, epsilon: float = 0.5) -> DataFrame:
    """doc_id, term, tf, df: postings whose impact is at least ``epsilon`` times the term's k-th; terms with fewer stay whole.

    The k-th impact of each term comes from lists of at most k of each task: Spark cuts a limited rank before it moves
    the rows, so a frequent term's postings never meet in one task.
    """
    corpus = corpus.counts
    found = impacts(corpus)
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "doc_id"))
    kth = found.withColumn("__r", place).where(F.col("__r") == k).select("term", F.col("impact").alias("kth"))
    dictionary = cut(corpus.lm.select("term", "df").join(kth, "term", "left"))
    return corpus.with_terms(found, dictionary).where(F.coalesce(F.col("impact") >= epsilon * F.col("kth"), F.lit(True))).select("doc_id", "term", "tf", "df")


def top_terms_only(corpus: Corpus, n: int) -> DataFrame:
    """Postings of the ``n`` most frequent terms (df, then term)."""
    keep = corpus.lm.orderBy(F.desc("df"), "term").limit(n).select("term")
    return corpus.tf_table.join(keep, "term", "left_semi").select("doc_id", "term", "tf")


def discretised(corpus: Corpus, bits: int = 5, k1: float = 1.2) -> DataFrame:
    """doc_id, term, level: impacts in 2^bits steps."""
    return impacts(corpus).select("doc_id", "term", F.floor(F.col("impact") / (k1 + 1) * (1 << bits)).cast("int").alias("level"))


def surrogates(corpus: Corpus, n: int = 12) -> DataFrame:
    """doc_id, term, kld: of each document the ``n`` terms that add most to its divergence from the collection."""
    rows = _with_stats(corpus)
    p, q = F.col("tf") / F.col("dl"), F.col("cf") / F.col("total")
    scored = rows.select("doc_id", "term", F.round(p * F.ln(p / q), 9).alias("kld"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("kld"), "term"))
    return scored.withColumn("__r", place).where(F.col("__r") <= n).drop("__r")


def surrogate_cosine(surrogate: DataFrame, doc_id: int) -> DataFrame:
    """doc_id, cosine of all documents with one of them, over surrogates."""
    surrogate = cut(surrogate)
    one = surrogate.where(F.col("doc_id") == doc_id).select("term", F.col("kld").alias("b"))
    lengths = surrogate.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("kld") * F.col("kld"))).alias("l"))
    base = one.agg(F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("lb"))
    dots = surrogate.join(F.broadcast(one), "term").groupBy("doc_id").agg(F.sum(F.col("kld") * F.col("b")).alias("dot"))  # a few terms
    return dots.join(lengths, "doc_id").crossJoin(F.broadcast(base)).select("doc_id", F.round(F.col("dot") / (F.col("l") * F.col("lb")), 6).alias("cosine"))  # one row


def keywords(corpus: Corpus, n: int = 10) -> DataFrame:
    """doc_id, term, score: of each document the terms with the greatest sqrt(ps) ln(ps/q), ps = .8 p + .2 q, q <= .01."""
    p, q = F.col("tf") / F.col("dl"), F.col("cf") / F.col("total")
    mixed = 0.8 * p + 0.2 * q
    scored = _with_stats(corpus).where(q <= 0.01).select("doc_id", "term", F.round(F.sqrt(mixed) * F.ln(mixed / q), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "term"))
    return scored.withColumn("__r", place).where(F.col("__r") <= n).drop("__r")


def feature_lines(corpus: Corpus) -> DataFrame:
    """doc_id, features: "term:tf ..." in the order of terms."""
    return corpus.tf_table.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("term", "tf"))), lambda x: F.concat_ws(":", x["term"], x["tf"].cast("string"))), " ").alias("features"))


def reordered(docs: DataFrame, by: str) -> DataFrame:
    """doc_id, new_id: documents numbered in the order of ``by``; ranges are counted, so no task holds them all."""
    ranged = docs.select("doc_id", by).repartitionByRange(by, "doc_id").sortWithinPartitions(by, "doc_id").withColumn("__p", F.spark_partition_id())
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("c"))
    before = sizes.withColumn("first", F.coalesce(F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    within = F.row_number().over(Window.partitionBy("__p").orderBy(by, "doc_id"))
    return ranged.withColumn("__n", within).join(F.broadcast(before.select("__p", "first")), "__p").select("doc_id", (F.col("__n") + F.col("first")).alias("new_id"))


def encoded(corpus: Corpus) -> DataFrame:
    """doc_id, term, code: counts in the 5-bit code of document-level postings."""
    return corpus.tf_table.select("doc_id", "term", encode_tf(F.col("tf")).alias("code"))

"""Counting and collection statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrove.operators.gcl import Engine
from lexigrove.session import cut
from lexigrove.sources.corpus import Corpus


def count(engine: Engine, *queries: str) -> DataFrame:
    """query, n, size, avgsize: number, summed and mean length of the matches of each expression."""
    lists = [engine.query(q).select(F.lit(q).alias("query"), F.expr("e - s + 1").alias("len")) for q in queries]
    frame = reduce(DataFrame.unionByName, lists)
    names = engine.corpus.docs.sparkSession.createDataFrame([(q,) for q in queries], "query string")
    counted = frame.groupBy("query").agg(F.count("*").alias("n"), F.sum("len").alias("size"), F.round(F.avg("len"), 1).alias("avgsize"))
    return names.join(counted, "query", "left").fillna({"n": 0, "size": 0, "avgsize": 0.0})


def documents_containing(engine: Engine, *queries: str) -> DataFrame:
    """query, df: in how many documents each expression matches; 0 where it has no match."""
    lists = [engine.query(q).select(F.lit(q).alias("query"), "doc_id").distinct() for q in queries]
    names = engine.corpus.docs.sparkSession.createDataFrame([(q,) for q in queries], "query string")
    return names.join(reduce(DataFrame.unionByName, lists).groupBy("query").agg(F.count("*").alias("df")), "query", "left").fillna(0, ["df"])


def histogram(engine: Engine, query: str, longest: int = 24) -> DataFrame:
    """n, size, sum_len_ln_len, and for each length up to ``longest`` how many matches have at most that length."""
    found = engine.query(query).select(F.expr("e - s + 1").alias("len"))
    return found.agg(F.count("*").alias("n"), F.sum("len").alias("size"), F.round(F.sum(F.col("len") * F.ln("len")), 4).alias("sum_len_ln_len"), *(F.sum((F.col("len") <= i).cast("int")).alias(f"upto{i}") for i in range(1, longest + 1)))


def dictionary_size(corpus: Corpus) -> DataFrame:
    return corpus.tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).agg(F.count_distinct("term").alias("terms"))


def summary(corpus: Corpus, kind: str = "lang") -> DataFrame:
    """Documents, tokens and characters by file type."""
    return corpus.docs.select(kind, F.length("text").alias("c"), F.size(corpus._words).alias("t")).groupBy(kind).agg(F.count("*").alias("files"), F.sum("t").alias("tokens"), F.sum("c").alias("chars"))


def top_terms(corpus: Corpus, n: int) -> DataFrame:
    """The language model of the ``n`` most frequent terms."""
    return corpus.lm.orderBy(F.desc("tf"), "term").limit(n)


def lm_merge(*models: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, models).groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def kl_divergence(p: DataFrame, q: DataFrame, floor: float = 0.5) -> DataFrame:
    """One row kld: sum of p ln(p/q); q is at least ``floor`` occurrences; shares of p under 1e-9 are left out."""
    p, q = cut(p.select("term", "tf")), cut(q.select("term", "tf"))
    tp, tq = p.agg(F.sum("tf").cast("double").alias("tp")), q.agg(F.sum("tf").cast("double").alias("tq"))
    rows = p.select("term", F.col("tf").alias("fp")).join(q.select("term", F.col("tf").alias("fq")), "term", "left").crossJoin(F.broadcast(tp)).crossJoin(F.broadcast(tq))  # one row each
    share, other = F.col("fp") / F.col("tp"), F.greatest(F.coalesce("fq", F.lit(0)).cast("double"), F.lit(floor)) / F.col("tq")
    return rows.where(share >= 1e-9).agg(F.round(F.sum(share * F.ln(share / other)), 6).alias("kld"))


def lm_mix(p: DataFrame, q: DataFrame, share: float) -> DataFrame:
    """term, p: linear interpolation of two models' relative frequencies."""
    p, q = cut(p.select("term", "tf")), cut(q.select("term", "tf"))

    def relative(m: DataFrame, name: str) -> DataFrame:
        return m.crossJoin(F.broadcast(m.agg(F.sum("tf").cast("double").alias("t")))).select("term", (F.col("tf") / F.col("t")).alias(name))  # one row

    both = relative(p, "a").join(relative(q, "b"), "term", "full").fillna(0.0)
    return both.select("term", (share * F.col("a") + (1 - share) * F.col("b")).alias("p"))


def vector_lengths(corpus: Corpus, log_tf: bool = True) -> DataFrame:
    """doc_id, vl: root of the summed squares of tf weight times idf."""
    corpus = corpus.counts
    lm, n = corpus.lm.select("term", "df"), corpus.doc_stats.agg(F.count("*").cast("double").alias("n"))
    weight = (1 + F.log2("tf")) if log_tf else F.col("tf")
    rows = corpus.with_terms(corpus.tf_table, lm).crossJoin(F.broadcast(n))  # one row
    return rows.groupBy("doc_id").agg(F.round(F.sqrt(F.sum(F.pow(weight * F.ln(F.col("n") / F.col("df")), 2))), 5).alias("vl"))


def length_distribution(corpus: Corpus) -> DataFrame:
    """dl, docs: documents by length."""
    return corpus.doc_stats.groupBy("dl").agg(F.count("*").alias("docs"))


def token_lengths(corpus: Corpus) -> DataFrame:
    return corpus.tokens.select(F.explode(F.transform("tokens", F.length)).alias("len")).groupBy("len").agg(F.count("*").alias("tokens"))


def zipf(corpus: Corpus, n: int = 1000) -> DataFrame:
    """rank, term, tf of the ``n`` most frequent terms."""
    top = top_terms(corpus, n)
    return top.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("tf"), "term")).alias("rank"), "term", "tf")  # at most n rows


def distinct_ngrams(corpus: Corpus, n: int) -> DataFrame:
    """An estimate of how many different word n-grams there are."""
    gram = F.when(F.size("tokens") >= n, F.transform(F.sequence(F.lit(1), F.size("tokens") - (n - 1)), lambda i: F.array_join(F.slice("tokens", i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    return corpus.tokens.select(F.explode(gram).alias("g")).agg(F.approx_count_distinct("g", 0.01).alias("ngrams"))


def encode_tf(tf: Column) -> Column:
    """The code of a count: itself under 16, then steps of a factor 1.15, at most 31."""
    return F.when(tf < 16, tf).otherwise(F.least(F.lit(31), 16 + F.round(F.ln(tf / 16) / F.ln(F.lit(1.15))))).cast("int")


def decode_tf(code: Column) -> Column:
    return F.when(code < 16, code).otherwise(F.round(16 * F.pow(F.lit(1.15), code - 16))).cast("long")


def postings_bytes(corpus: Corpus) -> DataFrame:
    """Bytes of all docid lists in variable-byte code of the gaps."""
    gap = F.col("doc_id") - F.coalesce(F.lag("doc_id").over(Window.partitionBy("term").orderBy("doc_id")), F.lit(0))
    size = F.greatest(F.lit(1), F.ceil(F.log2(gap + 1) / 7))
    return corpus.tf_table.select(size.alias("b")).agg(F.count("*").alias("postings"), F.sum("b").alias("bytes"))

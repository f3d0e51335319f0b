"""A collection as tables: tokens, postings, term and document statistics."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.functions.tokens import markup_tokens, tokens
from lexigrove.session import Shelf, table

#: Bytes of the documents that one task counts, and how many terms are broadcast at most.
TASK_BYTES, HEAD = 16 << 20, 500_000


def _places(wanted: tuple[str, ...]) -> Column:
    """pos and term of the wanted ones of ``tokens``."""
    return F.filter(F.transform("tokens", lambda t, i: F.when(t.isin(*wanted), F.struct(i.cast("long").alias("pos"), t.alias("term")))), lambda p: p.isNotNull())


class Corpus:
    """One row of ``docs`` (doc_id, text, ...) is one document; positions count its tokens from 0.

    Everything but ``counts`` is lazy. For many queries, ``save`` the index once and query the ``saved`` corpus: then a
    query reads only the row groups of its terms, and no text is tokenised again.
    """

    #: Where the index is, if the corpus is a saved one.
    index: str | None = None

    def __init__(self, docs: DataFrame, markup: bool = False, words: Column | None = None) -> None:
        self.docs, self.markup = docs, markup
        self._words = words if words is not None else (markup_tokens if markup else tokens)(F.col("text"))

    @classmethod
    def documents(cls, spark, sf_dir: str) -> Corpus:
        return cls(table(spark, sf_dir, "documents"))

    @classmethod
    def pages(cls, spark, sf_dir: str) -> Corpus:
        return cls(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url", F.col("html").alias("text")), markup=True)

    @cached_property
    def tokens(self) -> DataFrame:
        return self.docs.select("doc_id", self._words.alias("tokens"))

    @cached_property
    def postings(self) -> DataFrame:
        return self.tokens.select("doc_id", F.posexplode("tokens").alias("pos", "term")).withColumn("pos", F.col("pos").cast("long"))

    @cached_property
    def parts(self) -> int:
        """Among how many tasks documents are dealt out; the session's number where their size is unknown."""
        size = int(str(self.docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size >= 1 << 50:
            return int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return max(self.docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))

    @cached_property
    def tf_table(self) -> DataFrame:
        """doc_id, term, tf. Texts are dealt out by document before they are taken apart, as they are smaller than their counts."""
        dealt = self.docs.repartition(self.parts, "doc_id").select("doc_id", F.explode(self._words).alias("term"))
        return dealt.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))

    @cached_property
    def tf_lengths(self) -> DataFrame:
        """tf_table with dl."""
        return self.tf_table.join(self.doc_stats, "doc_id")

    @cached_property
    def counts(self) -> Corpus:
        """This corpus with its counts in tables, written at once: for what reads them more than once."""
        return self if self.index else _Counted(self)

    @cached_property
    def doc_stats(self) -> DataFrame:
        return self.tokens.select("doc_id", F.size("tokens").cast("long").alias("dl"))

    @cached_property
    def stats(self) -> DataFrame:
        """One row: n documents, avgdl, total tokens."""
        return self.doc_stats.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"), F.sum("dl").cast("double").alias("total"))

    @cached_property
    def lm(self) -> DataFrame:
        """term, tf, df."""
        return self.tf_table.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))

    @cached_property
    def frequencies(self) -> DataFrame:
        """term, tf: what the language model needs without df; no count of a document is made."""
        return self.lm.select("term", "tf") if self.index else self.tokens.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("tf"))

    def words(self, *wanted: str) -> DataFrame:
        """doc_id, dl, tokens: of the tokens these at least."""
        return self.tokens.select("doc_id", F.size("tokens").cast("double").alias("dl"), "tokens")

    def holding(self, *wanted: str) -> Corpus:
        """This corpus with lengths and the places of a few terms in a table, written at once by one scan of the texts."""
        return self if self.index or not wanted else _Gathered(self, wanted)

    def with_terms(self, rows: DataFrame, columns: DataFrame) -> DataFrame:
        """``rows`` joined by term with ``columns`` (term, df and more).

        Terms with over 1 / HEAD of all postings are fewer than HEAD, and are broadcast; so only the rows of rare terms move.
        """
        least = (columns.agg(F.sum("df")).first()[0] or 0) / HEAD
        often = F.broadcast(columns.where(F.col("df") > least))
        rare = rows.join(often, "term", "left_anti").join(columns.where(F.col("df") <= least), "term")
        joined = rows.join(often, "term")
        return joined.unionByName(rare.select(*joined.columns))

    def terms(self, *wanted: str) -> DataFrame:
        """Postings of a few terms; others are dropped before the arrays are taken apart."""
        return self.tokens.select("doc_id", F.explode(_places(wanted)).alias("p")).select("doc_id", "p.pos", "p.term")

    def save(self, path: str, parts: int) -> None:
        """Writes the index: postings and counts by ranges of terms and documents, so that no term is bound to one task,
        lengths, the dictionary and the collection's statistics. Ids name documents: each is in one row only."""

        def put(name: str, frame: DataFrame, *order: str) -> None:
            laid = frame.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order) if order else frame
            laid.write.mode("overwrite").parquet(f"{path}/{name}")

        put("postings", self.postings, "term", "doc_id", "pos")
        saved = self.saved(path, self.docs, self.markup, self._words)
        put("tf", saved.postings.groupBy("doc_id", "term").agg(F.count("*").alias("tf")), "term", "doc_id")
        put("lengths", self.doc_stats)
        put("lm", saved.tf_table.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df")), "term")
        put("stats", saved.doc_stats.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"), F.sum("dl").cast("double").alias("total")))

    @classmethod
    def saved(cls, path: str, docs: DataFrame, markup: bool = False, words: Column | None = None) -> Corpus:
        """The corpus of ``docs`` whose index was saved to ``path``."""
        return _Saved(path, docs, markup, words)


class _Saved(Corpus):
    """Reads the index; filters on terms reach the Parquet scan."""

    def __init__(self, path: str, docs: DataFrame, markup: bool, words: Column | None) -> None:
        super().__init__(docs, markup, words)
        self.index = path

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.docs.sparkSession.read.schema(schema).parquet(f"{self.index}/{name}")

    @cached_property
    def postings(self) -> DataFrame:
        return self._read("postings", "doc_id long, pos long, term string")

    @cached_property
    def tf_table(self) -> DataFrame:
        return self._read("tf", "doc_id long, term string, tf long")

    @cached_property
    def doc_stats(self) -> DataFrame:
        return self._read("lengths", "doc_id long, dl long")

    @cached_property
    def lm(self) -> DataFrame:
        return self._read("lm", "term string, tf long, df long")

    @cached_property
    def stats(self) -> DataFrame:
        return self._read("stats", "n double, avgdl double, total double")

    def terms(self, *wanted: str) -> DataFrame:
        return self.postings.where(F.col("term").isin(*wanted))


class _Gathered(Corpus):
    """Lengths and places of a few terms in a table of the shared folder; for other terms the texts are read."""

    def __init__(self, of: Corpus, held: tuple[str, ...]) -> None:
        super().__init__(of.docs, of.markup, of._words)
        self.held = frozenset(held)
        self._rows = Shelf(of.docs.sparkSession, "places").put(of.tokens.select("doc_id", F.size("tokens").cast("long").alias("dl"), _places(held).alias("places")))
        self.doc_stats = self._rows.select("doc_id", "dl")

    def words(self, *wanted: str) -> DataFrame:
        if not self.held.issuperset(wanted):
            return super().words(*wanted)
        return self._rows.select("doc_id", F.col("dl").cast("double").alias("dl"), F.col("places.term").alias("tokens"))

    def terms(self, *wanted: str) -> DataFrame:
        if not self.held.issuperset(wanted):
            return super().terms(*wanted)
        return self._rows.select("doc_id", F.explode("places").alias("p")).select("doc_id", "p.pos", "p.term").where(F.col("term").isin(*wanted))


class _Counted(Corpus):
    """Counts in tables of the shared folder, which stay as long as lazy results may read them."""

    def __init__(self, of: Corpus) -> None:
        super().__init__(of.docs, of.markup, of._words)
        shelf = Shelf(of.docs.sparkSession, "counts")
        self.index = shelf.folder
        self.doc_stats = shelf.put(of.doc_stats)
        # Rows of an id that is in several documents have all their lengths.
        lengths = self.doc_stats.repartition(of.parts, "doc_id").groupBy("doc_id").agg(F.collect_list("dl").alias("dls"))
        self._rows = shelf.put(of.tf_table.join(lengths.hint("shuffle_hash"), "doc_id", "left"))
        self.tf_table = self._rows.select("doc_id", "term", "tf")
        self.tf_lengths = self._rows.select("doc_id", "term", "tf", F.explode("dls").alias("dl"))
        self.lm = shelf.put(self.tf_table.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df")))

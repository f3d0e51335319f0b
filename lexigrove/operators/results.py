"""What result lines show beside places: the text between two positions, document names, a match nearby.

Texts are read only for documents that have a result, and cut within their row; results of any number are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrove.functions.tokens import RUN, no_number
from lexigrove.operators.gcl import Engine
from lexigrove.sources.corpus import Corpus

#: The most characters of an added text, and what stands for none.
ADDED_LENGTH, NOTHING = 256, "n/a"


def _chunks(text: Column) -> Column:
    """The runs of plain text, each with what comes before it; runs that take no position are among them."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[^A-Za-z0-9]*" + RUN), F.lit(0))


def _places(chunks: Column) -> Column:
    """For each position of the text, the place (from 1) of its run in ``chunks``."""
    numbered = F.transform(chunks, lambda c, i: F.when(no_number(F.regexp_replace(c, "^[^A-Za-z0-9]+", "")), i + 1))
    return F.filter(numbered, lambda i: i.isNotNull())


def get(corpus: Corpus, found: DataFrame, filtered: bool = False) -> DataFrame:
    """``found`` (doc_id, s, e and more) with ``got``: the text from the first to the last of these positions.

    ``filtered`` gives the tokens, joined by blanks, instead. Rows whose positions aren't all in their document, or
    run backwards, are left out, as are null positions; repeated rows stay. Marked-up corpora give tokens only. An
    older column ``got`` is replaced.
    """
    if corpus.markup and not filtered:
        raise ValueError("the text of a marked-up corpus is not kept by position: ask for tokens")
    wanted = found.select("doc_id").distinct()
    docs = corpus.docs.join(wanted, "doc_id", "left_semi")
    row = F.struct(*(F.col(c) for c in found.columns)).alias("row")
    rows = found.select("doc_id", row)
    s, e = F.col("row.s").cast("int"), F.col("row.e").cast("int")
    if filtered:
        texts = docs.select("doc_id", corpus._words.alias("words")).withColumn("size", F.size("words"))
        got = F.array_join(F.slice("words", s + 1, e - s + 1), " ")
    else:
        texts = docs.select("doc_id", _chunks(F.col("text")).alias("chunks")).withColumn("places", _places(F.col("chunks"))).withColumn("size", F.size("places"))
        first, last = F.get("places", s), F.get("places", e)
        got = F.regexp_replace(F.array_join(F.slice("chunks", first, last - first + 1), ""), "^[^A-Za-z0-9]+", "")
    inside = (s >= 0) & (s <= e) & (e < F.col("size"))
    kept = [F.col("row").getField(c).alias(c) for c in found.columns if c != "got"]
    return rows.join(texts, "doc_id").where(inside).select(*kept, got.alias("got"))


def named(corpus: Corpus, found: DataFrame, *columns: str) -> DataFrame:
    """``found`` with columns of its documents, as their file names; null where the document is unknown."""
    names = corpus.docs.select("doc_id", *columns)
    return found.drop(*columns).join(names.join(found.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", "left")


def added(engine: Engine, found: DataFrame, query: str) -> DataFrame:
    """``found`` (doc_id, s, e and more) with add_s and add_e: the first match of ``query`` from s on, if it ends by e.

    Both are -1 where there is none. One sort of a document's rows serves all its results; ties and repeated rows do
    no harm. Older columns add_s and add_e are replaced.
    """
    row = F.struct(*(F.col(c) for c in found.columns))
    results = found.select("doc_id", F.col("s").alias("at"), F.lit(None).cast("long").alias("xe"), row.alias("row"))
    matches = engine.query(query).select("doc_id", F.col("s").alias("at"), F.col("e").alias("xe"), F.lit(None).cast(found.select(row.alias("row")).schema["row"].dataType).alias("row"))
    # Matches don't hold each other: the first to begin is the first to end.
    onwards = Window.partitionBy("doc_id").orderBy("at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    first = F.min(F.when(F.col("xe").isNotNull(), F.struct("at", "xe"))).over(onwards)
    there = results.unionByName(matches).withColumn("first", first).where("row is not null")
    fits = F.coalesce(F.col("first.xe") <= F.col("row.e"), F.lit(False))
    kept = [F.col("row").getField(c).alias(c) for c in found.columns if c not in ("add_s", "add_e")]
    return there.select(*kept, F.when(fits, F.col("first.at")).otherwise(-1).cast("long").alias("add_s"), F.when(fits, F.col("first.xe")).otherwise(-1).cast("long").alias("add_e"))


def added_text(engine: Engine, found: DataFrame, query: str) -> DataFrame:
    """``found`` with add_s, add_e and ``added``: the text of that match on one line, or NOTHING.

    ``found`` is read twice, so it should be a ranking or come from a table. Rows that are equal stay apart.
    """
    rows = added(engine, found, query)
    places = rows.where("add_s >= 0").select("doc_id", F.col("add_s").alias("s"), F.col("add_e").alias("e")).distinct()
    line = F.translate(F.substring("got", 1, ADDED_LENGTH), "\t\n\x0b\x0c\r\"", "     '")
    texts = get(engine.corpus, places, engine.corpus.markup).select("doc_id", F.col("s").alias("add_s"), F.col("e").alias("add_e"), F.trim(line).alias("added"))
    return rows.drop("added").join(texts, ["doc_id", "add_s", "add_e"], "left").fillna(NOTHING, ["added"])


def whole(corpus: Corpus, ranked: DataFrame) -> DataFrame:
    """A ranking of documents with s and e, the first and last position of each; empty documents end before they start."""
    lengths = corpus.doc_stats.join(ranked.select("doc_id").distinct(), "doc_id", "left_semi")
    return ranked.join(lengths, "doc_id").select(*ranked.columns, F.lit(0).cast("long").alias("s"), (F.col("dl") - 1).alias("e"))

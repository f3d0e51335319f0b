"""Exact duplicates by content-defined chunk recipes, with DataFrame operations only.

A text is cut before each blank-separated word where a hash of a sliding window, that word and the one before, meets
a mask. So a cut depends on two words only: what is put in front of a text, or changed in it, moves no other chunk. Equal
texts have equal chunk lists, and a chunk list gives its text back. Chunks are deduplicated to verified identifiers: a
SHA-256 digest stands for a chunk once all its occurrences agree in length and in a second hash. Documents are then
compared by their ordered lists of identifiers, once for each distinct list; what moves after that is a digest of the list.
Texts are read where they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.session import Shelf

#: Words of a chunk on average. A text without blanks is one chunk.
CHUNK_WORDS = 128
#: So many keys of dropped rows (about 100 bytes each) are broadcast at most; more are joined by a shuffle of the rows.
BROADCAST_ROWS = 500_000


def recipes(docs: DataFrame, id_col: str, text_col: str, mean: int) -> DataFrame:
    """doc_id, text_sha256 and chunks (digest, length, second hash) of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("text_sha256"), F.split(text, " ", -1).alias("words"))
    places = words.withColumn("cuts", F.expr(f"filter(sequence(1, size(words)), i -> i = 1 or pmod(xxhash64(get(words, i - 2), get(words, i - 1)), {mean}L) = 0)"))
    cut = places.withColumn("texts", F.expr("transform(cuts, (a, k) -> array_join(slice(words, a, coalesce(get(cuts, k + 1), size(words) + 1) - a), ' '))"))
    return cut.select("doc_id", "text_sha256", F.transform("texts", lambda c: F.struct(F.unhex(F.sha2(c, 256)).alias("digest"), F.length(c).alias("length"), F.xxhash64(c).alias("check"))).alias("chunks"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean: int = CHUNK_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. A null text counts as empty, and empty texts form one group.
    Repeated rows (same id, same text) each give a row and each count in group_size; they are kept together.
    A row without an id loses to any id; it is kept only where its whole group has none.
    An empty table gives an empty result; other columns of ``docs`` are ignored, whatever their names.
    """
    shelf = Shelf(docs.sparkSession, "exact-dedup")
    cut = shelf.put(recipes(docs, id_col, text_col, mean))
    agree = (F.min("chunk.length") == F.max("chunk.length")) & (F.min("chunk.check") == F.max("chunk.check"))
    identifiers = cut.select(F.explode("chunks").alias("chunk")).groupBy("chunk.digest").agg(agree.alias("agree"))
    if not identifiers.where("not agree").isEmpty():
        raise ValueError("two chunks share a digest")
    listed = cut.select("doc_id", "text_sha256", F.expr("array_join(transform(chunks, c -> hex(c.digest)), '')").alias("ids")).withColumn("recipe", F.unhex(F.sha2("ids", 256)))
    groups = listed.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), (F.min("ids") == F.max("ids")).alias("same"))
    # Both sides of the join are plain tables, so that a large group of copies is split between tasks.
    verified = shelf.put(groups.withColumn("group_size", F.when(F.col("same"), F.col("group_size")).otherwise(F.raise_error(F.lit("two lists share a digest")).cast("long"))).drop("same"))
    return listed.select("doc_id", "text_sha256", "recipe").join(verified, "recipe").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without rows whose text a kept row repeats; all columns stay, whatever their names.

    Of repeated rows (same id, same text) any one stays. Nulls, empty texts and empty tables: as in ``exact_groups``.
    """
    shelf = Shelf(docs.sparkSession, "drop-copies")
    decided = shelf.put(exact_groups(docs, id_col, text_col).groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), "kept").agg(F.count("*").alias("copies")))
    gone = shelf.put(decided.where("not kept").select("id", "sha"))
    again = shelf.put(decided.where("kept and copies > 1").select("id", "sha"))
    shelf.drop(decided)
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.col(id_col).alias("own_id"), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("own_sha"))
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_sha") == F.col("sha"))
    left = rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, same, "left_anti")
    if not again.isEmpty():
        left = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["own_id", "own_sha"]))
    return left.select("row.*")

"""Text files as documents: what kind a text is, and files that hold many documents.

Spark reads .gz and .bz2 files by their names. Files of many documents are cut where one ends while they are read, so a
large one is many rows and, unless compressed by gzip, many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the first tag of a kind must begin, and the least characters of its text.
HTML_WITHIN, TREC_WITHIN, TREC_LEAST = 512, 200, 32
#: A mail of a mailbox starts with the first of these, one of the headers shows that it is one, and a
#: mailbox has so many characters at least.
MAIL_START, MAIL_HEADERS, MAIL_LEAST = "From ", ("X-UIDL: ", "X-Mozilla-Status: ", "Message-ID: ", "Date: "), 128


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def is_html(text: Column) -> Column:
    """An html tag begins early on, and there is a document type, a head, a body or a title."""
    low = F.lower(text)
    marks = [F.contains(low, F.lit(m)) for m in ("<!doctype html", "<head", "<body")]
    at = F.instr(low, "<html")
    return (at > 0) & (at <= HTML_WITHIN + 1) & _any([*marks, F.contains(low, F.lit("<title>")) & F.contains(low, F.lit("</title>"))])


def is_trec(text: Column) -> Column:
    """A doc tag begins early on and a docno is opened and closed; tags are all lower or all upper case."""
    at = F.coalesce(F.nullif(F.instr(text, "<doc>"), F.lit(0)), F.instr(text, "<DOC>"))
    has = lambda tag: _any([F.contains(text, F.lit(tag)), F.contains(text, F.lit(tag.upper()))])
    return (F.length(text) >= TREC_LEAST) & (at > 0) & (at <= TREC_WITHIN + 1) & has("<docno>") & has("</docno>")


def is_mailbox(text: Column) -> Column:
    return (F.length(text) >= MAIL_LEAST) & text.startswith(MAIL_START) & _any([F.contains(text, F.lit(h)) for h in MAIL_HEADERS])


def kind(text: Column) -> Column:
    """trec, mbox, html or text, the first that fits; null texts are text."""
    return F.when(is_trec(text), "trec").when(is_mailbox(text), "mbox").when(is_html(text), "html").otherwise("text")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text, kind: a row for each file. For files of many documents the readers below are better."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), kind(F.col("value")).alias("kind"))


def trec_documents(spark: SparkSession, path: str, end: str = "</DOC>") -> DataFrame:
    """path, docno, text of each document, its tags included; ``end`` as the files write it.

    What stands between documents is no part of them. A document without a docno has null, a last one that doesn't end
    is kept, and repeated docnos stay.
    """
    start = end.replace("/", "")
    rows = spark.read.text(path, lineSep=end).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    text = F.concat(F.substring(F.col("value"), F.instr("value", start), F.length("value")), F.lit(end))
    docno = F.trim(F.regexp_extract("text", r"(?is)<docno>(.*?)</docno>", 1), F.lit(" \t\r\n"))
    return rows.where(F.contains("value", F.lit(start))).select("path", text.alias("text")).select("path", F.nullif(docno, F.lit("")).alias("docno"), "text")


def mails(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each mail of mailboxes, from its From line on. A mail starts at any line that begins with "From "."""
    rows = spark.read.text(path, lineSep=f"\n{MAIL_START}").select(F.col("_metadata.file_path").alias("path"), "value")
    return rows.where("value <> ''").select("path", F.when(F.col("value").startswith(MAIL_START), F.col("value")).otherwise(F.concat(F.lit(MAIL_START), "value")).alias("text"))


def posting_lines(spark: SparkSession, path: str) -> DataFrame:
    """term, pos: postings from lines ``# TERM POSITION ...``; other lines and what is no number are skipped."""
    words = F.split(F.trim(F.col("value")), r"\s+")
    rows = spark.read.text(path).where(F.col("value").startswith("# ")).select(words.alias("w"))
    return rows.select(F.get("w", F.lit(1)).alias("term"), F.explode(F.slice("w", F.lit(3), F.greatest(F.size("w") - 2, F.lit(0)))).alias("pos")).select("term", F.expr("try_cast(pos AS long)").alias("pos")).where("pos is not null")

"""Kinds of texts and files of many documents."""

import bz2
import gzip

from pyspark.sql import functions as F

from lexigrove.sources import files


def test_kinds(spark):
    html = "<HTML><Head>x</head>"
    trec = "<DOC>\n<DOCNO> A-1 </DOCNO> some text here </DOC>"
    mail = "From a@b.c\nMessage-ID: <1>\n\n" + "hi " * 40
    cases = [(html, "html"), (" " * 512 + html, "html"), (" " * 513 + html, "text"), ("<html>nothing", "text"), ("<html><title>a</title>", "html"), (trec, "trec"), ("x" * 201 + trec, "text"), ("<Doc><docno>1</docno> and more text than that", "text"), ("<doc><docno>1</docno>", "text"), (mail, "mbox"), (mail[:127], "text"), ("From here on", "text"), ("", "text"), (None, "text")]
    rows = spark.createDataFrame(cases, "text string, want string")
    assert [tuple(r) for r in rows.where(files.kind(F.col("text")) != F.col("want")).collect()] == []


def test_trec_files(spark, tmp_path):
    body = "junk\n<DOC>\n<DOCNO> A-1 </DOCNO>\none\n</DOC>\n<DOC>no number</DOC>\n<DOC><DOCNO>A-1</DOCNO> again</DOC>\n"
    (tmp_path / "a").write_text(body)
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"<DOC><DOCNO>B</DOCNO> packed</DOC>"))
    (tmp_path / "c.bz2").write_bytes(bz2.compress("<DOC><DOCNO>C</DOCNO> ünpacked</DOC>\n".encode()))
    (tmp_path / "empty").write_text("")
    got = sorted((r.docno or "", r.text) for r in files.trec_documents(spark, str(tmp_path)).collect())
    assert got == [("", "<DOC>no number</DOC>"), ("A-1", "<DOC>\n<DOCNO> A-1 </DOCNO>\none\n</DOC>"), ("A-1", "<DOC><DOCNO>A-1</DOCNO> again</DOC>"), ("B", "<DOC><DOCNO>B</DOCNO> packed</DOC>"), ("C", "<DOC><DOCNO>C</DOCNO> ünpacked</DOC>")]


def test_mailboxes_and_whole_files(spark, tmp_path):
    (tmp_path / "box").write_text("From a\nDate: 1\n\nhello From me\nFrom b\nDate: 2\n\nbye" + "!" * 100)
    assert sorted(r.text for r in files.mails(spark, str(tmp_path)).collect()) == ["From a\nDate: 1\n\nhello From me", "From b\nDate: 2\n\nbye" + "!" * 100]
    (row,) = files.whole_files(spark, str(tmp_path)).collect()
    assert row.kind == "mbox" and row.path.endswith("/box") and row.text.endswith("bye" + "!" * 100)


def test_posting_lines(spark, tmp_path):
    (tmp_path / "p").write_text("# the 1 5 x 9\n# none\nother 3\n# of  2\n")
    assert sorted(map(tuple, files.posting_lines(spark, str(tmp_path)).collect())) == [("of", 2), ("the", 1), ("the", 5), ("the", 9)]

"""XPath on small documents."""

import pytest

from lexigrove.operators.xpath import Step, XPath, parse
from lexigrove.sources.corpus import Corpus

HTML = '<html><head><meta charset="x"><title>My Title</title></head><body><div class="a"><p>one</p><p>two <b>bold</b></p></div><div><p>three</p></div></body></html>'


@pytest.fixture(scope="module")
def xpath(spark):
    return XPath(Corpus(spark.createDataFrame([(1, HTML), (2, "plain"), (3, None), (4, "<p>top</p>")], "doc_id long, text string"), markup=True))


def test_steps():
    assert parse('doc("x")/html//p[2]/..') == (Step("child", "html"), Step("descendant-or-self", "node()"), Step("child", "p", ("2",)), Step("parent", "node()"))


def test_paths(xpath):
    names = lambda p: sorted((r.doc_id, r.name, r.level) for r in xpath.query(p).collect())
    assert names("/html/body/div") == [(1, "div", 3)] * 2
    assert names("//p") == [(1, "p", 4)] * 3 + [(4, "p", 1)]
    assert names("//p[2]/b") == [(1, "b", 5)]
    assert names("//b/ancestor::div") == [(1, "div", 3)]
    assert names("//b/..") == [(1, "p", 4)]
    assert names("//div[p/b]/p[1]") == [(1, "p", 4)]
    assert names('//div[contains(p,"three")]/p') == [(1, "p", 4)]
    assert names("//div[count(p) > 1 and not(b)]") == [(1, "div", 3)]
    assert names("//p[last()]") == [(1, "p", 4)] * 2 + [(4, "p", 1)]
    assert names('//title[. = "my title"]') == [(1, "title", 3)]
    assert names("/html/descendant::b/ancestor-or-self::*") == [(1, "b", 5), (1, "body", 2), (1, "div", 3), (1, "html", 1), (1, "p", 4)]
    assert names("//a/@href") == []


def test_where_elements_stand(xpath):
    assert [r.path for r in xpath.path_of(xpath.query("//b")).collect()] == ["html[1]/body[1]/div[1]/p[2]/b[1]"]

"""String functions as columns, and a few for single values."""

from __future__ import annotations

import math
import re
from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stopwords.
STOPWORDS = {
    "en": """
is has in been was where were are they done be do and up there to or such as of so about the a an by that this these
which for on he have if whether what who will it their his had at than find many through how but also begin them get
got use used more from any etc gotten she some s when those its due not nor with only relevant document documents
without i e g does did t no could
""".split(),
    "de": "als das der die ein eine haben hat in ist oder sind und".split(),
}


def without_stopwords(tokens: Column, language: str = "en") -> Column:
    words = STOPWORDS[language]
    return F.filter(tokens, lambda t: ~t.isin(words))


def wildcard(value: Column, pattern: str) -> Column:
    """Does all of ``value`` fit ``pattern`` with * and ?"""
    quoted = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in pattern)
    return value.rlike(f"(?s)^{quoted}$")


def normalised(text: Column) -> Column:
    """Letters, digits and non-ASCII characters, lower-cased; runs of others are one blank; none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " "))


def normalised_url(url: Column) -> Column:
    """Without scheme, www., fragment, index page and trailing slashes; the host lower-cased."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z]+://", "")
    host, rest = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), F.regexp_extract(bare, "^[^/?]*(.*)$", 1)
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(F.regexp_replace(rest, r"/index\.html?$", ""), "/+$", ""))


def collapsed(path: Column) -> Column:
    """A path without //, /./ and what precedes /../ (to eight levels)."""
    out = F.regexp_replace(F.regexp_replace(path, "/(\\./)+", "/"), "/+", "/")
    for _ in range(8):
        out = F.regexp_replace(out, r"/(?!\.\./)[^/]+/\.\./", "/")
    return out


def absolute_url(base: str, link: str) -> str:
    return urljoin(base, link)


def links(html: Column) -> Column:
    """array<struct<url, anchor>> of all <a href>; tags in an anchor are dropped."""
    anchors = F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*href\s*=\s*[\"']?[^\"'\s>]+[^>]*>.*?</a>"), F.lit(0))
    return F.transform(anchors, lambda a: F.struct(F.regexp_extract(a, r"(?is)href\s*=\s*[\"']?([^\"'\s>]+)", 1).alias("url"), F.trim(F.regexp_replace(F.regexp_replace(a, "(?s)<[^>]*>", " "), r"\s+", " ")).alias("anchor")))


def wiki_links(text: Column) -> Column:
    """array<struct<url, anchor>> of [[target|anchor]]."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[[^\[\]]+\]\]"), F.lit(0))
    inner = F.transform(found, lambda x: F.substr(x, F.lit(3), F.length(x) - 4))
    return F.transform(inner, lambda x: F.struct(F.split(x, r"\|")[0].alias("url"), F.element_at(F.split(x, r"\|"), -1).alias("anchor")))


def topic_query(text: str, language: str = "en", stems: bool = False) -> str:
    """Scorers of a plain-text topic: distinct terms, weighted by how often they come, without stopwords."""
    counts: dict[str, int] = {}
    for word in re.findall(r"[a-z0-9]{1,19}", text.lower()):
        if word not in STOPWORDS[language]:
            counts[word] = counts.get(word, 0) + 1
    return ", ".join(f'#{n} "{"$" if stems else ""}{w}"' for w, n in counts.items())


def ln_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hamming_weight(value: Column) -> Column:
    return F.bit_count(value)

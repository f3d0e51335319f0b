"""Tokens of plain and marked-up text as array columns.

A token is a lower-cased run of ASCII letters and digits, at most 19 characters; a longer run continues in the next
token. Numbers of over 8 characters (over 7 if the first is above '1') take no position; they count as numbers if one
of their first two characters is a digit. Tags are tokens of their own: <name> and </name>, without attributes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the longest token.
LONGEST = 19
RUN = f"[A-Za-z0-9]{{1,{LONGEST}}}"
#: The other characters whose lower case holds an ASCII letter.
FALSE_LETTERS = ("\u0130", "\u212a")
#: A tag up to its name, or a run outside tags; what follows a tag's name up to > is skipped.
MARKUP = rf"<(/?[A-Za-z0-9!]+)(?:[^<>]*>)?|({RUN})"


def long_number(token: str) -> bool:
    """The opposite of no_number(), for one string."""
    return re.match("^.?[0-9]", token) is not None and (len(token) > 8 or len(token) > 7 and token[0] > "1")


def no_number(token: Column) -> Column:
    """False for numbers that are too long to be tokens."""
    return (F.length(token) <= 7) | ~(token.rlike("^.?[0-9]") & ((F.length(token) > 8) | ((F.length(token) > 7) & (F.substring(token, 1, 1) > "1"))))


def tokens(text: Column) -> Column:
    """Tokens of plain text, which is lower-cased as a whole: what would become a letter is a blank first."""
    plain = F.coalesce(text, F.lit(""))
    for c in FALSE_LETTERS:
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    return F.filter(F.regexp_extract_all(F.lower(plain), F.lit(RUN.replace("A-Z", "")), F.lit(0)), no_number)


def markup_tokens(text: Column) -> Column:
    """Tokens of marked-up text; scripts, styles and comments are skipped."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<!--.*?-->|<!doctype[^>]*>", " ")
    clean = F.regexp_replace(clean, r"(?is)(<(script|style)\b[^>]*>).*?(?=</\2)", "$1")
    found = F.regexp_extract_all(clean, F.lit(r"</?[A-Za-z0-9!]+(?:[^<>]*>)?|" + RUN), F.lit(0))
    named = F.transform(found, lambda t: F.when(t.startswith("<"), F.concat(F.lower(F.regexp_extract(t, r"^(</?[A-Za-z0-9!]+)", 1)), F.lit(">"))).otherwise(F.lower(t)))
    return F.filter(named, lambda t: t.startswith("<") | no_number(t))


def ngrams(words: Column, n: int) -> Column:
    """Character n-grams across tokens joined by '_'; fewer characters give none."""
    return F.regexp_extract_all(F.array_join(words, "_"), F.lit(f"(?=(.{{{n}}}))"), F.lit(1))


def bigrams(words: Column) -> Column:
    """For each position the term a_b of it and the next, where that has at most LONGEST characters, else null."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws("_", a, b))
    return F.transform(pairs, lambda p: F.when(F.length(p) <= LONGEST, p))

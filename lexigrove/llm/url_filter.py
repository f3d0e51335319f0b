"""URL filtering by rules and character language models, with DataFrame operations only.

A rule decides the URLs it fits. For the others, two smoothed variable-order Markov models, one of accepted and one
of rejected URLs, give the log-likelihood of each character after the longest known context; the difference,
divided by the length, is compared with a threshold. The models learn from four fifths of the URLs that rules decide, by
hash, and the threshold is calibrated on the other fifth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.session import Shelf

#: Fixed values: (allow or block, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: The longest context in characters; the weight of a shorter context's estimate, in characters seen.
ORDER, SMOOTHING = 4, 2.0
#: Size of the uniform alphabet below the shortest context.
ALPHABET = 128.0
#: A URL is rejected if its score is so many standard deviations under that of accepted ones.
SPREADS = 1.645
#: URLs whose crc32 mod FOLDS is 0 calibrate the threshold; the models don't see them.
FOLDS = 5
#: So many grams (about 50 bytes each) are broadcast at most; a larger model is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Stands before a URL's first characters.
START = "\x02"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or # (or the end), A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host, up to ? or # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def with_rule(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """``pages`` (host, path) with __rule and __decision of the longest rule that fits; null where none does."""
    rule, decision = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        decision = F.when(fits, F.lit(verdict)).otherwise(decision)
    return pages.withColumn("__rule", rule).withColumn("__decision", decision)


def _grams(pages: DataFrame, *keep: str) -> DataFrame:
    """A row for each character of __url: the character after its ORDER predecessors, as __gram."""
    padded = F.concat(F.lit(START * ORDER), "__url")
    return pages.select(*keep, padded.alias("__p"), F.explode(F.expr("sequence(1, length(__url), 1)")).alias("__i")).select(*keep, F.expr(f"substring(__p, __i, {ORDER + 1})").alias("__gram"))


def ratios(shelf: Shelf, pages: DataFrame, order: int = ORDER, smoothing: float = SMOOTHING) -> DataFrame:
    """__gram, __ratio: log p(last character | the ones before) under accepted URLs less that under rejected ones.

    Counts of shorter contexts are sums over the longest; p of each order leans on that of the next shorter one.
    """
    seen = (
        _grams(pages.where("length(__url) > 0"), "__decision")
        .groupBy("__gram")
        .agg(*(F.sum(F.when(F.col("__decision") == v, 1.0).otherwise(0.0)).alias(v) for v in ("allow", "block")))
    )
    table = shelf.put(seen)
    out = table.select("__gram")
    p: dict[str, Column] = {"allow": F.lit(1 / ALPHABET), "block": F.lit(1 / ALPHABET)}
    for k in range(order + 1):  # the last k + 1 characters: a context of k and the next one
        tail = F.substring("__gram", order + 1 - k, k + 1)
        context = F.substring("__gram", order + 1 - k, k)
        both = table.groupBy(tail.alias("__tail"), context.alias("__context")).agg(F.sum("allow").alias("a"), F.sum("block").alias("b"))
        whole = both.groupBy("__context").agg(F.sum("a").alias("wa"), F.sum("b").alias("wb"))
        level = both.join(whole, "__context").select("__tail", *(F.col(x).alias(f"{x}{k}") for x in ("a", "b", "wa", "wb")))
        out = out.withColumn("__tail", tail).join(level, "__tail").drop("__tail")
        for v, x in (("allow", "a"), ("block", "b")):
            p[v] = (F.col(f"{x}{k}") + smoothing * p[v]) / (F.col(f"w{x}{k}") + smoothing)
    return out.select("__gram", (F.ln(p["allow"]) - F.ln(p["block"])).alias("__ratio"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, score.

    Null URLs and ones without :// have an empty host and path and a score of 0. Of rules that fit, the longest (host and
    path together) decides; of equally long ones, the last in alphabetical order of verdict, host and path. Each distinct
    host and path is scored once. The threshold lies SPREADS standard deviations under the mean score of held-out URLs
    that rules accept, but not nearer to it than to the mean of those that rules reject; without such URLs on both sides
    it is 0. Repeated rows each give a row; other columns are ignored, whatever their names; an empty table gives an
    empty result.
    """
    shelf = Shelf(pages.sparkSession, "url-filter")
    parted = with_rule(pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")), rules).withColumn("__url", F.concat("host", "path"))
    distinct = shelf.put(parted.groupBy("host", "path", "__url", "__rule", "__decision").agg(F.count("*").alias("__n")).withColumn("__id", F.monotonically_increasing_id()))
    held_out = F.pmod(F.crc32("__url"), F.lit(FOLDS)) == 0
    # Grams of all URLs are in the model, those of URLs beside the training ones with counts of 0 and shorter contexts.
    model = shelf.put(ratios(shelf, distinct.withColumn("__decision", F.when(~held_out, F.col("__decision")))))
    size = model.count()
    grams = _grams(distinct.where("length(__url) > 0"), "__id")
    scores = grams.join(F.broadcast(model) if size <= BROADCAST_ROWS else model, "__gram").groupBy("__id").agg(F.avg("__ratio").alias("score"))
    scored = shelf.put(distinct.join(scores, "__id", "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9)))
    known = {r[0]: r for r in scored.where("__decision is not null").where(held_out).groupBy("__decision").agg(F.avg("score"), F.stddev_pop("score")).collect()}
    threshold = 0.0
    if len(known) == 2:
        (_, good, spread_), (_, bad, _) = known["allow"], known["block"]
        threshold = round(min((good + bad) / 2, good - SPREADS * spread_), 6)
    verdict = F.coalesce("__decision", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    # A plain table: so Spark splits a popular URL between tasks. What has neither host nor path needs no join.
    decided = shelf.put(scored.select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.col("__rule").alias("rule"), verdict.alias("verdict"), "score"))
    shown = ("page_id", "host", "path", "rule", "verdict", "score")
    joined = parted.select("page_id", "host", "path").where("__url <> ''").join(decided, (F.col("host") == F.col("__h")) & (F.col("path") == F.col("__p"))).select(*shown)
    empty = parted.where("__url = ''").select("page_id", "host", "path", F.col("__rule").alias("rule"), F.coalesce("__decision", F.lit("allow" if threshold <= 0 else "block")).alias("verdict"), F.lit(0.0).alias("score"))
    return joined.unionByName(empty)

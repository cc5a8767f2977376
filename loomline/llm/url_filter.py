"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression with the literal tokens that any url it fits must hold. Tokens of urls are
counted over the whole table, each rule is indexed by its rarest token, and the tokens of each distinct
url fetch candidate rules; only those run their regular expression. The url itself is read once per pass
and never shuffled with the page: verdicts of distinct urls that any rule fits are joined back.

Only DataFrame functions run. The index is broadcast if it is counted to be small, else joined by a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, LOWER, checkpointed

#: Rules broadcast, at most (a few hundred bytes each).
BROADCAST_RULES = 20_000


@dataclass(frozen=True)
class UrlRule:
    """verdict for urls that pattern fits; text is what the result names, None for rules of the method."""

    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    text: str | None = None
    host: str = ""
    path: str = ""

    @property
    def rank(self) -> int:
        """Of rules that fit, the longest wins; host/path rules are before patterns, allow before block at equal length."""
        return (1 << 20) * (self.text is not None) + 2 * len((self.host + self.path).encode()) + (self.verdict == "allow")


def tokens_of(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(re.findall(r"[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))))


def host_rule(verdict: str, rule: str) -> UrlRule:
    """A rule host/path: it fits the host and its subdomains where the path starts with the rule's."""
    host, slash, path = rule.partition("/")
    host, path = host.translate(str.maketrans(UPPER, LOWER)), slash + path
    # the last token of a path may go on in the url, so only tokens that something ends count as literal
    whole = tokens_of(host + re.sub(r"[A-Za-z0-9]+$", "", path))
    return UrlRule(verdict, r"\A(?:[^/]*\.)?" + re.escape(host) + r"\Q" + path.replace(r"\E", r"\E\\E\Q") + r"\E", whole, rule, host, path)


def word_rule(verdict: str, *words: str) -> UrlRule:
    """A rule of the method: all words stand in the host, in this order, between other signs."""
    inner = "[^a-z0-9/]+".join(words)
    return UrlRule(verdict, rf"\A(?:[^/]*[^a-z0-9/])?{inner}(?:[^a-z0-9/][^/]*)?(?:/|\z)", words)


#: The host/path rules asked for.
HOST_RULES = (host_rule("block", "com/en/"), host_rule("allow", "example.com/en/7"), host_rule("allow", "net/de/"), host_rule("block", "example.net/de/8"), host_rule("block", "org/es/"))
#: Words of hosts that carry nothing worth keeping.
PATTERN_RULES = tuple(word_rule("block", *x.split()) for x in ("spam farm", "cheap pills", "free casino", "online casino", "adult", "porn", "xxx", "payday loans", "link farm"))
RULES = HOST_RULES + PATTERN_RULES


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of url; both empty for null and where there is no ://."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)([^?#]*)", 2)
    return F.translate(after, UPPER, LOWER), path


def rule_table(spark: SparkSession, rules: tuple[UrlRule, ...]) -> DataFrame:
    rows = [(i, r.verdict, r.pattern, list(r.tokens), r.text, r.rank) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "id int, verdict string, pattern string, tokens array<string>, rule string, rank int")


def url_filter(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, default: str = "allow") -> DataFrame:
    """Every row of pages (a column url) with host, path, rule and verdict; same-named columns are replaced.

    A host/path rule fits its host and all subdomains where the path starts with the rule's path; the
    longest that fits gives rule and verdict, and at equal length allow goes first. Else the verdict is
    block if a pattern rule fits, else the default, and rule is null. Null urls and urls without :// have an
    empty host and path and get the default. Rules without a token are tried on every url. Repeated rows are judged alike; an empty table gives an empty one.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col("url").cast("string"))
    distinct = pages.select(F.col("url").cast("string").alias("url")).where("url is not null").distinct().select("url", F.concat(host, path).alias("place"))
    flat = distinct.select("url", "place", F.explode(F.array_distinct(F.regexp_extract_all(F.translate("place", UPPER, LOWER), F.lit("[a-z0-9]+"), F.lit(0)))).alias("token"))
    table = rule_table(spark, rules).withColumn("token", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))))
    if any(not r.tokens for r in rules):  # a rule without a token is a candidate of every url
        flat = flat.unionByName(distinct.select("url", "place", F.lit("").alias("token")))
    small = len(rules) <= BROADCAST_RULES
    hint = F.broadcast if small else (lambda x: x)
    counts = flat.select("token").join(hint(table.select("token").distinct()), "token").groupBy("token").count()
    rarest = F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token")
    index = table.join(counts, "token", "left").groupBy("id", "verdict", "pattern", "rule", "rank").agg(rarest)
    index = checkpointed(index)
    fits = flat.join(hint(index), "token").where(F.regexp_like("place", F.col("pattern")))
    best = fits.groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), F.struct("rank", "id")).alias("best"))
    columns = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    placed = pages.select(*columns, host.alias("host"), path.alias("path"), F.col("url").cast("string").alias("_url"))
    joined = placed.join(best.withColumnRenamed("url", "_of"), F.col("_url") == F.col("_of"), "left")
    return joined.select(*columns, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))

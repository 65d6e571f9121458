"""URL filters: a weighted vocabulary of strict and soft terms, and rules for hosts and paths.

An Aho-Corasick automaton reads each url once, whatever the size of the
vocabulary, and counts the terms that stand between boundaries. One strict term
rejects; soft terms reject when several distinct ones are found. A rule for a
host and a path prefix goes before the terms; the longest fitting rule wins.

A few rules become one column expression. A rule table of any size is joined:
urls meet rules by host suffix, then by the path prefixes that have the lengths
of that host's rules, so that nothing is compared by trial.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bound_batches
from graphloom.scratch import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms of the default vocabulary.
STRICT = ("porn", "xxx", "hentai", "escort", "camgirl", "viagra", "spam", "malware", "phishing", "warez", "casino")
SOFT = ("adult", "sexy", "dating", "bet", "bets", "poker", "slots", "win", "prize", "free", "cheap", "deal", "deals", "pills", "loan", "loans", "click", "track", "tracker", "ads", "popup", "crack", "keygen", "torrent")
#: Distinct soft terms that reject a url.
MIN_SOFT = 2
#: Rules up to this number are one column expression, beyond it a join.
INLINE_RULES = 100


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path what follows the host up to `?`, `#` or the end. Both are empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _inside(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9" or c >= "\x80"


@lru_cache(maxsize=8)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    """Over the lower-cased terms; a term in both lists is strict."""
    out = ahocorasick.Automaton()
    for weight, terms in (("soft", soft), ("strict", strict)):
        for t in terms:
            if t:
                out.add_word(t.lower(), (weight, t.lower()))
    if len(out):
        out.make_automaton()
    return out


def count_terms(url: str, found: ahocorasick.Automaton) -> tuple[int, int]:
    """(occurrences of strict terms, distinct soft terms); a term counts where no letter, digit or non-ASCII character touches it."""
    strict, soft = 0, set()
    for end, (weight, term) in found.iter(url):
        start = end - len(term) + 1
        if (start and _inside(url[start - 1])) or (end + 1 < len(url) and _inside(url[end + 1])):
            continue
        if weight == "strict":
            strict += 1
        else:
            soft.add(term)
    return strict, len(soft)


def term_counts(url: Column, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT) -> Column:
    """struct(strict int, soft int) of a url; null has none."""
    strict, soft = tuple(strict), tuple(soft)

    @F.pandas_udf("strict int, soft int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = automaton(strict, soft)
        for urls in batches:
            yield pd.DataFrame([count_terms(u, found) if u and len(found) else (0, 0) for u in urls], columns=["strict", "soft"])

    return count(F.translate(url, UPPER, LOWER))


def _by_case(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, action) of the longest fitting rule; the rules are in order of preference."""
    out = None
    for action, at, prefix in rules:
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(prefix))
        found = F.struct(F.lit(at + prefix).alias("rule"), F.lit(action).alias("action"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return F.lit(None).cast("struct<rule:string,action:string>") if out is None else out


def _by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, action) of the distinct (host, path) that a rule fits."""
    labels = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths")).withColumnRenamed("host", "suffix")
    parts = F.split("host", r"\.")
    suffixes = urls.distinct().withColumn("labels", parts).withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(max(1, labels))))))
    suffixes = suffixes.select("host", "path", F.array_join(F.slice("labels", -F.col("k"), F.col("k")), ".").alias("suffix"))
    tried = suffixes.join(lengths, "suffix").withColumn("n", F.explode("lengths")).where("n <= length(path)")
    tried = tried.select("host", "path", "suffix", F.substring(F.col("path"), F.lit(1), F.col("n")).alias("prefix"))
    known = rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "action")
    order = F.struct((F.length("suffix") + F.length("prefix")).alias("n"), F.length("suffix").alias("m"), "action")
    best = tried.join(known, ["suffix", "prefix"]).groupBy("host", "path").agg(F.max_by(F.struct(F.concat("suffix", "prefix").alias("rule"), "action"), order).alias("best"))
    return best.select("host", "path", "best.rule", "best.action")


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = (), strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT,
    min_soft: int = MIN_SOFT, url_col: str = "url",
) -> DataFrame:
    """One row for each row of `pages`: row (its columns, of any name), host, path, rule, n_strict, n_soft, verdict.

    `rules`: (action, host, path) with action `allow` or `block`, as a sequence or
    as a table of these columns. A rule fits its host (A-Z lower-cased) and all
    subdomains if the url's path starts with the rule's; the longest (host and path
    together) wins, of equally long ones that with the longer host, then `block`.
    Without a rule the verdict is `block` with one strict term or with `min_soft`
    distinct soft terms, else `allow`.

    A null or empty url, or one without `://`, has an empty host and path, meets
    no rule unless one has an empty host or path, and is judged by its terms (null:
    none). Very long urls are read once. Rows are judged one by one, repeated ones
    alike; an empty table gives an empty result. Neither rows nor other columns move,
    except where a rule table is joined (`rules` a table, or more than INLINE_RULES).
    """
    spark = pages.sparkSession
    bound_batches(pages)
    base = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"))
    host, path = url_parts(F.col(f"row.`{url_col}`"))
    judged = base.select("row", host.alias("host"), path.alias("path"), term_counts(F.col(f"row.`{url_col}`"), strict, soft).alias("_terms"))
    if not isinstance(rules, DataFrame) and len(rules) <= INLINE_RULES:
        known = sorted({(a, h.translate(str.maketrans(UPPER, LOWER)), p) for a, h, p in rules}, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
        out = judged.withColumn("_rule", _by_case(F.col("host"), F.col("path"), known)).withColumns({"rule": F.col("_rule.rule"), "_action": F.col("_rule.action")})
    else:
        given = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "action string, host string, path string")
        given = given.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "action").where("host is not null and path is not null").groupBy("host", "path").agg(F.max("action").alias("action"))
        found = materialize(_by_join(judged.select("host", "path"), given), "url-rules")
        out = judged.join(found.withColumnRenamed("action", "_action"), ["host", "path"], "left")
    rejects = (F.col("_terms.strict") > 0) | (F.col("_terms.soft") >= min_soft)
    return out.select(
        "row", "host", "path", "rule", F.col("_terms.strict").alias("n_strict"), F.col("_terms.soft").alias("n_soft"),
        F.coalesce("_action", F.when(rejects, "block").otherwise("allow")).alias("verdict"),
    )

"""URL filter: a blocked Bloom filter passes possible hits on to an exact join. SQL functions only."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import materialized

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values: (rule, verdict). A rule is a host, which covers its subdomains, and the start of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Keys in a block of eight 64-bit words; each key sets one bit in each word.
KEYS_PER_BLOCK = 32
#: The filter is broadcast up to this many blocks (64 bytes each, 32 MB in all), else joined by its block number.
BROADCAST_BLOCKS = 500_000


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case. Path: from there
    up to ``?``, ``#`` or the end. Without ``://``, and for null, both are empty."""
    u = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.instr(u, "://")
    tail = F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(tail, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def canonical(url: str) -> Column:
    """Host without ``www.`` and port, path without doubled or final slashes, query parameters sorted and
    without campaign marks (``utm_``); no scheme, no fragment. Null and urls without a host give null."""
    host, path = host_and_path(url)
    host = F.regexp_replace(F.regexp_replace(host, r":\d*$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), "/$", "")
    query = F.regexp_extract(F.col(url), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for rule, decision in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, decision).otherwise(verdict)
    return name, verdict


def _words(key: Column) -> list[Column]:
    """One bit in each of the eight words of the key's block."""
    bits = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.pmod(F.shiftright(bits, 6 * i), F.lit(64)).cast("int"))
            for i in range(8)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks)).cast("long")


def bloom_filter(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0 .. w7): a blocked Bloom filter as a table; blocks without keys are absent. The words are
    bit_or aggregates, so copies of a key and hot blocks collapse before the shuffle."""
    words = [w.alias(f"w{i}") for i, w in enumerate(_words(F.col(key)))]
    return listed.select(_block(F.col(key), blocks).alias("block"), *words).groupBy("block").agg(
        *[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])


def listed_urls(urls: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """The canonical urls of ``urls`` that are in ``listed`` (its column ``url``), each once, as column ``canon``.

    The filter holds 16 bits a key (false positives well under one in a hundred); what it passes is joined
    exactly with the list, so false positives drop out and none is missed. The filter is broadcast only while
    its block count, derived from the counted list, is small. Nulls, empty texts and urls without a host are
    never listed; an empty list lists nothing.
    """
    keys = materialized(listed.select(canonical("url").alias("canon")).where("canon is not null").distinct(), "listed")
    blocks = max(1, -(-keys.count() // KEYS_PER_BLOCK))
    bloom = bloom_filter(keys, "canon", blocks)
    asked = urls.select(canonical(url).alias("canon")).where("canon is not null").distinct()
    asked = asked.withColumn("block", _block(F.col("canon"), blocks))
    bloom = F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom
    hit = [F.col(f"w{i}").bitwiseAND(w) != 0 for i, w in enumerate(_words(F.col("canon")))]
    possible = asked.join(bloom, "block").where(reduce(and_, hit)).select("canon")
    return possible.join(keys, "canon", "left_semi")


def judged(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed of every row of ``pages`` (page_id, url; other columns are
    left out). The verdict is the rule's; without one, block if the canonical url is in ``listed``, else allow.

    Null and empty urls have an empty host and path, no rule, and are allowed. Repeated rows are judged alike.
    Only distinct canonical urls go through filter and join; the pages meet the confirmed urls last.
    """
    host, path = host_and_path("url")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    found = listed_urls(pages, listed).select("canon", F.lit(True).alias("listed"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"),
                        F.coalesce(canonical("url"), F.concat(F.lit("\0"), F.xxhash64("page_id", "url").cast("string"))).alias("canon"))
    rows = rows.join(found, "canon", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"),
                       "listed")

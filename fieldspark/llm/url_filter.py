"""URL filter: host and path rules, then a blocked Bloom filter of listed canonical URLs and an exact hash join.

1. The listed URLs are brought into canonical form. Each falls into one block of the filter and sets one bit in each
   of the block's eight 64-bit words. A block is a row; the rows are made by one aggregation with bitwise OR.
2. A page's canonical URL is looked up in its block (broadcast if the measured filter is small, else a plain join).
   Only pages with all eight bits set are possible hits.
3. The possible hits meet the distinct listed URLs in an exact join, which removes the false positives. The other
   pages never enter that join.

Defined cases: a NULL url or one without ``://`` has an empty host and path and no canonical form, so it is not listed;
NULL and repeated list entries count once or not at all; repeated pages get equal verdicts; empty tables give empty
results, an empty list blocks nothing; columns of the input named like a result column are replaced, all others may
have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.text import ascii_lower, attach, free_name, fresh, spooled

HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
QUERY = r"(?s)^[^?#]*\?([^#]*)"
# Query parameters that say where a visitor came from.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"
WORDS = 8
BITS_PER_URL = 16


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without end slashes, sorted parameters without tracking; NULL without a host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    given = F.split(F.coalesce(F.regexp_extract(url, QUERY, 1), F.lit("")), "&")
    kept = F.array_sort(F.filter(given, lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.array_join(kept, "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def rule_verdicts(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest fitting rule, and its verdict; NULL for both if none fits. Of equal lengths the first one listed counts."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # Later ones overrule earlier ones: shorter rules come first, and of equal ones the last listed.
    for name, word in sorted(reversed(rules.items()), key=lambda r: len(r[0])):
        where, slash, rest = name.partition("/")
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def _bits(url: Column) -> list[Column]:
    """For each word of a block, a number with one bit set."""
    other = F.xxhash64(url, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(other, 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int")) for k in range(WORDS)]


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks).cast("long"))


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter: one row per block with entries, its words OR-ed together. ``listed`` has the column canonical."""
    words = [F.bit_or(b).alias(f"w{k}") for k, b in enumerate(_bits(F.col("canonical")))]
    return listed.groupBy(_block(F.col("canonical"), blocks).alias("block")).agg(*words)


def filter_urls(pages: DataFrame, listed_urls: DataFrame, url_column: str = "url", list_column: str = "url", rules: dict[str, str] | None = None) -> DataFrame:
    """The pages with host, path, canonical, rule, listed and verdict; listed_urls needs ``list_column`` only."""
    pages = fresh(pages, "host", "path", "canonical", "rule", "listed", "verdict")
    listed = spooled(listed_urls.select(canonical(F.col(list_column)).alias("canonical")).filter("canonical is not null").distinct())
    count = listed.count()
    blocks = max(1, -(-count * BITS_PER_URL // (64 * WORDS)))
    block, words, possible, found = (free_name(pages, n) for n in ("_block", "_words", "_possible", "_found"))
    table = bloom_blocks(listed, blocks).select(F.col("block").alias(block), F.array(*[f"w{k}" for k in range(WORDS)]).alias(words))
    url = F.col(url_column)
    named = pages.withColumns({"host": host_of(url), "path": path_of(url), "canonical": canonical(url)})
    probed = attach(named.withColumn(block, _block(F.col("canonical"), blocks)), table, [block], "left")
    hit = F.lit(True)
    for k, bit in enumerate(_bits(F.col("canonical"))):
        hit = hit & (F.col(words)[k].bitwiseAND(bit) == bit)
    probed = probed.withColumn(possible, F.coalesce(hit & F.col("canonical").isNotNull(), F.lit(False))).drop(block, words)
    hits = probed.filter(possible).join(listed.withColumn(found, F.lit(True)), "canonical", "left").withColumn("listed", F.coalesce(found, F.lit(False))).drop(found)
    judged = hits.unionByName(probed.filter(~F.col(possible)).withColumn("listed", F.lit(False)))
    rule, verdict = rule_verdicts(F.col("host"), F.col("path"), rules or {})
    by_list = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, by_list)).select(*pages.columns, "host", "path", "canonical", "rule", "listed", "verdict")

"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.llm.bloom import marked

#: The rules of the query, as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules that one projection holds; longer lists belong in the list of URLs.
MOST_RULES = 1000


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """host/path?query without scheme, www., default port, fragment, tracking parameters and last slash; null without a host."""
    host = F.regexp_replace(F.regexp_replace(url_host(url), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(url_path(url), r"/+$", "")
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    query = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.startswith("utm_")), "&")
    return F.when(url_host(url) != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def listed_urls(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """pages (with canonical) and a flag listed: whether canonical is in listed (canonical), nulls never.

    URLs that the Bloom filter of the list passes are looked up in the list by a
    join, whose skew Spark can split; all others are done.
    """
    listed = listed.select("canonical").where("canonical IS NOT NULL").distinct()
    found = marked(pages, "canonical", listed)
    exact = found.where("__hit").join(listed.withColumn("listed", F.lit(True)), "canonical", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    return exact.drop("__hit").unionByName(found.where("NOT __hit").drop("__hit").withColumn("listed", F.lit(False)))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as host/path, and its verdict; of rules as long, the one with the longer host."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; put long lists into the list of URLs")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, canonical, listed, rule, verdict for every row of pages (page_id, url).

    listed has a column canonical. The verdict is that of the longest rule that
    fits, else block for listed URLs and allow for all others. A null url, or one
    without ://, has an empty host and path and is allowed. Repeated rows are
    judged each; other columns are left out.
    """
    url = F.col("url")
    rows = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"), canonical_url(url).alias("canonical"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = listed_urls(rows, listed).withColumn("rule", rule)
    return out.withColumn("verdict", F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))).select(
        "page_id", "host", "path", "canonical", "listed", "rule", "verdict"
    )


#: The hosts whose pages make up the query's list.
SPAM_HOSTS = r"(^|\.)(spam-farm|cheap-pills)\."


def spam_list(pages: DataFrame) -> DataFrame:
    """The list of the query: the canonical URLs of all pages on spam hosts, over either scheme."""
    return pages.where(url_host(F.col("url")).rlike(SPAM_HOSTS)).select(canonical_url(F.col("url")).alias("canonical")).distinct()


ORACLE = rf"""
WITH p AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    array_to_string(list_filter(string_split(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_')), '&') AS q FROM pages),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN coalesce(q, '') <> '' THEN '?' || q ELSE '' END END AS canonical FROM p),
s AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '{SPAM_HOSTS}')),
r AS (SELECT c.*, s.canonical IS NOT NULL AS listed,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM c LEFT JOIN s ON c.canonical = s.canonical)
SELECT page_id, host, path, canonical, listed, rule,
    CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed THEN 'block' ELSE 'allow' END AS verdict FROM r"""

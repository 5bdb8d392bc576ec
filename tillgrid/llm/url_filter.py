"""Verdicts on page URLs: rules by host and path, and a list of canonical URLs.

The list is probed through a blocked Bloom filter: a URL's hash picks one block
of 512 bits and one bit in each of the block's eight words. Only URLs whose bits are all set
are joined with the list itself, which removes the false positives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillgrid.llm.common import ascii_lower, parts_for

#: (verdict, host, start of the path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Words that put a host on the list when one stands between its dots and hyphens.
TERMS = ("ads", "adult", "bets", "casino", "pills", "spam")

#: Filter bits for each listed URL, and the most blocks (of 64 bytes) that are
#: sent to every task: about 12 MB. A longer list makes the filter less selective, the join stays exact.
BITS = 16
MOST_BLOCKS = 1 << 17
WORDS = 8


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without www., path without a last slash, query without tracking parameters; no scheme, no fragment."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.concat(F.lit("&"), query), "&(utm_[a-z]+|ref)=[^&]*", "")
    query = F.regexp_replace(query, "^&", "?")
    return F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), "/$", ""),
                    F.when(query == "?", "").otherwise(query))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls when none does; of equally long ones the longer host, then the first by name."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (F.lit(None).cast("string"),) * 2 if rule is None else (rule, verdict)


def listed_on(pages: DataFrame, terms: Sequence[str] = TERMS) -> DataFrame:
    """``canon`` of the pages on hosts that carry one of ``terms``: the list this corpus brings along."""
    on = host_of(F.col("url")).rlike(rf"(^|[.-])({'|'.join(terms)})([.-]|$)")
    return pages.filter(on).select(canonical(F.col("url")).alias("canon")).distinct()


def _place(canon: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(canon), F.lit(blocks))


def _bit(canon: Column, word: int) -> Column:
    six = F.shiftrightunsigned(F.xxhash64(F.lit("bit"), canon), 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), six)


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """block and words w0..w7 of the filter of ``listed`` (canon); blocks nothing falls into are left out."""
    return (listed.groupBy(_place(F.col("canon"), blocks).alias("block"))
                  .agg(*[F.bit_or(_bit(F.col("canon"), k)).alias(f"w{k}") for k in range(WORDS)]))


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url).

    The longest rule that fits decides; where none fits, a URL whose canonical form is
    ``listed`` (canon) is blocked and any other allowed. A null url, or one without ://, has
    empty host and path and fits no rule. Repeated rows stay; further columns are not read.
    """
    listed = listed.filter(F.col("canon").isNotNull()).distinct()
    blocks = min(MOST_BLOCKS, parts_for(listed.count() * BITS, 64 * WORDS))
    url = F.col("url")
    seen = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canon"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    seen = seen.select("*", rule.alias("rule"), verdict.alias("ruled"), _place(F.col("canon"), blocks).alias("block"))
    # At most MOST_BLOCKS short rows are broadcast.
    probed = seen.join(F.broadcast(bloom(listed, blocks)), "block", "left")
    bits = [F.col(f"w{k}").bitwiseAND(_bit(F.col("canon"), k)) != 0 for k in range(WORDS)]
    possible = bits[0]
    for b in bits[1:]:
        possible = possible & b
    probed = probed.select("page_id", "host", "path", "rule", "ruled", "canon",
                           (F.col("ruled").isNull() & (F.col("canon") != "") & F.coalesce(possible, F.lit(False))).alias("possible"))
    out = ["page_id", "host", "path", "rule"]
    rest = probed.filter(~F.col("possible")).select(*out, F.coalesce("ruled", F.lit("allow")).alias("verdict"))
    # Only possible hits are shuffled to the list.
    hits = probed.filter("possible").join(listed.withColumn("on_list", F.lit(True)), "canon", "left")
    return rest.unionByName(hits.select(*out, F.when(F.col("on_list"), "block").otherwise("allow").alias("verdict")))


SQL = r"""
WITH parsed AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '://[^?#]*\?([^#]*)', 1) AS q,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
canon AS (
  SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '')
    || CASE WHEN query = '?' THEN '' ELSE query END AS canon
  FROM (SELECT *, regexp_replace(regexp_replace('&' || q, '&(utm_[a-z]+|ref)=[^&]*', '', 'g'), '^&', '?') AS query FROM parsed)),
listed AS (SELECT DISTINCT canon FROM canon WHERE regexp_matches(host, '(^|[.-])(ads|adult|bets|casino|pills|spam)([.-]|$)')),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT DISTINCT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS ruled
  FROM (SELECT DISTINCT host, path FROM canon) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY host, path)
SELECT page_id, host, path, rule,
  coalesce(ruled, CASE WHEN canon <> '' AND canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM canon LEFT JOIN fits USING (host, path)
"""

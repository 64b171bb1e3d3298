"""URL filter: domain rules first, then a list of canonical URLs through a
blocked Bloom filter and an exact join.

The filter has blocks of eight 64-bit words, one for KEYS listed URLs (under 0.2 %
of other URLs pass), BLOCKS at most.  A listed URL's hash names a block and sets
one bit in each word; blocks are combined with ``bit_or``, map-side first.  At
most BLOCKS rows result, whatever the list's length, so the filter is broadcast
with a proven bound.
Pages whose eight bits are all set are possible hits and go on to a hash join
with the listed URLs, which removes false positives; the others need no
shuffle.  A list beyond BLOCKS * KEYS URLs makes the filter pass more, never the
result differ.

Null URLs and URLs without ``://`` have an empty host, path and canonical form
and are never listed.  Repeated pages and URLs are each judged; an empty list
or table is fine; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import stage, with_id

#: (verdict, host, path); the longest rule wins.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Listed URLs a block (512 bits), and blocks at most: 32 MB of words for 8 million URLs.
KEYS, BLOCKS = 16, 1 << 19


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without a leading ``www.`` or ``m.`` and without a default port;
    path without closing slashes or ``.html``; query without tracking
    parameters; no fragment."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|ref)(=|$)")))
    name = F.regexp_replace(F.regexp_replace(host(url), "^(www|m)\\.", ""), ":(80|443)$", "")
    where = F.regexp_replace(path(url), r"(\.html|/+)$", "")
    return F.when(host(url) == "", F.lit("")).otherwise(F.concat(name, where, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))))


def rule_of(host_col: Column, path_col: Column, rules=None) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict; null when none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules or RULES, key=lambda r: (len(r[1] + r[2]), r[1])):
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _bits(key: str, blocks: int) -> dict[str, Column]:
    """The key's block and its bit in each of the eight words (six bits of a
    second hash choose each)."""
    word = F.xxhash64(F.lit(2), F.col(key))
    out = {"block": F.pmod(F.xxhash64(F.lit(1), F.col(key)), F.lit(blocks))}
    for i in range(8):
        out[f"b{i}"] = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(word, 6 * i).bitwiseAND(63).cast("int"))
    return out


def blocks_for(n: int) -> int:
    """Blocks for ``n`` listed keys: a power of two, BLOCKS at most."""
    return min(BLOCKS, 1 << max(0, -(-n // KEYS) - 1).bit_length())


def bloom(listed: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    """(block, w0 .. w7) of the listed keys: at most ``blocks`` rows."""
    bits = listed.select(*[c.alias(n) for n, c in _bits(key, blocks).items()])
    return bits.groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(8)])


def listed_hits(df: DataFrame, listed: DataFrame, key: str, blocks: int | None = None) -> DataFrame:
    """``df`` with ``listed`` (boolean): whether its ``key`` is among the listed
    keys.  ``listed``: a frame with a column of the same name.  ``blocks``: None
    to follow the length of the list."""
    listed = stage(listed.select(key).where(F.col(key) != "").distinct(), "url-list")
    blocks = blocks or blocks_for(listed.count())
    filt = F.broadcast(bloom(listed, key, blocks))
    tested = df.withColumns(_bits(key, blocks)).join(filt, "block", "left")
    passes = F.lit(True)
    for i in range(8):
        passes = passes & (F.col(f"w{i}").bitwiseAND(F.col(f"b{i}")) != 0)
    tested = tested.withColumn("possible", F.coalesce(passes, F.lit(False)) & (F.col(key) != "")).select(*df.columns, "possible")
    hits = tested.where("possible").drop("possible").join(listed.withColumn("listed", F.lit(True)), key, "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    return hits.select(*df.columns, "listed").unionByName(tested.where("NOT possible").drop("possible").withColumn("listed", F.lit(False)))


def filter_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", blocks: int | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed.  ``listed``
    has a column ``canonical``; listed pages without a rule are blocked."""
    with_id(with_id(pages, id_col), url_col)
    url = F.coalesce(F.col("url"), F.lit(""))
    own = (pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
           .select("page_id", host(url).alias("host"), path(url).alias("path"), canonical(url).alias("canonical")))
    name, verdict = rule_of(F.col("host"), F.col("path"))
    return listed_hits(own, listed, "canonical", blocks).select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def tracked(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The list the query uses: canonical URLs that were crawled with a tracking
    parameter (feeds and campaigns lead to them)."""
    url = F.col(f"`{url_col}`").cast("string")
    return pages.where(_rest(url).rlike(r"^[^?#]*\?([^#]*&)?utm_")).select(canonical(url).alias("canonical"))

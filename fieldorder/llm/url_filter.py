"""URL rules and a list of URLs behind a blocked Bloom filter.

A listed URL sets one bit in each of the eight words of one block, so a lookup touches a single block. The filter
is a table (block, eight words) of at most BLOCKS rows, a size that doesn't grow with the list, and is broadcast;
a longer list only lets more rows through. Those, and no others, are joined with the list itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldorder.llm.common import written

#: Blocks of 512 bits at most: 8 MB. Bits a listed URL gets before that.
BLOCKS, BITS = 2**17, 16

#: Rules of host and path with their verdicts; the longest that fits holds.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: str = "url") -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical(host: str = "host", path: str = "path") -> Column:
    """Host without a leading www., m. or blog., path without a closing slash or .html; no query, no fragment."""
    return F.concat(F.regexp_replace(host, r"^(www|m|blog)\.", ""), F.regexp_replace(path, r"(/|\.html)$", ""))


def rule_for(rules: dict[str, str], host: str = "host", path: str = "path") -> Column:
    """The longest rule whose host is the URL's or a parent of it and whose path begins the URL's."""
    found = []
    for rule in sorted(rules, key=len, reverse=True):
        h, slash, rest = rule.partition("/")
        fits = (F.col(host) == h) | F.col(host).endswith("." + h)
        found.append(F.when(fits & F.col(path).startswith(slash + rest), F.lit(rule)))
    return F.coalesce(*found, F.lit(None).cast("string"))


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bit(key: str, word: int) -> Column:
    """The bit of this word: six bits of a second hash."""
    at = F.shiftrightunsigned(F.xxhash64(F.lit("bits"), F.col(key)), 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def bloom(listed: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The filter as a table (_block, _w0 .. _w7) and the number of its blocks."""
    n, blocks = listed.count(), 1
    while blocks < BLOCKS and blocks * 512 < n * BITS:
        blocks *= 2
    words = [F.bit_or(_bit(key, i)).alias(f"_w{i}") for i in range(8)]
    return listed.groupBy(_block(key, blocks).alias("_block")).agg(*words), blocks


def in_list(urls: DataFrame, listed: DataFrame, key: str = "canonical") -> DataFrame:
    """``urls`` with listed: boolean. ``listed`` has the column ``key``; a null key is never listed."""
    listed = written(listed.select(key).where(F.col(key).isNotNull()).distinct(), "listed")
    table, blocks = bloom(listed, key)
    hit = F.lit(True)
    for i in range(8):
        hit = hit & F.coalesce(F.col(f"_w{i}").bitwiseAND(_bit(key, i)) != 0, F.lit(False))
    kept = [F.col(c) for c in urls.columns]
    tested = urls.withColumn("_b", _block(key, blocks)).join(F.broadcast(table), F.col("_b") == F.col("_block"), "left")
    tested = tested.select(*kept, (hit & F.col(key).isNotNull()).alias("_hit"))
    sure = listed.select(F.col(key).alias("_key"), F.lit(True).alias("_in"))
    maybe = tested.where("_hit").join(sure, F.col(key) == F.col("_key"), "left")
    maybe = maybe.select(*kept, F.coalesce("_in", F.lit(False)).alias("listed"))
    return maybe.unionByName(tested.where("NOT _hit").select(*kept, F.lit(False).alias("listed")))


def judge(pages: DataFrame, listed: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """page_id, host, path, canonical, rule, listed, verdict; one row per row of ``pages``.

    ``listed`` has a column url. A null url, or one without ://, has an empty host and path, fits no rule and is
    never listed (its canonical form is empty), so it is allowed. Repeated rows get a row each.
    """
    u = pages.select("page_id", host().alias("host"), path().alias("path"))
    u = u.withColumn("canonical", F.nullif(canonical(), F.lit(""))).withColumn("rule", rule_for(rules))
    forms = listed.select(host().alias("host"), path().alias("path")).select(F.nullif(canonical(), F.lit("")).alias("canonical"))
    said = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()])
    u = in_list(u, forms)
    return u.withColumn("verdict", F.coalesce(said, F.when(F.col("listed"), "block").otherwise("allow")))

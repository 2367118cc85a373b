"""URL filter: host/path rules, then a blocked Bloom filter of listed canonical
URLs whose possible hits are settled by an exact hash join.  DataFrame functions
only.

The filter is a table with one row per 512-bit block (eight 64-bit words).  A
canonical URL chooses a block by one hash and one bit in each word by another.
URLs meet their block in a join on the block number; only those whose eight bits
are all set go on to the exact join with the list.

Defined results.  Null URLs and URLs without ``://`` have empty host and path,
fit no rule and are never listed.  Repeated rows give repeated rows, an empty table an
empty result, an empty list no hits.  Other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_WORDS = 8
BITS_PER_URL = 16

#: (verdict, host, path); a rule fits the host and its subdomains
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Scheme, query and fragment dropped, a leading ``www.`` and trailing slashes too."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict (both null if none fits)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = (F.concat(F.lit("."), host).endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(F.lit("bits"), key)
    return [F.shiftrightunsigned(h, 6 * j).bitwiseAND(F.lit(63).cast("bigint")).cast("int") for j in range(BLOCK_WORDS)]


def _one(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(n_blocks).cast("bigint"))


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """The blocked filter of ``listed.canon``: ``block, w0 .. w7``."""
    bits = _bits(F.col("canon"))
    return (listed.select(_block(F.col("canon"), n_blocks).alias("block"),
                          *[_one(b).alias(f"m{j}") for j, b in enumerate(bits)])
            .groupBy("block").agg(*[F.bit_or(f"m{j}").alias(f"w{j}") for j in range(BLOCK_WORDS)]))


def filter_urls(pages: DataFrame, listed_urls: DataFrame, rules: list[tuple[str, str, str]] = RULES,
                id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` of every row of ``pages``.

    ``listed_urls`` has one column ``url``; a page whose canonical URL is listed is
    blocked unless a rule says otherwise."""
    host, path = split_url(F.col("url"))
    listed = (listed_urls.select(F.col("url").cast("string").alias("url"))
              .select(host.alias("host"), path.alias("path")).where("host <> ''")
              .select(canonical(F.col("host"), F.col("path")).alias("canon")).distinct())
    n_blocks = max(1, -(-listed.count() * BITS_PER_URL // (64 * BLOCK_WORDS)))
    blocks = bloom_blocks(listed, n_blocks)

    urls = (pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
            .select("page_id", host.alias("host"), path.alias("path"))
            .withColumn("canon", canonical(F.col("host"), F.col("path")))
            .withColumn("block", _block(F.col("canon"), n_blocks)))
    all_set = F.lit(True)
    for j, bit in enumerate(_bits(F.col("canon"))):
        all_set = all_set & (F.col(f"w{j}").bitwiseAND(_one(bit)) != 0)
    probed = (urls.join(blocks, "block", "left")
              .select("page_id", "host", "path", "canon", F.coalesce(all_set, F.lit(False)).alias("maybe")))
    hits = (probed.where("maybe").join(listed.withColumn("listed", F.lit(True)), "canon", "left")
            .select("page_id", "host", "path", F.coalesce("listed", F.lit(False)).alias("listed")))
    misses = probed.where("NOT maybe").select("page_id", "host", "path", F.lit(False).alias("listed"))
    rule, said = fitting_rule(F.col("host"), F.col("path"), rules)
    return (misses.unionByName(hits)
            .select("page_id", "host", "path", rule.alias("rule"),
                    F.coalesce(said, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                    "listed"))

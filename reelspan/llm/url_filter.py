"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter; DataFrame functions only.

The filter is a table of 64-bit blocks, each key setting a few bits of one block, built by a grouped bit_or. Every url reads
one block; those whose bits are all set go on to an exact hash join with the list, which removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut

#: Fixed values: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Keys for each 64-bit block, bits for each key, and the most blocks (16 bytes each) of a filter that is broadcast.
KEYS_PER_BLOCK, BITS, BROADCAST_BLOCKS = 5, 4, 1 << 20


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """From the host's end up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """host without a leading www. plus path without trailing slashes; null for urls without a host."""
    key = F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""))
    return F.when(host != "", key)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does; of rules equally long, a blocking one, then the first.

    Rules are written into the plan, so they are to be a short list (up to about a thousand).
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "block")):  # the later wrap the earlier
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit("bits"))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(BITS)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def bloom(keys: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, int]:
    """The filter (block, word) of a column of distinct keys, and its number of blocks, which follows the list."""
    blocks = max(1, -(-n_keys // KEYS_PER_BLOCK))
    return keys.groupBy(_block(F.col(key), blocks).alias("block")).agg(F.bit_or(_mask(F.col(key))).alias("word")), blocks


def filter_urls(df: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per row of df: id, host, path, rule, verdict, listed (only of urls that no rule decides; else null).

    listed has a column key of canonical urls; nulls and repeats in it do nothing. A null url and one without :// have empty
    host and path, fit no rule and are allowed. Repeated rows give repeated results. Other columns of df are ignored; an empty
    table or an empty list is fine. The filter is broadcast only up to BROADCAST_BLOCKS blocks and is joined by shuffle beyond.
    """
    keys = listed.select(F.col("key").cast("string").alias("key")).where("key is not null").distinct()
    keys = cut(keys)  # read twice; and the last join's sides come straight from shuffles, so that adaptive execution splits a hot url
    words, blocks = bloom(keys, "key", keys.count())
    if blocks <= BROADCAST_BLOCKS:
        words = F.broadcast(words)
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("u"))
    rows = rows.select("id", host(F.col("u")).alias("host"), path(F.col("u")).alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("verdict"))
    decided = rows.where("verdict is not null or host = ''").select("*", F.lit(None).cast("boolean").alias("listed"))
    rest = rows.where("verdict is null and host <> ''").withColumn("key", canonical(F.col("host"), F.col("path")))
    rest = rest.withColumn("block", _block(F.col("key"), blocks)).join(words, "block", "left")
    rest = rest.withColumn("hit", F.coalesce(F.col("word").bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key")), F.lit(False)))
    passed = rest.where("not hit").select(*rows.columns, F.lit(False).alias("listed"))
    hits = rest.where("hit").join(keys.withColumn("listed", F.lit(True)), "key", "left").select(*rows.columns, F.coalesce("listed", F.lit(False)).alias("listed"))
    out = decided.unionByName(passed).unionByName(hits)
    out = out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("listed"), "block").otherwise("allow")))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "listed")

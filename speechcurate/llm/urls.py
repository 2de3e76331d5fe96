"""URL filters: host and path rules, and a list of URLs behind a blocked Bloom filter. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechcurate.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 4  # 64-bit words of a block
KEYS_PER_BLOCK = 16
MAX_BLOCKS = 1 << 18  # 40 bytes a block: the broadcast filter never takes more than about 10 MB


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls.

    A rule is (allow or block, host with path); it fits its host and all subdomains where the path
    starts with the rule's. The rules are a parameter, not a table. Equal lengths: the first by code point.
    """
    name = verdict = F.lit(None).cast("string")
    for decision, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        at = rule.index("/") if "/" in rule else len(rule)
        domain, start = rule[:at].translate(str.maketrans(UPPER, LOWER)), rule[at:]
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(start))
        name = F.when(fits, F.lit(rule)).otherwise(name)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


def canonical(url: Column) -> Column:
    """Host and path without scheme, leading ``www.``, default port, ``index.html`` and closing slashes, then the
    query's parameters in order without those of trackers. The fragment goes. Empty for null or without ``://``."""
    host = F.regexp_replace(host_of(url), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"(/index\.html?)?/*$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]*|ref)(=|$)")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.coalesce(host_of(url), F.lit("")) == "", "").otherwise(F.concat(host, path, tail))


def _masks(key: Column) -> list[Column]:
    """One bit in each 64-bit word of the key's block."""
    second = F.xxhash64(key, F.lit(1))
    bits = [F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), b) for b in bits]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def blocked_bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row per block that has a key: ``block`` and ``w0`` .. ``w3``. Each key sets one bit in each word of its block."""
    bits = listed.select(_block(F.col(key), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def possible_keys(rows: DataFrame, key: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """``rows`` whose ``key`` the filter of ``blocks`` blocks may hold. Null is a key like others."""
    probe = rows.withColumn("__block", _block(F.col(key), blocks)).join(F.broadcast(bloom), F.col("__block") == F.col("block"))
    for i, m in enumerate(_masks(F.col(key))):
        probe = probe.filter(F.col(f"w{i}").bitwiseAND(m) == m)
    return probe.select(*rows.columns)


def mark_listed(pages: DataFrame, listed: DataFrame, url: str = "url", listed_url: str = "url", out: str = "listed",
                max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``pages`` with the boolean ``out``: does its canonical URL equal one of ``listed``? Empty URLs are not listed.

    The filter has about 16 listed URLs to each block of 256 bits, up to ``max_blocks`` blocks, which
    bounds what is broadcast; a fuller filter only lets more rows through to the exact join. Only rows
    that pass it are shuffled. Both sides of that join are plain tables, so adaptive execution can
    split a URL that many pages share. Repeated pages stay, repeated list entries count once.
    """
    urls = listed.select(canonical(F.col(f"`{listed_url}`").cast("string")).alias("__key")).filter("__key <> ''").distinct()
    urls = materialise(urls, "listed")
    blocks = min(max(-(-urls.count() // KEYS_PER_BLOCK), 1), max_blocks)
    names = [F.col(f"`{c}`") for c in pages.columns if c != out]
    keyed = pages.select(*names, canonical(F.col(f"`{url}`").cast("string")).alias("__key"))
    keyed = keyed.withColumn("__block", _block(F.col("__key"), blocks))
    probe = keyed.join(F.broadcast(blocked_bloom(urls, "__key", blocks)), F.col("__block") == F.col("block"), "left")
    possible = F.lit(True)
    for i, m in enumerate(_masks(F.col("__key"))):
        possible = possible & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(m) == m)
    probe = probe.select(*names, F.when(possible, F.col("__key")).alias("__maybe"))
    refused = probe.filter("__maybe IS NULL").select(*names, F.lit(False).alias(out))
    hits = probe.filter("__maybe IS NOT NULL").join(urls.withColumn("__found", F.lit(True)), F.col("__maybe") == F.col("__key"), "left")
    return refused.unionByName(hits.select(*names, F.coalesce("__found", F.lit(False)).alias(out)))


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``: the rule's, else block where the URL is listed, else allow."""
    text = F.col(f"`{url}`").cast("string")
    marked = mark_listed(pages, listed, url, out="__listed")
    base = marked.withColumns({"__host": host_of(text), "__path": path_of(text)})
    rule, verdict = match_rule(F.col("__host"), F.col("__path"), rules)
    rest = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    default = F.when(F.col("__listed"), "block").otherwise("allow")
    return base.select(*rest, F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"),
                       F.coalesce(verdict, default).alias("verdict"))

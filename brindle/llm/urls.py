"""URL filters: host and path rules, then a blocked Bloom filter before an exact join with listed URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Blocks of 512 bits that the filter has at most: about 6 MB broadcast, however long the list is. Beyond about two
#: million listed URLs more URLs pass to the exact join, whose result stays the same.
MAX_BLOCKS = 1 << 16
#: Bits per listed URL below that bound, and bits set per URL.
BITS, PROBES = 16, 6


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; without ://, or null: empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; without ://, or null: empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """A page's canonical URL: host without www. and m., path without /index.html, a final .html or slash."""
    short = F.regexp_replace(host, r"^(www|m)\.", "")
    return F.concat(short, F.regexp_replace(F.regexp_replace(path, r"/index\.html?$", ""), r"(\.html?|/+)$", ""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of the (verdict, host, path) rules that fits; null where none does.

    A rule fits its host and all subdomains, if the path starts with the rule's. Of equally long ones the first in
    alphabetical order wins. The rules are a short constant list and become one CASE.
    """
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _words(url: Column) -> list[Column]:
    """The eight 64-bit words of a block with the URL's bits set: PROBES slices of nine bits of an independent hash."""
    h = F.xxhash64(F.lit("bits"), url)
    at = [F.shiftrightunsigned(h, 9 * k).bitwiseAND(F.lit(511)) for k in range(PROBES)]
    out = []
    for w in range(8):
        bits = F.lit(0).cast("long")
        for a in at:
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), a.bitwiseAND(F.lit(63)).cast("int"))
            bits = bits.bitwiseOR(F.when(F.shiftright(a, 6) == w, bit).otherwise(F.lit(0).cast("long")))
        out.append(bits)
    return out


def bloom(listed: DataFrame, count: int) -> tuple[DataFrame, int]:
    """listed (url) -> block, w0..w7: the filter's blocks that have bits, and the number of blocks."""
    blocks = max(1, min(MAX_BLOCKS, count * BITS // 512))
    words = [w.alias(f"w{k}") for k, w in enumerate(_words(F.col("url")))]
    rows = listed.select(_block(F.col("url"), blocks).alias("block"), *words)
    return rows.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(8)]), blocks


def passing(rows: DataFrame, key: Column, filt: DataFrame, blocks: int, how: str) -> tuple[DataFrame, Column]:
    """rows joined with the broadcast filter's blocks, and whether the filter lets the key pass (null where no block
    holds it). `key` may be of any type that the filter was made of."""
    hit = F.col("block").isNotNull()
    for k, w in enumerate(_words(key)):
        hit = hit & (w.bitwiseAND(F.col(f"w{k}")) == w)
    return rows.withColumn("slot", _block(key, blocks)).join(F.broadcast(filt), F.col("slot") == F.col("block"), how), hit


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """pages (page_id, url) -> page_id, host, path, canonical, rule, verdict: the fitting rule's, else block for a listed
    canonical URL and allow for any other.

    The filter's blocks are broadcast (bounded by MAX_BLOCKS); only URLs without a rule that pass it are shuffled,
    to an exact hash join. A null URL or one without :// has empty host and path, fits no rule and is allowed; repeated
    rows stay; nulls and repeats in the list (url) go; other columns are ignored; an empty table gives none.
    """
    url = F.col(f"`{url_col}`").cast("string")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", canonical(F.col("host"), F.col("path")).alias("canonical"), rule.alias("rule"), verdict.alias("verdict"))
    exact = durable(listed.select(F.col("url").cast("string").alias("url")).where("url is not null and url <> ''").distinct(), "listed")
    filt, blocks = bloom(exact, exact.count())
    key = F.when(F.col("verdict").isNull() & (F.col("canonical") != ""), F.col("canonical"))
    probed, hit = passing(rows, key, filt, blocks, "left")
    probed = probed.withColumn("possible", F.coalesce(key.isNotNull() & hit, F.lit(False)))
    cols = ["page_id", "host", "path", "canonical", "rule"]
    sure = probed.where("not possible").select(*cols, F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    known = exact.withColumn("known", F.lit(True))
    found = probed.where("possible").select(*cols).join(known, F.col("canonical") == F.col("url"), "left")
    return sure.union(found.select(*cols, F.when(F.col("known"), "block").otherwise("allow").alias("verdict")))

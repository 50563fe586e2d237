"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, mpeg, packing, quality, secrets, simhash, substring, toxicity, training_order, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size, rows = packing.volume(docs)
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    cut = cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(cut, size, rows)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    counts = [secrets.count_of(F.col("spans"), k).alias(f"n_{k}") for k in secrets.KINDS[:3]]
    base = F.sha2(secrets.span_list(F.col("spans"), 3).cast("binary"), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), secrets.span_list(F.col("spans"), len(secrets.KINDS)).alias("spans"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality.COUNTS[:5], "base_failed", "kept", "quality")


def op4_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mpeg.info(mpeg.store(table(spark, sf_dir, "documents")))
    return m.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, octet_length(payload) - 63, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_apart(*toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    rows = toxicity.score(docs, model)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), key=20240229)[0]


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.substring_dedup(table(spark, sf_dir, "documents"), joiner=" ")
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


# doc_ids are taken to differ
OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), p AS (
  SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS passage FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)
), f AS (
  SELECT passage, min(doc_id) AS first FROM p GROUP BY passage
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM p JOIN f USING (passage) WHERE first < doc_id
), k AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.k) AS kept, count(*) AS n_kept
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM w) e LEFT JOIN c ON c.doc_id = e.doc_id AND c.k = e.k
  WHERE c.k IS NULL GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# The rules of the query.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
# The list of the query, which no table has a part in: the numbered pages of four sites under three
# domains in four languages, every third number below 30,000, as canonical URLs.
LISTED_SITES, LISTED_DOMAINS, LISTED_LANGS = ("spam-farm", "cheap-pills", "free-bets", "lucky-casino"), ("com", "net", "org"), ("de", "en", "es", "fr")
LISTED_NUMBERS, LISTED_STEP = 30_000, 3


def listed_urls(spark: SparkSession) -> DataFrame:
    """The query's list of canonical URLs (url)."""
    hosts = [f"{s}.example.{d}/{g}/" for s in LISTED_SITES for d in LISTED_DOMAINS for g in LISTED_LANGS]
    numbers = spark.range(0, LISTED_NUMBERS, LISTED_STEP)
    return numbers.select(F.explode(F.array(*[F.lit(h) for h in hosts])).alias("site"), "id").select(F.concat("site", F.col("id").cast("string")).alias("url"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages"), listed_urls(spark), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), c AS (
  SELECT *,
         regexp_replace(host, '^(www|m)\.', '') || regexp_replace(regexp_replace(path, '/index\.html?$', ''), '(\.html?|/+)$', '') AS canonical,
         CASE
           WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/7%' THEN 'example.com/en/7'
           WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/de/8%' THEN 'example.net/de/8'
           WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/en/%' THEN 'com/en/'
           WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/de/%' THEN 'net/de/'
           WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/es/%' THEN 'org/es/'
         END AS rule
  FROM p
), l AS (
  SELECT s || '.example.' || d || '/' || g || '/' || n AS url
  FROM (VALUES ('spam-farm'), ('cheap-pills'), ('free-bets'), ('lucky-casino')) AS sites(s),
       (VALUES ('com'), ('net'), ('org')) AS domains(d),
       (VALUES ('de'), ('en'), ('es'), ('fr')) AS langs(g),
       range(0, 30000, 3) AS numbers(n)
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN canonical IN (SELECT url FROM l) THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), decoded=True)
    text = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return rows.select("doc_id", "n_tokens", F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_secrets": op2_secrets,
    "op3_quality": op3_quality,
    "op4_mpeg": op4_mpeg,
    "op5_toxicity": op5_toxicity,
    "op6_training_order": op6_training_order,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_simhash": op8_simhash,
    "op9_url_filter": op9_url_filter,
    "op10_bpe": op10_bpe,
}

ORACLE_SQL: dict[str, str] = {"op7_substring_dedup": OP7_SQL, "op9_url_filter": OP9_SQL}

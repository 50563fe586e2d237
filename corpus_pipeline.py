"""The training-corpus pipeline: toxicity, near duplicates, repeated passages, secrets, then packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Between stages the result is written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import jaccard, packing, secrets, substring, toxicity
from brindle.llm.common import durable

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with(docs: DataFrame, text) -> DataFrame:
    """The columns of documents with another text."""
    return docs.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go. A row is scored beside its other columns: no join."""
    model = toxicity.fit_apart(*toxicity.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.score(docs, model, keep=COLUMNS).where("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that five-word shingles of Jaccard similarity 0.8 or more link, one row stays: that of the smallest
    doc_id, a null one last, then of the least hash of the text. Of equal rows (doc_id and text) of a group one stays."""
    return jaccard.deduplicated(docs.select(*COLUMNS))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document holds go; a document of which no word is left goes."""
    kept = substring.substring_dedup(docs, keep=("lang", "source", "n_chars"))
    left = kept.where("n_removed < n_words or n_words = 0")
    changed = _with(left, F.col("text"))
    return changed.select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret, and every weak one beside its complement, becomes a mark."""
    found = secrets.scan(docs, keep=COLUMNS)
    return _with(found, secrets.redacted(F.col("text"), F.col("spans"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids and their places in sequences of 2048 tokens."""
    size, rows = packing.volume(docs)
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    cut = cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(cut, size, rows)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("secrets", redact_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None

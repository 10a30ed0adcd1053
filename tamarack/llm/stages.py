"""The pipeline's stages: each applies one operator to all rows of docs and lets its decisions take effect.

All take and return the columns of documents (doc_id, text and whatever else there is, under any name), except the last.
Nulls may stand in any column: a null text has no words, no PII and no ids, a null doc_id takes part. Rows are told apart
by 128 bits of all their columns. Empty tables give empty tables; without labels or benchmark items nothing goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import find_contamination
from .ngram_join import near_duplicates
from .pii import pseudonymise
from .quality_classifier import resample
from .queries import PII_KEY, TOKENIZERS, good_labels, table
from .sentencepiece_codec import encode
from .shared import written
from .sizing import free_names, row_digest

#: Keys (16 bytes each) that are broadcast at most; more of them take a shuffled join.
BROADCAST_KEYS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier draws; the others go."""
    return resample(docs, good_labels(table(spark, sf_dir, "labels"))).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that of the least doc_id (nulls last), then of the least digest. Rows
    without words are a class each; of rows repeated whole one stays."""
    found = near_duplicates(docs, size=5, similarity=0.8)
    (key,) = free_names(docs, "key")
    stay = found.where("row_key = class_key").select(F.col("row_key").alias(key)).distinct()
    keyed = docs.withColumn(key, row_digest(docs))
    return keyed.join(stay, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any window of a benchmark item; the others go. Null and empty texts stay."""
    (key,) = free_names(docs, "key")
    keyed = docs.withColumn(key, row_digest(docs))
    found = find_contamination(keyed.select(key, "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    hit = written(found.where("contaminated").select(key).distinct(), "contaminated")
    few = hit.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return keyed.join(F.broadcast(hit) if few else hit, key, "left_anti").select(*docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with PII in their texts replaced; n_chars follows the text."""
    out = pseudonymise(docs, PII_KEY)
    return out.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each row doc_id, n_tokens and ids."""
    out = encode(docs.select("doc_id", "text"), f"{TOKENIZERS}/piece_bpe_32k.model", keep_text=False)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")

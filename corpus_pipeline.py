"""The training-corpus pipeline: STAGES in order, each over all that its predecessor kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the folder that driver
and executors share and reads it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamarack.llm import stages
from tamarack.llm.shared import written
from tamarack.shipping import ship

STAGES = [
    ("quality_classifier", stages.quality),
    ("ngram_jaccard_join", stages.deduplicate),
    ("benchmark_decontamination", stages.decontaminate),
    ("pii", stages.pseudonyms),
    ("sentencepiece", stages.tokens),
]

#: SQL can't express the classifier's draw or the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

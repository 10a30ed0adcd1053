"""Test tables and the views that stand in for the engine's own (chunks, sessions, messages, audit, edges)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conform(df: DataFrame, schema: T.StructType, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """df with exactly the schema's columns: the first of a column's names that df has (its own, then aliases in
    order, coalesced), cast; NULL where it has none."""
    have, out = set(df.columns), []
    for field in schema:
        names = [n for n in [field.name, *(aliases or {}).get(field.name, [])] if n in have]
        value = F.coalesce(*[F.col(n).cast(field.dataType) for n in names]) if names else F.lit(None).cast(field.dataType)
        out.append(value.alias(field.name))
    return df.select(*out)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as document chunks: approved if labelled good, tenant null for every third source."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    number = F.substring("source", 4, 9).cast("int")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("chunk_id"),
        F.col("text").alias("content"),
        F.col("lang").alias("jurisdiction"),
        F.col("source").alias("source_table"),
        F.when(F.col("quality") == 1, "approved").otherwise("pending_review").alias("review_status"),
        F.when(F.coalesce("toxic", F.lit(0)) == 1, "superseded").otherwise("active").alias("status"),
        F.when(number % 3 != 0, number % 3).alias("tenant_id"),
    )


CHUNKS_SQL = """
chunks AS (
  SELECT d.doc_id AS chunk_id, d.text AS content, d.lang AS jurisdiction, d.source AS source_table,
         CASE WHEN l.quality = 1 THEN 'approved' ELSE 'pending_review' END AS review_status,
         CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'superseded' ELSE 'active' END AS status,
         CASE WHEN CAST(substr(d.source, 4) AS INT) % 3 <> 0 THEN CAST(substr(d.source, 4) AS INT) % 3 END AS tenant_id
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation edges: each part cites the numbers of its suppliers."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("cited_id")).distinct()


EDGES_SQL = """
edges AS (SELECT DISTINCT l_partkey AS source_id, l_suppkey AS cited_id FROM lineitem)"""

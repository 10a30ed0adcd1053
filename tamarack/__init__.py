"""Tamarack: retrieval, text ingestion and operational analytics as Spark DataFrame jobs."""

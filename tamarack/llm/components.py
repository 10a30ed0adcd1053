"""Connected components: links are contracted within partitions, then by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import new_path

#: Links that a task contracts at once: bounds its memory.
_AT_ONCE = 1 << 18


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links (u, v) of a partition as stars around the least node of each component that they make up."""
    parent: dict = {}
    kind = None

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def stars() -> pa.RecordBatch:
        out = [(x, r) for x in parent if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], kind) for k in (0, 1)], names=["u", "v"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) >= _AT_ONCE:
            yield stars()
            parent = {}
    if parent:
        yield stars()


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (u, v) with u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.where("u > v").distinct()
    lower = large.groupBy("u").agg(F.min("v").alias("m"))
    linked = large.join(lower, "u")
    small = linked.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
    return small.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the undirected edges (u, v): label is the least node it is joined to.

    Links are first contracted where they lie, so long chains are gone before the rounds begin. Each round aggregates by
    node (combined before the shuffle) and joins its edges with one row a node, so hubs are split like any skewed join.
    A round is one job, which writes its edges to the shared folder and counts them and their hashes on the way; rounds
    end when these no longer change.
    """
    edges = edges.where("u <> v and u is not null and v is not null").select("u", "v")
    edges = edges.mapInArrow(_contracted, edges.schema).distinct()
    spark, seen = edges.sparkSession, None
    while True:
        seen_now, path = Observation(), new_path(spark, "edges")
        mark = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")
        edges.observe(seen_now, F.count(F.lit(1)).alias("n"), mark).write.parquet(path)
        edges, found = spark.read.schema(edges.schema).parquet(path), seen_now.get
        if found == seen or found["n"] == 0:
            break
        seen = found
        edges = _stars(edges)
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)

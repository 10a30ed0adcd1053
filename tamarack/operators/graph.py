"""Citation graph: precedent chains and expansion from seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import new_path

#: Edges of a node that a task joins with the paths that end in it: nodes with more are split.
HUB = 4096


def precedent_chain(edges: DataFrame, start_ids: list[int], max_depth: int = 3, test_source: bool = False) -> DataFrame:
    """Paths of citations (source_id -> cited_id) from the start nodes: start_id, source_id, cited_id, depth, path.

    A row for each path (UNION ALL). path holds the sources of the hops; an edge is taken while depth < max_depth and
    its target isn't on the path. With test_source (the older variant) its source must not be on it, and the path
    starts as the first source. A fixed number of joins: max_depth is a small constant.
    """
    level = edges.where(F.col("source_id").isin(start_ids) & F.col("cited_id").isNotNull())
    level = level.select(F.col("source_id").alias("start_id"), "source_id", "cited_id", F.lit(1).alias("depth"), F.array("source_id").alias("path"))
    out, hop = level, edges.select(F.col("source_id").alias("_s"), F.col("cited_id").alias("_c")).where("_c is not null")
    for depth in range(2, max_depth + 1):
        seen = F.array_contains("path", F.col("_s") if test_source else F.col("_c"))
        level = level.join(hop, F.col("cited_id") == F.col("_s")).where(~seen)
        level = level.select("start_id", F.col("_s").alias("source_id"), F.col("_c").alias("cited_id"), F.lit(depth).alias("depth"), F.array_append("path", F.col("_s")).alias("path"))
        out = out.unionByName(level)
    return out


def expand_seeds(edges: DataFrame, cases: DataFrame, seeds: list[int], depth: int = 2, most: int = 5) -> DataFrame:
    """Cases cited from the first `most` seeds within `depth`, tagged precedent, with their least depth."""
    chain = precedent_chain(edges, seeds[:most], depth)
    near = chain.groupBy("cited_id").agg(F.min("depth").alias("depth"), F.count("*").alias("paths"))
    return near.join(cases, F.col("cited_id") == F.col("case_id")).drop("case_id").withColumn("type", F.lit("precedent"))


def _stored(df: DataFrame, what: str) -> DataFrame:
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def precedent_chains(edges: DataFrame, seeds: DataFrame, max_depth: int = 3, test_source: bool = False, hub: int = HUB) -> DataFrame:
    """precedent_chain for a table of start nodes (start_id; nulls and repeats count once or not at all), of any depth.

    Levels are a loop over a frontier: each is written to the shared folder before it is joined again, so a deep chain has
    no long lineage, and the loop ends with the first empty one. Edges of a node with more than `hub` of them are dealt over
    several parts, and paths that end there meet each part on its own; so neither a hub's edges nor the paths into it are
    one task's. The number of paths is bounded by the depth only, as UNION ALL asks.
    """
    known = edges.where("source_id is not null and cited_id is not null")
    degree = known.groupBy("source_id").agg(F.ceil(F.count("*") / hub).cast("int").alias("_parts"))
    dealt = known.join(degree, "source_id").select(F.col("source_id").alias("_s"), F.col("cited_id").alias("_c"), "_parts", F.pmod(F.xxhash64("cited_id"), F.col("_parts")).cast("int").alias("_part"))
    hops = _stored(dealt, "hops")
    hubs = hops.where("_parts > 1").groupBy("_s").agg(F.max("_parts").alias("_parts"))
    starts = seeds.select(F.col("start_id").alias("_s")).where("_s is not null").distinct()
    first = hops.join(starts, "_s", "left_semi")
    level = _stored(first.select(F.col("_s").alias("start_id"), F.col("_s").alias("source_id"), F.col("_c").alias("cited_id"), F.lit(1).alias("depth"), F.array("_s").alias("path")), "level")
    levels = [level]
    for depth in range(2, max_depth + 1):
        if level.isEmpty():
            break
        met = level.join(hubs.withColumnRenamed("_s", "_h"), F.col("cited_id") == F.col("_h"), "left")
        ends = met.withColumn("_q", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_h", "_parts")
        seen = F.array_contains("path", F.col("_s") if test_source else F.col("_c"))
        out = ends.join(hops.drop("_parts"), (F.col("cited_id") == F.col("_s")) & (F.col("_q") == F.col("_part"))).where(~seen)
        level = _stored(out.select("start_id", F.col("_s").alias("source_id"), F.col("_c").alias("cited_id"), F.lit(depth).alias("depth"), F.array_append("path", F.col("_s")).alias("path")), "level")
        levels.append(level)
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    return every

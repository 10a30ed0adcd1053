"""Windows and top-k: best row a key, last n, trailing counts, version status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def ranked_top(df: DataFrame, keys: list[Column], limit: int, rank: str) -> DataFrame:
    """The first rows in the order of keys with their rank. The limit comes before the rank, so a corpus is never
    windowed whole: TakeOrderedAndProject keeps `limit` rows a task, and only they are numbered."""
    top = df.orderBy(*keys).limit(limit)
    return top.withColumn(rank, F.row_number().over(W.orderBy(*keys)).cast("long"))


def best_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def merged_per_key(df: DataFrame, key: str, score: str, ord: str, fields: list[str]) -> DataFrame:
    """One row a key: its first position, its best score, and for each field the value of the best-scored row that
    has one."""
    best = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.struct(F.col(score), -F.col(ord)))).alias(f) for f in fields]
    return df.groupBy(key).agg(F.min(ord).alias(ord), F.max(score).alias(score), *best)


def last_n(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of each key."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_rn") <= n).drop("_rn")


def trailing_count(df: DataFrame, key: str, seconds: Column, width: int) -> DataFrame:
    """df with recent: rows of the key in the last `width` seconds, the row's own included, the far edge excluded."""
    frame = W.partitionBy(key).orderBy("_s").rangeBetween(-(width * 1_000_000 - 1), 0)
    return df.withColumn("_s", (seconds * 1_000_000).cast("long")).withColumn("recent", F.count("*").over(frame)).drop("_s")


def version_status(df: DataFrame, key: str, version: str, active: str) -> DataFrame:
    """df with status: active, previous (older than the key's active version) or draft."""
    current = F.max(F.when(F.col(active), F.col(version))).over(W.partitionBy(key))
    return df.withColumn("status", F.when(F.col(active), "active").when(F.col(version) < current, "previous").otherwise("draft"))

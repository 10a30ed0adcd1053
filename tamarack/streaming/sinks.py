"""Sinks that a repeated batch can't change twice, and a log that only grows.

Structured Streaming runs a batch again after a failure, with the same number and the same rows. Each sink here keeps, for a
query's name, what a batch wrote in a folder of that batch, and takes a batch whose folder is complete (Spark's _SUCCESS file)
as done. So replays are no-ops, whatever the driver did or lost in between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.stored import Stored, file_system


def complete(spark: SparkSession, folder: str) -> bool:
    """Whether a write to the folder was committed."""
    fs, p = file_system(spark, f"{folder}/_SUCCESS")
    return fs.exists(p)


class AppendOnlyError(Exception):
    """An attempt to change what a log holds."""


class AppendLog:
    """A log of batches as Parquet. A batch is written once; the same number again is a no-op, and nothing can be updated,
    deleted or overwritten through it."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str) -> None:
        self.spark, self.path = spark, path
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def put(self, rows: DataFrame, batch: int, query: str = "main") -> bool:
        """Writes the batch unless it is there; whether it wrote. A folder that a failed attempt left is written again."""
        folder = f"{self.path}/query={query}/batch={batch}"
        if complete(self.spark, folder):
            return False
        rows.select(*self.schema.names).write.mode("overwrite").parquet(folder)
        return True

    def sink(self, query: str = "main") -> Callable[[DataFrame, int], None]:
        """For foreachBatch."""
        return lambda rows, batch: self.put(rows, batch, query) and None

    def read(self) -> DataFrame:
        """All rows of complete batches, with query and batch."""
        whole = T.StructType([*self.schema.fields, T.StructField("query", T.StringType()), T.StructField("batch", T.LongType())])
        fs, root = file_system(self.spark, self.path)
        if not fs.exists(root):
            return self.spark.createDataFrame([], whole)
        done = [str(f.getPath()) for q in fs.listStatus(root) for f in fs.listStatus(q.getPath()) if complete(self.spark, str(f.getPath()))]
        if not done:
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).option("basePath", self.path).parquet(*done)

    def change(self, *_args, **_named) -> None:
        raise AppendOnlyError("rows of an append-only log can't be updated or deleted")

    update = delete = overwrite = change


def counters(keyed: str, sums: dict[str, F.Column]) -> Callable[[DataFrame], DataFrame]:
    """For keyed_totals: what a batch adds to each key."""
    return lambda batch: batch.groupBy(keyed).agg(*[F.sum(v).cast("long").alias(n) for n, v in sums.items()])


def keyed_totals(log: AppendLog, increments: Callable[[DataFrame], DataFrame], query: str = "main") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch adds its increments (a row a key) to the log. Totals are their sum (totals()), so no batch
    rewrites keys that it doesn't hold, and a replay adds nothing."""

    def put(batch: DataFrame, i: int) -> None:
        log.put(increments(batch), i, query)

    return put


def totals(log: AppendLog, keyed: str) -> DataFrame:
    """The sum of a log's increments by key."""
    names = [f.name for f in log.schema if f.name != keyed]
    return log.read().groupBy(keyed).agg(*[F.sum(n).alias(n) for n in names])


def latest(log: AppendLog, *keyed: str) -> DataFrame:
    """The row of each key's last batch, for a log of one query in update mode: a key's row there stands for all before it."""
    others = [n for n in log.schema.names if n not in keyed]
    rows = log.read().groupBy(*keyed).agg(F.max_by(F.struct(*others), "batch").alias("_last"))
    return rows.select(*[F.col(n) if n in keyed else F.col("_last")[n].alias(n) for n in log.schema.names])


def compacted(log: AppendLog, keyed: str, path: str) -> AppendLog:
    """A log of one batch with the totals so far: what a job does now and then so that reads stay short. The new log has its
    own path; whoever publishes it (views.py) drops the old one."""
    out = AppendLog(log.spark, path, log.schema)
    out.put(totals(log, keyed).select(*log.schema.names), 0, "compacted")
    return out


def merged(table: Stored, version: str, done: AppendLog) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: upserts the batch's rows into a stored table, the highest version of a key first, and notes the
    batch. Upserts of one batch are idempotent, so a batch that failed between the two is done again without harm; one
    that is noted isn't done again, so that it can't undo a later one."""

    def put(batch: DataFrame, i: int) -> None:
        spark = batch.sparkSession
        if not complete(spark, f"{done.path}/query=merge/batch={i}"):
            table.upsert(batch, version)
            done.put(spark.createDataFrame([(i,)], done.schema), i, "merge")

    return put


def run_available(stream: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All available input through foreachBatch, then stops."""
    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return query

"""Stored tables that change: inserts, updates, deletes and upserts that rewrite only the partitions that they touch.

A table is a folder of Parquet files partitioned by a hash bucket of its key. A change finds the buckets of its keys, reads
only those, writes their new contents aside in the shared folder and puts them in place with dynamic partition overwrite;
the files of all other buckets stay as they are. Changes are idempotent: what is written aside is made before anything is
replaced, and doing a change again (after a failure half-way) gives the same table. Appends add files and rewrite none.

One writer at a time; readers of a bucket that is being replaced may have to read again. Views that must never be seen
half-written are in views.py.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..shared import new_path

BUCKETS = 64


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path, for metadata operations on any store that Spark writes to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


@dataclass(frozen=True)
class Stored:
    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: T.StructType
    buckets: int = BUCKETS

    @staticmethod
    def create(df: DataFrame, keys: list[str], path: str | None = None, buckets: int = BUCKETS) -> Stored:
        """A table of df's rows. Rows of equal keys may repeat; a null key is a key."""
        if "bucket" in (c.lower() for c in df.columns):
            raise ValueError("bucket is the name of the table's own partition column")
        table = Stored(df.sparkSession, path or new_path(df.sparkSession, "table"), tuple(keys), df.schema, buckets)
        table._written(df, "errorifexists")
        return table

    def _bucketed(self, df: DataFrame) -> DataFrame:
        named = [F.col(c).cast(self.schema[c].dataType) for c in self.keys]
        return df.withColumn("bucket", F.pmod(F.xxhash64(*named), F.lit(self.buckets)).cast("int"))

    def _written(self, df: DataFrame, mode: str) -> None:
        rows = self._bucketed(df.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema])).hint("rebalance", "bucket")
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop("bucket")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys: only their buckets are read."""
        own, _ = self._touched(keys)
        return _by_key(own, keys, self.keys, "left_semi")

    def _touched(self, changes: DataFrame) -> tuple[DataFrame, list[int]]:
        """The rows of the buckets that the keys of changes lie in, and these buckets (self.buckets at most)."""
        hit = sorted(r.bucket for r in self._bucketed(changes.select(*self.keys)).select("bucket").distinct().collect())
        return self._stored().where(F.col("bucket").isin(hit)).drop("bucket"), hit

    def _replace(self, new: DataFrame, hit: list[int]) -> None:
        aside = new_path(self.spark, "aside")
        new.select(*self.schema.names).write.parquet(aside)
        ready = self.spark.read.schema(self.schema).parquet(aside)
        self._written(ready, "overwrite")
        left = {r.bucket for r in self._bucketed(ready).select("bucket").distinct().collect()}
        for b in set(hit) - left:  # dynamic overwrite leaves a partition alone that gets no rows
            fs, p = file_system(self.spark, f"{self.path}/bucket={b}")
            fs.delete(p, True)
        fs, p = file_system(self.spark, aside)
        fs.delete(p, True)

    def append(self, rows: DataFrame, batch_rows: int | None = None) -> None:
        """Adds rows; batch_rows: at most so many in a file."""
        out = self._bucketed(rows.select(*self.schema.names)).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket")
        (out.option("maxRecordsPerFile", batch_rows) if batch_rows else out).parquet(self.path)

    def insert_missing(self, rows: DataFrame) -> None:
        """Appends the rows whose key the table lacks (ON CONFLICT DO NOTHING); of rows of one key the first by all columns."""
        own, _ = self._touched(rows)
        first = W.partitionBy(*self.keys).orderBy(*[F.col(c) for c in self.schema.names])
        one = rows.select(*self.schema.names).withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
        self.append(_by_key(one, own, self.keys, "left_anti"))

    def upsert(self, rows: DataFrame, version: str | None = None) -> None:
        """Rows take the place of those of their key; of several of one key the one of the highest version (then by all
        columns). A null version is the lowest."""
        own, hit = self._touched(rows)
        order = [F.desc_nulls_last(version)] if version else []
        last = W.partitionBy(*self.keys).orderBy(*order, *[F.desc(c) for c in self.schema.names])
        one = rows.select(*self.schema.names).withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")
        self._replace(_by_key(own, one, self.keys, "left_anti").unionByName(one), hit)

    def delete(self, keys: DataFrame) -> None:
        """Removes the rows of the keys."""
        own, hit = self._touched(keys)
        self._replace(_by_key(own, keys, self.keys, "left_anti"), hit)

    def update(self, keys: DataFrame, changes: dict[str, Column]) -> None:
        """Sets columns of the rows of the keys; changes are expressions over the row."""
        if set(changes) & set(self.keys):
            raise ValueError("keys can't be updated: delete and insert")
        own, hit = self._touched(keys)
        marked = _by_key(own, keys, self.keys, "left")
        told = marked.withColumns({c: F.when(F.col("_hit"), v.cast(self.schema[c].dataType)).otherwise(F.col(c)) for c, v in changes.items()})
        self._replace(told, hit)

    def files(self) -> set[str]:
        """Names of the table's files."""
        return {r.f for r in self._stored().select(F.input_file_name().alias("f")).distinct().collect()}


def _by_key(rows: DataFrame, keys: DataFrame, by: tuple[str, ...], how: str) -> DataFrame:
    """rows joined with the distinct keys (null equals null); a left join says which have one in _hit."""
    other = keys.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)]).distinct().withColumn("_hit", F.lit(True))
    out = rows.join(other, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)], how)
    return out.drop(*[f"_{i}" for i in range(len(by))]) if how == "left" else out

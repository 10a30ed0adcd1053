"""A cache with namespaces as a keyed log: every set, delete and clear is appended; reads take the latest word on a key.

The log is partitioned by namespace and by a hash bucket of the key, so a point read opens one bucket of one namespace. An
entry outlives the seconds that its namespace allows by not being read any more; compact() drops what is overwritten, deleted,
cleared or expired. Times are parameters (as_of), never the clock's, so that answers can be repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..shared import new_path
from .stored import file_system

#: A set has a key and a value, a delete a key and no value, a clear neither.
LOG = "key string, value string, at timestamp, batch long, op string, namespace string, bucket int"
COLUMNS = [c.split()[0] for c in LOG.split(", ")]
BUCKETS = 32


@dataclass(frozen=True)
class Cache:
    """ttl: seconds that entries of a namespace live; of one that it doesn't name, `otherwise`."""

    spark: SparkSession
    path: str
    ttl: dict[str, int]
    otherwise: int = 3600
    buckets: int = BUCKETS

    @staticmethod
    def create(spark: SparkSession, ttl: dict[str, int], path: str | None = None, otherwise: int = 3600, buckets: int = BUCKETS) -> Cache:
        cache = Cache(spark, path or new_path(spark, "cache"), dict(ttl), otherwise, buckets)
        cache._put(spark.createDataFrame([], LOG))
        return cache

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(self.path)

    def _put(self, rows: DataFrame, mode: str = "append") -> None:
        out = rows.select(*COLUMNS).hint("rebalance", "namespace", "bucket").write.mode(mode)
        out.option("partitionOverwriteMode", "dynamic").partitionBy("namespace", "bucket").parquet(self.path)

    def _add(self, rows: DataFrame, op: str) -> None:
        last = self._log().agg(F.coalesce(F.max("batch"), F.lit(0))).first()[0]
        key = F.col("key").cast("string")
        shaped = rows.select(key.alias("key"), F.col("value").cast("string").alias("value"), F.col("at").cast("timestamp").alias("at"), F.lit(last + 1).cast("long").alias("batch"), F.lit(op).alias("op"), F.col("namespace").cast("string").alias("namespace"))
        self._put(shaped.where("namespace <> '' and at is not null").withColumn("bucket", self._bucket(F.col("key"))))

    def set(self, entries: DataFrame) -> None:
        """Writes entries (namespace, key, value, at). Of several of one key the latest holds, then that of the later write,
        then the greatest value. Rows without namespace, key, value or time are none."""
        self._add(entries.where("key is not null and value is not null"), "set")

    def delete(self, keys: DataFrame) -> None:
        """Removes entries (namespace, key) as of the time `at`: older ones are gone."""
        self._add(keys.where("key is not null").withColumn("value", F.lit(None).cast("string")), "delete")

    def clear(self, namespaces: DataFrame) -> None:
        """Removes all entries of namespaces (namespace) up to the time `at`, that time included."""
        none = F.lit(None).cast("string")
        self._add(namespaces.withColumns({"key": none, "value": none}), "clear")

    def _latest(self, log: DataFrame, as_of: Column) -> DataFrame:
        """One row a key: its latest word, if that is a set that is neither cleared nor expired."""
        known = log.where(F.col("at") <= as_of)
        order = W.partitionBy("namespace", "key").orderBy(F.desc("at"), F.desc("batch"), F.desc(F.col("op") == "delete"), F.desc_nulls_last("value"))
        last = known.where("op <> 'clear'").withColumn("_rn", F.row_number().over(order)).where("_rn = 1 and op = 'set'").drop("_rn")
        cleared = self._log().where((F.col("op") == "clear") & (F.col("at") <= as_of)).groupBy(F.col("namespace").alias("_ns")).agg(F.max(F.struct("at", "batch")).alias("_c"))
        seconds = F.coalesce(*[F.when(F.col("namespace") == n, F.lit(s)) for n, s in self.ttl.items()], F.lit(self.otherwise))
        alive = F.col("_c").isNull() | (F.struct("at", "batch") > F.col("_c"))
        fresh = F.unix_micros(as_of) - F.unix_micros("at") < seconds.cast("long") * 1_000_000
        return last.join(cleared, F.col("namespace") == F.col("_ns"), "left").where(alive & fresh).select("namespace", "key", "value", "at", "batch")

    def entries(self, as_of: Column) -> DataFrame:
        """All live entries: namespace, key, value, at."""
        return self._latest(self._log(), as_of).drop("batch")

    def get(self, namespace: str, keys: list[str], as_of: Column) -> DataFrame:
        """The live entries of some keys (a short list) of a namespace: one bucket each is read."""
        hit = [r[0] for r in self.spark.createDataFrame([(k,) for k in keys], "key string").select(self._bucket(F.col("key"))).distinct().collect()]
        log = self._log().where((F.col("namespace") == namespace) & F.col("bucket").isin(hit) & F.col("key").isin(keys))
        return self._latest(log, as_of).drop("batch")

    def get_many(self, keys: DataFrame, as_of: Column) -> DataFrame:
        """The live entries of a table of keys (namespace, key)."""
        wanted = keys.select(F.col("namespace"), F.col("key").cast("string").alias("key")).distinct().withColumn("bucket", self._bucket(F.col("key")))
        log = self._log().join(wanted, ["namespace", "bucket", "key"], "left_semi")
        return self._latest(log.select(*COLUMNS), as_of).drop("batch")

    def exists(self, namespace: str, key: str, as_of: Column) -> bool:
        return not self.get(namespace, [key], as_of).isEmpty()

    def stats(self, as_of: Column) -> DataFrame:
        """By namespace: live entries, characters of their values, the oldest and the newest."""
        e = self.entries(as_of)
        return e.groupBy("namespace").agg(F.count("*").alias("entries"), F.sum(F.char_length("value").cast("long")).alias("chars"), F.min("at").alias("oldest"), F.max("at").alias("newest"))

    def compact(self, as_of: Column) -> None:
        """Rewrites the log as the entries that live at as_of (and what was written for later). Reads as of then or later
        give the same answers."""
        log = self._log()
        later = log.where(F.col("at") > as_of)
        now = self._latest(log, as_of).withColumn("op", F.lit("set")).withColumn("bucket", self._bucket(F.col("key")))
        aside = new_path(self.spark, "compacted")
        now.select(*COLUMNS).union(later.select(*COLUMNS)).write.parquet(aside)
        ready = self.spark.read.schema(LOG).parquet(aside)
        before = {(r.namespace, r.bucket) for r in log.select("namespace", "bucket").distinct().collect()}  # namespaces x buckets
        self._put(ready, "overwrite")
        kept = {(r.namespace, r.bucket) for r in ready.select("namespace", "bucket").distinct().collect()}
        for namespace, bucket in before - kept:
            folder = "__HIVE_DEFAULT_PARTITION__" if bucket is None else bucket
            fs, p = file_system(self.spark, f"{self.path}/namespace={_escaped(self.spark, namespace)}/bucket={folder}")
            fs.delete(p, True)
        fs, p = file_system(self.spark, aside)
        fs.delete(p, True)


def _escaped(spark: SparkSession, value: str) -> str:
    """A partition value as it stands in a folder's name."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)

"""Materialised views: versions that are written aside and published by one rename, refreshed whole or by changes.

A view is a folder with a subfolder for each version and a small file, CURRENT, that names the one to read. A refresh writes
the next version beside the others and then replaces CURRENT in one rename, so a reader sees the old version or the new one
whole; who has opened a version goes on reading it until vacuum() removes it.

refresh() aggregates the base table anew. refresh_changes() needs only the rows that came and went since: counts and sums are
added up, the largest values are compared, and only the groups that lost a row with their largest value are aggregated again
from the base. A group without rows leaves the view.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import new_path
from .stored import file_system

ROWS = "n_rows"


@dataclass(frozen=True)
class Summary:
    """What a view computes: groups by `keys`, the number of rows (as n_rows), sums (of values that are exact in any order:
    integers and decimals; null counts as none) and largest values."""

    keys: tuple[str, ...]
    sums: dict[str, Column]
    largest: dict[str, Column]

    def of(self, base: DataFrame) -> DataFrame:
        totals = [F.coalesce(F.sum(v), F.lit(0)).alias(n) for n, v in self.sums.items()]
        return base.groupBy(*self.keys).agg(F.count("*").alias(ROWS), *totals, *[F.max(v).alias(n) for n, v in self.largest.items()])


@dataclass(frozen=True)
class View:
    spark: SparkSession
    path: str
    summary: Summary

    @staticmethod
    def create(base: DataFrame, summary: Summary, path: str | None = None) -> View:
        view = View(base.sparkSession, path or new_path(base.sparkSession, "view"), summary)
        view.refresh(base)
        return view

    def _pointer(self):
        return file_system(self.spark, f"{self.path}/CURRENT")

    def version(self) -> int:
        """The number of the version that readers get; 0 before the first refresh."""
        fs, p = self._pointer()
        if not fs.exists(p):
            return 0
        stream = fs.open(p)
        try:
            return int(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self) -> DataFrame:
        """The current version; the frame stays with it whatever is published later."""
        return self.spark.read.parquet(f"{self.path}/v{self.version()}")

    def publish(self, rows: DataFrame) -> int:
        """Writes rows as the next version and makes it the current one."""
        number = self.version() + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/v{number}")  # what a failed refresh may have left
        fs, p = self._pointer()
        _, aside = file_system(self.spark, f"{self.path}/.CURRENT-{number}")
        out = fs.create(aside, True)
        out.write(bytearray(str(number).encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        replace = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(aside), fs.makeQualified(p), replace)
        return number

    def refresh(self, base: DataFrame) -> int:
        return self.publish(self.summary.of(base))

    def refresh_changes(self, added: DataFrame, removed: DataFrame, base: DataFrame) -> int:
        """Publishes the view of `base` (the table after the change) from the current version and the rows that were added
        to and removed from it (an updated row is one of each)."""
        keys, s = list(self.summary.keys), self.summary
        here = self.read()
        plus, minus = s.of(added), s.of(removed)
        renamed = lambda df, mark: df.select(*[F.col(k).alias(f"{mark}{k}") for k in keys], *[F.col(c).alias(f"{mark}{c}") for c in (ROWS, *s.sums, *s.largest)])
        on = lambda mark: [F.col(k).eqNullSafe(F.col(f"{mark}{k}")) for k in keys]
        every = here.select(*keys).union(plus.select(*keys)).distinct()
        told = every
        for df, mark in ((here, "_o_"), (plus, "_p_"), (minus, "_m_")):
            told = told.join(renamed(df, mark), on(mark), "left")
        value = lambda mark, c: F.coalesce(F.col(f"{mark}{c}"), F.lit(0))
        totals = {c: (value("_o_", c) + value("_p_", c) - value("_m_", c)).cast(here.schema[c].dataType) for c in (ROWS, *s.sums)}
        most = {c: F.greatest(f"_o_{c}", f"_p_{c}") for c in s.largest}
        lost = F.lit(False)
        for c in s.largest:
            lost = lost | F.coalesce(F.col(f"_m_{c}") >= F.greatest(f"_o_{c}", f"_p_{c}"), F.lit(False))
        aside = new_path(self.spark, "merged")
        told.select(*keys, *[v.alias(c) for c, v in {**totals, **most}.items()], lost.alias("_lost")).where(F.col(ROWS) > 0).write.parquet(aside)
        merged = self.spark.read.parquet(aside)
        again = merged.where("_lost").select(*[F.col(k).alias(f"_k_{k}") for k in keys])
        anew = s.of(base.join(again, on("_k_"), "left_semi"))
        number = self.publish(merged.where("not _lost").drop("_lost").unionByName(anew.select(*here.columns)))
        fs, p = file_system(self.spark, aside)
        fs.delete(p, True)
        return number

    def vacuum(self, keep: int = 2) -> list[int]:
        """Removes all but the last `keep` versions (at least the current one); the numbers of those removed."""
        current, gone = self.version(), []
        fs, root = file_system(self.spark, self.path)
        for status in fs.listStatus(root):
            found = re.fullmatch(r"v(\d+)", status.getPath().getName())
            if found and int(found[1]) <= current - max(1, keep):
                fs.delete(status.getPath(), True)
                gone.append(int(found[1]))
        return sorted(gone)

"""Ingestion as files arrive: new ones only, a job row for each, failed ones again when asked.

A file-source stream with a checkpoint hands on what it has not seen. Each batch goes through ingest(), and its chunks and
its jobs are put into append-only logs under the batch's number, chunks first; so a batch that failed half-way is completed
and never doubled. A retry reads the items whose last job failed and logs its results as further attempts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans.ingestion import chunk_rows, ingest
from ..sources.files import docx_text, mime_of, utf8_text
from ..sources.stored import file_system
from .sinks import AppendLog

JOBS = "id string, status string, review_status string, n_chunks int, text_length int, warnings array<string>, attempt int"
CHUNKS = "source_table string, source_id string, chunk_index int, section_ref string, content string, token_count int, quality double, jurisdiction string, review_status string, title string"


def file_stream(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """New files of a folder (path, modificationTime, length, content), at most most_files a batch."""
    return spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_files).schema("path string, modificationTime timestamp, length long, content binary").load(folder)


def uploads(files: DataFrame, document_type: str = "law", jurisdiction: str = "laos") -> DataFrame:
    """Files (path, content) as items of ingest(): the id is the path."""
    kind = mime_of(F.col("path"))
    text = F.when(kind == "docx", docx_text("content")).when(kind.isin("text", "html"), utf8_text("content"))
    extracted = F.when(text.isNotNull(), F.array(F.struct(kind.alias("method"), text.alias("text")))).otherwise(F.array().cast("array<struct<method:string,text:string>>"))
    return files.select(
        F.col("path").alias("id"), F.col("path").alias("file_name"), kind.alias("kind"), F.lit(document_type).alias("document_type"), F.lit(None).cast("string").alias("title"),
        F.lit(jurisdiction).alias("jurisdiction"), F.lit("pending_review").alias("review_status"), F.lit(False).alias("allow_short"), extracted.alias("extracted"),
    )


class IngestionLog:
    """Chunks and jobs of all batches below a path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._chunks, self._jobs = AppendLog(spark, f"{path}/chunks", CHUNKS), AppendLog(spark, f"{path}/jobs", JOBS)

    def put(self, items: DataFrame, batch: int, query: str, attempt: int = 1) -> None:
        aside = f"{self.path}/aside/query={query}/batch={batch}"
        ingest(items).drop("text").write.mode("overwrite").parquet(f"{aside}/ingested")  # reads files once; chunks have the text
        done = self.spark.read.parquet(f"{aside}/ingested")
        rows = chunk_rows(done)
        self._chunks.put(rows.select(*[F.col(f.name).cast(f.dataType) for f in self._chunks.schema]), batch, query)
        jobs = done.select(F.col("id").cast("string").alias("id"), "status", "review_status", F.size("chunks").alias("n_chunks"), "text_length", "warnings", F.lit(attempt).alias("attempt"))
        self._jobs.put(jobs, batch, query)
        fs, p = file_system(self.spark, aside)
        fs.delete(p, True)

    def sink(self, items: Callable[[DataFrame], DataFrame], query: str) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: items(batch) gives what ingest() takes."""
        return lambda rows, i: self.put(items(rows), i, query)

    def _last(self) -> DataFrame:
        order = W.partitionBy("id").orderBy(F.desc("attempt"), F.desc("batch"))
        return self._jobs.read().withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")

    def jobs(self) -> DataFrame:
        """The last job of each item."""
        return self._last().drop("query", "batch")

    def chunks(self) -> DataFrame:
        """The chunks of the last attempt on each item."""
        last = self._last().select(F.col("id").alias("source_id"), "query", "batch")
        return self._chunks.read().join(last, ["source_id", "query", "batch"], "left_semi").select(*self._chunks.schema.names)

    def failed(self) -> DataFrame:
        return self.jobs().where("status = 'failed'")

    def retry(self, items: DataFrame) -> int:
        """Ingests the items (id, ...) whose last job failed once more; the number of the attempt."""
        attempt = (self._jobs.read().agg(F.max("attempt")).first()[0] or 0) + 1
        wanted = self.failed().select("id")
        self.put(items.withColumn("id", F.col("id").cast("string")).join(wanted, "id", "left_semi"), attempt, "retry", attempt)
        return attempt

    def batches(self) -> DataFrame:
        """By query and batch: items, those indexed, and the status of the batch."""
        out = self._jobs.read().groupBy("query", "batch").agg(F.count("*").alias("files"), F.count_if(F.col("status") == "indexed").alias("indexed"))
        status = F.when(F.col("indexed") == F.col("files"), "indexed").when(F.col("indexed") == 0, "failed").otherwise("completed_with_errors")
        return out.withColumn("status", status)

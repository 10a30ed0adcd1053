"""Ingestion end to end: extracted texts become document and chunk rows with quality, status and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as N
from ..functions import legal_text as L
from ..tables import table
from .records import target_table
from .registry import query

# Characters that a document needs at least, and what its owner is told.
LEAST_CHARS = 20
SHORT = "Document text is very short; add the full legal text before relying on search or AI answers."
REVIEW = "Extracted text quality is below the preferred threshold; review the indexed chunks before approval."
TOO_SHORT = "Could not extract enough text from this document."
UNSUPPORTED = "File type is not supported."
KINDS = ["pdf", "docx", "text", "html"]
ITEM = "id, file_name, kind, document_type, title, jurisdiction, review_status, allow_short, extracted (array of method and text)"


def chosen_text(items: DataFrame) -> DataFrame:
    """items with method, text and quality of the best of their extracted texts, in ingestion form (PDF text layers
    without artifact lines); all NULL where there is none."""
    forms = items.withColumn("_raw", F.transform("extracted", lambda e: e["text"]))
    forms = N.with_ingest_forms(forms, "_raw", "_forms", F.coalesce(F.col("kind") == "pdf", F.lit(False)))
    forms = forms.withColumn("_counts", N.character_counts("_forms"))
    found = F.transform("_forms", lambda t, i: F.struct(F.get(F.col("extracted.method"), i).alias("method"), t.alias("text"), F.get(F.col("_counts"), i).alias("counts")))
    best = forms.withColumn("_best", N.settled(L.best_candidate(found, counted=True)))
    return best.select(*items.columns, "_best.method", "_best.text", "_best.quality")


def ingest(items: DataFrame, most: int = 2600, overlap: int = 350) -> DataFrame:
    """A row for each item (see ITEM): source_table, title, status, method, text, text_length, quality, warnings, chunks.

    status: indexed, or failed for kinds that no extractor reads and for texts under LEAST_CHARS characters (unless the
    item allows short ones). Failed items have no chunks.
    """
    told = chosen_text(items).withColumn("text", F.coalesce("text", F.lit("")))
    short, known = F.char_length("text") < LEAST_CHARS, F.col("kind").isin(KINDS)
    ok = known & (~short | F.col("allow_short"))
    told = N.with_chunks(told.withColumn("ok", ok), "text", "found", most, overlap)
    none = F.array().cast("array<struct<index:int,content:string,section:string,token_count:int>>")

    def note(test: Column, text: str) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), F.lit(text))

    notes = F.concat(
        F.coalesce(F.when(F.col("ok"), F.col("quality.warnings")), F.array().cast("array<string>")),
        F.array_compact(F.array(note(~known, UNSUPPORTED), note(known & ~F.col("ok"), TOO_SHORT), note(F.col("ok") & short, SHORT), note(F.col("ok") & F.col("quality.needs_review"), REVIEW))),
    )
    return told.select(
        "id", target_table(F.col("document_type")).alias("source_table"), F.coalesce("title", L.title_of_path(F.col("file_name"))).alias("title"),
        F.when(F.col("ok"), "indexed").otherwise("failed").alias("status"), "method", "text", F.char_length("text").alias("text_length"), "jurisdiction",
        F.when(F.col("ok"), F.col("review_status")).otherwise("failed").alias("review_status"), "quality", F.array_distinct(notes).alias("warnings"), F.when(F.col("ok"), F.col("found")).otherwise(none).alias("chunks"),
    )


def chunk_rows(ingested: DataFrame) -> DataFrame:
    """The rows of the chunk table: (source_table, source_id, chunk_index, section_ref, content, token_count, quality,
    jurisdiction, review_status, title)."""
    rows = ingested.select("source_table", F.col("id").alias("source_id"), "title", "jurisdiction", "review_status", F.round("quality.score", 3).alias("quality"), "chunks")
    rows = N.exploded(rows, "chunks", *rows.columns[:-1])
    return rows.select("source_table", "source_id", F.col("c.index").alias("chunk_index"), F.col("c.section").alias("section_ref"), F.col("c.content").alias("content"), "c.token_count", "quality", "jurisdiction", "review_status", "title")


def example_items(spark, sf_dir, rows: DataFrame | None = None) -> DataFrame:
    """documents (or rows of it) as uploads: two extractors each, one of which spoils the text; some kinds, titles and types."""
    d = table(spark, sf_dir, "documents") if rows is None else rows
    n, headed = F.col("doc_id"), F.concat(F.lit("Article 1\n"), F.substring("text", 1, 400), F.lit("\n\f12\n.........\nSection 2: "), F.col("text"))
    spoilt = F.translate("text", "aeiou", "�ÃÂÄË")
    extracted = F.array(F.struct(F.lit("layer").alias("method"), F.when(n % 3 == 0, spoilt).otherwise(headed).alias("text")), F.struct(F.lit("second").alias("method"), F.col("text").alias("text")))
    return d.select(
        n.alias("id"), F.concat("source", F.lit("/law_"), n.cast("string"), F.lit(".pdf")).alias("file_name"), F.when(n % 11 == 0, "image").when(n % 2 == 0, "pdf").otherwise("docx").alias("kind"),
        F.when(F.col("lang") == "de", "Judgment").when(F.col("lang") == "es", "form").otherwise("law").alias("document_type"), F.when(n % 5 == 0, F.concat(F.lit("Title "), n.cast("string"))).alias("title"),
        F.lit("laos").alias("jurisdiction"), F.lit("pending_review").alias("review_status"), (n % 2 == 0).alias("allow_short"), extracted.alias("extracted"),
    )


@query(None)
def ingest_documents(spark, sf_dir):
    """Documents through extraction choice, quality, chunking and status."""
    out = ingest(example_items(spark, sf_dir))
    return out.select(
        "id", "source_table", "title", "status", "method", "text_length", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.size("chunks").alias("n_chunks"),
        "review_status", F.round("quality.score", 6).alias("score"), F.array_join("warnings", " / ").alias("warnings"),
    )


@query(None)
def ingest_chunks(spark, sf_dir):
    """The chunk rows of the same documents."""
    rows = chunk_rows(ingest(example_items(spark, sf_dir)))
    return rows.withColumn("content", F.sha2(F.col("content").cast("binary"), 256)).withColumnRenamed("content", "content_sha256")


@query(None)
def repaired_answers(spark, sf_dir):
    """cut JSON objects closed, others refused."""
    d = table(spark, sf_dir, "documents")
    body = F.concat(F.lit('Answer: ```json\n{"id": '), F.col("doc_id").cast("string"), F.lit(', "parts": [{"text": "'), F.regexp_replace("text", r'[\x00-\x1f"\\]', " "), F.lit('"}, [1, 2], {"x": "y"}]}\n```'))
    cut = F.when(F.col("doc_id") % 7 == 0, F.replace(body, F.lit("[1, 2]"), F.lit("[1, 2}"))).otherwise(F.substr(body, F.lit(1), (F.char_length(body) - F.col("doc_id") % 41).cast("int")))
    return d.select("doc_id", N.repaired_json(cut).alias("json"))

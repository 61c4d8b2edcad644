"""Ingestion as one plan: files to blocks, fragments, vectors and statuses. A file that fails has a status and a message,
and stops no other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import collection_name, embedding_text, tokens
from lodestone.operators.chunking import MAX_CHARS, OVERLAP, fragment_files, number_fragments
from lodestone.operators.embedding import DIMENSIONS, embed, model_id
from lodestone.sources.extract import BLOCKS


@dataclass(frozen=True)
class Ingested:
    documents: DataFrame  # document_id, ingestion_status, error_code, error_message, chunk_count, characters, tokens, embedding_model, collection
    chunks: DataFrame  # document_id, chunk_index, chunk_id, content, section_path, page_number
    vectors: DataFrame  # collection, record_id, document_id, embedding


def ingest(files: DataFrame, most: int = MAX_CHARS, overlap: int = OVERLAP, dimensions: int = DIMENSIONS) -> Ingested:
    """``files`` has document_id, course_id, media_type and content. No table needs a shuffle: a file's fragments, its counts
    and the collection of its course all come from its own row."""
    model = model_id(dimensions)
    cut = files.select("document_id", "course_id", fragment_files(most, overlap)(F.col("media_type"), F.col("content")).alias("_x"))
    read = cut.select("document_id", "course_id", F.coalesce("_x.blocks", F.array().cast(BLOCKS)).alias("_f"), "_x.error_code", "_x.error_message")
    failed = F.col("error_code").isNotNull()
    words = F.aggregate("_f", F.lit(0).cast("long"), lambda n, f: n + F.size(tokens(f["text"])))
    documents = read.select(
        "document_id", F.when(failed, "failed").otherwise("indexed").alias("ingestion_status"), "error_code", "error_message", F.size("_f").cast("long").alias("chunk_count"),
        F.aggregate("_f", F.lit(0).cast("long"), lambda n, f: n + F.length(f["text"])).alias("characters"), words.alias("tokens"), F.lit(model).alias("embedding_model"),
        F.when(~failed, collection_name(F.col("course_id"), F.lit(model))).alias("collection"),
    )
    chunks = number_fragments(read, F.col("_f"), "document_id", "course_id")
    texts = chunks.withColumn("_t", embedding_text(F.col("section_path"), F.col("content")))
    named = embed(texts, "_t", dimensions).withColumn("collection", collection_name(F.col("course_id"), F.lit(model)))
    return Ingested(documents, chunks.drop("course_id"), named.select("collection", F.col("chunk_id").alias("record_id"), "document_id", "embedding"))

"""The document catalogue: filters, pages, counts, metadata, statuses and fragment replacement.

Tables are DataFrames; what changes a table returns the table as it is afterwards, to be
written as a new version.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.scalars import json_merge, json_text, unknown_fields
from lodestone.operators.durable import durable

#: Metadata keys that may be edited (fixed values).
EDITABLE = ["authority_level", "difficulty", "document_type", "learning_outcomes", "topic", "version"]


def document_filter(course: str | None = None, roles: Sequence[str] | None = None, document_type: str | None = None, topic: str | None = None, status: str | None = None) -> Column:
    """The conjunction of the given conditions; no roles match nothing, None any."""
    conditions = [F.lit(True)]
    if course is not None:
        conditions.append(F.col("course_id") == course)
    if roles is not None:
        conditions.append(F.col("knowledge_base_role").isin(sorted(roles)) if roles else F.lit(False))
    for key, value in (("document_type", document_type), ("topic", topic)):
        if value is not None:
            conditions.append(json_text(F.col("metadata"), key) == value)
    if status is not None:
        conditions.append(F.col("ingestion_status") == status)
    return reduce(Column.__and__, conditions)


def with_bases(documents: DataFrame, bases: DataFrame) -> DataFrame:
    """Documents with course_id and knowledge_base_role; a small dimension, which Catalyst broadcasts by its size."""
    return documents.join(bases.select("knowledge_base_id", "course_id", "knowledge_base_role"), "knowledge_base_id")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))


def page(documents: DataFrame, bases: DataFrame, chunks: DataFrame, condition: Column, limit: int, offset: int) -> DataFrame:
    """One page, by creation time and id, with the number of fragments of each document. The page is
    cut before fragments are counted, so that only its own are."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("a page has 1 to 100 rows and begins at 0 or later")
    rows = durable(with_bases(documents, bases).where(condition).orderBy("created_at", "document_id").offset(offset).limit(limit))
    counted = chunks.join(F.broadcast(rows.select("document_id")), "document_id", "left_semi")
    return rows.join(chunk_counts(counted), "document_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def total(documents: DataFrame, bases: DataFrame, condition: Column) -> DataFrame:
    return with_bases(documents, bases).where(condition).agg(F.count("*").alias("total"))


def by_id(table: DataFrame, column: str, value: str) -> DataFrame:
    return table.where(F.col(column) == value)


def missing_bases(wanted: DataFrame, bases: DataFrame) -> DataFrame:
    """Knowledge bases (course_id, knowledge_base_role) that are wanted and not there yet, as rows to append."""
    new = wanted.select("course_id", "knowledge_base_role").distinct().join(bases, ["course_id", "knowledge_base_role"], "left_anti")
    key = F.left(F.sha2(F.concat_ws("/", "course_id", "knowledge_base_role"), 256), F.lit(32))
    return new.select(key.alias("knowledge_base_id"), "course_id", "knowledge_base_role", F.concat("course_id", F.lit(" ("), "knowledge_base_role", F.lit(")")).alias("name"))


def patch_metadata(documents: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """``documents`` with the patches (document_id, patch: a JSON object) merged in. Patches with fields
    that cannot be edited, or none, change nothing; ``rejected_patches`` lists them."""
    good = patches.where((F.size(unknown_fields(F.col("patch"), EDITABLE)) == 0) & (F.size(F.json_object_keys("patch")) > 0))
    out = documents.join(good.select("document_id", "patch"), "document_id", "left")
    return out.withColumns({"metadata": F.when(F.col("patch").isNull(), F.col("metadata")).otherwise(json_merge(F.col("metadata"), F.col("patch"))), "updated_at": F.when(F.col("patch").isNull(), F.col("updated_at")).otherwise(now)}).drop("patch")


def rejected_patches(patches: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, error_code, fields): patches of unknown fields or documents."""
    known = documents.select("document_id", F.lit(True).alias("_known"))
    fields = unknown_fields(F.col("patch"), EDITABLE)
    out = patches.join(known, "document_id", "left").withColumn("fields", fields)
    code = F.when((F.size("fields") > 0) | (F.size(F.json_object_keys("patch")) == 0), "VALIDATION_FAILED").when(F.col("_known").isNull(), "NOT_FOUND")
    return out.withColumn("error_code", code).where("error_code IS NOT NULL").select("document_id", "error_code", "fields")


def latest(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The last event of each key. A maximum of structs, combined before the shuffle, not a window."""
    rest = [c for c in events.columns if c not in (key, *order)]
    last = events.groupBy(key).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("_e"))
    return last.select(key, "_e.*").select(events.columns)


def apply_statuses(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """``documents`` with the last of ``changes`` (document_id, changed_at, ingestion_status, error_message); a
    change without a message clears it."""
    last = latest(changes, "document_id", "changed_at").select("document_id", F.struct("changed_at", "ingestion_status", "error_message").alias("_c"))
    out = documents.join(last, "document_id", "left")
    new = F.col("_c").isNotNull()
    pick = lambda old, to: F.when(new, F.col(f"_c.{to}")).otherwise(F.col(old))
    return out.withColumns({"ingestion_status": pick("ingestion_status", "ingestion_status"), "error_message": pick("error_message", "error_message"), "updated_at": pick("updated_at", "changed_at")}).drop("_c")


def replace_chunks(chunks: DataFrame, fresh: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """``chunks`` with all fragments of the documents in ``fresh`` (or in ``documents``, for those left
    without any) replaced by those of ``fresh``."""
    ids = (documents if documents is not None else fresh).select("document_id").distinct()
    return chunks.join(ids, "document_id", "left_anti").unionByName(fresh)


def violations(chunks: DataFrame) -> DataFrame:
    """Rows that break a key or a range: (document_id, chunk_index, problem)."""
    twice = chunks.groupBy("document_id", "chunk_index").count().where("count > 1").select("document_id", "chunk_index", F.lit("duplicate index").alias("problem"))
    below = chunks.where("chunk_index < 0").select("document_id", "chunk_index", F.lit("negative index").alias("problem"))
    pages = chunks.where("page_number <= 0").select("document_id", "chunk_index", F.lit("page below 1").alias("problem"))
    return twice.unionByName(below).unionByName(pages)


def chunk_indices(pieces: DataFrame, document: str = "document_id", *order: str) -> DataFrame:
    """``pieces`` with chunk_index: the position within the document, from 0."""
    return pieces.withColumn("chunk_index", F.row_number().over(Window.partitionBy(document).orderBy(*order)) - 1)


def document_view(documents: DataFrame) -> DataFrame:
    """What a client sees of a document; ``error`` only where it failed."""
    failed = F.when(F.col("ingestion_status") == "failed", F.struct(F.coalesce("error_message", F.lit("")).alias("message")))
    return documents.select("document_id", "course_id", "knowledge_base_role", "filename", "ingestion_status", "chunk_count", failed.alias("error"))


def may_see(owner: Column, user: str, role: str) -> Column:
    """Own rows, and all for an administrator."""
    return (owner == user) | F.lit(role == "administrator")


def may_act(role: Column, *allowed: str) -> Column:
    """Whether a role is one of those that an operation is open to."""
    return F.coalesce(role.isin(sorted(allowed)), F.lit(False)) if allowed else F.lit(False)


def empty_courses(wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """(course_id, error_code): the courses of ``wanted`` that have no document, and so nothing to index or search."""
    return wanted.select("course_id").distinct().join(documents.select("course_id"), "course_id", "left_anti").withColumn("error_code", F.lit("NOT_FOUND"))


def insert(table: DataFrame, fresh: DataFrame, *key: str) -> DataFrame:
    """``table`` with the rows of ``fresh`` whose key it does not have yet; of several with one key any one."""
    return table.unionByName(fresh.dropDuplicates(list(key)).join(table.select(*key), list(key), "left_anti").select(table.columns))


def page_view(items: DataFrame, total_: DataFrame, limit: int, offset: int) -> DataFrame:
    """One row: the items of a page (100 at most), the total, and the limit and offset."""
    listed = items.limit(limit).agg(F.collect_list(F.struct(*items.columns)).alias("items"))
    return listed.join(F.broadcast(total_.select("total"))).select("items", "total", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"))

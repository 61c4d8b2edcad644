"""Re-indexing of courses: only fragments whose text has changed are embedded, and a document's fragments and vectors are swapped together.

Fragments and vectors are one versioned table, a row for each fragment, in buckets of documents. A fragment is known by the digest of what is embedded of
it. Files are cut up anew, the digests of their fragments meet those that the table has of the same documents, and vectors of equal digests are
carried over; documents of which nothing has changed are not written at all. All other documents that could be read are replaced in one commit, so that a reader sees
each of them old or new; one that cannot be read keeps its old fragments and is reported.

Fragments are written twice: once as they are cut, in a folder for each of the table's buckets, and with their vectors into the table. What is shuffled is ids and digests, and
the fragments and vectors of changed documents that are carried over.

Defined results: of several files of one document the one of the greatest checksum counts, then that of the greatest course and type; a file without a document id is left out; a document that is empty or
cannot be read fails with a code; documents that the files do not name stay as they are; no files change nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.scalars import collection_name, embedding_text, token_count
from lodestone.operators.chunking import MAX_CHARS, OVERLAP, fragment_files, number_fragments
from lodestone.operators.durable import BROADCAST_BYTES, BROADCAST_KEYS, durable, forget, in_small_batches, small
from lodestone.operators.embedding import DIMENSIONS, embed, model_id
from lodestone.operators.versioned import Snapshot, Table
from lodestone.sources.extract import BLOCKS

FRAGMENTS = T.StructType([
    T.StructField("document_id", T.StringType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk_id", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("section_path", T.ArrayType(T.StringType())), T.StructField("page_number", T.IntegerType()), T.StructField("digest", T.StringType()), T.StructField("course_id", T.StringType()),
    T.StructField("collection", T.StringType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
])


@dataclass(frozen=True)
class Reindexed:
    version: int
    #: document_id, course_id, ingestion_status, error_code, error_message, chunk_count, characters, tokens, embedded, reused, removed
    documents: DataFrame
    #: Milliseconds of reading and cutting, comparing, embedding, and writing.
    timings_ms: dict[str, int]

    def courses(self) -> DataFrame:
        """(course_id, documents, indexed, failed, chunk_count, embedded, reused, removed)."""
        count = lambda status: F.sum((F.col("ingestion_status") == status).cast("long"))
        sums = [F.sum(c).alias(c) for c in ("chunk_count", "embedded", "reused", "removed")]
        return self.documents.groupBy("course_id").agg(F.count("*").alias("documents"), count("indexed").alias("indexed"), count("failed").alias("failed"), *sums)

    def failures(self) -> DataFrame:
        """(course_id, document_id, error_code, error)."""
        return self.documents.where("ingestion_status = 'failed'").select("course_id", "document_id", "error_code", F.col("error_message").alias("error"))


def fragment_table(spark: SparkSession, path: str, buckets: int = 16) -> Table:
    """An empty table of fragments with their vectors."""
    return Table.create(spark, path, FRAGMENTS, ["document_id", "chunk_index"], ["document_id"], ["document_id", "chunk_index"], buckets, ["embedding"])


@F.pandas_udf(T.StructType([T.StructField("carry", T.ArrayType(T.IntegerType())), T.StructField("removed", T.LongType())]))
def _carried(now: pd.Series, digests: pd.Series, places: pd.Series, same: pd.Series, held: pd.Series) -> pd.DataFrame:
    """For each digest that a document has now the place of the first old fragment whose vector it takes, and how many old fragments are among them no more. Old fragments
    count if they are of the ``same`` collection; a place that is there twice gives no vector."""
    out = []
    for new, old, at, fits, has in zip(now, digests, places, same, held, strict=True):
        new, first, twice = list(new), {}, set()
        if old is None:
            out.append(([None] * len(new), 0))
            continue
        at = [int(a) for a in at]
        for a, b in zip(at, at[1:], strict=False):
            if a == b:
                twice.add(a)
        for digest, a, f, h in zip(old, at, fits, has, strict=True):
            if f and h and a not in twice:
                first.setdefault(digest, a)
        known = set(new)
        out.append(([first.get(d) for d in new], sum(not (f and d in known) for d, f in zip(old, fits, strict=True))))
    return pd.DataFrame(out, columns=["carry", "removed"])


def _latest(read: DataFrame, table: Table, base: Snapshot) -> DataFrame:
    """``read`` with one row for each document."""
    repeated = durable(read.groupBy("document_id").count().where("count > 1").select("document_id"))
    if not repeated.isEmpty():
        several = read.join(small(repeated), "document_id", "left_semi").select("document_id", "_mark", "course_id", "media_type", "_row")
        last = several.groupBy("document_id").agg(F.max(F.struct("_mark", "course_id", "media_type", "_row")).alias("m")).select("m._row")
        lost = durable(several.select("_row").join(last, "_row", "left_anti"))
        once = table.deal(read.drop("_bucket").join(small(lost), "_row", "left_anti"), base)
        forget(read, lost)
        read = once
    forget(repeated)
    return read


def reindex(files: DataFrame, table: Table, most: int = MAX_CHARS, overlap: int = OVERLAP, dimensions: int = DIMENSIONS, client: Callable[[list[str]], list[list[float]]] | None = None, base: Snapshot | None = None) -> Reindexed:
    """Brings ``table`` up to ``files`` (document_id, course_id, media_type, content). ``client`` embeds in place of the hashing; texts that
    are the same are sent to it once. ``base`` is the version to compare with, if not the newest; if another writer has changed these documents' buckets since, this
    raises and changes nothing."""
    base, clock, timings = base or table.snapshot(), time.monotonic(), {}

    def lap(name: str) -> None:
        nonlocal clock
        now = time.monotonic()
        timings[name], clock = round(1000 * (now - clock)), now

    model = F.lit(model_id(dimensions))
    own = in_small_batches(files).where("document_id IS NOT NULL").select(F.col("document_id").cast("string").alias("document_id"), "course_id", "media_type", F.sha2("content", 256).alias("_mark"), fragment_files(most, overlap)(F.col("media_type"), F.col("content")).alias("_x"))
    own = own.select("document_id", "course_id", "media_type", "_mark", "_x.error_code", "_x.error_message", F.coalesce("_x.blocks", F.array().cast(BLOCKS)).alias("_f"))
    sums = lambda of: F.aggregate("_f", F.lit(0).cast("long"), lambda n, f: n + of(f["text"]))
    counts = {"chunk_count": F.size("_f").cast("long"), "characters": sums(F.length), "tokens": sums(token_count)}
    read = _latest(table.deal(own.withColumns(counts | {"_row": F.monotonically_increasing_id()}), base), table, base)
    lap("cut")

    # what the table has of these documents; fragments and vectors stay where they are until they are written
    digest = lambda f: F.sha2(embedding_text(f["section_path"], f["text"]), 256)
    collection, good, some_held = collection_name(F.col("course_id"), model), F.col("error_code").isNull(), bool(base.parts)
    report = ["document_id", "course_id", "error_code", "error_message", "chunk_count", "characters", "tokens"]
    now = F.transform("_f", lambda f, i: F.struct(i.alias("chunk_index"), F.unhex(digest(f)).alias("digest"), F.col("collection").alias("collection")))
    if some_held:
        held = F.col("embedding").isNotNull() & F.col("chunk_index").isNotNull()
        old = table.read_keys(read.where(good), base.version, "document_id", F.col("chunk_index").cast("int").alias("chunk_index"), F.unhex("digest").alias("digest"), "collection", held.alias("held"))
        before = old.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "digest", "collection", "held"))).alias("_old"))
        status = read.withColumn("collection", collection).select(*report, "_bucket", "collection", now.alias("_now")).join(before, "document_id", "left")
        old_now = F.transform("_old", lambda o: F.struct(o["chunk_index"].alias("chunk_index"), o["digest"].alias("digest"), o["collection"].alias("collection")))
        of_old = lambda f: F.transform("_old", f)
        compared = _carried(F.col("_now.digest"), F.col("_old.digest"), of_old(lambda o: F.coalesce(o["chunk_index"], F.lit(-1))), of_old(lambda o: o["collection"].eqNullSafe(F.col("collection"))), F.col("_old.held"))
        changed = good & F.when(F.col("_old").isNull(), F.size("_now") > 0).otherwise(~F.col("_now").eqNullSafe(old_now))
        status = status.select(*report, "_bucket", changed.alias("changed"), compared.alias("_c")).select(*report, "_bucket", "changed", "_c.carry", "_c.removed")
    else:
        status = read.select(*report, "_bucket", (good & (F.size("_f") > 0)).alias("changed"), F.transform("_f", lambda f: F.lit(None).cast("int")).alias("carry"), F.lit(0).cast("long").alias("removed"))
    embedded = F.size(F.filter("carry", lambda c: c.isNull())).cast("long")
    status = durable(status.withColumn("embedded", embedded))
    changed = status.where("changed")
    sizes = changed.groupBy("_bucket").agg(F.count("*").alias("n"), F.sum(F.octet_length("document_id") + 4 * F.size("carry") + 64).alias("bytes")).agg(F.max("n").alias("n"), F.max("bytes").alias("bytes")).first()
    lap("compare")

    docs = read.where(good).withColumn("collection", collection)
    if some_held:
        few = (sizes["n"] or 0) <= BROADCAST_KEYS and (sizes["bytes"] or 0) <= BROADCAST_BYTES
        picked = changed.select("_bucket", "document_id", "carry")
        docs = docs.join(F.broadcast(picked) if few else picked, ["_bucket", "document_id"])
    place = lambda i: F.get("carry", i) if some_held else F.lit(None).cast("int")
    pieces = F.transform("_f", lambda f, i: F.struct(f["text"].alias("text"), f["section_path"].alias("section_path"), f["page_number"].alias("page_number"), place(i).alias("_from")))
    whole = number_fragments(docs, pieces, "document_id", "course_id", "collection", "_bucket")
    text = embedding_text(F.col("section_path"), F.col("content"))
    whole = whole.withColumn("digest", F.sha2(text, 256))

    # a client is sent equal texts once; the hashing needs only the row
    fresh = durable(embed(whole.where("_from IS NULL").select("digest", text.alias("text")).dropDuplicates(["digest"]), "text", dimensions, client, "embedding" in base.packed).select("digest", "embedding")) if client else None
    lap("embed")

    def with_vectors(rows: DataFrame, had: DataFrame) -> DataFrame:
        new = rows.where("_from IS NULL")
        new = new.join(fresh, "digest", "left") if client else embed(new.withColumn("text", text), "text", dimensions, as_bytes="embedding" in base.packed)
        if not some_held:
            return new
        vectors = had.select("document_id", F.col("chunk_index").alias("_from"), "embedding")
        return new.select(*FRAGMENTS.names).unionByName(rows.join(vectors, ["document_id", "_from"]).select(*FRAGMENTS.names))

    version = base.version
    if sizes["n"]:
        version = table.replace(whole, changed, base, with_vectors)
    lap("write")

    documents = status.select(
        "document_id", "course_id", F.when(good, "indexed").otherwise("failed").alias("ingestion_status"), "error_code", "error_message", "chunk_count",
        "characters", "tokens", "embedded", (F.size("carry") - F.col("embedded")).alias("reused"), "removed",
    )
    forget(read, fresh)
    return Reindexed(version, documents, timings)

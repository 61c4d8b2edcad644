"""A persisted inverted index for BM25, updated by documents.

Two versioned tables: postings (word, document, mark, f, length), dealt into buckets and sorted by word, and documents (document, mark, length). A document's mark is
a hash of its text. Adding documents cuts up only those whose mark is new, and writes their postings beside the old ones; the document's
row decides which mark counts, so that old postings are dead at once, and ``compact`` drops them. A search reads the buckets of its words, of
these the row groups that can hold them, and the small table of documents; it never reads a text.

Defined results: as those of ``retrieval.bm25``; a null text is empty; of several rows of one id in one addition the greatest mark stands, a row without an id is left
out; a search names a version of the documents, or takes the newest, and postings that came later do not count; versions from before a ``compact`` lose the postings
it dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.scalars import postings
from lodestone.operators.durable import durable, small
from lodestone.operators.retrieval import asked_words, bm25_weight, ranked, summed
from lodestone.operators.versioned import Table


class InvertedIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.postings, self.documents = Table(spark, f"{path}/postings"), Table(spark, f"{path}/documents")

    @classmethod
    def create(cls, spark: SparkSession, path: str, id_type: T.DataType, buckets: int = 16) -> InvertedIndex:
        """An empty index of documents whose ids have a type."""
        own = [T.StructField("document", id_type), T.StructField("mark", T.LongType())]
        counts = [T.StructField("f", T.LongType()), T.StructField("length", T.LongType())]
        Table.create(spark, f"{path}/postings", T.StructType([T.StructField("word", T.StringType()), *own, *counts]), ["word", "document", "mark"], ["word"], ["word"], buckets)
        Table.create(spark, f"{path}/documents", T.StructType([*own, counts[1]]), ["document"], buckets=buckets)
        return cls(spark, path)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Adds documents, in place of those of the same ids, and gives the number that were cut up: those that are new or have changed."""
        rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("document"), F.coalesce(text_col, F.lit("")).alias("text"))
        rows = rows.groupBy("document", F.xxhash64("text").alias("mark")).agg(F.min("text").alias("text"))
        latest = rows.groupBy("document").agg(F.max_by(F.struct("mark", "text"), "mark").alias("d")).select("document", "d.mark", "d.text")
        known = self.documents.read().select("document", "mark")
        fresh = durable(latest.join(known, ["document", "mark"], "left_anti"))
        n = fresh.count()
        if n:
            cut = durable(fresh.select("document", "mark", postings(F.col("text")).alias("p")))
            each = cut.select("document", "mark", F.explode("p").alias("p")).select("p.word", "document", "mark", F.col("p.n").alias("f"), "p.length")
            # postings come first: until the documents follow, no search counts them
            self.postings.append(each)
            self.documents.upsert(cut.select("document", "mark", F.coalesce(F.get("p", F.lit(0))["length"], F.lit(0).cast("long")).alias("length")))
        return n

    def remove(self, docs: DataFrame, id_col: str = "doc_id") -> int:
        """Takes documents out; the new version of the documents."""
        return self.documents.delete(docs.select(F.col(id_col).alias("document")))

    def compact(self) -> int:
        """Writes the postings anew without dead ones, each bucket as one segment; the new version of the postings. An addition meanwhile makes this a conflict."""
        base = self.postings.snapshot()
        alive = self.postings.read(base.version).join(self.documents.read().select("document", "mark"), ["document", "mark"], "left_semi").dropDuplicates(["word", "document", "mark"])
        return self.postings.overwrite(alive, base)

    def search(self, queries: DataFrame, top_k: int, version: int | None = None, id_col: str = "doc_id") -> DataFrame:
        """(query_id, id, score, rank) as ``retrieval.bm25`` gives it. ``queries`` has query_id and text."""
        documents = self.documents.read(version)
        totals = documents.agg(F.count("*").alias("n"), F.avg("length").alias("average")).first()
        asked = durable(asked_words(queries))
        words = durable(asked.select("word").distinct())
        held = self.postings.read_keys(words).join(documents.select("document", "mark"), ["document", "mark"], "left_semi").dropDuplicates(["word", "document"])
        held = durable(held)
        df = durable(held.groupBy("word").agg(F.count("*").alias("df")))
        weighed = held.join(small(df), "word").select("word", F.col("document").alias(id_col), bm25_weight(F.col("f"), F.col("length"), F.col("df"), totals.n, totals.average).alias("w"))
        return ranked(summed(weighed, asked, id_col), top_k, id_col)

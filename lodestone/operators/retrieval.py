"""Retrieval: dense with an authority policy, BM25, and fusion by reciprocal ranks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.scalars import postings, token_count, tokens
from lodestone.operators.durable import durable, small
from lodestone.operators.vectors import nearest

#: What a supplementary source's similarity is lowered by, and how many times top_k are looked at (fixed values).
PENALTY, OVERSAMPLING = 0.05, 3
#: The report names no constants for these two; the customary ones are taken.
BM25_K1, BM25_B, RRF_K = 1.2, 0.75, 60
#: Documents that are broadcast to filter vectors; more are joined by a shuffle.
BROADCAST_DOCUMENTS = 200_000
#: Entities of a context that are paired in one task.
CONTEXT_BLOCK = 1024


def check_request(course: str, text: str, top_k: int = 5, purpose: str = "context") -> None:
    """Raises for a request out of bounds: the course's name, 1 to 2000 characters, 1 to 50 results, a known purpose."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}", course):
        raise ValueError("a course is named by up to 64 letters, digits, dots, dashes and underscores")
    if not 1 <= len(text) <= 2000:
        raise ValueError("a query has 1 to 2000 characters")
    if not 1 <= top_k <= 50:
        raise ValueError("1 to 50 results can be asked for")
    if purpose not in ("mandatory", "context"):
        raise ValueError("evidence is asked for as mandatory or as context")


def request_errors(course: Column | None = None, text: Column | None = None, top_k: Column | None = None, purpose: Column | None = None, limit: Column | None = None, offset: Column | None = None) -> Column:
    """The same of requests that are rows: the names of the fields that are out of bounds, in order; a null is. Fields that are not given are not
    looked at. Pages have 1 to 100 rows and begin at 0 or later."""
    rules = {
        "course_id": course is not None and course.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,63}\z"), "limit": limit is not None and limit.between(1, 100), "offset": offset is not None and (offset >= 0),
        "purpose": purpose is not None and purpose.isin("mandatory", "context"), "query": text is not None and F.length(text).between(1, 2000), "top_k": top_k is not None and top_k.between(1, 50),
    }
    return F.array_compact(F.array(*(F.when(~F.coalesce(good, F.lit(False)), name) for name, good in rules.items() if good is not False), F.lit(None).cast("string")))


def admitted(purpose: str, role: Column) -> Column:
    """Mandatory evidence comes from primary sources alone, context from all."""
    return role == "primary" if purpose == "mandatory" else role.isNotNull()


def rank_score(similarity: Column, role: Column) -> Column:
    return similarity - F.when(role == "supplementary", PENALTY).otherwise(0.0)


def dense(vectors: DataFrame, documents: DataFrame, chunks: DataFrame, queries: DataFrame, top_k: int = 5, purpose: str = "context") -> DataFrame:
    """Evidence for each query: (query_id, rank, chunk_id, document_id, filename, knowledge_base_role, section_path, page_number,
    content, similarity, score).

    Only vectors of indexed and admitted documents are compared. The nearest 3 * top_k meet their
    fragments and documents - a vector without a fragment is no evidence - and are ranked again by score.
    """
    eligible = documents.where((F.col("ingestion_status") == "indexed") & admitted(purpose, F.col("knowledge_base_role"))).select("document_id", "filename", "knowledge_base_role")
    hits = nearest(vectors.join(small(eligible.select("document_id"), BROADCAST_DOCUMENTS), "document_id", "left_semi"), queries, OVERSAMPLING * top_k).drop("rank")
    found = hits.withColumnRenamed("record_id", "chunk_id").join(chunks.select("chunk_id", "document_id", "section_path", "page_number", "content"), "chunk_id").join(eligible, "document_id")
    similarity = 1 - F.col("distance")
    scored = found.withColumns({"similarity": F.round(similarity, 6), "score": F.round(rank_score(similarity, F.col("knowledge_base_role")), 6)})
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "distance", "chunk_id")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return best.select("query_id", "rank", "chunk_id", "document_id", "filename", "knowledge_base_role", "section_path", "page_number", "content", "similarity", "score")


def bm25_weight(f: Column, length: Column, df: Column, n: float, average: float, k1: float = BM25_K1, b: float = BM25_B) -> Column:
    """What one word adds to a document's score: idf = ln(1 + (n - df + 0.5) / (df + 0.5)), times its saturated frequency."""
    return F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * length / F.lit(average or 1.0)))


def asked_words(queries: DataFrame) -> DataFrame:
    """(query_id, word): the distinct words of each query."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word")).distinct()


def ranked(scores: DataFrame, top_k: int, id_col: str) -> DataFrame:
    """``scores`` (query_id, id, score) with ``rank``: the ``top_k`` highest scores of each query, of equal ones the least id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def bm25(docs: DataFrame, queries: DataFrame, top_k: int, id_col: str = "doc_id", k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """(query_id, id, score, rank) by BM25. ``docs`` has the id and text, ``queries`` query_id and text; a query's repeated words
    count once.

    Each text is cut into words once, and leaves its row only as the queries' words with their counts; a word's weight is then
    worked out once for each document that has it, not for each query, and sums are combined before they are shuffled.

    A null text has no words; rows of one id add up; of equal scores the least id comes first; queries without a word of any document, and
    empty tables, give no rows. For repeated searches over one collection see ``inverted``.
    """
    totals = docs.agg(F.count("*").alias("n"), F.avg(F.coalesce(token_count(F.col("text")), F.lit(0))).alias("average")).first()
    asked = durable(asked_words(queries))
    each = docs.select(id_col, F.explode(postings(F.col("text"))).alias("p")).select(id_col, "p.word", F.col("p.n").alias("f"), "p.length")
    held = durable(each.join(small(asked.select("word").distinct()), "word", "left_semi"))
    df = durable(held.groupBy("word").agg(F.count("*").alias("df")))
    weighed = held.join(small(df), "word").select("word", id_col, bm25_weight(F.col("f"), F.col("length"), F.col("df"), totals.n, totals.average, k1, b).alias("w"))
    return ranked(summed(weighed, asked, id_col), top_k, id_col)


def summed(weighed: DataFrame, asked: DataFrame, id_col: str) -> DataFrame:
    """(query_id, id, score): the weights (word, id, w) of each query's words, added up. A document's words are brought together before they meet the queries, so that its sums are
    whole where they are made, and only the best of each task go on to be ranked."""
    return weighed.repartition(id_col).join(small(asked), "word").groupBy("query_id", id_col).agg(F.round(F.sum("w"), 9).alias("score"))


def fuse(rankings: list[DataFrame], top_k: int, id_col: str, k: int = RRF_K) -> DataFrame:
    """(query_id, id, score, rank): the sum of 1 / (k + rank) over rankings, each (query_id, id, rank). A union and one
    aggregation stand in for a full outer join."""
    parts = [r.select("query_id", id_col, (1 / (k + F.col("rank"))).alias("part")) for r in rankings]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    fused = whole.groupBy("query_id", id_col).agg(F.round(F.sum("part"), 12).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def cooccurrence(mentions: DataFrame, context: str, entity: str) -> tuple[DataFrame, DataFrame]:
    """A graph of entities named in one context: edges (a, b, weight) and vertices (entity, degree, strength).

    A context of more than ``CONTEXT_BLOCK`` entities is dealt into blocks, and every two of its blocks are paired by themselves;
    so no task pairs a whole large context.
    """
    own = mentions.select(F.col(context).alias("c"), F.col(entity).alias("e")).distinct()
    blocks = own.groupBy("c").agg(F.ceil(F.count("*") / CONTEXT_BLOCK).cast("int").alias("m"))
    dealt = own.join(blocks, "c").withColumn("b", F.pmod(F.xxhash64("e"), F.col("m")).cast("int"))
    left = dealt.select("c", F.col("e").alias("a"), F.col("b").alias("x"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("y"))
    right = dealt.select("c", F.col("e").alias("b"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("x"), F.col("b").alias("y"))
    edges = left.join(right, ["c", "x", "y"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))
    ends = edges.select(F.explode(F.array("a", "b")).alias("entity"), "weight")
    return edges, ends.groupBy("entity").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))

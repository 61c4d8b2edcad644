"""The corpus pipeline: stages that each take documents and hand on those they keep.

Every stage works on all that the one before kept. All but the last return the columns
of ``documents``; the last returns the encoded documents.

Defined results: a null or empty text has no words, so the quality rules reject it; rows of one id and one text are
one document, of which the Jaccard join keeps one, and of near duplicates that of the smallest id; a row without an id is judged
like any other, and goes if a row with an id is linked to it; empty tables give empty results; columns beside those of ``documents``
are carried along by all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe, decontamination, ngram_jaccard, quality_classifier, quality_rules
from lodestone.operators.durable import durable

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from labels of four in five ids."""
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = quality_classifier.fit_quality(docs, _table(spark, sf_dir, "labels"), learn)
    return quality_classifier.score_quality(docs, model).where("predicted = 1").select(docs.columns)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the ratio of trusted to raw n-grams reject."""
    ratios = quality_rules.ratios(docs, quality_rules.trusted(docs, _table(spark, sf_dir, "labels")))
    return quality_rules.judge(docs, ratios).where("kept").select(docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id."""
    return ngram_jaccard.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages make up less than a twentieth of."""
    return decontamination.clean(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of what they decode to."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", encode),
]

#: DuckDB SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder, each one's result kept in the checkpoint folder."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Functions that give tables, for SQL: register them with ``register`` and call them with LATERAL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lodestone.operators.chunking import MAX_CHARS, OVERLAP, check_sizes, fragment_blocks
from lodestone.operators.durable import small_batches
from lodestone.sources.extract import blocks as read_blocks
from lodestone.sources.extract import normalized

#: Texts that are handed to Python at once.
ROWS = 1000
SCHEMA = T.StructType().add("chunk_index", "integer").add("content", "string").add("section_path", T.ArrayType(T.StringType())).add("page_number", "integer")


class Fragments:
    """``fragments(text [, media => 'text/plain', most => 1200, overlap => 150])``: the fragments of one text, or of one file's content.

    A null has none; a text in a media type that is not read, or that cannot be parsed, raises, unlike ``fragment_files``, which gives the error as a row. Sizes
    must be constants, and ones that are out of bounds are refused before anything runs.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, media: AnalyzeArgument | None = None, most: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, T.StringType | T.BinaryType | T.NullType):
            raise ValueError("fragments are made of a string or of binary content")
        for name, given in (("most", most), ("overlap", overlap)):
            if given and (not given.isConstantExpression or not isinstance(given.value, int)):
                raise ValueError(f"{name} must be a whole number that is the same for all rows")
        check_sizes(most.value if most else MAX_CHARS, overlap.value if overlap else OVERLAP)
        return AnalyzeResult(SCHEMA)

    def eval(self, text: str | bytes | None, media: str | None = "text/plain", most: int = MAX_CHARS, overlap: int = OVERLAP) -> Iterator[tuple]:
        if text is None or media is None:
            return
        plain = isinstance(text, str) and media == "text/plain"
        found = [(normalized(text), [], None)] if plain else read_blocks(media, text.encode() if isinstance(text, str) else bytes(text))
        for k, (content, path, page) in enumerate(fragment_blocks(found, most, overlap)):
            yield k, content, path, page


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session's SQL. Rows go to Python and back in small Arrow batches: all fragments of a batch are held at once."""
    small_batches(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ROWS:
        spark.conf.set(rows, str(ROWS))
    spark.udtf.register("fragments", udtf(Fragments, useArrow=True))

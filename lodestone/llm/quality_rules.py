"""Quality rules in DataFrame operations only: counts of each text, two base rules, and
a hashed n-gram log-likelihood ratio.

Tokens are runs of letters and digits and runs of other visible characters. Each token
and each pair of neighbouring tokens falls into a bucket by its hash. Over a trusted target
and over the raw corpus the buckets are counted as two multinomials; a text's score is the
mean, over its n-grams, of the log of the ratio of the two. Ratios are whole numbers of
``SCALE`` parts, so a score does not depend on the order of addition, and a text is kept if
its score is at least the threshold.

Defined results: a null text has no words and fails the base rules, as does an empty one;
every row is counted and judged for itself; if the target is empty all ratios are zero and
the base rules alone decide. Columns of the input are kept; those named like a result
are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.durable import small

#: Buckets of single tokens, and as many of pairs.
BUCKETS = 1 << 14
SCALE = 1000
#: Ids of trusted rows that are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Mean log ratio (natural) below which a text is rejected.
THRESHOLD = -0.3

_SPACE = r"[\x20\x09-\x0D]+"
_SOLID = r"[^\x20\x09-\x0D]"
_SYMBOLS = r"[#*$%&|<>]"
_TOKENS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def counts(words: str, text: str) -> dict[str, Column]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words by the names of the columns of
    a row's words and text."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(_SOLID))
    grams = f"transform(sequence(0, size({words}) - 3), i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2]))"
    return {
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(_SYMBOLS)).cast("long"),
        "_lines": lines,
        "_grams": F.when(F.size(words) >= 3, F.expr(grams)).otherwise(F.array().cast("array<bigint>")),
    }


#: The windows in the order of their hashes, if any is found twice.
_SORTED = """CASE WHEN size(array_distinct(_grams)) = size(_grams) THEN cast(array() AS array<struct<g: bigint, i: int>>)
  ELSE sort_array(transform(_grams, (g, i) -> struct(g, i))) END"""
#: The positions of those that have an equal neighbour.
_FOUND = """CASE WHEN size(_sorted) = 0 THEN cast(array() AS array<int>) ELSE array_sort(transform(filter(sequence(0, size(_sorted) - 1),
  j -> (j > 0 AND _sorted[j].g = _sorted[greatest(j - 1, 0)].g) OR (j + 1 < size(_sorted) AND _sorted[j].g = _sorted[least(j + 1, size(_sorted) - 1)].g)), j -> _sorted[j].i)) END"""
#: The words that these windows of three cover.
_REPEATS = "aggregate(_found, struct(0L AS n, 0 AS reach), (t, p) -> struct(t.n + (p + 3 - greatest(p, t.reach)) AS n, p + 3 AS reach), t -> t.n)"


def ratios(raw: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS, smooth: float = 1.0) -> np.ndarray:
    """Log ratios of target to raw by bucket, in parts of ``SCALE``; single tokens first, then pairs.
    What comes to the driver is one row for each bucket, whatever the corpus."""

    def counted(texts: DataFrame) -> dict[int, int]:
        tokens = texts.select(F.regexp_extract_all(text_col, F.lit(_TOKENS), F.lit(0)).alias("t")).where(F.size("t") > 0)
        both = tokens.withColumn("t2", F.slice("t", F.lit(2), F.size("t"))).select(F.explode(F.arrays_zip("t", "t2")).alias("p"))
        single = F.pmod(F.xxhash64("p.t"), F.lit(buckets))
        pair = F.when(F.col("p.t2").isNotNull(), F.pmod(F.xxhash64("p.t", "p.t2"), F.lit(buckets)) + buckets)
        return {r.bucket: r.n for r in both.select(F.explode(F.array(single, pair)).alias("bucket")).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n")).toLocalIterator()}

    def logs(count: dict[int, int]) -> np.ndarray:
        c = np.zeros(2 * buckets)
        for k, n in count.items():
            c[k] = n
        return np.concatenate([np.log((part + smooth) / (part.sum() + smooth * buckets)) for part in (c[:buckets], c[buckets:])])

    theirs = counted(target)
    if not theirs:
        return np.zeros(2 * buckets, np.int64)
    return np.rint((logs(theirs) - logs(counted(raw))) * SCALE).astype(np.int64)


def judge(docs: DataFrame, table: np.ndarray, text_col: str = "text", columns: list[str] | None = None, threshold: float = THRESHOLD, least_words: int = 50, most_repeats: int = 50) -> DataFrame:
    """``docs`` (or just ``columns`` of it) with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, ``base_failed`` (fewer than ``least_words`` words, or more than ``most_repeats`` per
    cent of them in repeats), ``llr`` and ``kept``. No shuffle."""
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
    kept = [F.col(c) for c in (columns or docs.columns) if c not in added]
    buckets = len(table) // 2
    ratio = F.from_json(F.lit("[" + ",".join(map(str, table.tolist())) + "]"), "array<int>")
    rows = docs.select(*kept, F.coalesce(text_col, F.lit("")).alias("_text"))
    rows = rows.withColumn("_words", F.filter(F.split("_text", _SPACE), lambda w: w != ""))
    rows = rows.withColumns(counts("_words", "_text"))
    rows = rows.withColumns({
        "n_words": F.size("_words").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_sorted": F.expr(_SORTED),
        "_tokens": F.regexp_extract_all("_text", F.lit(_TOKENS), F.lit(0)),
    })
    rows = rows.withColumns({"_found": F.expr(_FOUND), "_next": F.slice("_tokens", F.lit(2), F.greatest(F.size("_tokens"), F.lit(1)))})
    rows = rows.withColumn("n_repeat_words", F.expr(_REPEATS))
    at = lambda first, *of: F.get(ratio, (F.pmod(F.xxhash64(*of), F.lit(buckets)) + first).cast("int"))
    parts = F.zip_with("_tokens", "_next", lambda a, b: at(0, a) + F.when(b.isNull(), 0).otherwise(at(buckets, a, b)))
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda t, p: t + p) if table.any() else F.lit(0)
    rows = rows.withColumn("llr", F.coalesce(total / F.greatest(2 * F.size("_tokens") - 1, F.lit(1)) / SCALE, F.lit(0.0)))
    # the partition's number keeps Catalyst from moving a filter on the verdict below the
    # columns above, where it would write each of them out wherever it is used
    here = F.spark_partition_id() >= 0
    rows = rows.withColumn("base_failed", here & ((F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).select(*kept, *added)


def trusted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` whose id has the label 1. Texts are not shuffled while the ids can be broadcast."""
    good = labels.where(F.col(label_col) == 1).select(id_col).distinct()
    return docs.join(small(good, BROADCAST_IDS), id_col, "left_semi")

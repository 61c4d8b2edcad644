"""Benchmark decontamination by winnowing, in DataFrame operations only.

Each text is a sequence of words. Of every ``words - k + 1`` neighbouring k-grams the
smallest hash is kept, wherever it stands; so any span of ``words`` words that a document
and an item share leaves a common fingerprint. Fingerprints are joined, and each
hit is extended over its diagonal (the same shift between document and item) to
the runs of equal words. Runs of ``words`` words or more, or of a whole shorter item,
are what the two share. Fingerprints are taken of lower-cased words; runs are
confirmed on words in which only A-Z is lower-cased.

Items of fewer words than a window are found by all k-grams of just their length.

Defined results: a null or empty text has no words and no hits; equal texts are
compared once and every row gets the result; benchmark rows without an id or words
are left out, repeated ones count once by id; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.durable import durable, small

#: Every character that is not part of a word (fixed value): ASCII but for 0-9 and a-z.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Up to so many benchmark fingerprints (16 bytes and an id each) are broadcast; more are joined by a shuffle.
BROADCAST_FINGERPRINTS = 200_000
#: The same for texts with hits.
BROADCAST_TEXTS = 100_000


def split_words(text: Column) -> Column:
    """Words of a text in which A-Z is lower-cased already."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAPS), lambda w: w != "")


def exact_words(text: Column) -> Column:
    return split_words(F.translate(text, _UPPER, _LOWER))


def _gram_hashes(h: str, k: int) -> str:
    """SQL: the hashes of the k-grams of an array of word hashes."""
    return f"transform(sequence(0, size({h}) - {k}), i -> xxhash64({', '.join(f'{h}[i + {j}]' for j in range(k))}))"


def _least(g: str, window: int) -> str:
    """SQL: the least of each ``window`` neighbouring k-grams."""
    return f"transform(sequence(1, size({g}) - {window - 1}), s -> array_min(slice({g}, s, {window})))" if window > 1 else g


def _hashed(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, F.transform("w", lambda w: F.xxhash64(w)).alias("h"))


def _grams(rows: DataFrame, k: int, window: int, keep: tuple[str, ...]) -> DataFrame:
    """(keep, g, m): the hashes of a row's k-grams and the least of each ``window`` neighbouring ones. ``rows`` has ``w``,
    the array of words; rows too short for a window are left out."""
    rows = _hashed(rows.where(F.size("w") >= k + window - 1), *keep).select(*keep, F.expr(_gram_hashes("h", k)).alias("g"))
    return rows.select(*keep, "g", F.expr(_least("g", window)).alias("m"))


def minima(rows: DataFrame, families: list[tuple[int, int]], *keep: str) -> DataFrame:
    """(keep, family, f): the distinct fingerprints of each row, for each family, a length of k-grams and a window. The words of a row are
    split and hashed once for all of them."""
    none = "cast(array() AS array<struct<family: int, f: bigint>>)"
    each = []
    for t, (k, window) in enumerate(families):
        least = f"transform(array({_gram_hashes('h', k)}), g -> array_distinct({_least('g', window)}))[0]"
        each.append(f"CASE WHEN size(h) >= {k + window - 1} THEN transform({least}, f -> struct({t} AS family, f AS f)) ELSE {none} END")
    return _hashed(rows, *keep).select(*keep, F.explode(F.expr(f"flatten(array({', '.join(each)}))")).alias("e")).select(*keep, "e.family", "e.f")


def fingerprints(rows: DataFrame, k: int, window: int, *keep: str) -> DataFrame:
    """(keep, i, f): the fingerprints of each row and the words they begin at."""
    # a k-gram is the least of a window it is in if no such window has only smaller minima
    chosen = F.expr(f"""filter(transform(g, (f, i) -> struct(i, f)), e -> e.f = array_max(slice(m,
        greatest(e.i - {window - 2}, 1), least(e.i + 1, size(m)) - greatest(e.i - {window - 2}, 1) + 1)))""")
    return _grams(rows, k, window, keep).select(*keep, F.explode(chosen).alias("e")).select(*keep, "e.i", "e.f")


def shared_runs(docs: DataFrame, items: DataFrame, words: int, k: int) -> DataFrame:
    """(key, item, s, e): the words s to e (past the last) that a text shares with an item.
    ``docs`` has key and text, ``items`` item and text."""
    items = durable(items.select("item", exact_words(F.col("text")).alias("iw"), split_words(F.lower("text")).alias("w")).where(F.size("w") > 0))
    short = [r.n for r in items.where(F.size("iw") < words).select(F.size("iw").alias("n")).distinct().orderBy("n").collect()]
    every = docs.select("key", split_words(F.lower("text")).alias("w"))
    families = [(k, words - k + 1, F.size("iw") >= words), *((m, 1, F.size("iw") == m) for m in short)]
    theirs = []
    for size, window, which in families:
        own = fingerprints(items.where(which), size, window, "item").select("item", F.col("i").alias("q"), "f")
        theirs.append(small(durable(own), BROADCAST_FINGERPRINTS))
    known = reduce(DataFrame.union, [own.select(F.lit(t).alias("family"), "f").distinct() for t, own in enumerate(theirs)])
    met = minima(every, [(size, window) for size, window, _ in families], "key").join(small(durable(known), BROADCAST_FINGERPRINTS), ["family", "f"], "left_semi").select("key")
    # texts that share a fingerprint with any item, one of each; only for these are places looked up
    keys = small(durable(met.distinct()))
    texts = durable(docs.join(keys, "key", "left_semi").dropDuplicates(["key"]).select("key", exact_words(F.col("text")).alias("dw"), split_words(F.lower("text")).alias("w")))
    found = [fingerprints(texts, size, window, "key").join(own, "f").select("key", "item", (F.col("i") - F.col("q")).alias("shift")) for (size, window, _), own in zip(families, theirs, strict=True)]
    hits, texts = reduce(DataFrame.union, found).distinct(), texts.select("key", "dw")
    both = hits.join(texts, "key").join(items.select("item", "iw"), "item")
    both = both.withColumns({"a": F.greatest("shift", F.lit(0)), "b": F.greatest(-F.col("shift"), F.lit(0))})
    both = both.withColumn("n", F.least(F.size("dw") - F.col("a"), F.size("iw") - F.col("b"))).where("n > 0")
    apart = F.expr("concat(array(-1), filter(sequence(0, n - 1), j -> dw[a + j] <> iw[b + j]), array(n))")
    both = both.select("key", "item", "a", F.least(F.size("iw"), F.lit(words)).alias("least"), apart.alias("x"))
    runs = F.expr("filter(transform(sequence(0, size(x) - 2), t -> struct(a + x[t] + 1 AS s, a + x[t + 1] AS e)), r -> r.e - r.s >= least)")
    return both.select("key", "item", F.explode(runs).alias("r")).select("key", "item", "r.s", "r.e")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", words: int = 13, k: int = 6, share: int = 20) -> DataFrame:
    """For each row its id, ``n_words``, ``n_hit`` (words inside what it shares with items),
    ``n_items``, ``items`` (ids as sorted strings) and ``contaminated`` (n_hit > 0 and
    share * n_hit >= n_words)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("key", F.md5("text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).where("item IS NOT NULL")
    runs = durable(shared_runs(rows.where("text IS NOT NULL").select("key", "text"), items, words, k))
    covered = F.expr("""aggregate(array_sort(spans), struct(0 AS n, 0 AS reach),
        (t, r) -> struct(t.n + greatest(r.e - greatest(r.s, t.reach), 0) AS n, greatest(t.reach, r.e) AS reach), t -> t.n)""")
    spans = runs.groupBy("key").agg(F.collect_set(F.struct("s", "e")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    spans = small(durable(spans.select("key", covered.cast("long").alias("n_hit"), "items")), BROADCAST_TEXTS)
    out = rows.select("id", "key", F.size(split_words(F.lower("text"))).cast("long").alias("n_words")).join(spans, "key", "left")
    out = out.select("id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    key = F.md5(text_col)
    found = contamination(docs.select(key.alias("key"), F.col(text_col).alias("text")), benchmark, "key", "text", **options)
    return docs.join(small(durable(found.where("contaminated").select(F.col("key").alias("_found")).distinct())), key == F.col("_found"), "left_anti")

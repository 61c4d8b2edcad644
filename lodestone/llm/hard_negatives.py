"""Hard negatives for labelled vectors: rows of another label that score almost as high for an anchor as one of its own.

Components are made whole numbers, so that scores are exact. Rows are dealt into blocks once each, and the anchors, a small part of
the rows, are read by every block; no row is copied for them. Of each anchor a block sorts all of its scores, packed with the
row's place by id into one number; then

1. the best rows of the anchor's label are its block's candidates for positives, of which a window takes the first;
2. for each positive a binary search finds where scores come down to its own, and from there rows of other labels are read until there are
   enough or the scores pass the lower limit; a window ranks what the blocks have read.

So no task holds more than a block of rows and a batch of anchors, and both windows hold a few rows for each anchor and block.

Defined results: rows with a null id, label or vector, or a component that is null or not finite, take no part; of anchors with one id the
least (label, vector) stands for it, all other rows of one id count each; an anchor's own id is never its positive, and positives of one id and score are one; a shorter
vector is followed by zeros; a score outside of 64 bits is the nearest number inside; no rows give none; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.durable import durable

#: Rows of a block, and the fewest for which it is worth dealing one more.
MOST_ROWS, LEAST_ROWS = 1 << 17, 1 << 13
#: Scores that are sorted at once, 8 bytes each.
SCORES = 1 << 22
#: Rows of a block are placed by so many bits.
_BITS = 17


def usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, v) of the rows that take part."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad)


def _blocks(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """(block, late, id, label, v, goals): each row in one block, and every anchor in every block, after its rows."""
    n, most = rows.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a block of twice its mean size would still be placed by _BITS: ids that are alike are dealt by their hash
    blocks = max(1, -(-2 * n // MOST_ROWS), min(most, n // LEAST_ROWS))
    own = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("late"), "id", "label", "v", F.lit(None).cast(_GOALS).alias("goals"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("late"), "id", "label", "v", "goals")
    return own.unionByName(asked).repartition(min(blocks, 4 * most), "block").sortWithinPartitions("block", "late", "id", "label")


_GOALS = "array<struct<id:bigint,score:bigint>>"


def _whole(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """floor(256 x) of each component, as whole doubles, shorter rows filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = np.floor(256 * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = max(int(sizes.max(initial=0)), 1) if width is None else width
    out = np.zeros((len(lists), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact: as doubles while these can be, else as whole numbers of any size, held in 64 bits."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * width
    if bound < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, 1 - 2**63, 2**63 - 1).astype(np.int64)


class _Block:
    """Rows of a block, by id."""

    def __init__(self, parts: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(parts).combine_chunks()
        self.ids = table.column("id").to_numpy()
        self.labels = table.column("label").to_numpy()
        lists = table.column("v").combine_chunks()
        self.v = _whole(lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists)

    def sorted(self, anchors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each anchor its number, the scores of all rows, least first, and the rows in that order: of equal scores the greatest id comes
        first, so that reading backwards gives the highest scores and least ids."""
        n = len(self.ids)
        place = np.arange(n - 1, -1, -1)
        step = max(1, SCORES // max(n, 1))
        for k in range(0, len(anchors), step):
            scores = _scores(anchors[k : k + step], self.v)
            if n <= 1 << _BITS and np.abs(scores).max(initial=0) < 2**46:
                packed = np.sort((scores << _BITS) | place, axis=1)
                for j, row in enumerate(packed):
                    yield k + j, row >> _BITS, n - 1 - (row & ((1 << _BITS) - 1))
            else:  # a score and a place no longer fit one number
                for j, row in enumerate(scores):
                    order = np.lexsort((place, row))
                    yield k + j, row[order], order


def _backwards(order: np.ndarray, good: np.ndarray, end: int, start: int, most: int) -> np.ndarray:
    """Places below ``end``, not below ``start``, from the last, whose row is ``good``: the first ``most``. Looked at in growing pieces."""
    found, piece = [], 4 * most + 16
    while end > start and most > 0:
        low = max(start, end - piece)
        some = np.flatnonzero(good[order[low:end]])[::-1][:most] + low
        found.append(some)
        most -= len(some)
        end, piece = low, 4 * piece
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _read(blocks: DataFrame, find, schema: str) -> DataFrame:
    """What ``find(block, anchors)`` gives for each batch of anchors, over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            key = np.stack([batch.column("block").to_numpy(), batch.column("late").to_numpy()], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if key[a, 0] != at:
                    at, held, block = key[a, 0], [], None
                part = batch.slice(a, b - a)
                if not key[a, 1]:
                    held.append(part)
                elif held:
                    block = block or _Block(held)
                    yield find(block, part)

    return blocks.mapInArrow(run, schema)


def _batch(columns: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in columns], names)


def _array(column: pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def positives_of(rows: DataFrame, anchors: DataFrame, most: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score): the ``most`` best other rows of each anchor's label."""

    def find(block: _Block, part: pa.RecordBatch) -> pa.RecordBatch:
        ids, labels, columns = part.column("id").to_numpy(), part.column("label").to_numpy(), [[], [], []]
        for k, scores, order in block.sorted(_whole(part.column("v"))):
            at = _backwards(order, (block.labels == labels[k]) & (block.ids != ids[k]), len(order), 0, most)
            for column, values in zip(columns, (np.full(len(at), ids[k]), block.ids[order[at]], scores[at]), strict=True):
                column.append(values)
        return _batch(columns, ["anchor_id", "positive_id", "positive_score"])

    found = _read(_blocks(rows, anchors.withColumn("goals", F.lit(None).cast(_GOALS))), find, "anchor_id long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most).drop("_n")


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (``is_anchor``, of the column ``id``) and each of its first
    ``positives`` rows of the same label, the first ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score; the highest scores first, of equal ones the least id."""
    rows = usable(rows, id_col, label_col, vector_col)
    anchors = rows.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "v")).alias("a")).select("id", "a.label", "a.v")
    goals = durable(positives_of(rows, anchors, positives)).groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_set(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score")))).alias("goals"))

    def find(block: _Block, part: pa.RecordBatch) -> pa.RecordBatch:
        ids, labels, columns = part.column("id").to_numpy(), part.column("label").to_numpy(), [[], [], [], [], []]
        wanted = _array(part.column("goals")).to_pylist()
        for k, scores, order in block.sorted(_whole(part.column("v"))):
            other = block.labels != labels[k]
            for goal in wanted[k]:
                most, least = high * goal["score"] // 100, -(-low * goal["score"] // 100)
                end = int(np.searchsorted(scores, most, "right")) if most < 2**63 - 1 else len(scores)
                start = int(np.searchsorted(scores, max(least, -(2**63)), "left")) if least < 2**63 else len(scores)
                at = _backwards(order, other, end, start, negatives)
                for column, values in zip(columns, (np.full(len(at), ids[k]), np.full(len(at), goal["id"]), block.ids[order[at]], np.full(len(at), goal["score"]), scores[at]), strict=True):
                    column.append(values)
        return _batch(columns, names)

    names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
    found = _read(_blocks(rows, anchors.join(goals, "id")), find, ", ".join(f"{n} long" for n in names))
    best = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

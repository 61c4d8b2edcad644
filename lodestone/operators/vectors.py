"""A table of vectors (collection, record_id, document_id, embedding, ...) and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Queries that are sent to the vectors as they are, and bytes of vectors that a task holds at once for more.
QUERY_BLOCK, BLOCK_BYTES = 2048, 64 << 20
#: Distances that a task works out at once.
DISTANCES = 1 << 22
#: Vectors of which one result of single precision is kept.
GROUP = 64


def upsert(vectors: DataFrame, fresh: DataFrame) -> DataFrame:
    """``vectors`` with the rows of ``fresh`` in place of those of the same collection and record."""
    key = ["collection", "record_id"]
    return vectors.join(fresh.select(key), key, "left_anti").unionByName(fresh.dropDuplicates(key))


def delete_documents(vectors: DataFrame, documents: DataFrame) -> DataFrame:
    return vectors.join(documents.select("document_id").distinct(), "document_id", "left_anti")


def collection_counts(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("collection").agg(F.count("*").alias("records"))


def dangling(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors whose fragment is no longer there."""
    return vectors.join(chunks.select(F.col("chunk_id").alias("record_id")), "record_id", "left_anti")


def cosine_distance(a: str, b: str) -> str:
    """SQL for 1 - cosine of two arrays; a vector without length has distance 1 to any."""
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> cast(p AS double) * q), 0D, (t, v) -> t + v)"
    return f"1 - coalesce({dot(a, b)} / nullif(sqrt({dot(a, a)}) * sqrt({dot(b, b)}), 0D), 0D)"


def nearest(vectors: DataFrame, queries: DataFrame, top: int, id_col: str = "record_id") -> DataFrame:
    """(query_id, record_id, distance, rank): of each query (query_id, embedding) the ``top`` vectors of least cosine
    distance, to nine digits, then least id.

    Up to ``QUERY_BLOCK`` queries are sent to the vectors, which stay where they are. For more, vectors are dealt into blocks of up to ``BLOCK_BYTES`` and queries into lots, so
    that there are as many pairs of these as tasks; the queries of a lot stream past a block that one task holds. Neither is shuffled more often than there are lots or blocks. A task
    keeps the best ``top`` of each query, and a window ranks what the tasks have kept.

    Null vectors and queries take no part; a vector without length has distance 1 to any; all vectors have one length, else this raises;
    rows of one id count each, and queries of one id are one query; no vectors or no queries give no rows.
    """
    kind, record = queries.schema["query_id"], vectors.schema[id_col]
    if top <= 0:
        return queries.sparkSession.createDataFrame([], T.StructType([*_found(kind.dataType, record.dataType), T.StructField("rank", T.IntegerType())])).withColumnRenamed("record", id_col)
    # single precision, where both have it, is shuffled as it is and made double in the tasks
    both = {getattr(t.schema["embedding"].dataType, "elementType", None) for t in (vectors, queries)}
    e = F.col("embedding").cast("array<float>" if both == {T.FloatType()} else "array<double>").alias("e")
    asked = queries.select("query_id", e).where("e IS NOT NULL")
    rows = vectors.where("embedding IS NOT NULL").select(F.col(id_col).alias("record"), e)
    few = asked.limit(QUERY_BLOCK + 1).toArrow()
    if few.num_rows <= QUERY_BLOCK:
        best = rows.mapInArrow(_search(few.combine_chunks(), top), _found(kind.dataType, record.dataType))
    else:
        size = rows.agg(F.count("*").alias("n"), F.max(F.size("e")).alias("width")).first()
        n = block_count(rows, size.n, size.width or 1)
        # blocks are few, since each looks at all queries; tasks come of dealing out the queries as well, each of which meets every block once
        lots = max(1, -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // n))
        each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
        own = rows.select((F.pmod(F.xxhash64("record", "e"), F.lit(n)) * lots).alias("b"), each(lots).alias("lot"), "record", "e").select((F.col("b") + F.col("lot")).alias("block"), "record", "e")
        every = asked.select(each(n).alias("b"), F.pmod(F.xxhash64("query_id"), F.lit(lots)).alias("lot"), "query_id", "e").select((F.col("b") * lots + F.col("lot")).alias("block"), "query_id", "e")
        best = met(own, every, top)
    return first(best, top).withColumnRenamed("record", id_col)


def _found(query: T.DataType, record: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("query_id", query), T.StructField("record", record), T.StructField("distance", T.DoubleType())])


def first(best: DataFrame, top: int) -> DataFrame:
    """``best`` (query_id, record, distance) with ``rank``, up to ``top``."""
    order = Window.partitionBy("query_id").orderBy("distance", "record")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def block_count(rows: DataFrame, n: int, width: int) -> int:
    """Blocks that n vectors are dealt into: as many as their bytes need, or, of 16,384 vectors at least, as the root of the number of tasks."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-8 * n * width // BLOCK_BYTES), min(round(tasks**0.5), n // 16384))


def met(rows: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    """(query_id, record, distance): for each query of ``asked`` (block, query_id, e) the best ``top`` vectors of ``rows`` (block, record, e) in its block."""
    record, query = rows.schema["record"].dataType, asked.schema["query_id"].dataType
    own = rows.select("block", F.lit(0).alias("late"), F.lit(None).cast(query).alias("query_id"), "record", "e")
    both = own.unionByName(asked.select("block", F.lit(1).alias("late"), "query_id", F.lit(None).cast(record).alias("record"), "e"))
    return both.repartition("block").sortWithinPartitions("block", "late").mapInArrow(_search(None, top), _found(query, record))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Unit rows; a vector without length stays zero."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    if not len(lists):
        return np.zeros((0, 0))
    m = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


class _Best:
    """The best ``top`` of each of some queries, as vectors come by."""

    def __init__(self, ids: pa.Array, unit: np.ndarray, top: int) -> None:
        self.ids, self.unit, self.top = ids, unit, top
        self.held: list[tuple[np.ndarray, np.ndarray]] | None = None  # of each query: distances, records

    def look(self, record: np.ndarray, unit: np.ndarray) -> None:
        if not len(self.unit) or not len(record):
            return
        if self.held is None:
            self.held = [(np.zeros(0), record[:0])] * len(self.unit)
        for a in range(0, len(record), 4096):
            own = record[a : a + 4096]
            for q, d in enumerate(np.round(1 - self.unit @ unit[a : a + 4096].T, 9)):
                held, names = self.held[q]
                some = np.flatnonzero(d <= (held[-1] if len(held) == self.top else np.inf))
                if len(some) > 8 * self.top:
                    some = some[d[some] <= np.partition(d[some], self.top)[self.top]]
                if len(some):
                    d, names = np.concatenate([held, d[some]]), np.concatenate([names, own[some]])
                    order = np.lexsort((names, d))[: self.top]
                    self.held[q] = d[order], names[order]

    def rows(self, schema: list[str]) -> Iterator[pa.RecordBatch]:
        if self.held:
            each = [len(d) for d, _ in self.held]
            records, distances = (np.concatenate([h[k] for h in self.held]) for k in (1, 0))
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(np.repeat(np.arange(len(each)), each))), pa.array(records), pa.array(distances)], schema)


def _search(asked: pa.Table | None, top: int):
    """Of batches of vectors (record, e) the best for the queries ``asked``; without these, of batches of blocks."""
    names = ["query_id", "record", "distance"]

    def of(table: pa.Table | pa.RecordBatch) -> _Best:
        ids = table.column("query_id")
        return _Best(ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, _matrix(table.column("e")), top)

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = of(asked)
        for batch in batches:
            best.look(batch.column("record").to_numpy(zero_copy_only=False), _matrix(batch.column("e")))
        yield from best.rows(names)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, held = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("block", "late")], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if key[a, 0] != now:
                    now, waiting, held = key[a, 0], [], None
                part = batch.slice(a, b - a)
                if not key[a, 1]:
                    waiting.append(part)
                elif waiting:
                    if held is None:
                        table = pa.Table.from_batches(waiting)
                        unit = _matrix(table.column("e"))
                        held, waiting = (table.column("record").to_numpy(), unit, unit.astype(np.float32)), [None]
                    yield from _best_of(part, *held, top)

    return given if asked is not None else blocks


def _best_of(part: pa.RecordBatch, records: np.ndarray, unit: np.ndarray, single: np.ndarray, top: int) -> Iterator[pa.RecordBatch]:
    """The best ``top`` of a block for each query of a batch, which may have any number of queries. All pairs are compared in single precision, of which only the
    greatest of each ``GROUP`` vectors is looked at; groups that may hold one of the best, the error of single precision allowed for, are compared again in full."""
    asked, step = _matrix(part.column("e")), max(1, DISTANCES // len(records))
    groups = -(-len(records) // GROUP)
    slack, full = 1e-6 + 1e-7 * unit.shape[1], len(records) // groups * groups
    for a in range(0, len(asked), step):
        own = asked[a : a + step]
        near = own.astype(np.float32) @ single.T
        # group g has the vectors g, g + groups, ...
        peak = near[:, :full].reshape(len(own), -1, groups).max(1)
        np.maximum(peak[:, : len(records) - full], near[:, full:], out=peak[:, : len(records) - full])
        # as many groups as results reach this, so that many vectors do
        least = np.partition(peak, groups - top, axis=1)[:, groups - top] if groups > top else np.full(len(own), -np.inf)
        where, found = [], []
        for q, good in zip(own, peak >= (least - slack)[:, None], strict=True):
            some = (np.flatnonzero(good)[:, None] + groups * np.arange(GROUP)).ravel()
            some = some[some < len(records)]
            d = np.round(1 - unit[some] @ q, 9)
            order = np.lexsort((records[some], d))[:top]
            where.append(some[order])
            found.append(d[order])
        each = pa.array(np.repeat(np.arange(a, a + len(own)), [len(w) for w in where]))
        yield pa.RecordBatch.from_arrays([part.column("query_id").take(each), pa.array(records[np.concatenate(where)]), pa.array(np.concatenate(found))], ["query_id", "record", "distance"])

"""A persisted vector index of coarse cells, exact by the triangle inequality.

Unit vectors are put into the cell of their nearest centre, in a versioned table whose files are sorted by cell, with the distance to
that centre. A cell's radius is the greatest of these distances, so that no member is nearer to a query than the centre's
distance less the radius. A search looks into each query's most promising cells first, which bounds its ``top`` best
distances; a further cell is skipped only if none of its members can be within that bound. So the result is that of comparing every pair.

Centres are learnt once from at most ``SAMPLE`` vectors, those of least hash; every vector is indexed. Inserting and deleting rewrite only the
buckets they touch, as ``versioned`` does, and readers keep their version; radii follow from the rows.

Defined results: as those of ``vectors.nearest``; vectors without length lie in a cell of their own at distance 1 to all; an index of
no vectors gives no rows; a record that is inserted again stands in place of the old one, wherever its cell is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators import vectors as V
from lodestone.operators.durable import durable
from lodestone.operators.vectors import _matrix, first, met
from lodestone.operators.versioned import Table

#: Vectors that centres are learnt from at most, centres at most, and rounds of learning.
SAMPLE, CENTRES, ROUNDS = 1 << 16, 1024, 6
#: Cells that each query looks into first.
PROBES = 4
#: What bounds are widened by: distances are rounded to nine digits.
MARGIN = 1e-8
#: The cell of vectors without length, and that of all others where no centres were learnt.
_NOWHERE, _ANYWHERE = -1, -2
#: Blocks of one cell are numbered within so many.
_IN_CELL = 1 << 24


def learn_centres(sample: np.ndarray, most: int, seed: int = 5) -> np.ndarray:
    """Unit centres of unit vectors, by rounds of assignment and means from a spread-out beginning."""
    rng = np.random.default_rng(seed)
    sample = sample[(sample**2).sum(1) > 0]
    if not len(sample):
        return np.zeros((0, sample.shape[1] if sample.ndim == 2 else 0))
    most = min(most, len(sample))
    centres = sample[rng.choice(len(sample), most, replace=False)]
    for _ in range(ROUNDS):
        own = _nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norm = np.sqrt((sums**2).sum(1, keepdims=True))
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def _nearest(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(unit[a : a + 8192] @ centres.T, 1) for a in range(0, len(unit), 8192)]) if len(unit) else np.zeros(0, np.int64)


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.table = spark, path, Table(spark, f"{path}/vectors")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, id_col: str = "record_id", buckets: int = 16) -> VectorIndex:
        """An index of ``vectors`` (id, embedding) in a folder of its own."""
        spark = vectors.sparkSession
        rows = vectors.where("embedding IS NOT NULL").select(F.col(id_col).alias("record"), F.col("embedding").cast("array<double>").alias("e"))
        some = rows.orderBy(F.xxhash64("record", "e")).limit(SAMPLE).select("e").toArrow()
        n = rows.count()
        centres = learn_centres(_matrix(some.column("e")), int(min(CENTRES, max(1, n**0.5)))) if n else np.zeros((0, 0))
        spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
        schema = T.StructType([T.StructField("record", vectors.schema[id_col].dataType), T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType()), T.StructField("e", T.ArrayType(T.DoubleType()))])
        Table.create(spark, f"{path}/vectors", schema, ["record"], order=["cell"], buckets=buckets)
        out = cls(spark, path)
        out.table.append(out._placed(rows))
        return out

    def centres(self) -> np.ndarray:
        """The centres, at most ``CENTRES`` of them."""
        rows = self.spark.read.parquet(f"{self.path}/centres").toArrow().sort_by("cell")
        return _matrix(rows.column("centre"))

    def _placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` (record, e) with their cells and the distances to its centres."""
        centres = self.centres()

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit = _matrix(batch.column("e"))
                cell, far = np.full(len(unit), _NOWHERE, np.int32), np.ones(len(unit))
                some = np.flatnonzero((unit**2).sum(1) > 0)
                if not len(centres):
                    cell[some] = _ANYWHERE
                elif len(some):
                    cell[some] = _nearest(unit[some], centres)
                    far[some] = np.sqrt(((unit[some] - centres[cell[some]]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([batch.column("record"), pa.array(cell), pa.array(far), batch.column("e")], ["record", "cell", "far", "e"])

        return rows.mapInArrow(place, T.StructType([rows.schema["record"], T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType()), T.StructField("e", T.ArrayType(T.DoubleType()))]))

    def insert(self, vectors: DataFrame, id_col: str = "record_id") -> int:
        """Puts vectors in, in place of those of the same ids; the new version. A null vector changes nothing."""
        rows = vectors.where("embedding IS NOT NULL").select(F.col(id_col).alias("record"), F.col("embedding").cast("array<double>").alias("e"))
        return self.table.upsert(self._placed(rows))

    def remove(self, records: DataFrame, id_col: str = "record_id") -> int:
        return self.table.delete(records.select(F.col(id_col).alias("record")))

    def cells(self, version: int | None = None) -> DataFrame:
        """(cell, n, radius) of the cells that hold vectors; one row for each centre at most."""
        return self.table.read(version).groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.max(F.size("e")).alias("width"))

    def search(self, queries: DataFrame, top: int, version: int | None = None, id_col: str = "record_id") -> DataFrame:
        """(query_id, record_id, distance, rank) as ``vectors.nearest`` gives it."""
        return self._search(queries, top, version)[0].withColumnRenamed("record", id_col)

    def share_compared(self, queries: DataFrame, top: int, version: int | None = None) -> float:
        """The share of all pairs of a query and a vector that a search compares."""
        _, looked, sizes = self._search(queries, top, version)
        pairs = looked.join(F.broadcast(sizes), "cell").agg(F.sum("n").alias("pairs"), F.count_distinct("query_id").alias("queries")).first()
        n = sizes.agg(F.sum("n")).first()[0] or 0
        return (pairs.pairs or 0) / (n * pairs.queries) if n and pairs.queries else 0.0

    def _search(self, queries: DataFrame, top: int, version: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        version = self.table.snapshot(version).version  # all steps read the same one
        rows = self.table.read(version)
        held = self.cells(version).toArrow().sort_by("cell")
        cell, radius, count, width = (held.column(c).to_numpy() for c in ("cell", "radius", "n", "width"))
        per_block = max(1, V.BLOCK_BYTES // (8 * int(width.max(initial=1))))
        blocks = -(-count // per_block)
        sizes = self.spark.createDataFrame(list(zip(cell.tolist(), count.tolist(), blocks.tolist(), strict=True)), "cell int, n long, blocks long")
        asked = durable(queries.select("query_id", F.col("embedding").cast("array<double>").alias("e")).where("e IS NOT NULL"))
        centres, query = self.centres(), asked.schema["query_id"]
        schema = T.StructType([query, T.StructField("cell", T.IntegerType()), T.StructField("blocks", T.LongType()), T.StructField("e", T.ArrayType(T.DoubleType()))])

        def cells_of(skip: bool):
            """The first cells of each query; with ``skip``, the others that may hold a vector within its ``bound``."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    unit = _matrix(batch.column("e"))
                    if not len(cell) or not len(unit):
                        continue
                    near = np.ones((len(unit), len(cell)))  # the least distance that a member can have
                    real = cell >= 0
                    if real.any():
                        apart = np.sqrt(np.maximum(0, (unit**2).sum(1)[:, None] + 1 - 2 * unit @ centres[cell[real]].T))
                        near[:, real] = np.maximum(0, apart - radius[real] - MARGIN) ** 2 / 2
                    near[:, cell == _ANYWHERE] = 0
                    near[(unit**2).sum(1) == 0] = 1
                    rank = np.argsort(np.argsort(near, 1, kind="stable"), 1, kind="stable")
                    take = rank < PROBES
                    if skip:
                        bound = batch.column("bound").to_numpy(zero_copy_only=False)
                        take = ~take & ((near <= bound[:, None] + MARGIN) | np.isnan(bound)[:, None])
                    who, which = np.nonzero(take)
                    yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(who)), pa.array(cell[which].astype(np.int32)), pa.array(blocks[which].astype(np.int64)), batch.column("e").take(pa.array(who))], ["query_id", "cell", "blocks", "e"])

            return run

        number = lambda sub: F.col("cell").cast("long") * _IN_CELL + sub
        own = rows.join(F.broadcast(sizes), "cell").select(number(F.pmod(F.xxhash64("record", "e"), F.col("blocks"))).alias("block"), "record", "e")

        def look(pairs: DataFrame) -> DataFrame:
            each = pairs.select("query_id", "cell", "e", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("sub"))
            return met(own, each.select("query_id", number(F.col("sub")).alias("block"), "e"), top)

        early = durable(asked.mapInArrow(cells_of(False), schema))
        found = durable(look(early))
        bounds = first(found, top).where(F.col("rank") == top).select("query_id", F.col("distance").alias("bound"))
        late = durable(asked.join(bounds, "query_id", "left").mapInArrow(cells_of(True), schema))
        best = first(found.unionByName(look(late)), top)
        return best, early.select("query_id", "cell").unionByName(late.select("query_id", "cell")), sizes

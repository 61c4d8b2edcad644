"""The vector index against comparing every pair."""

import random

import pytest

from lodestone.operators import vector_index, vectors
from lodestone.operators.vector_index import VectorIndex

SCHEMA = "record_id string, embedding array<double>"


def clustered(rng, n, dims=6):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(8)]
    return [[x + rng.gauss(0, 0.1) for x in rng.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize("block_bytes", [64 << 20, 20 * 8 * 6])
def test_search_equals_all_pairs(spark, tmp_path, monkeypatch, block_bytes):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(vector_index, "PROBES", 2)
    rng = random.Random(2)
    rows = [(f"r{k}", v) for k, v in enumerate(clustered(rng, 400))] + [("z", [0.0] * 6), ("n", None)] + [(f"same{k}", [1.0] * 6) for k in range(60)]
    base = spark.createDataFrame(rows, SCHEMA).repartition(4)
    index = VectorIndex.build(base, str(tmp_path / "index"), buckets=4)
    asked = [(k, v) for k, v in enumerate(clustered(rng, 30))] + [(100, [1.0] * 6), (101, [0.0] * 6), (102, None), (103, rows[0][1])]
    queries = spark.createDataFrame(asked, "query_id int, embedding array<double>")
    want = lambda df: sorted(map(tuple, vectors.nearest(df, queries, 7).collect()))
    got = lambda version=None: sorted(map(tuple, index.search(queries, 7, version).collect()))
    before = want(base)
    assert got() == before and len(before) == 33 * 7
    # vectors move to other cells, new ones come, some go
    fresh = spark.createDataFrame([("r1", [-x for x in rows[1][1]]), ("new", [1.0] * 6), ("z", rows[5][1]), ("m", None)], SCHEMA)
    index.insert(fresh)
    index.remove(spark.createDataFrame([("same3",), ("r7",), ("never",)], "record_id string"))
    ids = {"r1", "new", "z", "same3", "r7"}
    now = base.where(~base.record_id.isin(*ids)).unionByName(fresh)
    assert got() == want(now)
    assert got(1) == before  # readers of a version keep it
    assert 0 < index.share_compared(queries, 7) < 1


def test_odd_indices(spark, tmp_path):
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    empty = VectorIndex.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "empty"))
    assert empty.search(queries, 3).count() == 0 and empty.share_compared(queries, 3) == 0
    empty.insert(spark.createDataFrame([("a", [2.0, 1.0]), ("b", [0.0, 0.0])], SCHEMA))
    assert [r.record_id for r in empty.search(queries, 3).orderBy("rank").collect()] == ["a", "b"]
    one = VectorIndex.build(spark.createDataFrame([("a", [3.0, 0.0])], SCHEMA), str(tmp_path / "one"))
    assert [(r.record_id, r.distance, r["rank"]) for r in one.search(queries, 3).collect()] == [("a", 0.0, 1)]
    assert one.search(queries.limit(0), 3).count() == 0

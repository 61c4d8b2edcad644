"""Vectors as bytes."""

import numpy as np
import pytest
from pyspark.sql import types as T

from lodestone.operators.embedding import hashed_vector
from lodestone.operators.packed import packed, unpacked
from lodestone.operators.versioned import Table


def test_bytes_give_back_every_bit():
    rng = np.random.default_rng(1)
    odd = np.zeros(70_000)
    odd[[0, 69_999]] = [-0.0, np.nan]
    some = [np.zeros(0), np.zeros(1), np.ones(3), odd, np.array([-0.0, 0.0, np.inf, 5e-324]), hashed_vector("a few words of a text")]
    some += [np.where(rng.random(n) < p, rng.normal(size=n), 0.0) for n in (5, 1024, 65_536, 65_537) for p in (0.001, 0.1, 0.79, 0.81, 1.0)]
    for v in some:
        assert unpacked(packed(v)).tobytes() == v.tobytes() and len(packed(v)) <= 4 + 8 * len(v)
    assert packed(None) is None and unpacked(None) is None
    assert len(packed(hashed_vector("a few words of a text"))) < 80


def test_tables_show_packed_columns_as_arrays(spark, tmp_path):
    schema = "k string, v array<double>"
    frame = lambda *rows: spark.createDataFrame(rows, schema)
    table = Table.create(spark, str(tmp_path / "t"), frame().schema, ["k"], buckets=2, packed=["v"])
    table.append(frame(("a", [0.0, 1.5]), ("b", None), ("c", [])))
    table.upsert(frame(("a", [0.0, 0.0, 2.0])))
    table.replace(frame(("c", [3.0] * 9)))
    table.delete(frame(("b", None)))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert table.read().schema == frame().schema and rows(table.read()) == [("a", [0.0, 0.0, 2.0]), ("c", [3.0] * 9)]
    assert rows(table.read_keys(frame(("a", None)))) == [("a", [0.0, 0.0, 2.0])]
    assert rows(table.changes(2)) == [("b", None, "removed"), ("c", [], "removed"), ("c", [3.0] * 9, "added")]
    table.compact()
    assert rows(table.read()) == [("a", [0.0, 0.0, 2.0]), ("c", [3.0] * 9)]
    with pytest.raises(ValueError, match="doubles"):
        Table.create(spark, str(tmp_path / "u"), T.StructType([T.StructField("k", T.StringType())]), ["k"], packed=["k"])

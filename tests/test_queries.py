"""Every query of the main package against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from lodestone.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(frame):
    def cell(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return ""
        return f"{v:.9g}" if isinstance(v, float) else str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)

    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Versioned tables against plain dictionaries."""

import random
import time

import pytest

from lodestone.operators import versioned
from lodestone.operators.versioned import Conflict, Table

SCHEMA = "document_id string, chunk_index int, content string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def table(spark, tmp_path):
    return Table.create(spark, str(tmp_path / "chunks"), frame(spark, []).schema, ["document_id", "chunk_index"], ["document_id"], ["document_id"], 4)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_changes_equal_a_dictionary(spark, table):
    rng, held, seen = random.Random(1), {}, {}
    for step in range(8):
        some = {(f"d{rng.randrange(8)}", k): f"t{step}" for k in range(rng.randrange(4))}
        match step % 4:
            case 0 | 1:
                table.upsert(frame(spark, [(*k, v) for k, v in some.items()]))
                held |= some
            case 2:
                table.delete(frame(spark, [(d, 0, "") for d, _ in some]))
                held = {k: v for k, v in held.items() if k[0] not in {d for d, _ in some}}
            case 3:
                gone = {d for d, _ in some} | {"d1"}
                table.replace(frame(spark, [(*k, v) for k, v in some.items()]), frame(spark, [(d, 0, "") for d in gone]))
                held = {k: v for k, v in held.items() if k[0] not in gone} | some
        seen[step + 1] = sorted(((*k, v) for k, v in held.items()), key=str)
        assert rows_of(table.read()) == seen[step + 1]
    assert all(rows_of(table.read(v)) == rows for v, rows in seen.items())  # every version is still there
    added, removed = set(seen[8]) - set(seen[3]), set(seen[3]) - set(seen[8])
    got = {tuple(r) for r in table.changes(3).collect()}
    assert got == {(*r, "added") for r in added} | {(*r, "removed") for r in removed}
    assert [r.operation for r in table.history().orderBy("version").collect()][:3] == ["create", "upsert", "upsert"]
    assert table.restore(2) == 9 and rows_of(table.read()) == seen[2]
    table.compact()
    table.vacuum()
    assert rows_of(table.read()) == seen[2] and table.versions() == [10]
    with pytest.raises(ValueError, match="no version 3"):
        table.read(3)


def test_of_two_writers_one_loses_cleanly(spark, table):
    table.append(frame(spark, [("a", 0, "old"), ("b", 0, "old")]))
    base = table.snapshot()
    assert table.upsert(frame(spark, [("a", 0, "first")]), base) == 2
    files = len(table.folder.names("data"))
    with pytest.raises(Conflict):
        table.upsert(frame(spark, [("a", 0, "second")]), base)
    assert rows_of(table.read()) == [("a", 0, "first"), ("b", 0, "old")]
    assert len(table.folder.names("data")) == files and table.versions() == [0, 1, 2]
    # other buckets, and rows that are only added, do not conflict
    other = next(k for k in "bcdefgh" if table._touched(frame(spark, [(k, 0, "")]), base) != table._touched(frame(spark, [("a", 0, "")]), base))
    assert table.upsert(frame(spark, [(other, 5, "x")]), base) == 3
    assert table._commit(base, "append", *table._write(frame(spark, [("a", 7, "y")]), base), None) == 4
    assert {r[:2] for r in rows_of(table.read())} == {("a", 0), ("a", 7), ("b", 0), (other, 5)}


def test_readers_keep_their_snapshot(spark, table):
    table.append(frame(spark, [("a", k, "old") for k in range(3)]))
    before, at = table.read(), time.time()
    table.replace(frame(spark, [("a", 0, "new")]))
    assert rows_of(before) == [("a", k, "old") for k in range(3)] and rows_of(table.read()) == [("a", 0, "new")]
    assert table.version_at(at) == 1
    assert rows_of(table.read_keys(frame(spark, [("a", 9, "")]), 1)) == rows_of(before)
    with pytest.raises(ValueError):
        table.version_at(0)


def test_odd_changes(spark, table, monkeypatch):
    assert table.read().collect() == []
    assert table.append(frame(spark, [])) == 1 and table.upsert(frame(spark, [])) == 2
    table.upsert(frame(spark, [(None, 0, "n"), ("a", None, "m")]))
    table.upsert(frame(spark, [(None, 0, "n2"), ("a", 1, None)]))
    assert len(table.read().collect()) == 4  # a null in the key matches nothing
    with pytest.raises(ValueError, match="columns"):
        table.append(frame(spark, [("a", 0, "x")]).drop("content"))
    with pytest.raises(ValueError, match="none of those"):
        table.replace(frame(spark, [("a", 0, "x")]), frame(spark, [("b", 0, "x")]))
    with pytest.raises(Conflict):
        Table.create(spark, table.path, table.read().schema, ["document_id"])
    monkeypatch.setattr(versioned, "ATTEMPTS", 0)
    with pytest.raises(Conflict):
        table.append(frame(spark, [("a", 0, "x")]))


def test_replace_writes_only_fresh_rows(spark, table, monkeypatch):
    """Rows that stay are not written again until a bucket has many segments; every version stays as it was."""
    held = {(f"d{i}", k): "old" for i in range(12) for k in range(2)}
    table.append(frame(spark, [(*k, v) for k, v in held.items()]))
    seen = {1: dict(held)}
    monkeypatch.setattr(versioned, "DEEP", 4)
    monkeypatch.setattr(versioned, "BROADCAST_KEYS", 2)
    for step in range(5):
        before = set(table.folder.names("data"))
        version = table.replace(frame(spark, [("d0", 0, f"new{step}")]), frame(spark, [("d0", 0, ""), ("d1", 0, "")] if step == 1 else [("d0", 0, "")]))
        held = {k: v for k, v in held.items() if k[0] != "d0" and (step != 1 or k[0] != "d1")} | {("d0", 0): f"new{step}"}
        seen[version] = dict(held)
        (segment,) = set(table.folder.names("data")) - before
        written = [r for b in table.folder.names(f"data/{segment}") if b.startswith("_bucket=") for r in rows_of(spark.read.schema(SCHEMA).parquet(f"{table.path}/data/{segment}/{b}"))]
        assert written == [("d0", 0, f"new{step}")] or step == 3  # then the bucket is written anew
    assert not any(len(s) > 4 for s in table.snapshot().parts.values())
    for version, rows in seen.items():
        assert rows_of(table.read(version)) == sorted(((*k, v) for k, v in rows.items()), key=str)
    table.append(frame(spark, [("d0", 7, "later")]))  # comes after what is gone
    assert ("d0", 7, "later") in rows_of(table.read()) and rows_of(table.read_keys(frame(spark, [("d0", 0, "")]), None, "document_id", "content")) == [("d0", "later"), ("d0", "new4")]
    table.restore(3)
    assert rows_of(table.read()) == sorted(((*k, v) for k, v in seen[3].items()), key=str)
    table.vacuum()
    assert rows_of(table.read()) == sorted(((*k, v) for k, v in seen[3].items()), key=str)
    table.compact()
    table.vacuum()
    assert rows_of(table.read()) == sorted(((*k, v) for k, v in seen[3].items()), key=str) and not table.snapshot().drops


def test_one_of_two_replacements_loses(spark, table):
    table.append(frame(spark, [("a", 0, "old"), ("b", 0, "old")]))
    base = table.snapshot()
    table.replace(frame(spark, [("a", 0, "first")]), None, base)
    with pytest.raises(Conflict):
        table.replace(frame(spark, [("a", 0, "second")]), None, base)
    other = next(k for k in "bcdefgh" if table._touched(frame(spark, [(k, 0, "")]), base) != table._touched(frame(spark, [("a", 0, "")]), base))
    assert table.replace(frame(spark, [(other, 1, "x")]), None, base) == 3
    assert {("a", 0, "first"), (other, 1, "x")} <= set(rows_of(table.read()))

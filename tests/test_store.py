"""The data source for stored documents, and checks of requests that are rows."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators.retrieval import request_errors
from lodestone.sources import store

SCHEMA = "storage_uri string, filename string, content binary"


def files(folder):
    return sorted(os.path.relpath(os.path.join(d, n), folder) for d, _, names in os.walk(folder) for n in names if ".staging-" not in d)


def test_round_trip_and_two_phases(spark, tmp_path):
    store.register(spark)
    folder = str(tmp_path / "store")
    read = lambda: sorted((r.storage_uri, r.filename, r.media_type, bytes(r.content)) for r in spark.read.format("documents").option("path", folder).load().collect())
    write = lambda rows: spark.createDataFrame([(u, n, None if c is None else bytearray(c)) for u, n, c in rows], SCHEMA).repartition(3).write.format("documents").mode("append").option("path", f"file:{folder}").save()
    assert read() == []
    write([("ab/ab1.md", "Über.md", b"# x"), ("ab/ab2.txt", "a.txt", b""), ("cd/cd1", "odd.exe", b"\x00")])
    want = [("ab/ab1.md", "Über.md", "text/markdown", b"# x"), ("ab/ab2.txt", "a.txt", "text/plain", b""), ("cd/cd1", "odd.exe", None, b"\x00")]
    assert read() == want
    before = files(folder)
    for bad in (("../x.md", "x", b"x"), ("/etc/x.md", "x", b"x"), ("ab/x.exe", "x", b"x"), ("ef/e1.md", "x", None), (None, "x", b"x")):
        with pytest.raises(Exception, match="stored file|content"):
            write([("ef/fine.md", "fine.md", b"fine"), bad])
        assert files(folder) == before  # no good rows of a failed job stay
    write([("ab/ab1.md", "new.md", b"# y")])
    assert read()[0] == ("ab/ab1.md", "new.md", "text/markdown", b"# y")
    with pytest.raises(Exception, match="added to"):
        spark.createDataFrame([], SCHEMA).write.format("documents").mode("overwrite").option("path", folder).save()


def test_requests_as_rows(spark):
    rows = [("OS", "x", 5, "context"), ("a b", "", 0, "other"), (None, None, None, None), ("x" * 64, "q" * 2000, 50, "mandatory"), ("x" * 65, "q" * 2001, 51, ""), ("OS\n", "x", 1, "context")]
    df = spark.createDataFrame(rows, "c string, q string, k int, p string")
    got = [r.e for r in df.select(request_errors(F.col("c"), F.col("q"), F.col("k"), F.col("p")).alias("e")).collect()]
    every = ["course_id", "purpose", "query", "top_k"]
    assert got == [[], every, every, [], every, ["course_id"]]
    pages = spark.createDataFrame([(1, 0), (101, 5), (0, -1), (None, None)], "n int, o int")
    assert [r.e for r in pages.select(request_errors(limit=F.col("n"), offset=F.col("o")).alias("e")).collect()] == [[], ["limit"], ["limit", "offset"], ["limit", "offset"]]

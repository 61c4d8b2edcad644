"""Re-indexing, fragments in SQL, and streamed latencies."""

from datetime import datetime, timedelta

import pytest

from lodestone.functions.tables import register
from lodestone.operators.embedding import hashed_vector
from lodestone.operators.versioned import Conflict, Table
from lodestone.plans.reindex import fragment_table, reindex
from lodestone.streaming.latencies import latencies

SCHEMA = "document_id string, course_id string, media_type string, content binary"


def files(spark, *rows):
    return spark.createDataFrame([(d, c, m, None if t is None else bytearray(t.encode())) for d, c, m, t in rows], SCHEMA)


def test_only_what_changed_is_embedded(spark, tmp_path):
    table = fragment_table(spark, str(tmp_path / "fragments"), 4)
    two = "# A\nfirst part\n# B\nsecond part\n"
    first = reindex(files(spark, ("d1", "OS", "text/markdown", two), ("d2", "OS", "text/plain", "plain"), ("d3", "DB", "text/plain", " "), ("d4", "DB", None, "x"), (None, "DB", "text/plain", "x")), table, dimensions=32)
    counts = lambda r: {x.document_id: (x.ingestion_status, x.chunk_count, x.embedded, x.reused, x.removed) for x in r.documents.collect()}
    assert counts(first) == {"d1": ("indexed", 2, 2, 0, 0), "d2": ("indexed", 1, 1, 0, 0), "d3": ("failed", 0, 0, 0, 0), "d4": ("failed", 0, 0, 0, 0)}
    assert {r.error_code for r in first.failures().collect()} == {"EMPTY_DOCUMENT", "UNSUPPORTED_DOCUMENT_FORMAT"}
    assert set(first.timings_ms) == {"cut", "compare", "embed", "write"}
    sent = spark.sparkContext.accumulator(0)

    def client(texts):
        sent.add(len(texts))
        return [hashed_vector(t, 32).tolist() for t in texts]

    # one part changes and one moves, one file is as it was, one can no longer be read
    changed = files(spark, ("d1", "OS", "text/markdown", "# B\nsecond part\n# A\nother part\n"), ("d2", "OS", "text/plain", "plain"), ("d5", "OS", "text/plain", "plain"))
    second = reindex(changed, table, dimensions=32, client=client)
    assert counts(second) == {"d1": ("indexed", 2, 1, 1, 1), "d2": ("indexed", 1, 0, 1, 0), "d5": ("indexed", 1, 1, 0, 0)} and sent.value == 2
    assert [tuple(r) for r in second.courses().collect()] == [("OS", 3, 3, 0, 4, 2, 2, 1)]
    rows = {(r.document_id, r.chunk_index): r for r in table.read().collect()}
    assert sorted(rows) == [("d1", 0), ("d1", 1), ("d2", 0), ("d5", 0)] and rows["d1", 0].content == "second part"
    assert all(r.embedding == hashed_vector("\n\n".join([*r.section_path, r.content]), 32).tolist() for r in rows.values())
    broken = reindex(files(spark, ("d1", "OS", "text/markdown", " ")), table, dimensions=32)
    assert broken.version == second.version and table.read().count() == 4  # the old fragments stay
    assert reindex(changed, table, dimensions=32).version == second.version  # nothing to write
    assert reindex(changed.limit(0), table).documents.count() == 0
    with pytest.raises(Conflict):
        reindex(files(spark, ("d1", "OS", "text/plain", "late")), table, dimensions=32, base=table.snapshot(first.version))


def test_fragments_in_sql(spark):
    register(spark)
    spark.createDataFrame([(1, "a b " * 60), (2, None), (3, " ")], "id long, text string").createOrReplaceTempView("texts")
    rows = spark.sql("SELECT id, f.* FROM texts, LATERAL fragments(text, most => 100, overlap => 10) f ORDER BY id, chunk_index").collect()
    assert {r.id for r in rows} == {1} and [r.chunk_index for r in rows] == list(range(len(rows))) and all(len(r.content) <= 100 for r in rows) and len(rows) > 2
    files = spark.sql("SELECT f.* FROM fragments('# T\nx\n## U\ny', media => 'text/markdown') f").collect()
    assert [(r.content, r.section_path) for r in files] == [("x", ["T"]), ("y", ["T", "U"])]
    for call in ("fragments('x', most => 50)", "fragments('x', most => 200, overlap => 100)", "fragments(1)"):
        with pytest.raises(Exception, match="fragment"):
            spark.sql(f"SELECT * FROM {call}").collect()


def test_streamed_latencies_equal_those_of_tables(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    schema = "job string, at timestamp"
    began = [("a", at(0)), ("b", at(1)), ("c", at(2)), ("d", at(50)), (None, at(1)), ("e", None), ("z", at(300))]
    ended = [("a", at(5)), ("a", at(20)), ("c", at(1)), ("d", at(75)), ("y", at(9)), ("z", at(301))]
    want = sorted(map(tuple, latencies(spark.createDataFrame(began, schema), spark.createDataFrame(ended, schema), "job", timedelta(minutes=10)).collect()), key=str)
    assert [(k, s) for k, *_, s in want] == [("a", 300.0), ("b", None), ("c", None), ("d", None), ("z", 60.0)]
    for cut in (0, 3):
        for name, rows in (("began", began), ("ended", ended)):
            spark.createDataFrame(rows[cut : cut + 3] if not cut else rows[cut:], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        streams = [spark.readStream.schema(schema).parquet(str(tmp_path / name)) for name in ("began", "ended")]
        latencies(*streams, "job", timedelta(minutes=10)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    assert got == want


def test_vectors_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Rows to put in have no vectors yet when they are dealt into buckets, and carried vectors are those that the table had."""
    files = lambda more: spark.createDataFrame([(f"d{k}", "c", "text/plain", bytearray(f"one {k}\n\n{'word ' * 300}{more if k < 2 else ''}".encode())) for k in range(6)], "document_id string, course_id string, media_type string, content binary")
    seen, replace = [], Table.replace
    monkeypatch.setattr(Table, "replace", lambda self, rows, *rest: seen.append(rows.columns) or replace(self, rows, *rest))
    table = fragment_table(spark, str(tmp_path / "f"))
    reindex(files(""), table)
    before = {(r.document_id, r.digest): r.embedding for r in table.read().collect()}
    reindex(files("more"), table)
    after = {(r.document_id, r.digest): r.embedding for r in table.read().collect()}
    assert len(seen) == 2 and not any("embedding" in columns for columns in seen)
    assert len(after) == len(before) and all(after[k] == before[k] for k in after.keys() & before.keys()) and all(len(v) == 1024 for v in after.values())


def test_documents_that_stay_are_not_written(spark, tmp_path):
    """A second run writes the changed documents alone, carries vectors of moved, repeated and shortened texts, and sees files without content and several files of a document."""
    some = {f"d{k}": f"text {k}\n\n" + "\n\n".join(f"{'word ' * 220}{j}" for j in range(4)) for k in range(12)}
    rows = lambda docs, *more: files(spark, *((d, "c", "text/plain", t) for d, t in docs.items()), *more)
    table = fragment_table(spark, str(tmp_path / "f"), 2)
    first = reindex(rows(some, ("empty", "none", "text/plain", None), ("d1", "a", "text/plain", some["d1"])), table, dimensions=64)
    report = {r.document_id: (r.course_id, r.ingestion_status, r.error_code) for r in first.documents.collect()}
    assert report["empty"] == ("none", "failed", "EMPTY_DOCUMENT") and report["d1"] == ("c", "indexed", None) and len(report) == 13
    before, old = set(table.folder.names("data")), {(r.document_id, r.digest): r.embedding for r in table.read().collect()}
    parts = some["d3"].split("\n\n")
    now = some | {"d3": "\n\n".join([*parts[2:], "one more", parts[1], parts[1]])}
    second = reindex(rows(now), table, dimensions=64)
    (segment,) = set(table.folder.names("data")) - before
    written = [r for b in table.folder.names(f"data/{segment}") if b.startswith("_bucket=") for r in spark.read.parquet(f"{table.path}/data/{segment}/{b}").collect()]
    assert {r.document_id for r in written} == {"d3"}
    got = sorted(table.read().where("document_id = 'd3'").collect(), key=lambda r: r.chunk_index)
    assert [r.chunk_index for r in got] == list(range(len(got))) and [r.content for r in got][-1] == parts[1].strip()
    assert all(r.embedding == hashed_vector(r.content, 64).tolist() for r in got)
    per = {r.document_id: (r.embedded, r.reused, r.removed) for r in second.documents.collect()}
    new, had = [("d3", r.digest) for r in got], [k for k in old if k[0] == "d3"]
    assert per.pop("d3") == (sum(k not in old for k in new), sum(k in old for k in new), sum(k not in new for k in had)) and {x[0] for x in per.values()} == {0}
    # without a course as well, what has not changed is not embedded again
    alone = files(spark, ("x", None, "text/plain", "alone"))
    assert [(r.embedded, r.reused) for r in (*reindex(alone, table, dimensions=64).documents.collect(), *reindex(alone, table, dimensions=64).documents.collect())] == [(1, 0), (0, 1)]

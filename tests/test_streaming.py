from lodestone.sources.files import read_corpus, read_files, write_trace
from lodestone.streaming.landing import ingest_landing


def test_landing_is_ingested_once(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    (land / "a.md").write_text("# T\nhello world\n")
    (land / "b.exe").write_text("x")
    run = lambda: ingest_landing(spark, str(land), str(tmp_path / "t"), str(tmp_path / "cp"), "OS").awaitTermination()
    run()
    run()
    (land / "c.txt").write_text("plain text")
    run()
    docs = spark.read.parquet(str(tmp_path / "t/documents")).collect()
    assert sorted((r.ingestion_status, r.error_code) for r in docs if r.error_code is None) == [("indexed", None)] * 2
    assert [r.error_code for r in docs if r.error_code] == ["UNSUPPORTED_DOCUMENT_FORMAT"]
    assert spark.read.parquet(str(tmp_path / "t/vectors")).count() == 2


def test_corpus_reader(spark, tmp_path):
    (tmp_path / "L1_Tutorial_Pipes.md").write_text("# P\n*Topic: Pipes*\ntext")
    (tmp_path / "Test_Task_1.md").write_text("x")
    got = {r.filename: (r.document_type, r.topic) for r in read_corpus(spark, str(tmp_path), "OS").collect()}
    assert got == {"L1_Tutorial_Pipes.md": ("tutorial", "Pipes"), "Test_Task_1.md": ("test_task", None)}
    assert read_files(spark, str(tmp_path)).count() == 2
    write_trace(spark.range(1), str(tmp_path / "trace"))
    assert spark.read.json(str(tmp_path / "trace")).count() == 1


def test_file_storage(spark, tmp_path):
    from lodestone.sources.files import checked_uploads, remove_files, save_files

    rows = [("a.md", bytearray(b"one")), ("b.txt", bytearray(b"two")), ("c.exe", bytearray(b"x"))]
    checked = checked_uploads(spark.createDataFrame(rows, "filename string, content binary"))
    root = str(tmp_path / "store")
    save_files(checked.where("error_code IS NULL"), root)
    save_files(checked.where("error_code IS NULL"), root)
    found = read_files(spark, root)
    assert sorted(bytes(r.content) for r in found.collect()) == [b"one", b"two"]
    gone = checked.where("filename = 'a.md'").select("storage_uri")
    remove_files(gone, root)
    assert [bytes(r.content) for r in read_files(spark, root).collect()] == [b"two"]


def test_streamed_event_counts(spark, tmp_path):
    from lodestone.streaming.landing import event_counts

    batch = spark.sql("SELECT timestamp_seconds(id * 600) AS ts, 'k' AS event_type, 1.0D AS value FROM range(40)")
    batch.write.parquet(str(tmp_path / "in"))
    stream = event_counts(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(spark.table("counted")) == rows(event_counts(batch)) and len(rows(event_counts(batch))) == 7

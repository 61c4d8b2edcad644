"""Files: landing folders, upload checks, the corpus reader and a trace sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.scalars import document_type, has_signature, media_type, safe_filename, topic_line

MAX_BYTES = 20 * 1024 * 1024


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, filename, content, modified_at) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "content", F.col("modificationTime").alias("modified_at"))


def checked_uploads(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``files`` (filename, content, ...) with a safe filename, media_type, checksum_sha256, storage_uri and error_code. Checks
    are made in the order: size, emptiness, type, signature."""
    out = files.withColumn("filename", safe_filename(F.col("filename"))).withColumn("media_type", media_type(F.col("filename")))
    size = F.octet_length("content")
    code = (
        F.when(size > max_bytes, "DOCUMENT_TOO_LARGE").when(F.coalesce(size, F.lit(0)) == 0, "EMPTY_DOCUMENT")
        .when(F.col("media_type").isNull() | ~has_signature(F.col("media_type"), F.col("content")), "UNSUPPORTED_DOCUMENT_FORMAT")
    )
    checksum = F.sha2("content", 256)
    return out.withColumns({"checksum_sha256": checksum, "storage_uri": storage_uri(checksum, F.col("filename")), "error_code": code})


def storage_uri(name: Column, filename: Column) -> Column:
    """Where a file of an opaque name is kept: a folder of its first two characters, and its suffix if it is a supported one."""
    suffix = F.when(media_type(filename).isNotNull(), F.concat(F.lit("."), F.lower(F.regexp_extract(filename, r"([^.]+)$", 1)))).otherwise("")
    return F.concat_ws("/", F.left(name, F.lit(2)), F.concat(name, suffix))


def read_corpus(spark: SparkSession, folder: str, course: str) -> DataFrame:
    """Markdown files with their metadata: filename, text, course_id, document_type, topic."""
    files = spark.read.text(f"{folder}/*.md", wholetext=True).select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("text"))
    return files.select("filename", "text", F.lit(course).alias("course_id"), document_type(F.col("filename")).alias("document_type"), topic_line(F.col("text")).alias("topic"))


def write_trace(summary: DataFrame, folder: str) -> None:
    summary.coalesce(1).write.mode("overwrite").json(folder)


def _inside(root: str, uri: str) -> str:
    """The path of a stored file; a uri that would leave the folder raises."""
    if uri.startswith("/") or ".." in uri.split("/"):
        raise ValueError(f"not a stored file: {uri}")
    return f"{root.rstrip('/')}/{uri}"


def _each_file(rows: DataFrame, root: str, act) -> None:
    rows.rdd.foreachPartition(lambda part: [act(_inside(root, r.storage_uri), r) for r in part])


def save_files(checked: DataFrame, root: str) -> None:
    """Keeps the content of checked uploads under ``root``, a folder that all executors see, by storage_uri. A file
    is written beside its place and renamed, so that none is ever seen half written."""
    import os

    def write(path: str, row) -> None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{os.getpid()}.part"
        with open(part, "wb") as f:
            f.write(row.content)
        os.replace(part, path)

    _each_file(checked.select("storage_uri", "content"), root, write)


def remove_files(stored: DataFrame, root: str) -> None:
    """Removes files by storage_uri; one that is not there is no error."""
    import contextlib
    import os

    def remove(path: str, row) -> None:
        with contextlib.suppress(FileNotFoundError):
            os.remove(path)

    _each_file(stored.select("storage_uri"), root, remove)

"""A data source for stored documents: ``spark.read.format("documents")`` and ``df.write.format("documents")`` over a folder that all executors see.

Files stand under ``storage_uri``, as ``files.storage_uri`` gives it: a folder of two characters, an opaque name and the suffix of a supported type. Beside each stands its own
name as ``.name``. Reading has a partition for each folder of two characters, listed by the task that reads it. Writing has two phases: tasks write into a staging
folder of their job, and only once all have ended are the files renamed into their places by the driver; a job that fails leaves none, but for what tasks that were still running then put into its staging folder, which no reader looks at.

Defined results: a file without content or a uri that would leave the folder fails the write; of two rows of one uri the last to be renamed stands; an
empty or missing folder has no rows; a file without its name beside it has its opaque one; other files in the folder are not looked at.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from lodestone.functions.scalars import MEDIA_TYPES

#: A folder of two characters, a name, and a suffix if the type is a supported one.
STORED = re.compile(r"([0-9a-z]{2})/([0-9A-Za-z_-]+)((?:\.(?:" + "|".join(MEDIA_TYPES) + r"))?)")


def local(path: str) -> str:
    """The path of a folder that may be written as a file: URI."""
    return re.sub(r"\Afile:(//)?(?=/)", "", path)


def place_of(root: str, uri: str) -> str:
    """Where a stored file is; a uri that is not one of ``files.storage_uri`` raises."""
    if not STORED.fullmatch(uri or ""):
        raise ValueError(f"not a stored file: {uri}")
    return os.path.join(root, uri)


@dataclass
class Shard(InputPartition):
    folder: str


@dataclass
class Staged(WriterCommitMessage):
    uris: list[str]


class _Reader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> Sequence[InputPartition]:
        found = [e.name for e in os.scandir(self.root) if e.is_dir() and re.fullmatch("[0-9a-z]{2}", e.name)] if os.path.isdir(self.root) else []
        return [Shard(n) for n in sorted(found)] or [Shard("")]

    def read(self, partition: Shard) -> Iterator[tuple]:
        if not partition.folder:
            return
        for name in sorted(os.listdir(os.path.join(self.root, partition.folder))):
            uri = f"{partition.folder}/{name}"
            if not (parts := STORED.fullmatch(uri)):
                continue
            with open(os.path.join(self.root, uri), "rb") as f:
                content = f.read()
            given = os.path.join(self.root, f"{uri}.name")
            if os.path.exists(given):
                with open(given, encoding="utf-8") as f:
                    name = f.read()
            yield uri, name, MEDIA_TYPES.get(parts[3][1:]), content


class _Writer(DataSourceWriter):
    def __init__(self, root: str) -> None:
        self.root, self.staging = root, os.path.join(root, f".staging-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        uris, own = [], uuid.uuid4().hex  # a task that is tried again writes beside what it wrote before
        for row in iterator:
            place_of(self.root, row.storage_uri)
            if row.content is None:
                raise ValueError(f"{row.storage_uri} has no content")
            staged = os.path.join(self.staging, own, row.storage_uri)
            os.makedirs(os.path.dirname(staged), exist_ok=True)
            with open(staged, "wb") as f:
                f.write(row.content)
            with open(f"{staged}.name", "w", encoding="utf-8") as f:
                f.write(row.filename or os.path.basename(row.storage_uri))
            uris.append(f"{own}/{row.storage_uri}")
        return Staged(uris)

    def commit(self, messages: list[Staged | None]) -> None:
        for message in messages:
            for staged in message.uris if message else []:
                place = place_of(self.root, staged.partition("/")[2])
                os.makedirs(os.path.dirname(place), exist_ok=True)
                # the name comes first: a file that is seen has one
                os.replace(os.path.join(self.staging, f"{staged}.name"), f"{place}.name")
                os.replace(os.path.join(self.staging, staged), place)
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Staged | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "storage_uri string, filename string, media_type string, content binary"

    def _root(self) -> str:
        if not (path := self.options.get("path")):
            raise ValueError("a folder must be given as the path")
        return local(path)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._root())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("stored documents are added to; remove_files takes them out")
        if not {"storage_uri", "filename", "content"} <= set(schema.names):
            raise ValueError("storage_uri, filename and content are needed")
        return _Writer(self._root())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Documents)

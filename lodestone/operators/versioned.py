"""Versioned tables: snapshots over plain Parquet, with atomic commits, conflict checks and time travel.

A table is a folder. ``data`` holds segments, each written by one commit and never changed; ``versions`` holds one manifest for each version, which
says for every bucket of the key which segments make it up. A commit writes its segment first and then its manifest, which must be
the first of its number: a rename that refuses an existing name decides between two writers, as far as the file system makes it atomic (HDFS
does; a local disk nearly so). The loser looks at what was committed since it began: if the buckets it read or
replaced are untouched, it commits on top; else it raises ``Conflict`` and has changed nothing.

Readers name a version, or take the newest when they begin, and keep reading the same files whatever is committed later, until ``vacuum`` removes them.
Changes by key read and rewrite only the buckets that hold the keys; a manifest is as long as buckets times segments, not rows. ``replace`` does not even rewrite
those: it writes the fresh rows and the keys that are gone, and readers leave out what earlier segments have of these, until a bucket has so many segments that it is written anew.

Defined results: rows with a null in the key belong to a bucket like any other, but match no row; of several fresh rows with one key any one is taken by ``upsert``;
columns stand in the order of the table, and a missing or an unknown one raises; an empty change is a version as well.
"""

from __future__ import annotations

import functools
import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.durable import BROADCAST_KEYS, durable, forget, in_small_batches, shared_folder
from lodestone.operators.packed import pack, unpack

BUCKETS = 16
#: Times a writer tries to commit on top of others that do not touch its buckets.
ATTEMPTS = 20
#: Buckets that are written at the same time.
TOGETHER = 4
#: Segments of a bucket from which on ``replace`` writes it anew.
DEEP = 8


#: How rows are written that are many and wide.
_SMALL = {"compression": "zstd"}


class Conflict(RuntimeError):
    """Another writer has changed what this one read or replaced."""


@dataclass(frozen=True)
class Snapshot:
    version: int
    schema: str
    key: list[str]
    bucket_by: list[str]
    order: list[str]
    buckets: int
    operation: str = "create"
    at: float = 0.0
    #: Segments of each bucket, and the buckets that this version changed.
    parts: dict[str, list[str]] = field(default_factory=dict)
    changed: list[int] = field(default_factory=list)
    #: Of each bucket: segments with keys that are gone from so many of its first segments, and the number of these keys.
    drops: dict[str, list[list]] = field(default_factory=dict)
    #: Columns of vectors that are bytes in the files.
    packed: list[str] = field(default_factory=list)


class _Folder:
    """A folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.conf, self.path = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path
        self.gateway = spark.sparkContext._gateway
        self.fs = self._at("").getFileSystem(self.conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        place = self._at(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(place)) if self.fs.exists(place) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Writes a file that is not there yet; false if it is."""
        part = self._at(f"{name}.{uuid.uuid4().hex}.part")
        stream = self.fs.create(part, False)
        stream.write(text.encode())
        stream.close()
        modes = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(part, self._at(name), modes)
        except Exception as e:
            self.fs.delete(part, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


class Table:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.folder = spark, path.rstrip("/"), _Folder(spark, path.rstrip("/"))

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, key: list[str], bucket_by: list[str] | None = None, order: list[str] | None = None, buckets: int = BUCKETS, packed: list[str] | None = None) -> Table:
        """An empty table. ``bucket_by`` are the columns of the key by which rows are dealt into buckets, all of them if not given; files are sorted by ``order``.
        ``packed`` columns, vectors with many zeros, are stored as bytes, which rows to write may have as well (``packed.packed``)."""
        out, by = cls(spark, path), bucket_by or key
        if not set(key) | set(by) | set(order or []) <= set(schema.names):
            raise ValueError("the key, the buckets and the order are of columns of the table")
        if any(schema[c].dataType != T.ArrayType(T.DoubleType()) for c in packed or []):
            raise ValueError("only arrays of doubles can be packed")
        if not out._put(Snapshot(0, schema.json(), key, by, order or [], buckets, at=time.time(), packed=packed or [])):
            raise Conflict(f"{path} is a table already")
        return out

    # versions

    def _put(self, snapshot: Snapshot) -> bool:
        return self.folder.put(f"versions/{snapshot.version:012d}.json", json.dumps(asdict(snapshot)))

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.folder.names("versions") if n.endswith(".json") and not n.startswith(".")]

    def snapshot(self, version: int | None = None) -> Snapshot:
        if version is None:
            version = max(self.versions(), default=-1)
        try:
            return Snapshot(**json.loads(self.folder.read(f"versions/{version:012d}.json")))
        except Exception as e:
            if "FileNotFound" in str(e):
                raise ValueError(f"{self.path} has no version {version}") from None
            raise

    def history(self) -> DataFrame:
        """(version, operation, at, buckets): the versions that are kept, and how many buckets each changed."""
        rows = [(s.version, s.operation, s.at, len(s.changed)) for s in map(self.snapshot, self.versions())]
        return self.spark.createDataFrame(rows, "version long, operation string, at double, buckets int").withColumn("at", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")))

    def version_at(self, at: float) -> int:
        """The version that was the newest at a time (seconds since 1970)."""
        known = [s.version for s in map(self.snapshot, self.versions()) if s.at <= at]
        if not known:
            raise ValueError("the table was not there yet, or its versions are gone")
        return max(known)

    # reading

    def _bucket(self, s: Snapshot) -> Column:
        return F.pmod(F.xxhash64(*s.bucket_by), F.lit(s.buckets)).cast("int")

    def _plain(self, rows: DataFrame, s: Snapshot) -> DataFrame:
        """``rows`` with vectors as the schema has them."""
        names = {c for c in s.packed if c in rows.columns and rows.schema[c].dataType == T.BinaryType()}
        return in_small_batches(rows).withColumns({c: unpack(F.col(c)) for c in names}) if names else rows

    def _stored(self, rows: DataFrame, s: Snapshot) -> DataFrame:
        """``rows`` with vectors as they are in the files."""
        names = {c for c in s.packed if c in rows.columns and rows.schema[c].dataType != T.BinaryType()}
        return in_small_batches(rows).withColumns({c: pack(F.col(c)) for c in names}) if names else rows

    def _rows(self, s: Snapshot, buckets: list[int] | None = None) -> DataFrame:
        """Rows as they are in the files."""
        schema, data = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name in s.packed else f for f in T.StructType.fromJson(json.loads(s.schema))]), f"{self.path}/data"
        # files that the same keys are gone from are read together, as far as these keys can be broadcast
        groups: dict[tuple, list[tuple[int, list[str], list[str]]]] = {(): [(0, [], [])]}
        for b, held in sorted(s.parts.items()):
            if buckets is not None and int(b) not in buckets:
                continue
            for at, segment in enumerate(held):
                gone = [d for d in s.drops.get(b, []) if at < d[1]]
                group, n = groups.setdefault(tuple(d[0] for d in gone), [(0, [], [])]), sum(d[2] for d in gone)
                known, files, keys = group[-1]
                if files and known + n > BROADCAST_KEYS:
                    group.append((0, [], []))
                    known, files, keys = group[-1]
                more = [place for d in gone if (place := f"{data}/{d[0]}/gone/_bucket={b}") not in keys]
                group[-1] = (known + n if more else known, [*files, f"{data}/{segment}/_bucket={b}"], [*keys, *more])
        out = []
        for known, files, keys in (g for group in groups.values() for g in group if g[1]):
            rows = self.spark.read.schema(schema).parquet(*files)
            if keys:
                left = self.spark.read.schema(T.StructType([schema[c] for c in s.bucket_by])).parquet(*keys)
                rows = rows.join(F.broadcast(left) if known <= BROADCAST_KEYS else left, s.bucket_by, "left_anti").select(*schema.names)
            out.append(rows)
        return functools.reduce(DataFrame.unionByName, out) if out else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        s = self.snapshot(version)
        return self._plain(self._rows(s), s)

    def read_keys(self, keys: DataFrame, version: int | None = None, *columns: Column | str) -> DataFrame:
        """The rows whose bucket columns are among ``keys``; only the files of their buckets are read. ``columns``, the bucket's among them, are what is wanted of the rows, made
        where they are read, of rows as they are in the files."""
        s = self.snapshot(version)
        wanted = durable(keys.select(*s.bucket_by).distinct())
        rows = self._rows(s, self._touched(wanted, s))
        return self._plain((rows.select(*columns) if columns else rows).join(wanted, s.bucket_by, "left_semi"), s)

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """Rows that are in one of two versions and not in the other, with ``change`` 'added' or 'removed'. Only the buckets that were
        changed in between are compared; repeated rows count each."""
        old, new = self.snapshot(since), self.snapshot(until)
        between = {b for v in range(old.version + 1, new.version + 1) for b in self.snapshot(v).changed}
        a, b = (self._plain(self._rows(s, sorted(between)), s) for s in (old, new))
        return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(a.exceptAll(b).withColumn("change", F.lit("removed")))

    # writing

    def _touched(self, rows: DataFrame, s: Snapshot) -> list[int]:
        return sorted(r.b for r in rows.select(self._bucket(s).alias("b")).distinct().collect())

    def _write(self, rows: DataFrame, s: Snapshot) -> tuple[str, list[int]]:
        """A segment and the buckets it has rows in. Rows are balanced over tasks, so that a bucket that holds most of them is many files."""
        segment, names = uuid.uuid4().hex, T.StructType.fromJson(json.loads(s.schema)).names
        if sorted(rows.columns) != sorted(names):
            raise ValueError(f"the table has the columns {', '.join(names)}")
        dealt = self._stored(rows, s).select(*names, self._bucket(s).alias("_bucket")).hint("rebalance", "_bucket")
        if s.order:
            dealt = dealt.sortWithinPartitions("_bucket", *s.order)
        dealt.write.partitionBy("_bucket").parquet(f"{self.path}/data/{segment}")
        return segment, [int(n.split("=")[1]) for n in self.folder.names(f"data/{segment}") if n.startswith("_bucket=")]

    def _commit(self, base: Snapshot, operation: str, segment: str, written: list[int], replaced: list[int] | None, dropped: dict[int, int] | None = None) -> int:
        """``replaced`` buckets consist of the new segment alone, but for ``dropped`` ones, from which so many keys are gone; None for rows that are only added."""
        touched, dropped = set(replaced if replaced is not None else written), dropped or {}
        for _ in range(ATTEMPTS):
            stays = lambda b: replaced is None or int(b) not in touched or int(b) in dropped
            parts, drops = ({b: held for b, held in x.items() if stays(b)} for x in (base.parts, base.drops))
            for b, n in dropped.items():
                drops[str(b)] = [*drops.get(str(b), []), [segment, len(parts[str(b)]), n]]
            for b in written:
                parts[str(b)] = [*parts.get(str(b), []), segment]
            now = replace(base, version=base.version + 1, operation=operation, at=time.time(), parts=parts, drops=drops, changed=sorted(touched))
            if self._put(now):
                return now.version
            newest = self.snapshot()
            since = [self.snapshot(v) for v in range(base.version + 1, newest.version + 1)]
            if replaced is not None and any(touched & set(s.changed) for s in since):
                self.folder.remove(f"data/{segment}")
                raise Conflict(f"version {newest.version} changed what this change was based on")
            base = newest
        raise Conflict("others kept committing")

    def append(self, rows: DataFrame) -> int:
        """Adds rows without reading any; the new version's number."""
        base = self.snapshot()
        return self._commit(base, "append", *self._write(rows, base), None)

    def upsert(self, rows: DataFrame, base: Snapshot | None = None) -> int:
        """Puts rows in place of those of the same key. ``base`` is the version the rows were made from, if not the newest."""
        base = base or self.snapshot()
        fresh = durable(self._stored(rows.dropDuplicates(base.key), base))
        touched = self._touched(fresh, base)
        kept = self._rows(base, touched).join(fresh.select(*base.key), base.key, "left_anti")
        done = self._commit(base, "upsert", *self._write(kept.unionByName(fresh), base), touched)
        forget(fresh)
        return done

    def deal(self, rows: DataFrame, base: Snapshot | None = None) -> DataFrame:
        """``rows`` written to an intermediate table, in a folder for each bucket and without a shuffle, with ``_bucket``. ``forget`` removes it."""
        base, path = base or self.snapshot(), f"{shared_folder(self.spark)}/table-{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", self._bucket(base))
        dealt = dealt.sortWithinPartitions("_bucket", *(c for c in base.order if c in rows.columns))
        dealt.write.options(**_SMALL).partitionBy("_bucket").parquet(path)
        out = self.spark.read.schema(dealt.schema).parquet(path)
        out._durable = path
        return out

    def replace(self, rows: DataFrame, of: DataFrame | None = None, base: Snapshot | None = None, finish: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> int:
        """Puts ``rows`` in place of all rows whose bucket columns are in ``of`` (those of ``rows``, if not given): all fragments of some
        documents at once, for instance, so that no reader sees old and new ones together. ``finish`` makes the table's rows from those of one bucket, as they are written,
        and the rows that they replace as they are in the files; so wide columns need not be dealt out. Rows with a ``_bucket``, made from what ``deal`` gave, are not dealt out again; they must give the same
        each time and belong to rows of ``of``. Rows that stay are not written but in buckets of ``DEEP`` segments or more, which are copied without a shuffle."""
        base = base or self.snapshot()
        names = T.StructType.fromJson(json.loads(base.schema)).names
        if not finish and sorted(c for c in rows.columns if c != "_bucket") != sorted(names):
            raise ValueError(f"the table has the columns {', '.join(names)}")
        own = None if "_bucket" in rows.columns else self.deal(self._stored(rows, base), base)
        fresh, segment = rows if own is None else own, uuid.uuid4().hex
        gone = durable((fresh if of is None else of).select(*base.bucket_by, self._bucket(base).alias("_bucket")).distinct())
        counts = {r["_bucket"]: r["n"] for r in gone.groupBy("_bucket").agg(F.count("*").alias("n")).collect()}
        touched, filled = sorted(counts), set(counts)
        if own is not None:
            filled = {int(n.split("=")[1]) for n in _Folder(self.spark, own._durable).names() if n.startswith("_bucket=")}
            if not fresh.join(gone.drop("_bucket"), base.bucket_by, "left_anti").isEmpty():
                raise ValueError("rows to put in belong to none of those to replace")
        deep = {b for b in touched if len(base.parts.get(str(b), [])) >= DEEP}
        dropped = {b: counts[b] for b in touched if str(b) in base.parts and b not in deep}
        if dropped:
            gone.where(F.col("_bucket").isin(*dropped)).write.partitionBy("_bucket").parquet(f"{self.path}/data/{segment}/gone")
        options = _SMALL | {f"parquet.enable.dictionary#{c}": "false" for c in base.packed}

        def write(b: int) -> None:
            old, keys, place = self._rows(base, [b]), gone.where(F.col("_bucket") == b).drop("_bucket"), f"{self.path}/data/{segment}/_bucket={b}"
            keys = F.broadcast(keys) if counts[b] <= BROADCAST_KEYS else keys
            if b in deep:
                old.join(keys, base.bucket_by, "left_anti").select(*names).write.options(**options).parquet(place)
            if b in filled:
                new = fresh.where(F.col("_bucket") == b).drop("_bucket")
                new = new.sortWithinPartitions(*base.order) if base.order else new
                new = finish(new, old.join(keys, base.bucket_by, "left_semi")) if finish else new
                self._stored(new, base).select(*names).write.options(**options).mode("append").parquet(place)

        # all keys that are broadcast at the same time are as many as may be broadcast once
        together = min(TOGETHER, max(1, BROADCAST_KEYS // max(counts.values(), default=1))) if base.parts else TOGETHER
        with ThreadPoolExecutor(together) as pool:
            list(pool.map(write, touched))
        done = self._commit(base, "replace", segment, [b for b in touched if b in filled or b in deep], touched, dropped)
        forget(gone, own)
        return done

    def delete(self, keys: DataFrame, base: Snapshot | None = None) -> int:
        """Removes the rows whose bucket columns are among ``keys``."""
        base = base or self.snapshot()
        gone = durable(keys.select(*base.bucket_by).distinct())
        touched = self._touched(gone, base)
        done = self._commit(base, "delete", *self._write(self._rows(base, touched).join(gone, base.bucket_by, "left_anti"), base), touched)
        forget(gone)
        return done

    def overwrite(self, rows: DataFrame, base: Snapshot | None = None) -> int:
        """Puts ``rows`` in place of all that the table has. Whatever others have committed since ``base`` is a conflict."""
        base = base or self.snapshot()
        return self._commit(base, "overwrite", *self._write(rows, base), list(range(base.buckets)))

    def compact(self) -> int:
        """Writes buckets of several segments, or with keys that are gone, as one segment."""
        base = self.snapshot()
        many = [int(b) for b, held in base.parts.items() if len(held) > 1 or b in base.drops]
        return self._commit(base, "compact", *self._write(self._rows(base, many), base), many)

    def restore(self, version: int) -> int:
        """A new version with the rows of an old one; no data is written."""
        base, old = self.snapshot(), self.snapshot(version)
        changed = sorted({int(b) for b in base.parts.keys() | old.parts.keys() if (base.parts.get(b), base.drops.get(b)) != (old.parts.get(b), old.drops.get(b))})
        if not self._put(replace(base, version=base.version + 1, operation="restore", at=time.time(), parts=old.parts, drops=old.drops, changed=changed)):
            raise Conflict("another version was committed")
        return base.version + 1

    def vacuum(self, keep: int = 1) -> None:
        """Removes all versions but the newest ``keep``, and the segments that only they were made of. Their readers fail from then on, and so
        does a writer that is at work: this is for a time when none is."""
        versions = self.versions()
        kept = [self.snapshot(v) for v in versions[-keep:]]
        used = {segment for s in kept for held in s.parts.values() for segment in held} | {d[0] for s in kept for held in s.drops.values() for d in held}
        for v in versions[:-keep]:
            self.folder.remove(f"versions/{v:012d}.json")
        for segment in self.folder.names("data"):
            if segment not in used:
                self.folder.remove(f"data/{segment}")

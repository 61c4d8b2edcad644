"""Lineage cuts that survive lost executors, and broadcasts behind a check of size."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that are broadcast at most, and bytes of them; more are joined by a shuffle.
BROADCAST_KEYS, BROADCAST_BYTES = 500_000, 64 << 20
#: Bytes of rows that Spark hands to Python at once; its own default holds 64 MB on both sides.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the session's ``spark.checkpoint.dir``. Only where none is set and the master is
    local, as in tests on one machine, a temporary one is made."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestone-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet under the checkpoint folder, which all executors share, and read from there.

    What is read back has the size of its files as its estimate, whatever was estimated for the plan that made it, so that cuts
    in a loop do not carry estimates on, and tables that have become small are broadcast. Columns are written by number: names may
    clash or hold any character. ``forget`` removes what a loop no longer needs.
    """
    spark, names = df.sparkSession, df.columns
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields)]
    df.toDF(*(f.name for f in fields)).write.parquet(path)
    out = spark.read.schema(T.StructType(fields)).parquet(path).toDF(*names)
    out._durable = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Removes the files of tables that ``durable`` gave and that nothing will read any more."""
    for df in tables:
        if path := getattr(df, "_durable", None):
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def _row_bytes(df: DataFrame):
    """A column: about how many bytes a row takes."""
    fixed, varying = 16, []
    for field in df.schema.fields:
        match field.dataType:
            case T.StringType() | T.BinaryType():
                varying.append(F.octet_length(F.col(field.name)))
            case T.ArrayType(elementType=T.StringType()):
                varying.append(F.aggregate(field.name, F.lit(0), lambda n, x: n + F.octet_length(x) + 16))
            case T.ArrayType() | T.MapType():
                varying.append(16 * F.size(field.name))
            case _:
                fixed += 8
    return sum((F.coalesce(v, F.lit(0)) + 8 for v in varying), F.lit(fixed)).cast("long")


def small(df: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows and ``BROADCAST_BYTES``, else as it is. Both are counted in
    the tasks; one row of sums comes to the driver."""
    size = df.select(_row_bytes(df).alias("b")).agg(F.count("*").alias("rows"), F.sum("b").alias("bytes")).first()
    return F.broadcast(df) if size.rows <= most and (size.bytes or 0) <= BROADCAST_BYTES else df


def small_batches(spark: SparkSession) -> None:
    """Has the session hand over batches of ``BATCH_BYTES`` at most."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(key, "64m"))
    if not now or not 0 < int(now[1]) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands over batches of ``BATCH_BYTES`` at most."""
    small_batches(df.sparkSession)
    return df

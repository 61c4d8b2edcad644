"""The state of each job as its log comes in: a stateful stream with event-time timers.

Log rows may come late, out of order and more than once. A job's rows are held until the watermark has passed them and are then taken in order of
time and number, so that the outcome does not depend on how they came. Each row that is taken leads to one row of output:

* a legal change of state (none to queued; queued or running to running; running to succeeded or failed), or
* ``ILLEGAL_TRANSITION`` for any other, which changes nothing.

A job that runs for ``timeout`` of event time without an end is failed with ``JOB_TIMED_OUT`` by a timer, even if no row of it comes any more. A
later end of it is then illegal. What is kept of a job is its state and the rows that the watermark has not passed,
as one list, and a timer for the next moment at which any of this changes.

Defined results: rows without a job, a time, a number or a known event are left out; of rows of one number of a job the first to come counts, a copy
that comes once the watermark has passed it is dropped, as is any such row in a windowed stream; rows that the watermark has not passed by the end of the
input are not taken yet; times are to the millisecond.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.operators.jobs import state_of

#: What may follow each state (fixed values).
LEGAL = {None: ["queued"], "queued": ["running"], "running": ["running", "succeeded", "failed"], "succeeded": [], "failed": []}
#: The state store that such streams need: spark.sql.streaming.stateStore.providerClass.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The number of a row that a timer has made.
TIMER = -1

State = tuple[str | None, int | None]


def taken(state: State, rows: list[tuple[int, int, str]], until: int, timeout: int) -> tuple[State, list[tuple]]:
    """The state of a job (status, when it began to run) after some rows (time, number, status) and the time ``until``, and rows of
    output (number, status, time, problem). Times are in milliseconds."""
    (status, since), out = state, []

    def lost(before: int) -> None:
        nonlocal status, since
        if status == "running" and since + timeout <= before:
            out.append((TIMER, "failed", since + timeout, "JOB_TIMED_OUT"))
            status, since = "failed", None

    for at, number, new in sorted(rows):
        lost(at)
        if new in LEGAL[status]:
            status, since = new, at if new == "running" else None
            out.append((number, new, at, None))
        else:
            out.append((number, new, at, "ILLEGAL_TRANSITION"))
    lost(until)
    return (status, since), out


class _Jobs(StatefulProcessor):
    def __init__(self, timeout: int) -> None:
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, since long")
        self.waiting = handle.getListState("waiting", "number long, at long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - names of the interface
        first = None
        for batch in rows:
            numbers, at, statuses = batch["log_id"].tolist(), batch["at"].tolist(), batch["status"].tolist()
            if numbers:
                self.waiting.appendList(list(zip(numbers, at, statuses, strict=True)))
                first = min(at) if first is None else min(first, *at)
        if first is not None:
            self.handle.registerTimer(first + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # all that the watermark has passed is taken at once, so a job's rows are read once for each batch, not once for each row
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) - 1
        rows: dict[int, tuple[int, str]] = {}
        for number, at, status in self.waiting.get():
            rows.setdefault(number, (at, status))
        due = [(at, number, status) for number, (at, status) in rows.items() if at <= until]
        left = [(number, at, status) for number, (at, status) in rows.items() if at > until]
        if due:
            self.waiting.put(left) if left else self.waiting.clear()
        state, out = taken(tuple(self.job.get()) if self.job.exists() else (None, None), due, until, self.timeout)
        self.job.update(state)
        # of the timers that may be set for one of these moments already, setting it again changes nothing
        wake = [min(at for _, at, _ in left) + 1] if left else []
        if state[0] == "running":
            wake.append(state[1] + self.timeout + 1)
        if wake:
            self.handle.registerTimer(min(wake))
        if out:
            number, status, at, problem = zip(*out, strict=True)
            yield pd.DataFrame({"job_id": [key[0]] * len(out), "log_id": number, "status": status, "at": at, "problem": pd.array(problem, object)})

    def close(self) -> None:
        pass


def job_stream(log: DataFrame, timeout: timedelta = timedelta(hours=1), late: timedelta = timedelta(minutes=10)) -> DataFrame:
    """(job_id, log_id, status, at, problem) from a stream of log rows (job_id, log_id, event_type, recorded_at), in append mode. Rows
    that time a job out have the number ``TIMER``. The session's state store must be ``PROVIDER``."""
    rows = log.select("job_id", F.col("log_id").cast("long").alias("log_id"), F.col("recorded_at").cast("timestamp").alias("recorded_at"), F.unix_millis(F.col("recorded_at").cast("timestamp")).alias("at"), state_of(F.col("event_type")).alias("status"))
    rows = rows.where("job_id IS NOT NULL AND log_id IS NOT NULL AND at IS NOT NULL AND status IS NOT NULL")
    milliseconds = lambda span: span // timedelta(milliseconds=1)
    schema = T.StructType([rows.schema["job_id"], T.StructField("log_id", T.LongType()), T.StructField("status", T.StringType()), T.StructField("at", T.LongType()), T.StructField("problem", T.StringType())])
    waited = rows.withWatermark("recorded_at", f"{milliseconds(late)} milliseconds").groupBy("job_id")
    out = waited.transformWithStateInPandas(statefulProcessor=_Jobs(milliseconds(timeout)), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return out.withColumn("at", F.timestamp_millis("at"))


def read_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream with state gives for the input that is there, kept in ``folder`` with its checkpoint: run again, it takes only what is new. The
    session's state store is ``PROVIDER`` meanwhile."""
    spark, key = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    try:
        stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")

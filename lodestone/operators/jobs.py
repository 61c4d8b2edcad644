"""Jobs as events: submission, runs, states and durations derived from the log."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Mapping
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import seconds_between
from lodestone.operators.catalog import latest
from lodestone.operators.durable import durable, forget

#: State by the last event of a job, and what each type of job is aimed at (fixed values).
STATES = {"job.queued": "queued", "job.started": "running", "job.succeeded": "succeeded", "job.failed": "failed"}
TARGETS = {"document_ingestion": "document_id", "course_indexing": "course_id", "retrieval": "course_id"}
FINAL = ["succeeded", "failed"]


def state_of(event_type: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair))[event_type]


def job_states(log: DataFrame, order: str = "log_id", key: str = "job_id") -> DataFrame:
    """(job_id, status, at): by the last event of each job that says a state."""
    rows = log.select(key, order, F.col("recorded_at"), state_of(F.col("event_type")).alias("status")).where("status IS NOT NULL")
    return latest(rows, key, order).select(key, "status", F.col("recorded_at").alias("at"))


def job_times(log: DataFrame, key: str = "job_id") -> DataFrame:
    """(job_id, queued_at, started_at, completed_at, waiting_s, running_s); a job that runs again starts anew."""
    at = lambda *types: F.max(F.when(F.col("event_type").isin(*types), F.col("recorded_at")))
    out = log.groupBy(key).agg(F.min("recorded_at").alias("queued_at"), at("job.started").alias("started_at"), at("job.succeeded", "job.failed").alias("completed_at"))
    return out.withColumns({"waiting_s": seconds_between(F.col("queued_at"), F.col("started_at")), "running_s": seconds_between(F.col("started_at"), F.col("completed_at"))})


def dispatch(jobs: DataFrame) -> DataFrame:
    """``jobs`` with ``error_code``: a job needs the one target of its type, and no other."""
    has = {c: F.col(c).isNotNull() for c in ("document_id", "course_id")}
    fits = F.lit(False)
    for kind, target in TARGETS.items():
        other = "course_id" if target == "document_id" else "document_id"
        fits = F.when(F.col("job_type") == kind, has[target] & ~has[other]).otherwise(fits)
    return jobs.withColumn("error_code", F.when(~fits, F.lit("VALIDATION_FAILED")))


def submit(jobs: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """The rows of new jobs, queued, and their first log rows."""
    rows = jobs.withColumns({"status": F.lit("queued"), "created_at": at})
    log = rows.select("job_id", F.lit("info").alias("level"), F.lit("job.queued").alias("event_type"), F.concat("job_type", F.lit(" queued")).alias("message"), F.lit(None).cast("string").alias("details"), F.col("created_at").alias("recorded_at"))
    return rows, log


def pending(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """Jobs to run: all but those whose last state is final. One that was running is run again."""
    done = job_states(log).where(F.col("status").isin(FINAL)).select("job_id")
    return jobs.join(done, "job_id", "left_anti")


def outcome_log(outcomes: DataFrame) -> DataFrame:
    """Log rows of finished runs (job_id, job_type, error_code, error_message, recorded_at): failed where a code is given."""
    failed = F.col("error_code").isNotNull()
    details = F.when(failed, F.to_json(F.struct(F.col("error_code").alias("code"))))
    return outcomes.select("job_id", F.when(failed, "error").otherwise("info").alias("level"), F.when(failed, "job.failed").otherwise("job.succeeded").alias("event_type"), F.when(failed, F.col("error_message")).otherwise(F.concat("job_type", F.lit(" succeeded"))).alias("message"), details.alias("details"), "recorded_at")


Handler = Callable[[DataFrame], DataFrame]


def run(jobs: DataFrame, log: DataFrame, handlers: Mapping[str, Handler], at: Column) -> DataFrame:
    """Runs all pending jobs and gives a row for each: (job_id, job_type, result, error_code, error_message, recorded_at), from
    which ``outcome_log`` makes log rows. Jobs that have ended already are left out.

    A handler takes the jobs of its type as one DataFrame and gives (job_id, result, error_code, error_message). Every job ends in a
    recorded state: one of a wrong target or an unknown type with the code of ``dispatch``; one whose handler raises, or gives no row
    for it, with INTERNAL_ERROR.
    """
    waiting = durable(dispatch(pending(jobs, log)))
    known = F.col("job_type").isin(list(handlers))
    refused = waiting.where(F.col("error_code").isNotNull() | ~known)
    code = F.coalesce("error_code", F.lit("VALIDATION_FAILED"))
    ends = [refused.select("job_id", "job_type", F.lit(None).cast("string").alias("result"), code.alias("error_code"), F.lit("The job cannot be run.").alias("error_message"))]
    for kind, handler in handlers.items():
        own = waiting.where(F.col("error_code").isNull() & (F.col("job_type") == kind))
        done = None
        if not own.isEmpty():
            try:
                done = durable(handler(own).select("job_id", F.col("result").cast("string").alias("result"), "error_code", "error_message", F.lit(True).alias("_ended")))
            except Exception:
                logging.getLogger(__name__).exception("the jobs of type %s failed", kind)
        if done is None:
            done = own.sparkSession.createDataFrame([], f"job_id {own.schema['job_id'].dataType.simpleString()}, result string, error_code string, error_message string, _ended boolean")
        lost = F.col("_ended").isNull()
        ends.append(own.select("job_id", "job_type").join(done, "job_id", "left").select(
            "job_id", "job_type", "result", F.when(lost, "INTERNAL_ERROR").otherwise(F.col("error_code")).alias("error_code"),
            F.when(lost, "The job ended without a result.").otherwise(F.col("error_message")).alias("error_message"),
        ))
    whole = ends[0]
    for one in ends[1:]:
        whole = whole.unionByName(one)
    return whole.withColumn("recorded_at", at)


def wait(log: Callable[[], DataFrame], job_ids: DataFrame, limit: timedelta, every: timedelta = timedelta(seconds=1)) -> DataFrame:
    """(job_id, status): the last states of jobs once all of them have ended. ``log`` reads the log anew each time it is asked, every ``every``. Jobs that
    have not ended within ``limit`` raise TimeoutError, which names how many; a job that the log does not know has not ended."""
    wanted, until = durable(job_ids.select("job_id").distinct()), time.monotonic() + limit.total_seconds()
    while True:
        states = job_states(log()).select("job_id", "status")
        done = durable(wanted.join(states.where(F.col("status").isin(FINAL)), "job_id", "left"))
        open_ = done.where("status IS NULL").count()
        if not open_:
            return done
        forget(done)
        if time.monotonic() >= until:
            raise TimeoutError(f"{open_} jobs have not ended")
        time.sleep(every.total_seconds())


def job_view(jobs: DataFrame) -> DataFrame:
    """What a client sees of a job; ``error`` only where it failed."""
    failed = F.when(F.col("status") == "failed", F.struct(F.coalesce("error_code", F.lit("UNKNOWN")).alias("code"), F.coalesce("error_message", F.lit("")).alias("message")))
    return jobs.select("job_id", "job_type", "status", "course_id", "document_id", "result", failed.alias("error"), "created_at", "started_at", "completed_at")


def log_view(log: DataFrame) -> DataFrame:
    """What a client sees of a log row; missing details are an empty object."""
    return log.select("job_id", "level", "event_type", "message", F.coalesce("details", F.lit("{}")).alias("details"))


def course_summary(documents: DataFrame) -> DataFrame:
    """(course_id, documents, indexed, failures, chunk_count) after indexing."""
    is_ = lambda status: F.sum((F.col("ingestion_status") == status).cast("int"))
    return documents.groupBy("course_id").agg(F.count("*").alias("documents"), is_("indexed").alias("indexed"), is_("failed").alias("failures"), F.sum("chunk_count").alias("chunk_count"))


def course_failures(documents: DataFrame) -> DataFrame:
    """(course_id, document_id, error): the documents that failed. Any number of one course's."""
    return documents.where("ingestion_status = 'failed'").select("course_id", "document_id", F.coalesce("error_message", F.lit("")).alias("error"))


def all_ok(checks: DataFrame) -> DataFrame:
    return checks.agg(F.coalesce(F.every("ok"), F.lit(True)).alias("ok"))

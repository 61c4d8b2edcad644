"""The job stream against a fold over the sorted log."""

import random
from datetime import UTC, datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest

from lodestone.operators.jobs import STATES, wait
from lodestone.streaming.jobs import PROVIDER, TIMER, _Jobs, job_stream, taken

SCHEMA = "job_id string, log_id long, event_type string, recorded_at timestamp"
START = datetime(2024, 5, 1, tzinfo=UTC)


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    yield
    spark.conf.set(key, before)


def millis(at):
    return (at - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1)


def run(spark, folder, batches):
    """What a stream gives that reads a folder into which one file comes after the other."""
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/log")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/log")
        job_stream(stream, timedelta(minutes=30), timedelta(minutes=10)).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    rows = spark.read.parquet(f"{folder}/out").collect()
    return sorted((r.job_id, r.log_id, r.status, millis(r["at"].replace(tzinfo=UTC)), r.problem) for r in rows)


def test_taken():
    hour = 3_600_000
    state, out = taken((None, None), [(0, 1, "queued"), (5, 2, "running"), (9, 3, "running"), (hour + 20, 4, "succeeded")], 2 * hour, hour)
    assert state == ("failed", None)
    assert out == [(1, "queued", 0, None), (2, "running", 5, None), (3, "running", 9, None), (TIMER, "failed", hour + 9, "JOB_TIMED_OUT"), (4, "succeeded", hour + 20, "ILLEGAL_TRANSITION")]
    assert taken(("queued", None), [], hour, hour) == (("queued", None), [])


def test_stream_equals_a_fold(spark, store, tmp_path):
    rng = random.Random(8)
    log = [(f"j{rng.randrange(5)}", k, rng.choice([*STATES, "other"]), START + timedelta(minutes=k / 2, milliseconds=rng.randrange(1000))) for k in range(120)]
    log += [("alone", 900, "job.queued", START), ("alone", 901, "job.started", START + timedelta(minutes=1))]
    # out of order by less than ten minutes, and a third of the rows come twice
    came = sorted(log + rng.sample(log, 40), key=lambda r: r[3] + timedelta(minutes=rng.uniform(0, 8)))
    cut = [came[k : k + 30] for k in range(0, len(came), 30)]
    odd = [(None, 1, "job.queued", START), ("x", None, "job.queued", START), ("x", 2, None, START), ("x", 3, "job.queued", None)]
    got = run(spark, str(tmp_path), [cut[0] + odd, *cut[1:]])
    end = millis(max(r[3] for r in log)) - 600_000
    want = []
    for job in {r[0] for r in log}:
        rows = [(millis(at), n, STATES[event]) for j, n, event, at in log if j == job and event in STATES and millis(at) <= end]
        want += [(job, *row) for row in taken((None, None), rows, end, 1_800_000)[1]]
    got = [r for r in got if r[3] <= end]
    assert sorted(got, key=str) == sorted((r for r in want if r[3] <= end), key=str)
    assert ("alone", TIMER, "failed", millis(START + timedelta(minutes=31)), "JOB_TIMED_OUT") in got
    assert len({r[4] for r in got}) == 3


class Counted:
    """A state that counts the calls that a processor makes."""

    def __init__(self):
        self.calls, self.held, self.timers = 0, {}, []

    def getValueState(self, name, schema):  # noqa: N802 - names of the interface
        return self._State(self, name, None)

    getListState = getMapState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.append(at)

    class _State:
        def __init__(self, owner, name, empty):
            self.owner, self.name = owner, name

        def __getattr__(self, call):
            def done(*values):
                own, name = self.owner, self.name
                own.calls += 1
                if call == "appendList":
                    own.held.setdefault(name, []).extend(values[0])
                elif call in ("update", "put"):
                    own.held[name] = values[0]
                elif call == "clear":
                    own.held.pop(name, None)
                elif call == "exists":
                    return name in own.held
                return iter(own.held.get(name, [])) if name == "waiting" else own.held.get(name)

            return done


def test_calls_do_not_grow_with_rows():
    """A job's rows go to the state together and come back together; one call for each row took hours at 60 times the table."""
    calls = {}
    for n in (10, 1000):
        handle = Counted()
        jobs = _Jobs(3_600_000)
        jobs.init(handle)
        rows = pd.DataFrame({"log_id": range(n), "at": range(n), "status": ["queued", *["running"] * (n - 1)]})
        list(jobs.handleInputRows(("a",), iter([rows, rows]), None))
        now, passed = SimpleNamespace(getExpiryTimeInMs=lambda: 1), SimpleNamespace(getCurrentWatermarkInMs=lambda: 5_000_000)
        out = pd.concat(jobs.handleExpiredTimer(("a",), passed, now))
        assert len(out) == n + 1 and out["log_id"].iloc[-1] == TIMER
        calls[n] = handle.calls
    assert calls[10] == calls[1000] < 12


def test_wait_for_jobs(spark):
    rows = [("a", 1, "job.queued", START), ("b", 2, "job.succeeded", START)]
    reads = []

    def log():
        reads.append(1)
        return spark.createDataFrame(rows + ([("a", 3, "job.failed", START)] if len(reads) > 1 else []), SCHEMA)

    jobs = spark.createDataFrame([("a",), ("b",), ("b",)], "job_id string")
    got = {r.job_id: r.status for r in wait(log, jobs, timedelta(minutes=1), timedelta(0)).collect()}
    assert got == {"a": "failed", "b": "succeeded"} and len(reads) == 2
    with pytest.raises(TimeoutError, match="1 jobs"):
        wait(log, jobs.limit(0).unionByName(spark.createDataFrame([("never",)], "job_id string")), timedelta(0), timedelta(0))

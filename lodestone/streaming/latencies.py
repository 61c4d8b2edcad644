"""How long things took, as they end: starts and ends are two streams, joined within a span of time."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import seconds_between


def latencies(started: DataFrame, ended: DataFrame, key: str, within: timedelta, late: timedelta = timedelta(minutes=10)) -> DataFrame:
    """(key, started_at, ended_at, seconds) of starts (key, at) and the ends (key, at) of the same key that follow within a span, of two streams or two
    tables. A start that no end follows has null ends: from a table at once, from a stream when the watermarks of both have passed
    its span, so that nothing is kept longer than the span and the lateness.

    A start is joined with every end in its span; starts and ends without a key or a time are left out; rows later than ``late`` are dropped by a stream.
    """
    span = f"INTERVAL {within // timedelta(milliseconds=1)} MILLISECONDS"

    def side(rows: DataFrame, name: str) -> DataFrame:
        out = rows.select(F.col(key).alias(f"{name}_key"), F.col("at").cast("timestamp").alias(f"{name}_at")).where(f"{name}_key IS NOT NULL AND {name}_at IS NOT NULL")
        return out.withWatermark(f"{name}_at", f"{late // timedelta(milliseconds=1)} milliseconds") if out.isStreaming else out

    pairs = side(started, "started").join(side(ended, "ended"), F.expr(f"started_key = ended_key AND ended_at >= started_at AND ended_at <= started_at + {span}"), "left")
    return pairs.select(F.col("started_key").alias(key), "started_at", "ended_at", seconds_between(F.col("started_at"), F.col("ended_at")).alias("seconds"))

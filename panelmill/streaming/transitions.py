"""Transition counts over a stream of (person, time, state) rows, and windowed counts with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def transitions(stream: DataFrame, person: str, time: str, state: str, idle: str | None = None) -> DataFrame:
    """(person, time, state, next) for consecutive rows of a person as they arrive.

    A person's last row is the only state kept, so memory grows with people, not with rows; with ``idle`` (as ``2 hours``) the row of
    a person of whom nothing came for so long is forgotten. Rows of a person must arrive in time order across batches; within
    a batch they are sorted. Rows without a person or a time are left out; of rows of one time the last one stands.
    """
    rows = stream.select(F.col(person).cast("long").alias("person"), F.col(time).cast("long").alias("t"), F.col(state).alias("s")).where("person is not null and t is not null")
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def step(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        new = pd.concat(list(batches))[["t", "s"]]
        if kept.exists:
            last = kept.get
            new = pd.concat([pd.DataFrame({"t": [last[0]], "s": [last[1]]}), new[new["t"] >= last[0]]])
        new = new.sort_values("t", kind="stable").drop_duplicates("t", keep="last")
        after = new.shift(-1)
        out = pd.DataFrame({"person": key[0], "t": new["t"], "state": new["s"], "next": after["s"]})[(after["t"] - new["t"] == 1).to_numpy()]
        kept.update((int(new["t"].iloc[-1]), new["s"].iloc[-1]))
        if wait:
            kept.setTimeoutDuration(wait)
        yield out

    timeout = GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout
    return rows.groupBy("person").applyInPandasWithState(step, "person long, t long, state string, next string", "t long, s string", "append", timeout)


def windowed_counts(stream: DataFrame, time: str, kind: str, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts by event kind and time window; rows later than the watermark are dropped by it."""
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")

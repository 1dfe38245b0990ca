"""Structured Streaming over run logs and events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fields of a training log record.
LOG = "ts timestamp, run string, event string, epoch int, step long, loss double, seconds double"


def follow(spark: SparkSession, path: str, schema: str = LOG, per_trigger: int = 1000) -> DataFrame:
    """New JSON lines under a folder as a stream; lines that do not parse are skipped."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", per_trigger).load(path)
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).where("r.event is not null").select("r.*")


def rates(events: DataFrame, ts: str = "ts", kind: str = "event", width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events per tumbling window and kind; windows close when the watermark passes (the watermark is ours to choose)."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n")).select("window.start", kind, "n")


#: Steps of a run that wait for earlier ones before they are folded into the average for good.
WAIT = 1000


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    average, n, last, late, steps, seconds = state.get if state.exists else (None, 0, None, 0, [], [])
    waiting = list(zip(steps, seconds, strict=True))
    for frame in frames:
        for step, x in frame[["step", "seconds"]].dropna().itertuples(index=False):
            if last is not None and step < last:
                late += 1
            else:
                waiting.append((int(step), float(x)))
                n += 1
    waiting.sort()

    def folded(a: float | None, values: list) -> float | None:
        for _, x in values:
            a = x if a is None else a * 0.8 + x * 0.2
        return a

    done, waiting = waiting[: max(0, len(waiting) - WAIT)], waiting[max(0, len(waiting) - WAIT) :]
    if done:
        average, last = folded(average, done), done[-1][0]
    state.update((average, n, last, late, [s for s, _ in waiting], [x for _, x in waiting]))
    yield pd.DataFrame({"run": [key[0]], "n": [n], "ema": [folded(average, waiting)], "late": [late]})


def ema(events: DataFrame) -> DataFrame:
    """Moving average of seconds per step by run, kept as state between batches: (run, n, ema, late).

    The last ``WAIT`` steps of a run are kept apart and put in order before they are averaged, so files may arrive in any
    order within that; a step from before them is not averaged but counted in ``late``.
    """
    state = "ema double, n long, last long, late long, steps array<long>, seconds array<double>"
    return events.groupBy("run").applyInPandasWithState(_update, "run string, n long, ema double, late long", state, "update", GroupStateTimeout.NoTimeout)

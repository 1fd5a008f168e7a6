"""Stale points as a stream: timers tell of a sample that grew too old, without another sample.

Sweeps come at the ticks of a grid. At a tick, a point's value is the sample that arrived last (greatest ingest_seq) of those taken up to it; it is stale by its
quality, or if it is older than its window, strictly. Each sample is told of once, at the first tick that finds it stale. A point's rows wait until the watermark has passed
them; a timer stands at the next tick that could find the present sample stale. Late rows are dropped and counted by Spark.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .lifecycle import MICROS, Waiting, micros

OUTPUT = "point_id string, ingest_seq long, tick timestamp_ntz"
WAITING = "at long, seq long, received long, window long, stale boolean"
CURRENT = "at long, seq long, received long, window long, stale boolean, told boolean"


class Health(StatefulProcessor):
    def __init__(self, first: int, step: int) -> None:
        self.first, self.step = first, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.current, self.waiting = handle, handle.getValueState("current", CURRENT), Waiting(handle, WAITING)

    def stale_at(self, at: int, received: int, window: int, stale: bool) -> int:
        """The first tick that finds a sample stale."""
        least = at if stale else max(at, received + window * MICROS + 1)
        return self.first + max(0, -(-(least - self.first) // self.step)) * self.step

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            received = part["received_timestamp"].fillna(part["source_timestamp"])
            self.waiting.add(list(zip(micros(part["ts"]), part["ingest_seq"].tolist(), micros(received), part["stale_after_seconds"].tolist(), part["quality"].str.strip().str.upper().eq("STALE").tolist(), strict=True)))
        yield pd.DataFrame([], columns=["point_id", "ingest_seq", "tick"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        now, out = tuple(self.current.get()) if self.current.exists() else None, []

        def tell(sample: tuple, before: int) -> tuple:
            """The sample, told of if a tick before the given time finds it stale."""
            *facts, told = sample
            tick = self.stale_at(facts[0], *facts[2:])
            if not told and tick < before:
                out.append((key[0], facts[1], pd.Timestamp(tick, unit="us")))
                told = True
            return (*facts, told)

        for row in self.waiting.passed(watermark // 1000):
            if now is None or row[1] > now[1]:
                if now is not None:
                    tell(now, row[0])
                now = (*row, False)
        if now is not None:
            now = tell(now, watermark + 1)
            if not now[-1]:
                self.handle.registerTimer(-(-self.stale_at(now[0], *now[2:-1]) // 1000))
            self.current.update(now)
        yield pd.DataFrame(out, columns=["point_id", "ingest_seq", "tick"])

    def close(self) -> None:
        pass


def streaming_stale_points(samples: DataFrame, first_tick: str, step_seconds: int, lateness: str = "0 seconds") -> DataFrame:
    """point_id, ingest_seq and tick of each sample that a sweep finds stale, at the first such tick from ``first_tick`` on; samples may come ``lateness`` out of order."""
    slim = samples.select("point_id", "ingest_seq", "ts", "quality", "received_timestamp", "source_timestamp", "stale_after_seconds", F.col("ts").cast("timestamp").alias("event_time")).withWatermark("event_time", lateness)
    grid = Health(int(pd.Timestamp(first_tick).value // 1000), step_seconds * MICROS)
    return slim.groupBy("point_id").transformWithStateInPandas(statefulProcessor=grid, outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

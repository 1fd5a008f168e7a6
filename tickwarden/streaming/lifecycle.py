"""The alarm lifecycle as a stream, in two ways that give what the batch operators give.

``streaming_transitions`` orders by time: rows of a rule wait in its state until the watermark has passed them and are then worked through
in the order of (ts, seq), whatever order they came in. A row that the watermark has passed before it came is late: Spark drops it and counts it in the
query's progress (numRowsDroppedByWatermark); the alarms are those of a history without it. The rules' states can begin with
those at the end of a batch run. What a rule costs is its rows of the watermark's delay, in one task.

``lifecycle_sink`` orders by arrival and bears rules of any size: each micro-batch is run through the batch operator, which cuts rules with many rows into
segments, on top of the states that the micro-batch before left in a store of tables; states and transitions are committed together with the micro-batch's number.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.lifecycle import ACTIVE, CLEARED, NONE, PENDING, SEGMENT_ROWS, continued, end_states, transitions
from ..sources.snapshots import Transaction, batch_sink

OUTPUT = "rule_id string, ts timestamp_ntz, seq long, episode long, event_type string, event_previous_state string, event_new_state string"
STATE = "state string, since long, episode long"
WAITING = "at long, seq long, triggered boolean, clears boolean, delay long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = {PENDING: "PENDING_CREATED", ACTIVE: "ALARM_ACTIVATED", NONE: "ALARM_CLEARED"}
MICROS = 1_000_000


def step(state: str, since: float, triggered: bool, clears: bool, at: float, delay: float) -> tuple[str, float]:
    """The state after one evaluation; since is when the current run of triggered evaluations began."""
    if triggered:
        since = at if pd.isna(since) else since
        if state == ACTIVE or delay <= 0 or at - since >= delay:
            return ACTIVE, since
        return PENDING, since
    if state == ACTIVE and not clears:
        return ACTIVE, float("nan")
    return NONE, float("nan")


def micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


class Waiting:
    """Rows that wait for the watermark in a list state, and the timer for the first of them."""

    def __init__(self, handle: StatefulProcessorHandle, schema: str) -> None:
        self.handle, self.rows = handle, handle.getListState("waiting", schema)

    def _again_at(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def add(self, rows: list[tuple]) -> None:
        """Rows begin with their time in microseconds."""
        if rows:
            self.rows.appendList(rows)
            self._again_at(min(r[0] for r in rows))

    def passed(self, watermark_ms: int) -> list[tuple]:
        """The rows up to the watermark, by time and number; they wait no more."""
        rows = sorted(tuple(r) for r in self.rows.get()) if self.rows.exists() else []
        done = [r for r in rows if r[0] <= watermark_ms * 1000]
        if done:
            left = rows[len(done) :]
            if left:
                self.rows.put(left)
                self._again_at(left[0][0])
            else:
                self.rows.clear()
        return done


class Lifecycle(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.alarm, self.waiting = handle.getValueState("alarm", STATE), Waiting(handle, WAITING)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        row = initialState.iloc[0]
        self.alarm.update((row["state"], None if pd.isna(row["since"]) else micros(pd.Series([row["since"]]))[0], int(row["episode"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            self.waiting.add(list(zip(micros(part["ts"]), part["seq"].tolist(), (part["status"] == "Triggered").tolist(), part["clears"].astype(bool).tolist(), part["delay_seconds"].tolist(), strict=True)))
        yield pd.DataFrame([], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, since, episode = tuple(self.alarm.get()) if self.alarm.exists() else (NONE, None, 0)
        since, out = float("nan") if since is None else since, []
        for at, seq, triggered, clears, delay in self.waiting.passed(timerValues.getCurrentWatermarkInMs()):
            was = state
            state, since = step(state, since, triggered, clears, at, delay * MICROS)
            episode += was == NONE and state != NONE
            if was != state:
                out.append((key[0], pd.Timestamp(at, unit="us"), seq, episode, EVENT[state], "" if was == NONE else was, CLEARED if state == NONE else state))
        self.alarm.update((state, None if pd.isna(since) else int(since), int(episode)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def streaming_transitions(evaluations: DataFrame, lateness: str = "0 seconds", initial: DataFrame | None = None) -> DataFrame:
    """Transitions of a stream of rule_id, ts, seq, status, clears and delay_seconds; rows may come ``lateness`` out of order.

    ``initial`` has rule_id, state, since and episode, as ``end_states`` gives them. The session needs the RocksDB state store (PROVIDER).
    """
    slim = evaluations.select("rule_id", "ts", "seq", "status", "clears", "delay_seconds", F.col("ts").cast("timestamp").alias("event_time")).withWatermark("event_time", lateness)
    grouped = None if initial is None else initial.select("rule_id", "state", "since", "episode").groupBy("rule_id")
    return slim.groupBy("rule_id").transformWithStateInPandas(statefulProcessor=Lifecycle(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime", initialState=grouped)


def continue_alarms(tables: Transaction, evaluations: DataFrame, segment_rows: int = SEGMENT_ROWS) -> None:
    """The evaluations on top of the states in ``alarm_states``: new states there, changes into ``alarm_transitions``. Of the states, only those of the rules at hand are read and written."""
    rows = tables.staged(evaluations)
    before = tables.table("alarm_states") if tables.has("alarm_states") else None
    states = tables.staged(continued(rows, before, segment_rows))
    tables.append("alarm_transitions", transitions(states).select(*(c.split()[0] for c in OUTPUT.split(", "))))
    tables.upsert("alarm_states", end_states(states), "rule_id")


def lifecycle_sink(root: str, stream: str = "alarms", segment_rows: int = SEGMENT_ROWS) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: evaluations in the order of their arrival, into the store at ``root``."""
    return batch_sink(root, stream, lambda tables, batch: continue_alarms(tables, batch, segment_rows))


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

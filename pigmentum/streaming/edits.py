"""Edit logs as a stream: the stacks of every open editor as state, which ends with the session."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.history import STEPS, Stacks


class _Editor(StatefulProcessor):
    """One editor: both stacks as lists, what it shows, and a timer at the end of its session."""

    def __init__(self, key: str, at: str, tie: str, limit: int, idle: float):
        self.key, self.at, self.tie, self.limit, self.idle = key, at, tie, limit, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.past = handle.getListState("past", "version string")
        self.future = handle.getListState("future", "version string")
        self.shown = handle.getValueState("shown", "version string, opened boolean, dirty boolean, last bigint, timer bigint")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s, last, timer = Stacks(self.limit), None, -1
        if self.shown.exists():
            s.shown, s.opened, s.dirty, last, timer = self.shown.get()
            s.past.extend(v for (v,) in self.past.get())
            s.future.extend(v for (v,) in self.future.get())
        pdf = pd.concat(list(rows)).sort_values([self.at, self.tie])
        out = []
        for action, version, t in zip(pdf["action"], pdf["version"], pdf["micros"], strict=True):
            if last is not None and t - last >= self.idle * 1e6:
                s.close()
            last = int(t)
            s.apply(action, version)
            out.append(s.row())
        due = math.ceil(last / 1000 + 1000 * self.idle)
        if due != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        for state, held in ((self.past, s.past), (self.future, s.future)):
            state.put([(v,) for v in held]) if held else state.clear()
        self.shown.update((s.shown, s.opened, s.dirty, last, due))
        yield pdf[[self.key, self.tie]].reset_index(drop=True).join(pd.DataFrame(out, columns=["version", "undos", "redos", "dirty"]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.past, self.future, self.shown):
            state.clear()
        yield from ()


def replay(log: DataFrame, key: str, at: str, tie: str, idle: float, limit: int = STEPS, delay: str = "1 minute") -> DataFrame:
    """(key, tie, version, undos, redos, dirty) after each row of a stream (key, at, tie, action, version).

    The rows are those of `operators.history.replay` with the same `idle`. An editor's rows come in
    order; later ones than the delay are dropped. The state of an editor is gone once the watermark
    has passed its last row by `idle` seconds, so it grows with the open sessions. Needs the RocksDB state store.
    """
    kinds = dict(log.dtypes)
    rows = log.select(key, at, tie, "action", F.col("version").cast("string").alias("version"), F.unix_micros(F.col(at)).alias("micros")).withWatermark(at, delay)
    schema = f"{key} {kinds[key]}, {tie} {kinds[tie]}, version string, undos bigint, redos bigint, dirty boolean"
    out = rows.groupBy(key).transformWithStateInPandas(_Editor(key, at, tie, limit, idle), schema, "Append", "EventTime")
    return out.withColumn("version", F.col("version").cast(kinds["version"]))

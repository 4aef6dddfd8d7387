"""Fixed-window rate limiting: a window opens at a client's first request, not at whole hours.

`decide` is the batch form, a fold over each client's ordered requests; `decide_stream` is the same
on a stream, with one small state per client. Both give the same decisions for the same order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _fold(pdf: pd.DataFrame, at: str, limit: int, seconds: float, opened: float | None, n: int) -> tuple[pd.DataFrame, float | None, int]:
    """Ordered requests with their decisions, when the last window opened and its count; a step a window, not a request."""
    s = pdf[at].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
    allowed, wait, i = np.empty(len(s), bool), np.zeros(len(s), np.int64), 0
    while i < len(s):
        if opened is None or s[i] >= opened + seconds:
            opened, n = float(s[i]), 0
        end = i + int(np.searchsorted(s[i:], opened + seconds))
        allowed[i:end] = np.arange(n + 1, n + 1 + end - i) <= limit
        wait[i:end] = np.where(allowed[i:end], 0, -((s[i:end] - opened - seconds) // 1))
        n, i = n + end - i, end
    return pdf.assign(allowed=allowed, retry_after=wait), opened, n


def decide(requests: DataFrame, client: str, at: str, tie: str, limit: int, seconds: float) -> DataFrame:
    """Requests with allowed and retry_after (whole seconds): the first `limit` of every window pass."""
    kinds = dict(requests.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _fold(pdf.sort_values([at, tie]), at, limit, seconds, None, 0)[0][[client, tie, "allowed", "retry_after"]]

    return requests.select(client, at, tie).groupBy(client).applyInPandas(run, f"{client} {kinds[client]}, {tie} {kinds[tie]}, allowed boolean, retry_after bigint")


class _Limit(StatefulProcessor):
    """A client's open window: when it opened, its count, and the timer at its end, which takes the state away."""

    def __init__(self, out: list[str], at: str, tie: str, limit: int, seconds: float):
        self.out, self.at, self.tie, self.limit, self.seconds = out, at, tie, limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "opened double, n bigint, timer bigint")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        opened, n, timer = self.window.get() or (None, 0, -1)
        out, opened, n = _fold(pd.concat(list(rows)).sort_values([self.at, self.tie]), self.at, self.limit, self.seconds, opened, n)
        due = math.ceil(1000 * (opened + self.seconds))
        if due != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.window.update((opened, n, due))
        yield out[self.out]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        yield from ()


def decide_stream(requests: DataFrame, client: str, at: str, tie: str, limit: int, seconds: float, delay: str = "1 minute") -> DataFrame:
    """The same on a stream of requests that come in order per client; later ones than the delay are dropped.

    The state holds when the client's window opened and its count. Once the watermark has passed
    the window's end, any further request would open another one, so the state goes: it grows with
    the clients of a window, not with all there ever were. Needs the RocksDB state store.
    """
    kinds = dict(requests.dtypes)
    out = [client, tie, "allowed", "retry_after"]
    schema = f"{client} {kinds[client]}, {tie} {kinds[tie]}, allowed boolean, retry_after bigint"
    return requests.select(client, at, tie).withWatermark(at, delay).groupBy(client).transformWithStateInPandas(_Limit(out, at, tie, limit, seconds), schema, "Append", "EventTime")

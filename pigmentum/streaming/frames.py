"""Frames as a stream: duplicates dropped within a watermark, cuts and crossfades found as soon as their surroundings are known."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import kernels


def distinct_frames(stream: DataFrame, key: str = "video", at: str = "ts", delay: str = "1 second", step_ms: int = 1) -> DataFrame:
    """Frames whose time, in steps of a millisecond, was not seen before within the delay."""
    slot = F.floor(F.unix_micros(F.col(at)) / (1000 * step_ms)).cast("bigint")
    return stream.withColumn("slot", slot).withWatermark(at, delay).dropDuplicatesWithinWatermark([key, "slot"])


class _Cuts(StatefulProcessor):
    """Cuts and fades of one video. State: frames that later ones may still need, candidates whose
    group is still open, and how far the video is judged; all of it goes when the video ends."""

    def __init__(self, key: str, w: int, h: int, idle: float):
        self.key, self.w, self.h, self.idle = key, w, h, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getListState("frames", "t double, v array<double>")
        self.open = handle.getListState("open", "time double, kind string, length double, share double")
        self.judged = handle.getValueState("judged", "judged double, first double, timer bigint")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        judged, first, timer = self.judged.get() or (-math.inf, math.inf, -1)
        held = {t: v for t, v in self.frames.get()} if self.frames.exists() else {}
        for pdf in rows:
            for ts, v in zip(pdf["ts"], pdf["v"], strict=True):
                t = ts.value / 1e9
                if t > judged:  # what comes later than its watermark is too late
                    held.setdefault(t, v)
        yield from self._advance(key, held, judged, first, timer, timerValues.getCurrentWatermarkInMs() / 1000, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        judged, first, _ = self.judged.get()
        held = {t: v for t, v in self.frames.get()}
        now = timerValues.getCurrentWatermarkInMs() / 1000
        yield from self._advance(key, held, judged, first, -1, now, max(held) + self.idle <= now)

    def _advance(self, key, held: dict, judged: float, first: float, timer: int, now: float, ended: bool) -> Iterator[pd.DataFrame]:
        """Judges the frames whose surroundings the watermark has passed, or all at the video's end."""
        times = np.array(sorted(held))
        whole = len(times) if ended else int(np.searchsorted(times, now, "right"))  # in order and complete
        if whole:
            first = min(first, float(times[0]))
        # a frame is judged once AROUND frames beyond its reach are there
        upto = whole if ended else int(np.searchsorted(times, times[whole - kernels.AROUND] - kernels.REACH)) if whole > kernels.AROUND else 0
        lo = int(np.searchsorted(times, judged, "right"))
        groups = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        if upto > lo:
            # with its first two frames alone a video has no cut
            if upto > 2 or times[0] > first:
                seen = np.stack([np.asarray(held[t], float) for t in times[:whole]]).reshape(-1, self.h, self.w)
                groups += kernels.cut_candidates(seen, times[:whole], lo, upto, first, float(times[whole - 1]))
            judged = float(times[upto - 1])
        groups.sort()
        done, at = [], 0
        for i in range(1, len(groups) + 1):
            last = i == len(groups)
            if (groups[i][0] - groups[i - 1][0] > kernels.APART) if not last else (ended or groups[-1][0] + kernels.APART < judged):
                done += kernels.choose_cuts(groups[at:i])
                at = i
        if ended:
            self.frames.clear()
            self.open.clear()
            self.judged.clear()
        else:
            keep = max(0, int(np.searchsorted(times, judged - kernels.REACH)) - kernels.AROUND) if math.isfinite(judged) else 0
            self.frames.put([(float(t), list(map(float, held[t]))) for t in times[keep:]])
            self.open.put(groups[at:]) if groups[at:] else self.open.clear()
            # the next look: when the frames on hand are complete and judged, at the latest when the video counts as ended
            due = int(1000 * (times[-1] + self.idle)) + 1
            if due != timer:
                if timer >= 0:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(due)
            self.judged.update((judged, first, due))
        yield pd.DataFrame([(key[0], *c) for c in done], columns=[self.key, "time", "kind", "length"], dtype=object)


def cuts(stream: DataFrame, w: int, h: int, key: str = "video", delay: str = "1 second", idle: float = 10.0) -> DataFrame:
    """(key, time, kind, length) of hard cuts and crossfades from frames (key, ts, v) in any order within the delay.

    The decisions are those of the batch form (`operators.video.cuts`) with ts in seconds as the
    time: a frame is judged once the watermark has passed what lies within reach of it, and a group
    of candidates is chosen from once no other can join it. A video without frames for `idle`
    seconds has ended: its last frames are judged as such and its state is gone; later frames begin
    a video of their own. Of frames with the same time one counts. Needs the RocksDB state store.
    """
    rows = stream.select(key, F.col("ts"), F.col("v")).withWatermark("ts", delay)
    schema = f"{key} {dict(stream.dtypes)[key]}, time double, kind string, length double"
    return rows.groupBy(key).transformWithStateInPandas(_Cuts(key, w, h, idle), schema, "Append", "EventTime")


def autosaves(stream: DataFrame, key: str = "client", at: str = "ts", quiet: str = "800 milliseconds", delay: str = "1 minute") -> DataFrame:
    """One save per burst of edits: (key, saved, edits) once a key was quiet for so long."""
    w = F.session_window(at, quiet)
    return stream.withWatermark(at, delay).groupBy(key, w).agg(F.max(at).alias("saved"), F.count(F.lit(1)).alias("edits")).select(key, "saved", "edits")

"""Edit history: an editor's log replayed on two bounded stacks, one of versions to undo and one to redo.

Actions of a log: `open` and `switch` show a version and empty both stacks, `edit` shows a new version and
can be undone, `drag` shows one that can't by itself, `commit` puts what is shown on the undo stack, `undo`
and `redo` step, `save` ends the dirty state. The first version in a log opens it, whatever brought it;
steps before that, steps on an empty stack, and null or unknown actions change nothing.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

STEPS = 60


class Stacks:
    """What an editor shows, what it can undo (the last first) and redo (the first first)."""

    def __init__(self, limit: int):
        self.past: deque = deque(maxlen=limit)
        self.close()

    def close(self) -> None:
        self.past.clear()
        self.future: list = []  # the next to redo stands last
        self.shown, self.opened, self.dirty = None, False, False

    def apply(self, action: str | None, version) -> None:
        if not self.opened:
            if action in ("open", "switch", "edit", "drag"):
                self.shown, self.opened, self.dirty = version, True, action == "switch"
            return
        match action:
            case "open" | "switch":
                self.past.clear()
                self.future.clear()
                self.shown, self.dirty = version, action == "switch"
            case "edit":
                self.past.append(self.shown)
                self.future.clear()
                self.shown, self.dirty = version, True
            case "drag":
                self.shown, self.dirty = version, True
            case "commit":
                self.past.append(self.shown)
                self.future.clear()
            case "undo" if self.past:
                self.future.append(self.shown)
                self.shown, self.dirty = self.past.pop(), True
            case "redo" if self.future:
                self.past.append(self.shown)
                self.shown, self.dirty = self.future.pop(), True
            case "save":
                self.dirty = False

    def row(self) -> tuple:
        return self.shown, len(self.past), len(self.future), self.dirty


def replay(log: DataFrame, key: str, *order: str, limit: int = STEPS, idle: float | None = None) -> DataFrame:
    """(key, *order, version, undos, redos, dirty): what every editor shows after each row of (key, *order, action, version).

    With `idle`, the first of `order` is a timestamp, and an editor without rows for so many seconds is
    closed. One shuffle by key and a sort that spills; a task walks its rows in order and holds the
    stacks of one editor, at most `limit` versions, however long its log is. Rows with a null key are one editor.
    """
    kept = log.select(key, *order).schema
    types = {f.name: f for f in log.schema}
    out = StructType([*kept, StructField("version", types["version"].dataType), StructField("undos", LongType()), StructField("redos", LongType()), StructField("dirty", BooleanType())])
    at = F.unix_micros(F.col(order[0])) if idle is not None else F.lit(None).cast("bigint")
    names = [f.name for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, whose, last = Stacks(limit), object(), None
        for b in batches:
            rows = []
            for k, action, version, t in zip(*(b.column(c).to_pylist() for c in (key, "action", "version", "_at")), strict=True):
                if k != whose or (t is not None and last is not None and t - last >= idle * 1e6):
                    s.close()
                whose, last = k, t
                s.apply(action, version)
                rows.append(s.row())
            version, undos, redos, dirty = zip(*rows, strict=True) if rows else ((),) * 4
            new = [pa.array(version, b.schema.field("version").type), pa.array(undos, pa.int64()), pa.array(redos, pa.int64()), pa.array(dirty, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *new], names=names)

    dealt = log.select(key, *order, "action", "version", at.alias("_at")).repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(run, out)


def current(log: DataFrame, key: str, order: str, limit: int = STEPS) -> DataFrame:
    """(key, version, undos, redos): what each editor shows after its log (key, order, action, version)."""
    last = F.max_by(F.struct("version", "undos", "redos"), F.col(order))
    return replay(log, key, order, limit=limit).groupBy(key).agg(last.alias("s")).select(key, "s.*")

"""Undo and redo: both stacks against a loop over lists, batches of one long log, the stream against the batch form."""

import datetime as dt
import random

import pytest

from pigmentum.operators import history
from pigmentum.streaming import edits

ACTIONS = ["edit"] * 6 + ["undo"] * 4 + ["redo"] * 3 + ["drag", "commit", "save", "open", "switch", "blur", None]
SCHEMA = "editor long, ts timestamp, n int, action string, version long"
T0 = dt.datetime(2024, 1, 1)


def log(seed, n, editors=3, gaps=(1, 2, 400)):
    rng, at, rows = random.Random(seed), 0, []
    for i in range(n):
        at += rng.choice(gaps)
        rows.append((rng.randrange(editors), T0 + dt.timedelta(seconds=at), i, rng.choice(ACTIONS), 2**60 + i if rng.random() < 0.9 else None))
    return rows


def plain(rows, limit, idle=None):
    """The tape form: all versions in a row with a cursor, in place of two stacks."""
    out, tapes = {}, {}
    for editor, ts, n, action, version in rows:
        t = tapes.get(editor)
        if t and idle is not None and (ts - t["last"]).total_seconds() >= idle:
            t = None
        if t is None and action in ("open", "switch", "edit", "drag"):
            t = tapes[editor] = {"tape": [version], "c": 0, "dirty": action == "switch"}
        elif t is None:
            tapes.pop(editor, None)
            out[n] = (None, 0, 0, False)
            continue
        elif action in ("open", "switch"):
            t.update(tape=[version], c=0, dirty=action == "switch")
        elif action in ("edit", "commit"):
            t["tape"] = (t["tape"][: t["c"] + 1] + [version if action == "edit" else t["tape"][t["c"]]])[-limit - 1 :]
            t["c"], t["dirty"] = len(t["tape"]) - 1, t["dirty"] or action == "edit"
        elif action == "drag":
            t["tape"][t["c"]], t["dirty"] = version, True
        elif action == "undo" and t["c"] > 0:
            t["c"], t["dirty"] = t["c"] - 1, True
        elif action == "redo" and t["c"] + 1 < len(t["tape"]):
            t["c"], t["dirty"] = t["c"] + 1, True
        elif action == "save":
            t["dirty"] = False
        t["last"] = ts
        out[n] = (t["tape"][t["c"]], t["c"], len(t["tape"]) - 1 - t["c"], t["dirty"])
    return out


def shown(rows):
    return {r.n: (r.version, r.undos, r.redos, r.dirty) for r in rows}


@pytest.mark.parametrize(("limit", "idle"), [(3, None), (60, None), (4, 400)])
def test_replay_as_a_tape(spark, limit, idle):
    rows = log(limit, 1500)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert shown(history.replay(df, "editor", "ts", "n", limit=limit, idle=idle).collect()) == plain(rows, limit, idle)


def test_one_editor_over_many_batches(spark):
    rows = [(None, *r[1:]) for r in log(8, 900, 1)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert shown(history.replay(spark.createDataFrame(rows, SCHEMA), "editor", "ts", "n").collect()) == plain(rows, 60)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert history.replay(spark.createDataFrame([], SCHEMA), "editor", "ts", "n").count() == 0


def test_stream_as_in_batch(spark, tmp_path, rocksdb):
    rows = log(5, 160)
    last = (9, T0 + dt.timedelta(days=2), 999, "edit", 1)
    for i, part in enumerate([*(rows[k : k + 30] for k in range(0, 160, 30)), [last]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = edits.replay(stream, "editor", "ts", "n", idle=600, limit=4)
    q = out.writeStream.format("memory").queryName("edits").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [r for r in spark.table("edits").collect() if r.editor != 9]
    assert shown(got) == plain(rows, 4, 600)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3  # the last editor's stacks and its timer

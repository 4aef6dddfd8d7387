"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that an operator's code sees at once; long texts make the second one matter.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
#: Rows of keys that are broadcast at most; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000

LOWER = bytes(range(256)).lower()


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow limits to this subpackage's, which are always the same; smaller ones stay.

    What Spark sends a worker at once is held several times, in the JVM and in the worker. The limits
    apply when a plan runs, so they can't be put back before.
    """
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        n, unit = re.match(r"(-?\d+)\s*([kmg]?)", spark.conf.get(name).lower()).groups()
        if int(n) <= 0 or int(n) * units.get(unit, 1) > most:
            spark.conf.set(name, str(most))


def small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded rows and bytes, none empty."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = min(BATCH_ROWS, b.num_rows - at)
            while n > 1 and b.slice(at, n).nbytes > BATCH_BYTES:
                n //= 2
            yield b.slice(at, n)
            at += n


def map_batches(df: DataFrame, cols: list | None, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow over the named columns only (None: all), so that the scan reads nothing else."""

    def run(batches):
        return fn(small_batches(batches))

    bound_batches(df.sparkSession)
    return (df if cols is None else df.select(*cols)).mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, i: int) -> list[str]:
    """Column i as Python strings; null becomes the empty text."""
    return [x or "" for x in batch.column(i).to_pylist()]


def bucket(col: Column, mod: int) -> Column:
    """crc32 of a value's text, modulo; a null value counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() in the cluster's shared folder; a folder of our own only in a local session where none is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.match(r"local(\[[^,\]]*(,\d+)?\])?$", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the DataFrame doesn't have yet, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def docs(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

"""Archives of many files: each file's entry is worked out by itself, its place is a running sum of lengths.

Entries are stored, not packed (pictures are packed already). The bytes of an archive are rows in order
of their offset, so no task holds one whole; only its directory, a short line a file, is one value.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What the format's 16- and 32-bit fields can hold.
MOST_FILES, MOST_BYTES = 65_535, 2**32 - 1
# Fixed values of the format: signatures, version needed, the flag of UTF-8 names, 1 January 1980.
LOCAL, CENTRAL, END, VERSION, UTF8, DATE = 0x04034B50, 0x02014B50, 0x06054B50, 20, 0x0800, 0x21


def _little(*fields: tuple[Column | int, int]) -> Column:
    """Numbers as bytes, the lowest first: (number, bytes) each."""
    out = []
    for x, n in fields:
        c = F.lit(x).cast("bigint") if isinstance(x, int) else x.cast("bigint")
        out += [F.lpad(F.hex(F.shiftright(c, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(n)]
    return F.unhex(F.concat(*out))


def entries(files: DataFrame, key: str) -> DataFrame:
    """(key, path, offset, size, content, local, central): files (key, path, content) in order of their path, with their headers.

    Of equal paths all stay. Null contents are empty files, rows with a null path are none. Raises an error
    where the format's limits of files or bytes are passed.
    """
    c = F.col
    x = files.where("path is not null").select(key, "path", F.coalesce("content", F.lit(b"")).alias("content")).withColumn("name", F.encode("path", "UTF-8"))
    x = x.withColumn("size", F.length("content").cast("bigint")).withColumn("crc", F.crc32("content"))
    x = x.withColumn("_all", 30 + F.length("name") + c("size"))
    by = Window.partitionBy(key).orderBy("path", "crc", "size")
    x = x.withColumn("offset", F.sum("_all").over(by.rowsBetween(Window.unboundedPreceding, 0)) - c("_all")).withColumn("_n", F.row_number().over(by))
    fits = (c("_n") <= MOST_FILES) & (c("offset") + c("_all") <= MOST_BYTES)
    x = x.withColumn("offset", F.when(fits, c("offset")).otherwise(F.raise_error(F.lit("too many files or bytes for one archive")).cast("bigint")))
    common = [(VERSION, 2), (UTF8, 2), (0, 2), (0, 2), (DATE, 2), (c("crc"), 4), (c("size"), 4), (c("size"), 4), (F.length("name"), 2), (0, 2)]
    local = F.concat(_little((LOCAL, 4), *common), c("name"))
    central = F.concat(_little((CENTRAL, 4), (VERSION, 2), *common, (0, 2), (0, 2), (0, 2), (0, 4), (c("offset"), 4)), c("name"))
    return x.select(key, "path", "offset", "size", "content", local.alias("local"), central.alias("central"))


def parts(files: DataFrame, key: str) -> DataFrame:
    """(key, offset, bytes): an archive per key; its parts, put together by offset, are the file."""
    e = entries(files, key)
    last = F.array_sort(F.collect_list(F.struct("offset", "central")))
    d = e.groupBy(key).agg(last.alias("c"), F.count(F.lit(1)).alias("n"), F.sum(F.length("local") + F.col("size")).alias("offset"))
    d = d.withColumn("d", F.unhex(F.array_join(F.transform("c", lambda x: F.hex(x["central"])), "")))
    end = _little((END, 4), (0, 2), (0, 2), (F.col("n"), 2), (F.col("n"), 2), (F.length("d"), 4), (F.col("offset"), 4), (0, 2))
    return e.select(key, "offset", F.concat("local", "content").alias("bytes")).unionByName(d.select(key, "offset", F.concat("d", end).alias("bytes")))


def write(files: DataFrame, key: str, folder: str, suffix: str = ".zip") -> DataFrame:
    """(key, file, size) of the archives written below a folder that all executors share, one a key.

    Parts stream to a file of the attempt's own, which takes its name when it is whole; a lost
    task leaves at most such a file, and its second attempt puts the same bytes in place.
    """
    kinds = dict(files.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whose, out, done = None, None, []
        schema = None

        def finish() -> None:
            out.close()
            to = Path(folder) / f"{whose}{suffix}"
            os.replace(out.name, to)
            done.append((whose, str(to), to.stat().st_size))

        Path(folder).mkdir(parents=True, exist_ok=True)
        for b in batches:
            schema = b.schema.field(key).type
            for k, data in zip(b.column(key).to_pylist(), b.column("bytes"), strict=True):
                if out is None or k != whose:
                    if out is not None:
                        finish()
                    whose, out = k, open(Path(folder) / f".{uuid.uuid4().hex}", "wb")  # noqa: SIM115
                out.write(data.as_buffer())
        if out is not None:
            finish()
            ks, names, sizes = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ks, schema), pa.array(names), pa.array(sizes, pa.int64())], names=[key, "file", "size"])

    return parts(files, key).repartition(key).sortWithinPartitions(key, "offset").mapInArrow(run, f"{key} {kinds[key]}, file string, size bigint")

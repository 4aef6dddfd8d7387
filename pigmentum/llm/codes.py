"""Vector codes: each part of a vector is replaced by the number of its nearest codebook entry.

Codebooks are learnt in rounds. In each one, a kd-tree per codebook is broadcast (a fixed number of
entries, however many vectors there are); tasks search it by branch and bound, a batch of vectors at
a time, and add up their parts by entry; the sums, one row per codebook, entry and task, are added
by a shuffle, and the driver reads one row per codebook and entry. All arithmetic is in integers, so
neither the partitions nor their order change a result.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, map_batches, small_batches

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Entries of a kd-tree's leaf.
LEAF = 2
#: Up to this size of components, a part's squared distances are exact in 64 bits for up to 512 components.
EXACT = 1 << 26
_FAR = int(np.iinfo(np.int64).max)


class KdTree:
    """A codebook's entries (rows of integers), split at the median of the widest dimension."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        self.entries, self.leaf = entries, leaf
        self.root = self._build(np.arange(len(entries)))

    def _build(self, ids: np.ndarray):
        x = self.entries[ids]
        low, high = x.min(axis=0), x.max(axis=0)
        if len(ids) <= self.leaf or (low == high).all():
            return low, high, ids, None, None, None
        dim = int((high - low).argmax())
        order = ids[np.argsort(x[:, dim], kind="stable")]
        mid = len(order) // 2
        cut = self.entries[order[mid], dim]
        return low, high, None, (dim, cut), self._build(order[:mid]), self._build(order[mid:])

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every point its entry with the smallest squared distance, ties to the lower index, and that distance."""
        best = np.full(len(points), _FAR if points.dtype != object else None, points.dtype)
        index = np.full(len(points), len(self.entries), np.int64)
        if points.dtype == object:
            best[:] = 1 << 200
        self._visit(self.root, points, np.arange(len(points)), best, index)
        return index, best

    def _visit(self, node, points, at, best, index) -> None:
        low, high, ids, cut, left, right = node
        if not len(at):
            return
        x = points[at]
        away = np.maximum(np.maximum(low - x, x - high), 0)
        # a node whose bound equals the best so far may hold a lower index at the same distance
        open_ = (away * away).sum(axis=1) <= best[at]
        at, x = at[open_], x[open_]
        if not len(at):
            return
        if ids is not None:
            for i in ids:
                d = x - self.entries[i]
                d = (d * d).sum(axis=1)
                better = (d < best[at]) | ((d == best[at]) & (i < index[at]))
                best[at[better]], index[at[better]] = d[better], i
            return
        first = x[:, cut[0]] < cut[1]
        self._visit(left, points, at[first], best, index)
        self._visit(right, points, at[~first], best, index)
        self._visit(right, points, at[first], best, index)
        self._visit(left, points, at[~first], best, index)


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, vec array<double>, label) of the rows whose vector isn't null and has only finite components."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = table.select("vec_id", "embedding", "label").where(x.isNotNull() & F.coalesce(fine, F.lit(False)))
    return kept.select("vec_id", x.cast("array<double>").alias("vec"), "label")


def _parts(column: pa.Array, width: int, parts: int, scale: int) -> np.ndarray:
    """(rows, parts, components) of floor(scale * x): 64 bits where those hold all distances, else Python's own integers."""
    ends, flat = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy(zero_copy_only=False)
    n, flat = np.diff(ends), flat[ends[0] : ends[-1]]
    small = not len(flat) or np.abs(flat).max() * scale <= EXACT
    out = np.zeros((len(n), width), np.int64 if small else object)
    # doubles from 2^53 on are whole numbers
    whole = np.floor(flat * scale).astype(np.int64) if small else [int(v) * scale if abs(v) >= 1 << 53 else math.floor(v * scale) for v in flat.tolist()]
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], n)] = whole
    return out.reshape(len(n), parts, width // parts)


def _wide(x: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Points in Python's integers where the entries need those."""
    return x.astype(object) if like.dtype == object and x.dtype != object else x


class Codebooks(NamedTuple):
    entries: list[np.ndarray]  #: by part, (entries, components) of integers
    width: int  #: of a whole vector, a multiple of the number of parts
    scale: int

    def trees(self) -> list[KdTree]:
        return [KdTree(e) for e in self.entries]

    def text(self) -> str:
        return ",".join(str(int(v)) for e in self.entries for v in e.ravel())


def _entries(rows: list[list[int]]) -> np.ndarray:
    small = all(abs(v) <= EXACT for r in rows for v in r)
    return np.array(rows, np.int64) if small else np.array([[int(v) for v in r] for r in rows], object)


#: Sums as decimal text: many rows' sums may go beyond a long.
SUMS = "part int, entry int, n long, sums array<string>"


def _add(found: dict, key: tuple[int, int], n: int, sums: list[int]) -> None:
    before, own = found.get(key, (0, None))
    found[key] = before + n, sums if own is None else [a + b for a, b in zip(own, sums, strict=True)]


def _sums(found: dict):
    if found:
        rows = [(p, i, n, [str(v) for v in own]) for (p, i), (n, own) in found.items()]
        kinds = pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "entry", "n", "sums"])


def _total(batches):
    """All tasks' sums of the codebooks that were dealt here."""
    found: dict = {}
    for b in small_batches(batches):
        for p, i, n, sums in zip(*(c.to_pylist() for c in b.columns), strict=True):
            _add(found, (p, i), n, [int(v) for v in sums])
    yield from _sums(found)


def fit(vecs: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Learns one codebook per part from all rows of (vec_id, vec); None where there is no row.

    Codebooks start as the parts of the rows with the smallest vec_ids (null ids last, equal ids by
    their components), so rows fewer than entries give that many entries. Each round gives every
    part its nearest entry and moves entries to the floor of their parts' mean; entries without
    parts stay. Vectors shorter than the longest, and those whose length the parts don't divide,
    count as filled up with zeros. The rows are read once a round: hand over a table or a
    checkpoint, not a sample drawn anew.
    """
    longest = vecs.agg(F.max(F.size("vec")).alias("n")).first().n
    if longest is None:
        return None
    step = max(1, -(-longest // parts))
    width = step * parts
    first = vecs.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    whole = _parts(pa.array([r.vec for r in first], pa.list_(pa.float64())), width, parts, scale)
    books = Codebooks([_entries(whole[:, p].tolist()) for p in range(parts)], width, scale)
    sc = vecs.sparkSession.sparkContext
    for _ in range(rounds):
        shared = sc.broadcast(books.trees())  # parts * entries rows

        def summed(batches, shared=shared):
            trees, found = shared.value, {}
            for b in batches:
                x = _parts(b.column(0), width, parts, scale)
                for p, tree in enumerate(trees):
                    index, _ = tree.nearest(_wide(x[:, p], tree.entries))
                    for i in np.unique(index):
                        own = x[index == i, p]
                        _add(found, (p, int(i)), len(own), own.sum(axis=0).tolist())
            yield from _sums(found)

        each = map_batches(vecs, ["vec"], summed, SUMS)
        moved = [e.tolist() for e in books.entries]
        for r in each.repartition(parts, "part").mapInArrow(_total, SUMS).collect():  # parts * entries rows
            moved[r.part][r.entry] = [int(v) // r.n for v in r.sums]
        books = Codebooks([_entries(m) for m in moved], width, scale)
    return books


def assign(vecs: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code string, error long): the entries' numbers in part order, two hex digits each, and the squared distances' sum.

    An error beyond a long is cut to its largest value.
    """
    shared, parts = vecs.sparkSession.sparkContext.broadcast(books.trees()), len(books.entries)

    def run(batches):
        trees = shared.value
        for b in batches:
            x = _parts(b.column(1), books.width, parts, books.scale)
            index, error = np.zeros((len(x), parts), np.uint8), [0] * len(x)
            for p, tree in enumerate(trees):
                index[:, p], far = tree.nearest(_wide(x[:, p], tree.entries))
                error = [a + int(d) for a, d in zip(error, far, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([row.tobytes().hex() for row in index], pa.string()), pa.array([min(e, _FAR) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = dict(vecs.dtypes)
    return map_batches(vecs, ["vec_id", "vec", "label"], run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(vecs: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """`assign` of all rows with the codebooks that `fit` learns from them. An empty table has no rows and no codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's number has two hex digits")
    books = fit(vecs, parts, entries, rounds, scale)
    if books is None:
        kinds = dict(vecs.dtypes)
        return vecs.sparkSession.createDataFrame([], f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), None
    return assign(vecs, books), books


def with_label_errors(coded: DataFrame, label: Column | str = "label") -> DataFrame:
    """Adds label_error: the errors' sum over all rows of an equal label, nulls together; beyond a long, its largest value.

    Sums are made before the shuffle, so a label of many rows costs no more than others. Labels are
    counted: few are broadcast, many are joined by a shuffle whose large keys Spark splits.
    """
    keyed = coded.withColumn("_label", F.col(label) if isinstance(label, str) else label)
    sums = keyed.groupBy("_label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_FAR).cast("decimal(38,0)")).cast("long").alias("label_error")).withColumnRenamed("_label", "_of")
    if sums.count() <= BROADCAST_ROWS:
        sums = F.broadcast(sums)
    return keyed.join(sums, F.col("_label").eqNullSafe(F.col("_of"))).drop("_label", "_of")

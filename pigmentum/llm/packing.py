"""Packing documents into fixed-length sequences: dominance reduction, then best fit.

Lengths are whole numbers up to the capacity, so an instance is a histogram, however many
documents there are; the driver only ever holds one count per length. The plan is made in bulk:

1. Dominance reduction (Martello and Toth). A set {j, k} may be fixed for good if every feasible
   set that holds j can be exchanged for it without needing another sequence. That is so when
   nothing else fits beside j, when k fills the sequence exactly, when only one document can stand
   beside j (k is the longest that fits), and when no combination of documents beside j fills more
   than k does. Fixed documents leave the instance, and the rules apply again to what is left.
2. Best fit in decreasing length for the remainder: each document goes to the fullest sequence it
   fits, a whole group of equal sequences at a time.

The plan is a table of runs (length, ranks, sequences, offset), bounded by the capacity and not by
the documents. Documents find their place by (length, rank); ranks come from counts per partition,
so no length, however frequent, is gathered anywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import load
from .common import cut_lineage, map_batches, texts_of

END_ID = 0


class _Plan:
    """Runs of placements: rank .. rank+n of a length go to sequences seq .. seq+n at one offset."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {length: n for length, n in counts.items() if n > 0}
        self.rank = dict.fromkeys(self.left, 0)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.sequences = self.fixed = 0

    def put(self, length: int, n: int, seq: int, offset: int) -> None:
        self.runs.append((length, self.rank[length], n, seq, offset))
        self.rank[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _best_sum(self, room: int, without: int) -> int:
        """The most that documents other than one of length `without` fill of the room."""
        sums, mask = 1, (1 << (room + 1)) - 1
        for length, n in self.left.items():
            n, step = min(n - (length == without), room // length), 1
            while n > 0:
                take = min(step, n)
                sums |= sums << (length * take) & mask
                n, step = n - take, step * 2
        return sums.bit_length() - 1

    def reduce(self) -> None:
        for j in sorted(self.left, reverse=True):
            while j in self.left:
                room, n = self.capacity - j, self.left[j]
                others = sorted(x for x, m in self.left.items() if x <= room and (x != j or m > 1))
                if not others:  # nothing fits beside it
                    self.put(j, n, self.open(n), 0)
                    self.fixed += n
                    break
                k = others[-1]
                low, more = others[0], self.left[others[0]] - (others[0] == j) > 1
                two = 2 * low if more else low + others[1] if len(others) > 1 else room + 1
                if not (k == room or two > room or self._best_sum(room, j) <= k):
                    break
                m = n // 2 if k == j else min(n, self.left[k])
                # a bulk step is only as long as the rule holds: the partial sums can only fall
                seq = self.open(m)
                self.put(j, m, seq, 0)
                self.put(k, m, seq, j)
                self.fixed += 2 * m

    def best_fit(self) -> None:
        free: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences
        for length in sorted(self.left, reverse=True):
            while n := self.left.get(length, 0):
                room = min((r for r in free if r >= length), default=None)
                if room is not None:
                    seq, have = free[room].pop()
                    take = min(n, have)
                    if take < have:
                        free[room].append((seq + take, have - take))
                    if not free[room]:
                        del free[room]
                    self.put(length, take, seq, self.capacity - room)
                    free.setdefault(room - length, []).append((seq, take))
                    continue
                each = self.capacity // length
                full = n // each
                if full:
                    seq = self.open(full)
                    for i in range(each):
                        self.put(length, full, seq, i * length)
                    free.setdefault(self.capacity - each * length, []).append((seq, full))
                else:
                    seq = self.open(1)
                    for i in range(n):
                        self.put(length, 1, seq, i * length)
                    free.setdefault(self.capacity - n * length, []).append((seq, 1))


def plan(counts: dict[int, int], capacity: int) -> _Plan:
    """Place every document of a histogram of lengths (1 to capacity)."""
    p = _Plan(counts, capacity)
    p.reduce()
    p.best_fit()
    return p


def lower_bound(counts: Iterable[tuple[int, int]], capacity: int) -> int:
    """No packing needs fewer sequences: volume, and documents longer than half (L2 bound)."""
    counts = list(counts)
    best = -(-sum(length * n for length, n in counts) // capacity)
    for cut in range(capacity // 2 + 1):
        big = sum(n for length, n in counts if length > capacity - cut)
        mid = [(length, n) for length, n in counts if capacity // 2 < length <= capacity - cut]
        small = sum(length * n for length, n in counts if cut <= length <= capacity // 2)
        spare = sum(n for _, n in mid) * capacity - sum(length * n for length, n in mid)
        best = max(best, big + sum(n for _, n in mid) + max(0, -(-(small - spare) // capacity)))
    return best


def pieces(docs: DataFrame, capacity: int, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and the piece's rank among those of its length in its partition."""

    def run(batches):
        bpe, seen, part = load(path), {}, TaskContext.get().partitionId()
        for b in batches:
            out = []
            for i, text in enumerate(texts_of(b, 1)):
                ids = bpe.encode(text)
                n = len(ids) + 1
                raw = ids.tobytes() + END_ID.to_bytes(4, "little")
                first = (n - 1) % capacity + 1  # the later pieces are full
                at = 0
                for k in range(-(-n // capacity)):
                    length = first if k == 0 else capacity
                    nth = seen[length] = seen.get(length, -1) + 1
                    out.append((i, k, at, length, zlib.crc32(raw[4 * at : 4 * (at + length)]), part, nth))
                    at += length
            if out:
                cols = list(zip(*out, strict=True))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int32())), *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True))], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return map_batches(docs, ["doc_id", "text"], run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack(docs: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its tokens and one end id; null and empty texts are the end id alone. Documents
    longer than the capacity are cut, only the first piece may be shorter than the capacity.
    Repeated rows are documents of their own; an empty table gives no rows; other columns are not
    read. Two passes over small piece rows, which are checkpointed so that ranks never change.
    """
    cut = cut_lineage(pieces(docs, capacity, path))
    counts = cut.groupBy("part", "length").agg((F.max("nth") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    p = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    runs = np.array(sorted(p.runs), np.int64).reshape(-1, 5)
    keys = (runs[:, 0] << 44) | runs[:, 1]
    shared = docs.sparkSession.sparkContext.broadcast((keys, runs))  # bounded by the capacity

    def place(batches):
        keys, runs = shared.value
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            at = np.searchsorted(keys, (length << 44) | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(runs[at, 3] + rank - runs[at, 1]), pa.array(runs[at, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

"""Packing documents into windows by non-negative least squares over shallow combinations of lengths.

Lengths are whole numbers up to the capacity, so an instance is a histogram, however many documents
there are; the driver only ever holds one count per length. A plan is made in three steps:

1. Every combination of up to three lengths that fills a window exactly is a column of a system
   whose right side is the histogram. Non-negative least squares gives each one's repeat count.
2. Counts are rounded, the largest first, each to no more than the documents that are left.
3. What is left is packed greedily: the longest piece that fits, again and again; where nothing
   fits the room that remains, a longest piece is cut to fill it. The last tokens, less than a
   window, go to windows of powers of two, which need no padding either.

Combinations with one difference between their two smaller lengths form a block whose members meet
in few lengths, so least squares goes from block to block and solves all of a block at once.

The plan is a table of runs, bounded by the capacity and not by the documents. Documents find their
places by (length, rank); ranks come from counts per partition.
"""

from __future__ import annotations

import bisect
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut_lineage, map_batches, texts_of
from .word_bpe import load

CAPACITY, END_ID = 4096, 2
#: Rounds of least squares at most, and the gain of a round below which it ends.
ROUNDS, GAIN = 40, 1e-3
#: Combinations that a plan takes over at most, those of the highest counts; documents of others are packed greedily.
MOST = 1 << 16
#: Documents encoded at once, so that a batch's ids stay small.
GROUP = 256


class Blocks:
    """The combinations of two and three lengths that fill a window, and their repeat counts x."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        #: of each block: three slices of the lengths, and the columns' squared norms
        self.cols: list[tuple[list[slice], np.ndarray]] = []
        half = capacity // 2
        if half:
            up, down = slice(1, half + 1), slice(capacity - 1, capacity - half - 1, -1)
            norm = np.full(half, 2.0)
            if capacity % 2 == 0:
                norm[-1] = 4
            self.cols.append(([up, down], norm))
        for k in range((capacity - 1) // 2):
            m = (capacity - 2 * k) // 3  # a, a + k, capacity - k - 2a, in rising order
            if m < 1:
                break
            last = capacity - k - 2 * m
            norm = np.full(m, 3.0 if k else 5.0)
            if last == m + k:  # the two longer ones are equal, or all three
                norm[-1] = 5.0 if k else 9.0
            self.cols.append(([slice(1, m + 1), slice(1 + k, m + k + 1), slice(capacity - k - 2, last - 1, -2)], norm))
        self.x = [np.zeros(len(norm)) for _, norm in self.cols]

    def solve(self, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
        """Lowers |A x - counts|^2 over x >= 0; returns the residual by length."""
        left = counts.astype(np.float64)
        before = float(left @ left)
        for _ in range(rounds):
            for (slices, norm), x in zip(self.cols, self.x, strict=True):
                slope = sum(left[s] for s in slices)
                # a length meets at most three columns of a block: half a step each never goes up
                new = np.maximum(x + slope / (2 * norm), 0)
                step = new - x
                if step.any():
                    for s in slices:
                        left[s] -= step
                    x[:] = new
            now = float(left @ left)
            if before - now <= GAIN * before:
                break
            before = now
        return left

    def rounded(self) -> list[tuple[float, tuple[int, ...]]]:
        """(count, lengths) of the counts that round to one or more, the highest first."""
        out = []
        for (slices, norm), x in zip(self.cols, self.x, strict=True):
            lengths = [np.arange(self.capacity)[s] for s in slices]
            for i in np.nonzero(x >= 0.5)[0]:
                out.append((float(x[i]), tuple(int(v[i]) for v in lengths)))
        return sorted(out, key=lambda r: (-r[0], r[1]))[:MOST]


class Plan:
    """Runs (length, rank, n, start, size, seq, offset): of the documents of a length, ranks rank to
    rank + n put their tokens start to start + size into sequences seq to seq + n at one offset."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.sequences, self.runs = capacity, 0, []
        #: what is left by length of piece: (document length, first rank, number, start)
        self.pool = {length: deque([(length, 0, n, 0)]) for length, n in counts.items() if n > 0}
        self.left = {length: n for length, n in counts.items() if n > 0}
        self.lengths = sorted(self.left)
        self.kept_whole = sum(self.left.values())

    def take(self, length: int, n: int) -> list[tuple[int, int, int, int]]:
        out, pool = [], self.pool[length]
        self.left[length] -= n
        while n:
            of, rank, have, start = pool.popleft()
            if have > n:
                pool.appendleft((of, rank + n, have - n, start))
                have = n
            out.append((of, rank, have, start))
            n -= have
        if not self.left[length]:
            del self.left[length], self.pool[length]
            self.lengths.remove(length)
        return out

    def put(self, length: int, size: int, n: int, offset: int) -> None:
        """The first `size` tokens of n pieces go to the n newest sequences; the rest of them becomes shorter pieces."""
        seq = self.sequences - n
        for of, rank, have, start in self.take(length, n):
            self.runs.append((of, rank, have, start, size, seq, offset))
            seq += have
            if size < length:
                rest = length - size
                if rest not in self.left:
                    bisect.insort(self.lengths, rest)
                    self.left[rest], self.pool[rest] = 0, deque()
                self.left[rest] += have
                self.pool[rest].append((of, rank, have, start + size))

    def combinations(self, blocks: Blocks) -> None:
        for x, lengths in blocks.rounded():
            need = {v: lengths.count(v) for v in lengths}
            n = min(round(x), *(self.left.get(v, 0) // k for v, k in need.items()))
            if n > 0:
                self.sequences += n
                at = 0
                for v in lengths:
                    self.put(v, v, n, at)
                    at += v

    def window(self, capacity: int, most: int | None = None) -> None:
        """One pattern of pieces that fills a window, the longest that fit first, as often as there are pieces for it."""
        room, used = capacity, {}
        steps = []  # (length, size, times)
        top = len(self.lengths)
        while room and (top := bisect.bisect_right(self.lengths, room, 0, top)):
            length = self.lengths[top - 1]
            times = min(room // length, self.left[length])
            steps.append((length, length, times))
            used[length] = times
            room -= times * length
            top -= 1
        if room:  # nothing that fits is left: a longest piece is cut
            length = next(v for v in reversed(self.lengths) if self.left[v] > used.get(v, 0) and v > room)
            steps.append((length, room, 1))
            used[length] = used.get(length, 0) + 1
        n = min(self.left[v] // k for v, k in used.items())
        n = n if most is None else min(n, most)
        self.sequences += n
        at = 0
        for length, size, times in steps:
            for _ in range(times):
                self.put(length, size, n, at)
                at += size

    def greedy(self) -> None:
        total = sum(v * n for v, n in self.left.items())
        while total >= self.capacity:
            before = self.sequences
            self.window(self.capacity)
            total -= (self.sequences - before) * self.capacity
        for bit in reversed(range(total.bit_length())):
            if total >> bit & 1:
                self.window(1 << bit, 1)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Places every token of a histogram of lengths (1 to capacity)."""
    p = Plan(counts, capacity)
    if n := p.left.get(capacity):  # filled windows already
        p.sequences += n
        p.put(capacity, capacity, n, 0)
    wanted = np.zeros(capacity, np.int64)
    for length, n in p.left.items():
        wanted[length] = n
    if wanted.any():
        blocks = Blocks(capacity)
        blocks.solve(wanted)
        p.combinations(blocks)
    p.greedy()
    return p


def pieces(docs: DataFrame, capacity: int, path: str | None = None) -> DataFrame:
    """Documents in full windows and a rest: doc_id, start, length, crc, ids (of the rests), doc_tokens, part, nth.

    nth is the piece's rank among those of its length in its partition, part.
    """

    def run(batches):
        bpe, seen, part = load(path), {}, TaskContext.get().partitionId()
        end = np.array([END_ID], bpe.kind)
        for b in batches:
            for g in range(0, b.num_rows, GROUP):
                some, out = b.slice(g, GROUP), []
                for i, text in enumerate(texts_of(some, 1)):
                    ids = np.concatenate([bpe.encode(text), end])
                    for at in range(0, len(ids), capacity):
                        own = ids[at : at + capacity]
                        n = len(own)
                        nth = seen[n] = seen.get(n, -1) + 1
                        out.append((i, at, n, zlib.crc32(own.astype("<u4").tobytes()), own.tobytes() if n < capacity else None, len(ids), part, nth))
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(cols[0], pa.int32())), *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True))], ["doc_id", "start", "length", "crc", "ids", "doc_tokens", "part", "nth"])

    return map_batches(docs, ["doc_id", "text"], run, f"doc_id {dict(docs.dtypes)['doc_id']}, start long, length int, crc long, ids binary, doc_tokens long, part int, nth long")


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its tokens and one end id; null and empty texts are the end id alone. Each token
    is in one piece; a document is cut where it is longer than the capacity, and at most once more
    per sequence that it ends. All sequences are full but the last ones, which hold a power of two.
    Repeated rows are documents of their own; a null doc_id stays null; an empty table gives no
    rows; other columns aren't read. The texts are read once: ids of pieces that may yet be cut,
    two bytes each, are checkpointed, so ranks never change.
    """
    if not 2 <= capacity < 1 << 15:
        raise ValueError("the capacity must be from 2 to 32767")
    cut = cut_lineage(pieces(docs, capacity, path))
    counts = cut.groupBy("part", "length").agg((F.max("nth") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = cut_lineage(counts.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    p = plan({r.length: r.n for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    few = base.count() <= BROADCAST_ROWS
    base = base.select("part", "length", "base")
    bits = capacity.bit_length()
    runs = np.array(sorted(p.runs, key=lambda r: (r[0], r[3], r[1])), np.int64).reshape(-1, 7)
    key = lambda length, start, rank: length << (62 - bits) | start << (62 - 2 * bits) | rank
    shared = docs.sparkSession.sparkContext.broadcast((key(runs[:, 0], runs[:, 3], runs[:, 1]), runs))  # bounded by the capacity
    kind = load(path).kind

    def place(batches):
        keys, runs = shared.value
        for b in batches:
            length, rank = b.column(2).to_numpy().astype(np.int64), b.column(6).to_numpy()
            row, at, out = np.arange(len(length)), np.zeros(len(length), np.int64), []
            while len(row):  # each round places one more part of every piece that isn't all placed
                run = np.searchsorted(keys, key(length[row], at, rank[row]), "right") - 1
                size = runs[run, 4]
                out.append((row, at, size, runs[run, 5] + rank[row] - runs[run, 1], runs[run, 6]))
                more = at + size < length[row]
                row, at = row[more], (at + size)[more]
            row, at, size, seq, offset = (np.concatenate(c) for c in zip(*out, strict=True))
            crc = b.column(3).to_numpy()[row].copy()
            for k in np.nonzero(size < length[row])[0]:
                ids = np.frombuffer(b.column(4)[int(row[k])].as_buffer(), kind)[at[k] : at[k] + size[k]]
                crc[k] = zlib.crc32(ids.astype("<u4").tobytes())
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(rows), pa.array(b.column(1).to_numpy()[row] + at), pa.array(size), pa.array(crc), b.column(5).take(rows), pa.array(seq), pa.array(offset)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = cut.join(F.broadcast(base) if few else base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    return map_batches(ranked, ["doc_id", "start", "length", "crc", "ids", "doc_tokens", "rank"], place, f"doc_id {dict(docs.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

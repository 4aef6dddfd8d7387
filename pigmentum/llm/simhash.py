"""SimHash near-duplicates by segment-popcount embedding and a grid range-join.

A 64-bit fingerprint is mapped to the bit counts of its segments (two bits each by default, in one
arithmetic step). The Manhattan distance of two such vectors is never more than the Hamming
distance of the fingerprints, so fingerprints within k bits lie within k in the embedding. The
segments are dealt into g groups. With g over k, at least g - k groups of two such fingerprints are
equal, so there is a grid for every choice of g - k groups, and a fingerprint goes to its own cell
in each. With fewer groups, at least one group's part lies within k // g, and a fingerprint goes to
its cell and to those within that distance. Only fingerprints that share a cell are compared,
exactly, bit by bit. More groups mean finer cells; their number follows from the number of
fingerprints, so that a fingerprint meets about the same number of others whatever the size.

Equal fingerprints are one node from the start. A cell gives a spanning forest of its links, not
all of them, so a group of many copies costs rows in proportion to its members. A cell with many
members is cut into blocks, and pairs of blocks are separate keys of the shuffle.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut_lineage, free_name, map_batches, texts_of
from .components import components

SHINGLE, BITS, SEED = 4, 4, 42
#: Members of a cell compared at once at most, from each of two blocks.
BLOCK = 2048
#: Fingerprints that one meets in its cells, by chance, from which on cells are made finer; most groups.
LOAD, MOST_GROUPS = 400, 10
#: In cells of up to so many members all pairs are looked at together, with those of other cells.
SMALL = 32


def hashes(text: str, size: int) -> np.ndarray:
    """The hashes of a text's shingles of so many words, in their order; a shorter text is one shingle."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    norm = b" ".join(words)
    h, hash64 = np.empty(max(1, len(words) - size + 1), np.uint64), xxhash.xxh64_intdigest
    if len(words) <= size:
        h[0] = hash64(norm, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[: len(h) - 1] + 1]).tolist()
        h[:] = [hash64(norm[s:e], SEED) for s, e in zip(starts, ends[size - 1 :].tolist(), strict=True)]
    return h


def fingerprint(text: str, size: int = SHINGLE) -> int:
    return majority(hashes(text, size))


def majority(h: np.ndarray) -> int:
    """A bit is set if more than half the shingles' hashes have it; signed, as Spark's long."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h)).view(">i8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, row, fp for every row; a text without words (or null) has fingerprint zero. row: see row_hash."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([fingerprint(x, size) for x in texts_of(b, 1)], pa.int64())], ["doc_id", "row", "fp"])

    return map_batches(docs, ["doc_id", "text", row_hash(docs).alias("row")], run, "doc_id long, row long, fp long")


def row_hash(docs: DataFrame) -> Column:
    """Tells apart rows that repeat a doc_id, by all columns that Spark can hash."""
    return F.xxhash64(*(F.col("`" + c.replace("`", "``") + "`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"))


def embedding(fp: Column, width: int = 2) -> Column:
    """The bit counts of a fingerprint's segments of 2, 4 or 8 bits, each in its segment's place."""
    half = lambda x, n, mask: (F.shiftrightunsigned(x, n)).bitwiseAND(F.lit(mask))
    odd, even = half(fp, 1, 0x5555555555555555), fp.bitwiseAND(F.lit(0x5555555555555555))
    out = F.shiftleft(odd.bitwiseAND(even), 1).bitwiseOR(odd.bitwiseXOR(even))  # a sum of two bits; + could overflow
    if width >= 4:
        out = out.bitwiseAND(F.lit(0x3333333333333333)) + half(out, 2, 0x3333333333333333)
    if width >= 8:
        out = (out + F.shiftrightunsigned(out, 4)).bitwiseAND(F.lit(0x0F0F0F0F0F0F0F0F))
    return out


def _steps(near: Column, i: int, width: int) -> list[Column]:
    """The embeddings one step up and one step down in segment i, where there is such a count."""
    rest = ~(((1 << width) - 1) << (i * width)) & ((1 << 64) - 1)
    others = F.lit(rest - (1 << 64) if rest >> 63 else rest).cast("long")

    def at(x: Column) -> Column:
        return F.shiftrightunsigned(x, i * width).bitwiseAND(F.lit((1 << width) - 1))

    def put(x: Column, n: Column) -> Column:
        return x.bitwiseAND(others).bitwiseOR(F.shiftleft(n, i * width))

    up = F.transform(F.filter(near, lambda x: at(x) < width), lambda x: put(x, at(x) + 1))
    down = F.transform(F.filter(near, lambda x: at(x) > 0), lambda x: put(x, at(x) - 1))
    return [up, down]


def groups_for(n: int, bits: int = BITS, width: int = 2) -> int:
    """The least number of groups with which a fingerprint among n random ones meets about LOAD others or fewer."""
    # the chance that two random segments have the same bit count
    same = sum((math.comb(width, c) / 2**width) ** 2 for c in range(width + 1))
    for g in range(bits + 1, MOST_GROUPS):
        if math.comb(g, bits) * n * same ** (64 / width * (g - bits) / g) <= LOAD:
            return g
    return max(bits + 1, MOST_GROUPS)


def cells(fps: DataFrame, bits: int, groups: int, width: int = 2) -> DataFrame:
    """(grp, cell, fp): every cell of every grid that the fingerprint goes to."""
    segments, reach = 64 // width, bits // groups
    own = [range(g * segments // groups, (g + 1) * segments // groups) for g in range(groups)]
    emb, parts = embedding(F.col("fp"), width), []
    for at, chosen in enumerate(combinations(range(groups), max(1, groups - bits))):
        mask = sum(((1 << width) - 1) << (i * width) for g in chosen for i in own[g])
        near = F.array(emb.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
        for _ in range(reach):  # one more step along any axis
            steps = [near]
            for i in own[chosen[0]]:
                steps += _steps(near, i, width)
            near = F.array_distinct(F.concat(*steps))
        parts.append(F.struct(F.lit(at).alias("grp"), near.alias("near")))
    dealt = fps.select("fp", F.explode(F.array(*parts)).alias("p"))
    return dealt.select(F.col("p.grp").alias("grp"), F.explode("p.near").alias("cell"), "fp")


def forest(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over the fingerprints (distinct, unsigned) within `bits` of each other."""
    u, v = [], []
    rest = fp
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= bits
            if near.any():
                got = rest[near]
                rest = rest[~near]
                u.append(np.full(len(got), x, np.uint64))
                v.append(got)
                todo.extend(got)
    none = np.empty(0, np.uint64)
    return np.concatenate([*u, none]).astype(np.uint64), np.concatenate([*v, none]).astype(np.uint64)


def links_of(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forests of all cells: rows of equal `key` lie together, each a cell's distinct fingerprints."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(edge)
    hit = size > SMALL
    cell = np.repeat(np.arange(len(size)), size)
    rows = np.flatnonzero((size[cell] > 1) & (size[cell] <= SMALL))
    for d in range(1, SMALL):  # members d places apart in the same cell
        rows = rows[rows + d < len(fp)]
        rows = rows[cell[rows] == cell[rows + d]]
        if not len(rows):
            break
        hit[cell[rows[np.bitwise_count(fp[rows] ^ fp[rows + d]) <= bits]]] = True
    found = [forest(fp[edge[c] : edge[c + 1]], bits) for c in np.flatnonzero(hit).tolist()]
    none = np.empty(0, np.uint64)
    return np.concatenate([*(u for u, _ in found), none]), np.concatenate([*(v for _, v in found), none])


def links(fps: DataFrame, bits: int = BITS, groups: int | None = None, width: int = 2) -> DataFrame:
    """(u, v): links whose components are those of all pairs of the distinct fingerprints within `bits` bits."""
    groups = groups or groups_for(fps.count(), bits, width)
    dealt = cells(fps, bits, groups, width)
    large = dealt.groupBy("grp", "cell").count().where(F.col("count") > BLOCK).select("grp", "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    # a member of block i meets block j under the key (min, max); small cells have the one key (0, 0)
    held = dealt.join(large, ["grp", "cell"], "left").withColumn("own", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")))
    met = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
    met = met.select(F.xxhash64("grp", "cell", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")

    def run(batches):
        held = np.empty((2, 0), np.int64)

        def parts():
            nonlocal held
            for b in batches:
                held = np.concatenate([held, np.stack([b.column(i).to_numpy() for i in (0, 1)])], axis=1)
                whole = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on
                yield held[:, :whole]
                held = held[:, whole:]
            yield held

        for x in parts():
            if x.shape[1] > 1:
                # a key of two cells, should their hashes be equal, only compares more
                u, v = links_of(x[0], x[1].view(np.uint64), bits)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return map_batches(met.repartition("key").sortWithinPartitions("key", "fp"), None, run, "u long, v long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, bits: int = BITS, groups: int | None = None, width: int = 2) -> DataFrame:
    """doc_id, row, fp, root, component_id for every row: the smallest doc_id linked to it, directly or not.

    root is the component's smallest fingerprint, in the order of signed numbers. Null and empty
    texts share the fingerprint zero and are linked like any other. Repeated rows get the same
    component. A null doc_id counts for no component; its row gets the component of its
    fingerprint, null if no row there has a doc_id. Empty tables give no rows; other columns don't
    matter.
    """
    marked = cut_lineage(fingerprints(docs, size))
    nodes = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    return marked.join(named(nodes, "fp", components(links(nodes.select("fp"), bits, groups, width))), "fp").select("doc_id", "row", "fp", "root", "component_id")


def named(nodes: DataFrame, node: str, roots: DataFrame) -> DataFrame:
    """(node, root, component_id) of all nodes (node, first), from the roots of those that have links.

    It is checkpointed, so that a join with it shuffles both sides and Spark can split hot nodes.
    """
    rooted = cut_lineage(roots.withColumnRenamed("node", node).join(nodes.select(node, "first"), node))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = nodes.select(node, "first").join(rooted.select(node, "root").join(least, "root"), node, "left")
    return cut_lineage(of.select(node, F.coalesce("root", node).alias("root"), F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of docs per component, all columns as they are: the one with the smallest doc_id."""
    return keep_first(docs, near_duplicates(docs, **options))


def keep_first(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The first row of docs in each component (doc_id, row, root), by doc_id and then by its hash.

    It is decided row by row, so rows that repeat a doc_id with another text stand for themselves;
    of rows that are the same in all columns one stays. Rows without a doc_id can't be named as
    copies and stay. Only the keys of the rows to go meet the table, broadcast if they are few.
    """
    known = members.where("doc_id is not null")
    rows = cut_lineage(known.groupBy("root", "doc_id", "row").agg(F.count(F.lit(1)).alias("n")))
    best = cut_lineage(rows.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("best")))
    wins = F.struct("doc_id", "row") == F.col("best")
    gone = cut_lineage(rows.join(best, "root").where(~wins | (F.col("n") > 1)).select(F.col("doc_id").alias("_gone_id"), F.col("row").alias("_gone_row"), wins.alias("_again")))
    few = gone.count() <= BROADCAST_ROWS
    at = free_name(docs, "row")
    # names of our own for the join, so that no column of docs can clash with them
    id_, row_, again_ = (free_name(docs, x) for x in ("_gone_id", "_gone_row", "_again"))
    gone = gone.toDF(id_, row_, again_)
    hint = F.broadcast if few else (lambda x: x)
    marked = docs.withColumn(at, row_hash(docs))
    same = (F.col("doc_id") == F.col(id_)) & (F.col(at) == F.col(row_))
    kept = marked.join(hint(gone), same, "left_anti")
    again = gone.where(again_)
    if not again.isEmpty():
        kept = kept.unionAll(marked.join(hint(again), same, "left_semi").dropDuplicates(["doc_id", at]))
    return kept.drop(at)

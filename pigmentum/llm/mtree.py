"""Exact top-k by inner product with M-trees.

Inner products become distances by one more coordinate: with M the largest squared norm, x is
extended by sqrt(M - |x|^2) and a query by 0, and then |q - x|^2 = |q|^2 + M - 2 q.x, so the highest
products are the nearest points. Each block of vectors is indexed by an M-tree: pages of at most
PAGE entries, and above them nodes whose entries hold a pivot, a covering radius and the distance to
the node's own pivot. A search keeps a queue of nodes by their least possible distance; entries are
skipped on the stored distances to the parent pivot alone where the triangle inequality rules them
out, and the search ends when the nearest node can't beat the k-th product.

Blocks are metric as well: vectors go to the nearest of at most CELLS pivots (a bounded sample picks
these; every row is indexed), and a cell with many vectors is cut into blocks. A query first
searches the block it lies in. With the k-th product found there it goes to the blocks of those
cells only whose pivot and covering radius leave room for a higher one, and there its search
begins with that product. Blocks stay where they are and queries come to them: a task builds a
block's tree once and reads its queries as a stream, some QUERIES of them before the tree is built
again elsewhere.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, map_batches

PAGE, FANOUT = 192, 16
#: Vectors of a block, queries that one building of its tree serves, and pivots of cells at most.
BLOCK, QUERIES, CELLS = 4096, 16384, 256
#: Up to this size of components and length of vectors, doubles hold every product and sum exactly.
EXACT = 1 << 52
_MOST, _LEAST = (1 << 63) - 1, -1 << 63


class Node:
    """A page (its rows' places) or an inner node (children); `far`: entries' distances to the own pivot."""

    __slots__ = ("children", "far", "pivot", "pivots", "radii", "radius", "rows")

    def __init__(self, pivot, rows, far, children=None):
        self.pivot, self.rows, self.far, self.children, self.radius = pivot, rows, far, children, float(far.max(initial=0))
        if children is not None:
            self.pivots, self.radii = np.array([c.pivot for c in children]), np.array([c.radius for c in children])


class MTree:
    def __init__(self, vectors: np.ndarray, page: int = PAGE, fanout: int = FANOUT):
        self.x, self.page, self.fanout = vectors, page, fanout
        self.norm = np.einsum("ij,ij->i", vectors, vectors)
        self.most = float(self.norm.max(initial=0))
        self.extra = np.sqrt(np.maximum(self.most - self.norm, 0))
        self.computed = self.skipped = 0
        self.root = self._build(np.arange(len(vectors)), 0) if len(vectors) else None
        self._lay_out()

    def _distances(self, rows: np.ndarray, pivot: int) -> np.ndarray:
        d2 = self.norm[rows] + self.extra[rows] ** 2 + self.norm[pivot] + self.extra[pivot] ** 2 - 2 * (self.x[rows] @ self.x[pivot] + self.extra[rows] * self.extra[pivot])
        return np.sqrt(np.maximum(d2, 0))

    def _build(self, rows: np.ndarray, pivot: int) -> Node:
        far = self._distances(rows, pivot)
        if len(rows) <= self.page:
            return Node(pivot, rows, far)
        # pivots spread over the rows by distance, no more than the pages need; each row goes to its nearest
        most = min(self.fanout, max(2, math.ceil(1.5 * len(rows) / self.page)))
        picks = [rows[int(far.argmax())]]
        near = self._distances(rows, picks[0])
        table = [near]
        while len(picks) < most and near.max() > 0:
            picks.append(rows[int(near.argmax())])
            table.append(self._distances(rows, picks[-1]))
            near = np.minimum(near, table[-1])
        if len(picks) == 1:  # equal vectors only: pages in order
            children = [Node(picks[0], part, self._distances(part, picks[0])) for part in np.array_split(rows, math.ceil(len(rows) / self.page))]
        else:
            of = np.argmin(np.array(table), axis=0)
            children = [self._build(rows[of == i], picks[i]) for i in range(len(picks)) if (of == i).any()]
        # an entry's distance to the parent pivot; the radius must cover all rows below
        node = Node(pivot, None, self._distances(np.array([c.pivot for c in children]), pivot), children)
        node.radius = float(far.max())
        return node

    def _lay_out(self) -> None:
        """Keeps each page's vectors side by side: `at` has a row's number in the given order, pages hold (start, end)."""
        pages, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if node.children is None:
                pages.append(node)
            else:
                todo += node.children
        self.at = np.concatenate([np.empty(0, np.int64), *(p.rows for p in pages)]).astype(np.int64)
        self.by_page, start = self.x[self.at], 0
        for p in pages:
            p.rows, start = (start, start + len(p.rows)), start + len(p.rows)

    def search(self, q: np.ndarray, k: int, ids: np.ndarray, own: int, floor: float = -math.inf, keys: np.ndarray | None = None, product=None) -> list[tuple[int, int]]:
        """The k highest (product, smaller id first) of at least `floor`, among rows whose key (default: id) isn't `own`.

        product(row) gives whole products where doubles can't; distances then only rule rows out.
        """
        best: list[tuple[float, int]] = []
        if self.root is None:
            return best
        keys = ids if keys is None else keys
        qq = float(q @ q)
        reach = qq + self.most
        # doubles round distances; products may be that much higher than a bound says
        slack = 1e-9 * (reach + 1)
        upper = lambda d: (reach - d * d) / 2 + slack  # noqa: E731  the highest product at that distance
        kth = floor
        d = math.sqrt(max(reach - 2 * float(self.x[self.root.pivot] @ q), 0.0))
        queue = [(max(d - self.root.radius, 0.0), 0, d, self.root)]
        count = 0
        while queue:
            least, _, d, node = heapq.heappop(queue)
            if upper(least) < kth:
                break
            if node.children is not None:
                # the stored distances rule entries out before theirs are computed
                near = np.flatnonzero(upper(np.maximum(np.abs(d - node.far) - node.radii, 0)) >= kth)
                self.computed += len(near)
                self.skipped += len(node.children) - len(near)
                away = np.sqrt(np.maximum(reach - 2 * (self.x[node.pivots[near]] @ q), 0))
                low = np.maximum(away - node.radii[near], least)
                for i, dc, lo in zip(near.tolist(), away.tolist(), low.tolist(), strict=True):
                    if upper(max(lo, 0.0)) >= kth:
                        count += 1
                        heapq.heappush(queue, (max(lo, 0.0), count, dc, node.children[i]))
                continue
            start, end = node.rows
            if kth > -math.inf:
                gap = d - node.far
                near = np.flatnonzero((reach - gap * gap) / 2 + slack >= kth)
                if 2 * len(near) > end - start:
                    scores, rows = self.by_page[start:end] @ q, self.at[start:end]
                else:
                    scores, rows = self.by_page[start + near] @ q, self.at[start + near]
            else:
                scores, rows = self.by_page[start:end] @ q, self.at[start:end]
            self.computed += len(rows)
            good = (scores >= (kth if product is None else kth - slack)) & (keys[rows] != own)
            if good.any():
                rows, scores = rows[good], scores[good]
                if product is None and len(rows) > k:  # ties of the k-th stay
                    most = scores >= np.partition(scores, len(rows) - k)[len(rows) - k]
                    rows, scores = rows[most], scores[most]
                whole = (-scores).tolist() if product is None else [-product(r) for r in rows.tolist()]
                best = heapq.nsmallest(k, [*best, *zip(whole, ids[rows].tolist(), strict=True)])
                if len(best) == k and best[-1][0] < -_LEAST:  # products clipped from below are equal, whatever their size
                    kth = max(floor, float(-best[-1][0]))
        return [(int(-s), i) for s, i in best]


def whole_vectors(table: DataFrame, scale: float = 1024.0) -> DataFrame:
    """(vec_id, vec array<long>): floor(scale * x); rows with null or non-finite components or a null id take no part.

    Components beyond a long are cut to its largest or smallest value.
    """
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return table.select("vec_id", "embedding").where(x.isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select("vec_id", F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long")).alias("vec"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The vectors as rows of doubles, filled up with zeros."""
    ends, flat = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy(zero_copy_only=False)
    n = np.diff(ends)
    out = np.zeros((len(n), width))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat[ends[0] : ends[-1]])) - np.repeat(ends[:-1] - ends[0], n)] = flat[ends[0] : ends[-1]]
    return out


class _Block:
    """A block's tree, and the searches in it."""

    def __init__(self, batches: list[pa.RecordBatch], width: int):
        self.width = width
        table = pa.Table.from_batches(batches).combine_chunks()
        self.whole = table.column("vec").chunk(0) if len(table) else None
        self.ids, self.keys = (table.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "rid"))
        self.tree = MTree(_matrix(self.whole, width) if len(table) else np.zeros((0, width)))
        self.high = float(np.abs(self.tree.x).max(initial=0))

    def search(self, q: pa.RecordBatch, k: int) -> list[tuple[int, int, int, int]]:
        out, vectors = [], _matrix(q.column("vec"), self.width)
        floors = q.column("floor").to_pylist()
        for i, (rid, own) in enumerate(zip(q.column("rid").to_pylist(), q.column("vec_id").to_pylist(), strict=True)):
            product = None
            if max(self.high, float(np.abs(vectors[i]).max(initial=0))) ** 2 * max(self.width, 1) >= EXACT:
                mine = q.column("vec")[i].as_py()
                product = lambda r, mine=mine: max(min(sum(a * b for a, b in zip(mine, self.whole[r].as_py(), strict=False)), _MOST), _LEAST)
            floor = -math.inf if floors[i] is None or floors[i] == _LEAST else float(floors[i])
            out += [(rid, own, j, s) for s, j in self.tree.search(vectors[i], k, self.ids, rid, floor, self.keys, product)]
        return out


def _searched(rows: DataFrame, k: int, width: int, parts: int) -> DataFrame:
    """(rid, query_id, vec_id, score) from rows (key, kind 0 for vectors and 1 for queries, rid, vec_id, vec, floor)."""

    def run(batches):
        now, held, block = None, [], None
        for b in batches:
            key, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:], strict=False):
                part = b.slice(s, e - s)
                if key[s] != now:
                    now, held, block = key[s], [], None
                if kind[s] == 0:
                    held.append(part)
                elif held:
                    block = block or _Block(held, width)
                    got = block.search(part, k)
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*got, strict=True)], ["rid", "query_id", "vec_id", "score"])

    dealt = rows.repartition(parts, "key").sortWithinPartitions("key", "kind")
    return map_batches(dealt, ["key", "kind", "rid", "vec_id", "vec", "floor"], run, "rid long, query_id long, vec_id long, score long")


def reachable(q: np.ndarray, least: np.ndarray, pivots: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """(query, cell): whether the cell can hold a product of `least` or more with the query."""
    norm = np.sqrt((q * q).sum(axis=1))[:, None]
    centre = q @ pivots.T
    # the product with the pivot, and the most that anything within the radius adds; doubles round both
    slack = 1e-9 * (norm * np.sqrt((pivots * pivots).sum(axis=1)) + norm * radius + 1)
    return centre + norm * radius + slack >= least[:, None]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products with other rows, ties to the smaller id.

    Takes (vec_id, vec); shorter vectors count as filled up with zeros. Every row is a candidate
    for every query but itself, also where rows repeat a vec_id; each such row is a query of its
    own with its own ranks. Products beyond a long are cut to its largest or smallest value before
    they are ranked. An empty table gives no rows.
    """
    asked = F.coalesce(is_query, F.lit(False))
    held = cut_lineage(vectors.select("vec_id", "vec", asked.alias("asked")).withColumn("rid", F.monotonically_increasing_id()))
    n, m, width = held.agg(F.count(F.lit(1)), F.count(F.when(F.col("asked"), 1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    splits, parts = max(1, math.ceil(m / queries)), max(1, math.ceil(n / block)) * max(1, math.ceil(m / queries))
    # pivots of the cells: a bounded sample, the rows with the smallest hashes
    chosen = held.orderBy(F.xxhash64("rid"), "rid").limit(min(CELLS, max(1, math.ceil(n / block)))).select("vec").collect()
    pivots = np.zeros((len(chosen), width))
    for row, r in zip(pivots, chosen, strict=True):
        row[: len(r.vec)] = r.vec
    pivots = np.unique(pivots, axis=0)

    def nearest(batches):
        for b in batches:
            x = _matrix(b.column(1), width)
            d2 = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T
            cell = d2.argmin(axis=1)
            away = x - pivots[cell]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt((away * away).sum(axis=1)))], ["vec_id", "vec", "asked", "rid", "cell", "far"])

    placed = cut_lineage(map_batches(held, ["vec_id", "vec", "asked", "rid"], nearest, "vec_id long, vec array<long>, asked boolean, rid long, cell int, far double"))
    blocks, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():
        blocks[r.cell], radius[r.cell] = math.ceil(r.n / block), r.far
    first = np.cumsum(blocks) - blocks  # the number of each cell's first block
    of = lambda values, at: F.element_at(F.array(*(F.lit(int(v)).cast("long") for v in values)), at + 1)
    at_home = of(first, F.col("cell")) + F.pmod(F.xxhash64("rid"), of(blocks, F.col("cell"))) if len(pivots) else F.lit(0)
    placed = placed.withColumn("block", at_home)
    split = F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(splits))
    here = placed.select(F.explode(F.sequence(F.col("block") * splits, F.col("block") * splits + (splits - 1))).alias("key"), F.lit(0).alias("kind"), "rid", "vec_id", "vec", F.lit(None).cast("long").alias("floor"))
    ask = placed.where("asked")
    home = ask.select((F.col("block") * splits + split).alias("key"), F.lit(1).alias("kind"), "rid", "vec_id", "vec", F.lit(None).cast("long").alias("floor"))
    begun = cut_lineage(_searched(here.unionAll(home), k, width, parts))
    # the k-th product so far; a query with fewer has none
    floor = begun.groupBy("rid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    rest = ask.join(floor, "rid", "left").select("rid", "vec_id", "vec", "floor", "block")

    def visits(batches):
        for b in batches:
            q = _matrix(b.column(2), width)
            least = np.array([-math.inf if f is None or f == _LEAST else float(f) for f in b.column(3).to_pylist()])
            row, cell = np.nonzero(reachable(q, least, pivots, radius))
            go = np.concatenate([np.arange(first[c], first[c] + blocks[c]) for c in cell] + [np.empty(0, np.int64)]).astype(np.int64)
            row = np.repeat(row, blocks[cell])
            other = go != b.column(4).to_numpy()[row]
            row, go = row[other], go[other]
            for s in range(0, len(row), 2000):
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(row[s : s + 2000])) for i in range(4)), pa.array(go[s : s + 2000])], ["rid", "vec_id", "vec", "floor", "block"])

    away = map_batches(rest, ["rid", "vec_id", "vec", "floor", "block"], visits, "rid long, vec_id long, vec array<long>, floor long, block long")
    away = away.select((F.col("block") * splits + split).alias("key"), F.lit(1).alias("kind"), "rid", "vec_id", "vec", "floor")
    found = begun.unionAll(_searched(here.unionAll(away), k, width, parts))
    order = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

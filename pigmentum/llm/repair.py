"""Repair of conversations whose turns break the order of roles, by an error-correcting Earley parse.

The grammar of roles is left-linear, so every chart item begins in column 0 and a column holds one
item per rule. Error productions delete a row, give it another role, or insert an empty one; every
item keeps its least (cost, audit), where the audit spells the edits made so far. Audits are never
compared as strings: two audits of one column have a letter for each of the same rows, so one is
never the beginning of the other, and ranks decide in the next column what they decide in this one.

A conversation may hold any share of the rows. Identical rows are counted together before anything
is shuffled; the rest are range-partitioned by (conversation, turn), sorted, and cut into segments of
bounded rows and bytes. Nearly all conversations are one segment and are parsed where they lie. The
segments of others are parsed from every nonterminal that may stand before them (a table of 4 x 4
costs and ranks, whatever the segment's size), the tables are folded in order, and each segment is
parsed once more from the nonterminal that the fold found.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import cut_lineage, map_batches

#: Rows and bytes of text of a segment; one longer text is a segment of its own.
ROWS, BYTES = 1024, 4 << 20
SPACE = " \t\n\x0b\x0c\r"

#: Nonterminals by what they have read: nothing, a system turn, an open pair, whole pairs.
START, SYSTEM, OPEN, CLOSED = range(4)
#: head -> nonterminal before, role's initial: s?(ua)+, or nothing at all (START is final too).
GRAMMAR = [(SYSTEM, START, "s"), (OPEN, START, "u"), (OPEN, SYSTEM, "u"), (OPEN, CLOSED, "u"), (CLOSED, OPEN, "a")]
FINAL = START, CLOSED
ROLES = {"u": "user", "a": "assistant"}
#: Costs: another role for a row, a row deleted, an empty row inserted, a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rules by the nonterminal that they go on from.
AFTER = {n: [(head, role) for head, before, role in GRAMMAR if before == n] for n in range(4)}


class Item(NamedTuple):
    """A completed nonterminal of a column. The audit is that of the item of rank `rank` one column
    back, and `suffix`: inserts, then the letter of the column's row; `back` is that item's nonterminal."""

    cost: int
    rank: int
    suffix: str
    back: int


#: (nonterminal, cost beyond the cheapest, rank of its audit) of a column's items.
Column_ = tuple[tuple[int, int, int], ...]


class Inserted(NamedTuple):
    cost: int
    rank: int
    suffix: str
    base: int


def inserts(column: Column_) -> dict[int, Inserted]:
    """The column's items, completed by insert productions: least (cost, audit) first."""
    best: dict[int, Inserted] = {}
    queue = [(cost, rank, "", n, n) for n, cost, rank in column]
    heapq.heapify(queue)
    while queue:
        cost, rank, suffix, n, base = heapq.heappop(queue)
        if n not in best:
            best[n] = Inserted(cost, rank, suffix, base)
            for head, role in AFTER[n]:
                if role in ROLES:
                    heapq.heappush(queue, (cost + INSERT, rank, suffix + "I", head, base))
    return best


@functools.cache
def scan(column: Column_, initial: str, fault: str) -> tuple[dict[int, Item], Column_, int]:
    """The next column's items after one row, that column, and what its costs were lowered by.

    Columns hold costs beyond their cheapest item's, so there are only few different ones; each is
    worked out once per worker.
    """
    out: dict[int, Item] = {}

    def offer(n: int, item: Item) -> None:
        if n not in out or item[:3] < out[n][:3]:
            out[n] = item

    stays = TRUNCATED if fault == "truncated" else 0
    for n, (cost, rank, suffix, base) in inserts(column).items():
        offer(n, Item(cost + DELETE, rank, suffix + "D", base))
        if fault in ("", "truncated"):
            for head, role in AFTER[n]:
                if role == initial:
                    offer(head, Item(cost + stays, rank, suffix + "K", base))
                elif role in ROLES:
                    offer(head, Item(cost + stays + REROLE, rank, suffix + "R", base))
    low = min(i.cost for i in out.values())
    order = sorted(out, key=lambda n: out[n][1:3])
    return out, tuple((n, out[n].cost - low, k) for k, n in enumerate(order)), low


def chart(rows: list[tuple[str, str]], entry: int) -> tuple[list[dict[int, Item]], Column_, int]:
    """All columns' items after (initial, fault) rows, begun with one nonterminal read, the last column, and its least cost."""
    columns, last, least = [], ((entry, 0, 0),), 0
    for initial, fault in rows:
        items, last, low = scan(last, initial if initial in ("s", "u", "a") else "", fault)
        columns.append(items)
        least += low
    return columns, last, least


def finish(last: Column_) -> tuple[int, int, int]:
    """(cost, nonterminal, inserts) of the completed chart: the nonterminal of the last column and the inserts behind it."""
    done = inserts(last)
    cost, _, suffix, base = min(done[n] for n in FINAL if n in done)
    return cost, base, len(suffix)


def spell(suffixes: list[str], tail: int, initials: list[str], entry: int) -> Iterator[tuple[str, int | None, str | None]]:
    """(edit, row, new role) one by one: the row of an insert and the role of a row that keeps its own are None."""
    n = entry
    for i, suffix in enumerate([*suffixes, "I" * tail]):
        for edit in suffix:
            if edit == "D":
                yield edit, i, None
            elif edit == "K":
                n = next(head for head, role in AFTER[n] if role == initials[i])
                yield edit, i, None
            else:
                n, role = next((head, role) for head, role in AFTER[n] if role in ROLES)
                yield edit, i if edit == "R" else None, ROLES[role]


def damage(table: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows damaged by crc32 of `conv_id:turn` modulo 20; a null counts as one space.

    0 drops a row, 1 empties its text, 2 removes the text's full stops, exclamation and question
    marks, 3 repeats the row, 4 makes it the user's; other rows stay.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = table.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("_")).drop("_")


_KEYS = ["conv_id", "turn", "role", "text"]
#: Rows of a segment as arrays; copies: of identical rows, again: role and text stand in an earlier turn.
_ROWS = "turns array<long>, roles array<string>, texts array<string>, copies array<long>, again array<boolean>"
#: A segment's part of the result; first and last: the initials of its outer rows.
_FACTS = "least long, most long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string, cost long, audit string"
_EDITS = "edits array<struct<edit: string, fault: string, turn: bigint, role: string, text: string>>"
_LEGAL = {"su", "ua", "au"}


def _rows(table: DataFrame) -> DataFrame:
    """Distinct rows with their copies, and whether their role and text stand in an earlier turn."""
    text = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    counted = table.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text")).groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("copies"))
    counted = counted.withColumn("said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    place = F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"))  # a null turn comes first
    first = counted.groupBy("conv_id", "said").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("of"), F.col("said").alias("same"), "first")
    joined = counted.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("said") == F.col("same")), "left")
    return joined.select(*_KEYS, "copies", F.coalesce(place > F.col("first"), F.lit(False)).alias("again"))


def _batches(rows: Iterator[tuple[int, tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of (weight, row) pairs, each of bounded rows and weight."""
    held, weight = [], 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    for w, row in rows:
        held.append(row)
        weight += w
        if len(held) >= 256 or weight >= BYTES:
            yield make()
            held, weight = [], 0
    if held:
        yield make()


def _one_by_one(batches) -> Iterator[tuple]:
    """Rows of batches as Python objects, a few at a time."""
    for b in batches:
        for at in range(0, b.num_rows, 16):
            yield from zip(*(c.to_pylist() for c in b.slice(at, 16).columns), strict=True)


def _mapped(df: DataFrame, fn, ddl: str, *args) -> DataFrame:
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return map_batches(df, None, lambda batches: _batches(fn(_one_by_one(batches), *args), schema), ddl)


def _cut(rows: Iterator[tuple], most: int, most_bytes: int) -> Iterator[tuple[int, tuple]]:
    """Segments (part, seg, whole, arrays) of sorted rows.

    whole: the segment is its whole conversation. That of a range's first or last conversation
    isn't called so, since other ranges may hold more of it.
    """
    part, seg, number, cut = TaskContext.get().partitionId(), 0, 0, False
    conv, held, size, weight = None, [], 0, 0

    def closed(ends: bool) -> tuple[int, tuple]:
        return weight, (conv, part, seg, ends and number > 1 and not cut, *map(list, zip(*held, strict=True)))

    for c, turn, role, text, copies, again in rows:
        if held and c != conv:
            yield closed(True)
            seg, held, size, weight, cut = seg + 1, [], 0, 0, False
        if not number or c != conv:
            conv, number = c, number + 1
        while copies:
            n = min(copies, most)  # of identical rows; all but the first repeat it
            if held and (size + n > most or weight + len(text) > most_bytes):
                yield closed(False)
                seg, held, size, weight, cut = seg + 1, [], 0, 0, True
            held.append((turn, role, text, n, again))
            size, weight, copies, again = size + n, weight + len(text), copies - n, True
    if held:
        yield closed(False)


def _segments(rows: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """Segments of the rows in order; checkpointed, so that ranges never change."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranged = rows.select(*_KEYS, "copies", "again").repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(_mapped(ranged, _cut, f"conv_id {dict(rows.dtypes)['conv_id']}, part int, seg int, whole boolean, {_ROWS}", most, most_bytes))


def _faults(roles: list[str], texts: list[str], copies: list[int], again: list[bool]) -> Iterator[tuple[int, str, str]]:
    """(row, initial, fault) of every single row."""
    for i, (role, text, n, seen) in enumerate(zip(roles, texts, copies, again, strict=True)):
        said = text.rstrip(SPACE)
        for k in range(n):
            yield i, role[:1], "blank" if not said else "duplicate" if seen or k else "truncated" if said[-1] not in ".!?" else ""


def _tables(segments: Iterator[tuple]) -> Iterator[tuple[int, tuple]]:
    """Of every segment the cost and rank of each way from one nonterminal to another (none: -1), 16 of each."""
    for conv, part, seg, roles, texts, copies, again in segments:
        rows = [(initial, fault) for _, initial, fault in _faults(roles, texts, copies, again)]
        ways = {}
        for entry in range(4):
            _, last, least = chart(rows, entry)
            ways |= {4 * entry + n: (least + cost, rank) for n, cost, rank in last}
        cells = [ways.get(k, (-1, -1)) for k in range(16)]
        yield 1, (conv, part, seg, [c for c, _ in cells], [r for _, r in cells])


def _fold(tables: Iterator[tuple]) -> Iterator[tuple[int, tuple]]:
    """(part, seg, entry, leave, tail) of the segments of each conversation, which come in order."""
    for _, own in itertools.groupby(tables, lambda t: t[0]):
        column, backs, places = ((START, 0, 0),), [], []
        for _, part, seg, costs, ranks in own:
            best: dict[int, tuple] = {}
            for before, cost, rank in column:
                for n in range(4):
                    if (way := costs[4 * before + n]) >= 0:
                        best[n] = min(best.get(n, (1 << 62,)), (cost + way, rank, ranks[4 * before + n], before))
            low = min(b[0] for b in best.values())
            column = tuple((n, best[n][0] - low, k) for k, n in enumerate(sorted(best, key=lambda n: best[n][1:3])))
            backs.append(tuple(best[n][3] if n in best else -1 for n in range(4)))
            places.append((part, seg))
        _, leave, tail = finish(column)
        for place, back in zip(reversed(places), reversed(backs), strict=True):
            yield 1, (*place, back[leave], leave, tail)
            leave, tail = back[leave], 0


def _parse(segments: Iterator[tuple]) -> Iterator[tuple[int, tuple]]:
    """Facts and edits of every segment, parsed from the nonterminal it is known to follow."""
    for conv, part, seg, turns, roles, texts, copies, again, entry, leave, tail in segments:
        rows = list(_faults(roles, texts, copies, again))
        initials, faults = [initial for _, initial, _ in rows], [fault for *_, fault in rows]
        columns, last, _ = chart(list(zip(initials, faults, strict=True)), entry)
        if leave is None:
            _, leave, tail = finish(last)
        suffixes, n = [], leave
        for column in reversed(columns):
            suffixes.append(column[n].suffix)
            n = column[n].back
        made, cost = [], 0
        for edit, k, role in spell(suffixes[::-1], tail, initials, entry):
            i, fault = (None, "") if k is None else (rows[k][0], faults[k])
            made.append({"edit": edit, "fault": fault, "turn": None if i is None else turns[i], "role": role or roles[i], "text": "" if i is None else texts[i]})
            cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if edit in "KR" and fault == "truncated" else 0)
        known = {t for t in turns if t is not None}
        illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        yield sum(map(len, texts)), (conv, part, seg, min(known, default=None), max(known, default=None), len(known), *counts, illegal, initials[0], initials[-1], cost, "".join(m["edit"] for m in made), made)


def parse(conversations: DataFrame, most: int = ROWS, most_bytes: int = BYTES) -> tuple[DataFrame, DataFrame]:
    """The parsed segments, of conversations that are one segment each and of those that are more.

    Columns: conv_id, part and seg (a segment's place; they rise with its conversation's turns),
    facts for `summaries`, and edits array<struct<edit, fault, turn, role, text>>: one entry for each
    row and each inserted turn, in order, with the role it ends with.

    Rows of (conv_id, turn, role, text) are a conversation's by conv_id, in the order of turn (null
    first), role and text. Rows without an id are a conversation of their own; a null role or text
    is one space; roles count by their first character, which an empty role hasn't. Identical rows
    are duplicates of the first one. An empty table gives no rows; other columns aren't read.
    """
    segments = _segments(_rows(conversations), most, most_bytes)
    kind = dict(segments.dtypes)["conv_id"]
    ddl = f"conv_id {kind}, part int, seg int, {_FACTS}, {_EDITS}"
    arrays = ["turns", "roles", "texts", "copies", "again"]
    none = F.lit(None).cast("int")
    one = segments.where("whole").select("conv_id", "part", "seg", *arrays, F.lit(START).alias("entry"), none.alias("leave"), none.alias("tail"))
    parts = segments.where("not whole")
    tables = _mapped(parts.select("conv_id", "part", "seg", "roles", "texts", "copies", "again"), _tables, f"conv_id {kind}, part int, seg int, costs array<long>, ranks array<int>")
    ways = _mapped(_in_order(tables), _fold, "of_part int, of_seg int, entry int, leave int, tail int")
    more = parts.join(ways, (F.col("part") == F.col("of_part")) & (F.col("seg") == F.col("of_seg"))).select("conv_id", "part", "seg", *arrays, "entry", "leave", "tail")
    return _mapped(one, _parse, ddl), _mapped(more, _parse, ddl)


def _in_order(segments: DataFrame) -> DataFrame:
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")


def _summed(segments: Iterator[tuple]) -> Iterator[tuple[int, tuple]]:
    for conv, own in itertools.groupby(segments, lambda s: s[0]):
        least, most, turns, sums, last, audit, digest, begun = None, None, 0, [0] * 5, None, [], hashlib.sha256(), False
        for _, _, _, low, high, n, blank, duplicate, truncated, illegal, initial, final, cost, letters, edits in own:
            if low is not None:
                turns += n - (most == low)  # a turn whose rows lie on both sides
                least, most = low if least is None else least, high
            illegal += last is not None and last + initial not in _LEGAL
            sums = [a + b for a, b in zip(sums, (blank, duplicate, truncated, illegal, cost), strict=True)]
            last = final
            audit.append(letters)
            for e in edits:
                if e["edit"] != "D":
                    digest.update((begun * "\n" + f"{e['role']}:{e['text']}").encode())
                    begun = True
        yield sum(map(len, audit)), (conv, 0 if least is None else most - least + 1 - turns, *sums, "".join(audit), digest.hexdigest())


def summaries(parsed: tuple[DataFrame, DataFrame]) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired_sha256; one row per conversation.

    Conversations of one segment need no shuffle. A longer one's segments go past one task in order,
    since its digest is one chain over all its text; only the audit and the digest are held there.
    """
    one, more = parsed
    ddl = f"conv_id {dict(one.dtypes)['conv_id']}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _mapped(one, _summed, ddl).unionAll(_mapped(_in_order(more), _summed, ddl))


def edits(parsed: tuple[DataFrame, DataFrame]) -> DataFrame:
    """conv_id, part, seg, place, edit, fault, turn, role, text: every row and inserted turn; deleted ones are those of edit D."""
    one, more = parsed
    return one.unionAll(more).select("conv_id", "part", "seg", F.posexplode("edits").alias("place", "e")).select("conv_id", "part", "seg", "place", "e.*")

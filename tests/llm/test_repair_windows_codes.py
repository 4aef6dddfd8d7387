"""Conversation repair, window packing and vector codes against brute force."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pigmentum.llm import codes, queries, repair, windows, word_bpe

D = "/root/testdata/sf0.001"
WS = " \t\n\x0b\x0c\r"
NEXT = {("0", "s"): "S", ("0", "u"): "O", ("S", "u"): "O", ("C", "u"): "O", ("O", "a"): "C"}


def damaged(rows):
    """Rows of (conv_id, turn, role, text) by conversation, in order."""
    out = {}
    for c, t, r, x in rows:
        own = out.setdefault(c, [])
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if k == 1:
            x = ""
        if k == 2:
            x = x.translate({ord(y): None for y in ".!?"})
        if k == 4:
            r = "user"
        own += [(t, r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return {c: sorted(v, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode())) for c, v in out.items()}


def repaired(rows):
    """The cheapest audit by whole strings, from the last row back."""
    faults, seen = [], set()
    for _, r, x in rows:
        s = x.strip(WS)
        faults.append("blank" if not s else "duplicate" if (r, x) in seen else "truncated" if s[-1] not in ".!?" else "")
        seen.add((r, x))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    after = {}
    for i in range(len(rows), -1, -1):
        now = {}
        for q in "0SOC":
            ways = [(0, "")] if i == len(rows) and q in "0C" else []
            if i < len(rows):
                ways.append((2 + after[q][0], "D" + after[q][1]))
                if faults[i] in ("", "truncated"):
                    stays = 5 * (faults[i] == "truncated")
                    for role in "sua":
                        if to := NEXT.get((q, role)):
                            cost, audit = after[to]
                            ways += [(stays + cost, "K" + audit)] * (role == initials[i]) + [(stays + 1 + cost, "R" + audit)] * (role in "ua")
            now[q] = min(ways, default=(10**9, ""))
        for _ in range(3):
            for q, role in itertools.product("0SOC", "ua"):
                if to := NEXT.get((q, role)):
                    now[q] = min(now[q], (5 + now[to][0], "I" + now[to][1]))
        after = now
    cost, audit = after["0"]
    said, q, i = [], "0", 0
    for edit in audit:
        if edit == "K":
            q = NEXT[(q, initials[i])]
            said.append(f"{rows[i][1]}:{rows[i][2]}")
        elif edit != "D":
            role = "a" if q == "O" else "u"
            q = NEXT[(q, role)]
            said.append({"u": "user", "a": "assistant"}[role] + ":" + (rows[i][2] if edit == "R" else ""))
        i += edit != "I"
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def odd_rows():
    r = random.Random(5)
    rows = [(c, r.choice([None, *range(12)]), r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "U"]), r.choice(["a.", "b!", "c", "  ", "", None, "d?\n", "e. ", "fé"])) for c in [None, *range(60)] for _ in range(r.choice([1, 3, 8, 40]))]
    return [*rows, *[(3, 5, "user", "same.")] * 70, (61, 1, "user", "long " * 200_000 + "."), (62, None, "assistant", "x.")]


@pytest.mark.parametrize(("most", "most_bytes"), [(1, 1 << 20), (2, 1 << 20), (5, 30), (1024, 4 << 20)])
def test_repair_whatever_the_segments(spark, most, most_bytes):
    rows = odd_rows()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("audit", F.lit("clash")).withColumn("of", F.lit(1)).repartition(7)
    parsed = repair.parse(repair.damage(table), most, most_bytes)
    want = {c: repaired(v) for c, v in damaged(rows).items() if v}
    assert {x.conv_id: tuple(x)[1:] for x in repair.summaries(parsed).collect()} == want
    made = repair.edits(parsed).collect()
    assert len(made) == sum(len(w[-2]) for w in want.values())
    of = sorted((e for e in made if e.conv_id == 3), key=lambda e: (e.part, e.seg, e.place))
    assert "".join(e.edit for e in of) == want[3][-2]


def test_one_conversation_over_many_ranges(spark):
    r = random.Random(2)
    rows = [(9, t, r.choice(["user", "assistant"]), r.choice(["yes.", f"t{t}.", f"u{t}", ""])) for t in range(700)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = repair.summaries(repair.parse(table, 16)).collect()
    assert len(got) == 1
    assert tuple(got[0])[1:] == repaired(sorted(rows, key=lambda x: x[1]) and [x[1:] for x in rows])


def test_repair_query_keeps_every_conversation(spark, tmp_path):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "x."), *[tuple(x) for x in spark.read.parquet(f"{D}/conversations.parquet").where(f"conv_id <> {gone}").select("conv_id", "turn", "role", "text").collect()]]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x.conv_id: tuple(x)[1:] for x in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == {c: repaired(v) for c, v in damaged(rows).items()}
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert queries.op11_conversation_repair(spark, f"{tmp_path}/none").count() == 0


def test_word_ids_equal_the_library():
    bpe = word_bpe.load()
    r, signs = random.Random(1), "abcdeeeestthhaaio'\"!?.,-0123 \n\t\x0b\x0c\x1c\x1d\x1f\x85\xa0 éÉßİΣσςªº½①中文字한글ñãçøåA̧é "
    made = ["".join(r.choice(signs if i % 3 else signs[:30]) for _ in range(r.randint(0, 40))) for i in range(4000)]
    made += ["<|endoftext|>" + made[5] + "<|STARTOFTEXT|><|startoftext|>x", "", " \n", "a" * 30_000, "don't we'll I'M 'sx ''s", "héllo " * 5000]
    for text in made:
        assert bpe.encode(text).tolist() == bpe.hf.encode(text, add_special_tokens=False).ids, text[:80]


@pytest.mark.parametrize(("n", "capacity", "seed"), [(3000, 4096, 1), (900, 64, 2), (5, 4096, 3), (1, 7, 4), (400, 2, 5), (300, 3, 6), (2000, 100, 7)])
def test_plans_place_every_token_once(n, capacity, seed):
    r = np.random.default_rng(seed)
    lengths, counts = np.unique(np.clip(r.lognormal(np.log(capacity) * 0.78, 1.0, n).astype(int), 1, capacity), return_counts=True)
    p = windows.plan(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), capacity)
    filled = [np.zeros(0, int)] * p.sequences
    placed = {}
    for length, rank, m, start, size, seq, offset in p.runs:
        for k in range(m):
            placed.setdefault((length, rank + k), []).append((start, size))
            filled[seq + k] = np.concatenate([filled[seq + k], np.arange(offset, offset + size)])
    assert len(placed) == n
    for (length, _), parts in placed.items():
        parts.sort()
        assert [s for s, _ in parts] == [0, *np.cumsum([z for _, z in parts])[:-1]]
        assert sum(z for _, z in parts) == length
    sizes = [len(f) for f in filled]
    assert all((np.sort(f) == np.arange(len(f))).all() for f in filled)
    assert all(z == capacity or z & (z - 1) == 0 for z in sizes)  # no padding
    assert p.sequences <= -(-int((lengths * counts).sum()) // capacity) + capacity.bit_length()


def test_least_squares_are_at_their_optimum():
    """Every combination is a column once; the residual has no way down at x >= 0."""
    capacity = 24
    blocks = windows.Blocks(capacity)
    combos = []
    for slices, _ in blocks.cols:
        combos += zip(*(np.arange(capacity)[s].tolist() for s in slices), strict=True)
    want = [c for d in (2, 3) for c in itertools.combinations_with_replacement(range(1, capacity), d) if sum(c) == capacity]
    assert sorted(map(tuple, map(sorted, combos))) == sorted(want)
    counts = np.random.default_rng(0).integers(0, 50, capacity)
    counts[0] = 0
    saved, windows.GAIN = windows.GAIN, 0
    try:
        left = blocks.solve(counts, 3000)
    finally:
        windows.GAIN = saved
    used = np.zeros(capacity)
    for (slices, norm), x in zip(blocks.cols, blocks.x, strict=True):
        assert (x >= 0).all()
        for s in slices:
            used[s] += x
        slope = sum(left[s] for s in slices) / norm
        assert (slope < 1e-3).all()  # no count should rise
        assert (np.abs(slope[x > 1e-3]) < 1e-2).all()  # nor any positive one fall
    assert np.allclose(used + left, counts)


def test_window_packing(spark):
    texts = [None, "", "a b", "word " * 9000, "héllo wörld", "x" * 40_000, *[f"t{i} " * (i * 7 % 900) for i in range(60)]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (2, "a b")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).withColumn("ids", F.lit(1)).repartition(5)
    bpe = word_bpe.load()
    for capacity in (4096, 64):
        got = windows.pack(table, capacity).toPandas()
        ids = {i: [*bpe.hf.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
        for key, own in got.groupby("doc_id", dropna=False):
            key = None if pd.isna(key) else int(key)
            times = 2 if key == 2 else 1
            seen = np.zeros(len(ids[key]), int)
            for r in own.itertuples():
                assert r.doc_tokens == len(ids[key])
                part = ids[key][r.start : r.start + r.length]
                assert len(part) == r.length > 0
                assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
                seen[r.start : r.start + r.length] += 1
            assert (seen == times).all()
        assert got.doc_id.nunique(dropna=False) == len(ids)
        for _, own in got.sort_values("offset").groupby("sequence_id"):
            assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
            assert (n := own.length.sum()) == capacity or n & (n - 1) == 0
    assert windows.pack(table.limit(0)).count() == 0


def brute_codes(rows, parts, entries, rounds):
    """(codes, errors, text of the codebooks) of (vec_id, vector) rows, in plain Python."""
    width = -(-max(len(v) for _, v in rows) // parts) * parts
    step = width // parts
    whole = [[int(np.floor(4096 * float(x))) for x in v] + [0] * (width - len(v)) for _, v in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, list(map(float, rows[i][1]))))
    books = [[whole[i][p * step : (p + 1) * step] for i in order[:entries]] for p in range(parts)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for w in whole:
                part = w[p * step : (p + 1) * step]
                own.setdefault(nearest(p, part)[1], []).append(part)
            for i, of in own.items():
                books[p][i] = [sum(c) // len(of) for c in zip(*of, strict=True)]
    found = [[nearest(p, w[p * step : (p + 1) * step]) for p in range(parts)] for w in whole]
    return ["".join(f"{i:02x}" for _, i in f) for f in found], [sum(d for d, _ in f) for f in found], ",".join(str(v) for b in books for e in b for v in e)


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_vector_codes(spark, scale):
    r = np.random.default_rng(3)
    rows = [(i if i % 41 else None, (r.integers(-3, 4, 16) / 4096 * scale).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (301, [1.5] * 9), (302, [-0.3])]
    rows = [(i, [float(np.float32(x)) for x in v], k % 3 if k % 5 else None) for k, (i, v) in enumerate(rows)]
    bad = [(400, None, 1), (401, [1.0, None], 1), (402, [float("nan")], 1), (403, [float("-inf")] * 16, 0)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("clash")).withColumn("_label", F.lit(1)).repartition(3)
    want, errors, text = brute_codes([r[:2] for r in rows], 4, 16, 3)
    coded, books = codes.compress(codes.vectors(table), parts=4, rounds=3)
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    sums = {}
    for (_, _, label), e in zip(rows, errors, strict=True):
        sums[label] = sums.get(label, 0) + e
    got = [(x.vec_id, x.code, x.error, x.label_error) for x in codes.with_label_errors(coded).collect()]
    assert sorted(got, key=key) == sorted(((i, c, e, sums[label]) for (i, _, label), c, e in zip(rows, want, errors, strict=True)), key=key)
    assert books.text() == text


def test_trees_keep_the_lower_of_equal_entries():
    r = np.random.default_rng(0)
    for leaf in (1, 2, 5):
        entries = r.integers(0, 3, (16, 3))
        points = r.integers(-1, 4, (500, 3))
        index, best = codes.KdTree(entries, leaf).nearest(points)
        far = ((points[:, None] - entries) ** 2).sum(axis=2)
        assert (index == far.argmin(axis=1)).all()
        assert (best == far.min(axis=1)).all()


def test_codes_of_few_and_huge_vectors(spark):
    rows = [(1, [3e38, -3e38], 1), (2, [1e-3, 5.0], None)]
    coded, books = codes.compress(codes.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")))
    assert {(r.vec_id, r.code, r.error) for r in coded.collect()} == {(1, "00" * 8, 0), (2, "01" + "01" + "00" * 6, 0)}
    assert books.text().startswith(f"{int(np.float32(3e38)) * 4096},4,")
    none = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    coded, books = codes.compress(codes.vectors(none))
    assert books is None
    assert codes.with_label_errors(coded).count() == 0


def test_vector_codes_equal_their_sql(spark):
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{D}/embeddings.parquet'")
    want = db.execute(queries.SQL["op13_vector_codes"]).fetchall()
    got = queries.op13_vector_codes(spark, D).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)

"""Near-duplicates of the pipeline against brute force over planted copies, and the grids of op9."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from pigmentum.llm import simhash, similar
from pigmentum.llm.components import components


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute(rows):
    """The doc_ids that stay."""
    found = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(found[i], found[j]) >= 0.8:
                a, b = up(i), up(j)
                root[max(a, b)] = min(a, b)
    return [rows[i][0] for i in range(len(rows)) if up(i) == i]


def edited(rng, words, n):
    """The text with n of its words replaced, far apart."""
    out = list(words)
    for i in rng.sample(range(3, len(words) - 3, 6), n):
        out[i] = f"new{rng.randrange(10**9)}"
    return out


def test_planted_copies(spark):
    rng = random.Random(5)
    texts, near = [], 0
    for n in (60, 100, 200, 400, 1000):
        for _ in range(12):
            words = [f"w{rng.randrange(3000)}" for _ in range(n)]
            texts.append(words)
            for low, high in ((0.8, 0.83), (0.83, 0.9), (0.9, 0.95), (0.7, 0.8)):
                made = [edited(rng, words, k) for k in range(1, n // 20 + 2)]
                fit = [x for x in made if low <= jaccard(shingles(" ".join(words)), shingles(" ".join(x))) < high]
                texts += fit[:1]
                near += bool(fit) and low >= 0.8
    assert near > 100
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "").collect()
    assert sorted(r.doc_id for r in got) == brute(rows)


def test_recall_by_similarity_and_few_chance_meetings():
    """Keys meet for nearly all pairs from 0.8 on, whatever the size, and seldom for texts that only share a passage."""
    rng = random.Random(11)
    for n in (150, 700, 2500):
        for low, high, least in ((0.8, 0.85, 0.97), (0.85, 0.9, 0.99), (0.9, 0.95, 1.0)):
            met = pairs = 0
            for _ in range(60):
                words = [f"w{rng.randrange(9000)}" for _ in range(n)]
                for k in rng.sample(range(1, n // 20 + 2), min(4, n // 20)):
                    a, b = " ".join(words), " ".join(edited(rng, words, k))
                    if low <= jaccard(shingles(a), shingles(b)) < high:
                        pairs += 1
                        met += bool(np.isin(*(similar.keys_of(similar.shingles(x)) for x in (a, b))).any())
            assert met >= least * pairs, (n, low, met, pairs)
    passage = [f"p{i}" for i in range(100)]
    keys = [set(similar.keys_of(similar.shingles(" ".join([*passage, *(f"o{rng.randrange(10**9)}" for _ in range(60))]))).tolist()) for _ in range(200)]
    met = sum(bool(keys[i] & keys[j]) for i in range(200) for j in range(i))
    assert met < 0.3 * 200 * 199 / 2


def test_candidates_in_proportion_to_the_table(spark, monkeypatch):
    """No cells of fingerprints, which texts share by chance; one band more finds more pairs than they would."""
    monkeypatch.setattr(simhash, "cells", None)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(edited(rng, base, i % 3))) for i in range(9)] + [(9 + i, " ".join(f"o{rng.randrange(10**6)}" for _ in range(50))) for i in range(30)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in got) == [0, *range(9, 39)]
    for s in (0.8, 0.9, 0.95):
        met, extra = 0, int(400 * (1 - s) / s)
        draw = np.random.default_rng(int(100 * s))
        for _ in range(400):
            both, own = draw.integers(0, 1 << 63, 400, np.uint64), draw.integers(0, 1 << 63, extra, np.uint64)
            a, b = (simhash.majority(np.concatenate([both, x])) for x in (own[: extra // 2], own[extra // 2 :]))
            met += ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4
        assert met / 400 < s**similar.ROWS


def test_chains_and_large_groups(spark, monkeypatch):
    """Each text is like its neighbours only, so a comparison with one member of a key doesn't suffice."""
    monkeypatch.setattr(similar, "HUB", 8)
    monkeypatch.setattr(similar, "BLOCK", 16)
    rng = random.Random(8)
    rows = []
    for c in range(6):
        words = [f"c{c}w{i}" for i in range(120)]
        for _ in range(25):
            rows.append((len(rows), " ".join(words)))
            words = words[4:] + [f"c{c}n{rng.randrange(10**9)}" for _ in range(4)]
    base = [f"b{i}" for i in range(200)]
    rows += [(len(rows) + i, " ".join(edited(rng, base, 1))) for i in range(60)]
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "").collect()
    assert sorted(r.doc_id for r in got) == brute(rows) and len(got) == 7


def test_odd_rows(spark):
    rows = [(3, None), (1, ""), (2, "  "), (None, "a b"), (None, "a b"), (5, "A  b"), (4, "a b"), (7, "one two three"), (7, "one two three"), (8, "x y z")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_dedup(spark, table, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "a b"), (0, "a b"), (1, ""), (4, "a b"), (7, "one two three"), (8, "x y z")]
    assert corpus_pipeline.near_dedup(spark, table.limit(0), "").count() == 0


def test_repeated_ids_are_judged_row_by_row(spark):
    """A doc_id that stands for several texts names none of them: each row is judged by its own text."""
    rng = random.Random(2)
    a, b, c = (" ".join(f"{k}{rng.randrange(300)}" for _ in range(80)) for k in "abc")
    rows = [(3, a, 1), (7, a, 2), (7, b, 3), (5, b, 4), (5, c, 5), (6, c, 6), (6, c, 6), (9, "x", 7), (9, "x", 8), (9, "x", 8)]
    table = spark.createDataFrame(rows, "doc_id long, text string, row int").withColumnRenamed("row", "_gone_id").repartition(3)
    for keep in (simhash.keep_one, similar.keep_one):
        got = keep(table)
        assert got.columns == table.columns
        kept = sorted(map(tuple, got.collect()))
        # b's first id is 5, so 7 goes there; c's is 5 as well; of the rows with x one stays
        assert [r[:2] for r in kept] == sorted([(3, a), (5, b), (5, c), (9, "x")])


@pytest.mark.parametrize("groups", [6, 7, 9])
def test_finer_grids_lose_nothing(spark, groups, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(groups)
    fps = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for f in list(fps):
        for _ in range(rng.choice([0, 1, 40])):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 4)):
                g ^= 1 << b
            fps.add(g)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    table = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r.node: r.root for r in components(simhash.links(table, 4, groups)).collect()}
    left, want = set(fps), {}
    while left:
        todo, group = [left.pop()], []
        while todo:
            x = todo.pop()
            group.append(signed(x))
            near = {y for y in left if (x ^ y).bit_count() <= 4}
            left -= near
            todo += near
        want |= dict.fromkeys(group, min(group))
    assert {n: got.get(n, n) for n in want} == want


def test_comparisons_level_off():
    """With the number of groups that follows from the number of fingerprints, one meets about as many others at any size."""
    met = {}
    for n in (250_000, 1_000_000, 4_000_000):
        g = simhash.groups_for(n)
        load = 0.0
        rng = np.random.default_rng(g)
        sample = rng.integers(0, 1 << 64, 200_000, np.uint64)
        half = np.uint64(0x5555555555555555)
        odd, even = (sample >> np.uint64(1)) & half, sample & half
        emb = ((odd & even) << np.uint64(1)) | (odd ^ even)
        for chosen in itertools.combinations(range(g), g - 4):
            mask = sum(3 << (2 * i) for c in chosen for i in range(c * 32 // g, (c + 1) * 32 // g))
            _, size = np.unique(emb & np.uint64(mask), return_counts=True)
            load += float((size.astype(float) * (size - 1)).sum()) / len(sample) * n / len(sample)
        met[n] = load
        assert len(list(itertools.combinations(range(g), 4))) <= 210
    assert max(met.values()) < 900, met


def test_sketches_rule_out_no_alike_pair():
    """Pairs of 0.8 and more pass in all sizes; of small sets, most pairs of 0.7 and less don't."""
    rng = np.random.default_rng(3)
    passed = 0
    for n in (1, 4, 30, 150, 511, 512, 640, 1100, 5000, 40_000):
        for wanted in (0.8, 0.83, 0.95, 0.7, 0.5):
            for _ in range(20):
                both = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
                extra = int(n * (1 - wanted) / wanted)
                left = int(rng.integers(0, extra + 1))
                more = rng.integers(0, 1 << 63, extra, np.uint64) * np.uint64(2) + np.uint64(1)
                a, b = (np.unique(np.concatenate([both, x])) for x in (more[:left], more[left:]))
                sizes = np.array([len(a)]), np.array([len(b)])
                sketches = tuple(np.frombuffer(similar.sketch_of(x), np.uint64)[None] for x in (a, b))
                may = bool(similar.may_be_alike(sizes, sketches)[0])
                assert may or not similar.alike(a, b)
                passed += may and 30 <= n < 400 and wanted <= 0.7
    assert passed <= 8

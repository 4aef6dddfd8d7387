"""The text operators on small tables with nulls, empty and long texts, ties, repeated rows and odd columns, against brute force."""

import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pigmentum.llm import bpe, gru, langid, licenses, lm, packing, quality, simhash, token_counts

TEXT = [
    "Released under the MIT License. MIT license, again; the mit-license!",
    "Licensed under the Apache License, Version 2.0.\nAll rights reserved.",
    "This work is licensed under the GNU General Public License, version 3.",
    "", None, "   \n\t ", "12345 67890", "éèêç <|endoftext|> ñandú", "a" * 3000 + " " + "=" * 700, "你好世界 hello",
]
WORDS = "the of and to in that is was for with one two three four five six seven eight nine ten".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ",\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en", 3) for i, t in enumerate(TEXT)]
    out += [(100 + i, prose(i, 5 + 40 * i), "en" if i % 2 else "de", 0) for i in range(12)]
    out += [(200, prose(1, 4000), None, 1), (100, prose(0, 5), "en", 0), (None, "no id at all here", "fr", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    # columns with the names of results must do no harm
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int").withColumn("score", F.lit("x")).withColumn("kept", F.lit(0)).repartition(3)


def key(r, *names):
    return tuple(str(r[n]) for n in names)


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_licenses_base_places(docs, rows):
    got = licenses.scan(docs).collect()
    want = []
    for i, text, *_ in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = [(at, label) for p, label in licenses.PHRASES.items() for at in range(len(words)) if words[at : at + len(p.split())] == p.split()]
        starts = [a for a, _ in places]
        want.append((i, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    same([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], want)
    by = {r.doc_id: r for r in got}
    assert by[0].labels == "mit,mit-notice" and by[1].labels == "all-rights-reserved,apache,apache-2.0" and by[2].labels == "gpl,gpl-3.0"
    assert all(0 <= r.score <= 1 for r in got) and by[3].labels == ""


def test_license_automata():
    a = licenses.Automaton("grant <<beginOptional>>full <<endOptional>>rights to <<var;name=x;words=0-2>> free of charge")
    w = licenses.words_of
    assert a.match(w("grant rights to free of charge"), 0) == 6
    assert a.match(w("grant full rights to any person free of charge now"), 0) == 9
    assert a.match(w("grant full rights to any such person free of charge"), 0) is None
    assert a.match(w("grant most rights to free of charge"), 0) is None
    text = licenses.TEMPLATES["mit-text"].replace("<<beginOptional>>", "").replace("<<endOptional>>", "")
    for shown in (text, text.replace("(including the next paragraph)", ""), "x " * 50 + text + " y"):
        assert "mit-text" in licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES).scan(shown)["labels"]
    assert "mit-text" not in licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES).scan(text.replace("merge", "alter"))["labels"]


def expression(template):
    """The same template as a regular expression over space-separated words."""
    out, opened = "", 0
    for mark, text in re.findall(r"<<([^>]*)>>|([^<]+)", template):
        if mark == "beginOptional":
            out += "(?:"
        elif mark == "endOptional":
            out += ")?"
        elif mark:
            low, high = re.search(r"words=(\d+)-(\d+)", mark).groups()
            out += rf"(?:[^ ]+ ){{{low},{high}}}"
        out += "".join(re.escape(w.decode()) + " " for w in licenses.words_of(text))
    return re.compile("(?:^| )(" + out + ")")


def test_license_automata_against_expressions():
    """Texts made from each template, with parts left out, filled, or spoilt by one word."""
    rng = random.Random(11)
    for label, template in licenses.TEMPLATES.items():
        a, ex, hits = licenses.Automaton(template), expression(template), 0
        for k in range(12):
            text, skip = "", 0
            for mark, part in re.findall(r"<<([^>]*)>>|([^<]+)", template):
                if mark == "beginOptional":
                    skip = skip + 1 if skip or rng.random() < 0.5 else 0
                elif mark == "endOptional":
                    skip = max(0, skip - 1)
                elif mark and not skip:
                    low, high = map(int, re.search(r"words=(\d+)-(\d+)", mark).groups())
                    text += " ".join(rng.choice(["acme", "inc", "2020"]) for _ in range(rng.randint(low, min(high, low + 3)))) + " "
                elif not skip:
                    text += part + " "
            words = [w.decode() for w in licenses.words_of(text)]
            if k % 3 == 2:
                words[rng.randrange(len(words))] = "spoilt"
            words = ["x", *words, "y"]
            found = {len(" ".join(words)[: m.start(1)].split()) for m in ex.finditer(" ".join(words) + " ")}
            got = {i for i in range(len(words)) if a.match([w.encode() for w in words], i) is not None}
            assert found <= got and bool(found) == bool(got), (label, words)
            hits += bool(got)
        assert hits >= 8, label


def test_license_scan_is_linear():
    """5 MB of phrases and of words that templates begin with."""
    s = licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES)
    for text, n in (("mit license " * 420_000, 420_000), ("permission licensed this under " * 160_000, 0)):
        began = time.perf_counter()
        got = s.scan(text)
        assert got["n_base"] == n and time.perf_counter() - began < 60


def test_bpe_round_trip(docs, rows):
    tok = bpe.load().hf
    got = bpe.encode_decode(docs, leaf_bytes=64).collect()
    want = []
    for i, text, *_ in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        want.append((i, ids, tok.decode(ids, skip_special_tokens=False)))
    same([(r.doc_id, r.ids, r.decoded) for r in got], want)


def test_bpe_trees_agree_with_the_library():
    rng, small = random.Random(3), bpe.load(None, 7)
    parts = ["the", " ", "  ", "\n", "'s", "'", "aaaa", "ing", "é", "ß", "12", "==", "<|endoftext|>", "-", "你好", "\t", "'ll", "A", "\u00a0", "tion", "'re"]
    for k in range(3000):
        text = "".join(rng.choices(parts if k % 3 else ["a", "b", "ab", "s", "tion", "in"], k=rng.randint(0, 60)))
        assert small.encode(text).tolist() == small.hf.encode(text, add_special_tokens=False).ids, text
    long = "".join(rng.choices("abcdefgh 'st", k=bpe.PARALLEL_BYTES + 1000))  # in threads
    assert bpe.load().decode(bpe.load().encode(long)) == long


#: Letters, numbers, spaces, marks and signs far from Latin, also some that Unicode got lately.
WORLD = ["你好", "世界", "。", "Привет", "мир", ", ", "مرحبا", "٣٤", "🙂", "👩‍🔬", "\u3000", "\u2028", "\u0085", "\u00a0", "é", "e\u0301", "ไทย", "한국어", "½", "Ⅷ", "\U0001e4d0", "\U00011f04", "\u0c5d", "\ua7c0", "\u200b", "ß", " ", "  ", "\n", "'s", "don't", "ab", "12", "!?", "<|endoftext|>", "\ufeff", "\ufffd"]


def test_bpe_in_other_scripts_goes_by_trees(monkeypatch):
    """Every text is cut, joined and merged here; the library is only asked for characters' classes."""
    rng, small = random.Random(5), bpe.ByteBpe(bpe.default_path(), 9)
    hf, count = small.hf, token_counts.TokenCounter(small)

    class OnlyClasses:
        pre_tokenizer = hf.pre_tokenizer

    small.__dict__["hf"] = OnlyClasses()
    for k in range(3000):
        text = "".join(rng.choices(WORLD if k % 3 else WORLD[:8], k=rng.randint(0, 40)))
        want = hf.encode(text, add_special_tokens=False).ids
        got = small.encode(text)
        assert got.tolist() == want, text
        assert small.decode(got) == hf.decode(want, skip_special_tokens=False)
        assert count.count(text) == len(want), text


def test_bpe_over_a_megabyte_equals_the_library():
    rng, own = random.Random(6), bpe.load()
    for parts in (["абв", "где", "ёжз ", "и, "], ["abc", "d'e", "fg ", "st"], ["你", "好", "世", "界", "。"]):
        text = "".join(rng.choices(parts, k=bpe.PARALLEL_BYTES // 5))
        text += text[: max(0, bpe.PARALLEL_BYTES - len(text.encode()))] + "end"
        assert len(text.encode()) > bpe.PARALLEL_BYTES
        assert own.encode(text).tolist() == own.hf.encode(text, add_special_tokens=False).ids


def test_empty_tables(docs):
    none = docs.limit(0)
    for df in (licenses.scan(none), bpe.encode_decode(none), quality.judge(none), token_counts.count_tokens(none), quality.filter_kept(none)):
        assert df.count() == 0


def test_quality_with_short_windows():
    assert quality.measure("a b a b a", (2, 8))["share"][2] == 1.0


def test_token_counts(docs, rows):
    tok = bpe.load().hf
    got = token_counts.count_tokens(docs, limit=100).collect()
    n = {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows}
    same([tuple(r) for r in got], [(i, len((t or "").encode()), n[i], n[i] > 100) for i, t, *_ in rows])
    whole = token_counts.whole_tokens(bpe.load())
    assert " the" in whole and all(len(tok.encode(x).ids) == 1 for x in random.Random(1).sample(sorted(whole), 300))


def test_quality_against_brute_force(docs, rows):
    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)

    got = quality.judge(docs).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got], [(i, *brute(t)) for i, t, *_ in rows])
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    for n in (2, 7, 40, 300):
        for seed in range(20):
            text = " ".join(random.Random(seed).choices("a b c d ee".split(), k=n)) + "\n# x\n# x"
            m = quality.measure(text)
            assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == brute(text)


def test_quality_collisions_are_compared(monkeypatch):
    monkeypatch.setattr(quality, "_windows", lambda ids, lengths: {n: np.zeros(len(ids) - n + 1, np.uint64) for n in lengths})
    assert quality.measure(" ".join(map(str, range(50))) + " 0")["n_repeat_words"] == 0
    assert quality.measure(" ".join([*map(str, range(8)), "x", *map(str, range(8))]))["n_repeat_words"] == 16


def test_language_id(spark):
    de, en = "der die das und nicht mit ein eine schön über straße", "the and that with for this have from they which"
    rng = random.Random(5)
    say = lambda words: " ".join(rng.choices(words.split(), k=30))
    rows = [(i, say(de if i % 2 else en), "de" if i % 2 else "en") for i in range(200)] + [(900, None, "en"), (901, "123 ...", "de"), (902, "", None), (None, say(en), "en")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    held = F.coalesce(F.col("doc_id"), F.lit(0)) % 4 == 2
    model = langid.fit(table.where(~held))
    counts = defaultdict(Counter)
    for i, text, lang in rows:
        if text and lang and (i or 0) % 4 != 2:
            counts[lang].update(langid._grams(langid._codes(text)).tolist())
    for lang in model.langs:
        want = [g for g, _ in sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))][: model.size]
        assert langid.profiles(table.where(~held))[lang] == np.array(want, np.uint64).astype(np.int64).tolist()
    got = {r.doc_id: r for r in langid.predict(table, model).collect()}
    assert got[900].lang_pred == got[901].lang_pred == got[902].lang_pred == "und" and got[901].score == 0
    wrong = [i for i, text, lang in rows if i is not None and i < 900 and got[i].lang_pred != lang]
    assert not wrong and all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(table, langid.fit(table.limit(0))).select("lang_pred").distinct().collect()[0][0] == "und"
    assert langid.filter_known(table, model).columns == table.columns


def test_lm_base_scores_and_probabilities(docs, rows):
    toks = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [" end"]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    c = Counter(t for i, text, *_ in rows if not out(i) for t in toks(text))
    total, kinds = sum(c.values()), len(c)
    want = []
    for i, text, *_ in rows:
        own = toks(text)
        want.append((i, out(i), len(own), sum(c[t] > 0 for t in own), total, round(sum(math.log10((c[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in own), 6)))
    for head in (lm.HEAD, 3, 0):  # also where most tokens, or all, are beyond the head
        got = lm.score(docs, head).collect()
        same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], want)
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    empty = lm.score(docs.limit(0))
    assert empty.count() == 0 and "train_tokens" in empty.columns


def test_end_token_of_rare_documents(spark):
    """One training document of very many words: its end token is rarer than most words, and counts all the same."""
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 10]
    held = next(i for i in range(40) if zlib.crc32(str(i).encode()) % 10 == 0)
    n = 5000
    table = spark.createDataFrame([(ids[0], " ".join(f"w{i} w{i}" for i in range(n))), (held, "zz")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(table, 100).collect()}[held]
    below = 2 * n + 1 + 0.1 * (n + 2)
    assert got.n_known == 1
    assert math.isclose(got.base_score, math.log10(0.1 / below) + math.log10(1.1 / below), rel_tol=1e-9)


def test_gru_sums_to_one_carries_state_and_learns():
    rng = np.random.default_rng(0)
    counts = np.zeros(gru.VOCAB)
    counts[:200] = 1 + rng.integers(0, 50, 200)
    p = gru.start(counts)
    # every next word's probability, by scoring each one as a document of two words
    docs = [np.array([5, w], np.int32) for w in range(gru.VOCAB)]
    both = gru.log_likelihoods(p, docs)
    first = gru.log_likelihoods(p, [np.array([5], np.int32)])[0]
    assert abs(np.exp(both - first).sum() - 1) < 1e-3
    long = rng.integers(2, 200, 500).astype(np.int32)
    whole = gru.log_likelihoods(p, [long, long[:7]], steps=16)
    assert abs(whole[0] - gru.log_likelihoods(p, [long], steps=500)[0]) < 1e-2  # windows don't matter
    assert abs(whole[1] - gru.log_likelihoods(p, [long[:7]], steps=3)[0]) < 1e-3
    # two kinds of documents: the state tells which, so training must help on unseen ones
    kind = lambda: (lambda base: np.append(base + rng.integers(0, 40, 60), 1).astype(np.int32))(2 if rng.random() < 0.5 else 102)
    test = [kind() for _ in range(50)]
    before = gru.log_likelihoods(p, test).sum()
    for _ in range(3):
        gru.train(p, [kind() for _ in range(1500)])
    assert gru.log_likelihoods(p, test).sum() > before + 0.3 * 61 * 50


def test_gru_gradient_matches_differences(monkeypatch):
    """The first step's direction in every kind of weight against differences of the log-likelihood."""
    counts = np.zeros(gru.VOCAB)
    counts[:130] = 3
    p = gru.start(counts, seed=1)
    doc = [np.array([5, 70, 9, 100, 1], np.int32)]
    monkeypatch.setattr(gru, "CLIP", 1e9)
    moved = {k: v.copy() for k, v in p.items()}
    gru.train(moved, doc, rate=1e-3)
    rng = np.random.default_rng(0)
    for name in p:
        delta = (moved[name] - p[name]).ravel()
        # an Adagrad step is rate * g / sqrt(1e-3 + g * g); solved for g, the gradient of the mean loss
        x = np.clip(-delta / 1e-3, -0.999, 0.999)
        grad = x * np.sqrt(1e-3 / (1 - x * x))
        for i in rng.choice(np.flatnonzero(np.abs(grad) > 3e-3), 6):
            def at(step, name=name, i=i):
                q = {k: v.copy() for k, v in p.items()}
                q[name].ravel()[i] += step
                return -gru.log_likelihoods(q, doc)[0] / 5
            assert abs((at(0.02) - at(-0.02)) / 0.04 - grad[i]) < 0.05 * abs(grad[i]) + 1e-3, (name, i)


def test_gru_long_documents_take_little_memory():
    """One text of 120,000 words beside 600 short ones: memory follows the words, not the longest text times the lanes."""
    rng = np.random.default_rng(1)
    counts = np.ones(gru.VOCAB)
    docs = [rng.integers(2, 4000, n).astype(np.int16) for n in [120_000, *[50] * 600]]
    p = gru.start(counts)
    tracemalloc.start()
    gru.log_likelihoods(p, docs)
    gru.train(p, docs)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_lm_scores_do_not_depend_on_partitions(spark):
    table = spark.createDataFrame([(i, prose(i, 30 + i % 50)) for i in range(300)], "doc_id long, text string")
    got = [{r.doc_id: r.score for r in lm.score(table.repartition(n)).collect()} for n in (1, 3, 8)]
    for other in got[1:]:
        assert all(abs(other[i] - x) < 1e-3 * abs(x) for i, x in got[0].items())


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_fingerprints_and_components(spark, docs, rows):
    got = simhash.near_duplicates(docs).collect()
    fps = {(i, t): fingerprint(t) for i, t, *_ in rows}
    nodes = sorted(set(fps.values()))
    root = {f: f for f in nodes}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in nodes:
        for b in nodes:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for (i, _), f in fps.items():
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    same([(r.doc_id, r.fp % (1 << 64), r.component_id) for r in got], [(i, fps[i, t], least.get(find(fps[i, t]))) for i, t, *_ in rows])


@pytest.mark.parametrize(("groups", "width"), [(5, 2), (3, 2), (2, 4), (2, 8)])
def test_simhash_links_lose_nothing(spark, groups, width, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)  # cells of many blocks
    rng = random.Random(groups * 10 + width)
    fps = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1, 1 << 63]
    for _ in range(200):
        f = rng.choice(fps)
        for _ in range(rng.randint(1, 4)):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    fps = sorted(set(fps))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    table = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    from pigmentum.llm.components import components

    got = {r.node: r.root for r in components(simhash.links(table, 4, groups, width)).collect()}
    group = {signed(f): signed(f) for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 4 and group[signed(a)] != group[signed(b)]:
                    group[signed(a)] = group[signed(b)] = min(group[signed(a)], group[signed(b)])
                    changed = True
    assert {n: got.get(n, n) for n in group} == group


def test_keep_one(spark):
    a, b = prose(1, 200), prose(2, 200)
    rows = [(5, a, 1), (3, a, 2), (3, a, 2), (9, b, 1), (None, a, 7), (11, None, 1), (12, "", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    same([(r.doc_id, r.extra) for r in got.collect()], [(3, 2), (9, 1), (11, 1), (None, 7)])
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_packing_round_trip(docs, rows):
    capacity = 50
    got = packing.pack(docs, capacity).collect()
    bp = bpe.load()
    want = Counter()
    for i, t, *_ in rows:
        ids = [*bp.hf.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    lengths = Counter(r.length for r in got)
    assert len(bins) <= packing.lower_bound(lengths.items(), capacity) + 1
    assert packing.pack(docs.limit(0)).count() == 0


def best_count(items, capacity):
    """Fewest sequences, by trying everything."""
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def test_packing_reduction_keeps_an_optimum():
    rng = random.Random(4)
    for _ in range(150):
        items = sorted((rng.randint(1, 12) for _ in range(rng.randint(1, 9))), reverse=True)
        p = packing._Plan(dict(Counter(items)), 12)
        p.reduce()
        rest = sorted((x for x, n in p.left.items() for _ in range(n)), reverse=True)
        assert p.sequences + (best_count(rest, 12) if rest else 0) == best_count(items, 12), items


def test_digests(spark, docs):
    from pigmentum.llm import queries

    out = bpe.encode_decode(docs.where("doc_id = 0")).first()
    q = queries.op3_bpe_roundtrip(spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").first().text
    ids = bpe.load().hf.encode(text, add_special_tokens=False).ids
    assert q.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and q.n_tokens == len(ids) and out.decoded == TEXT[0]
    assert q.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_lm_words_of_batches_are_those_of_the_texts(monkeypatch):
    import pyarrow as pa

    texts = ["  A b\t\nc ", "", None, " \n", "Ä ÉX\x0bq\x0cr\x1cs", "x b", *(prose(i, 40) for i in range(9))]
    monkeypatch.setattr(lm, "SLICE_BYTES", 50)
    got = []
    for at, end, names, word, start in lm.words_of(pa.record_batch({"text": pa.array(texts)}), 0):
        assert len(start) == end - at + 1
        got += [[names[w] for w in word[s:e]] for s, e in zip(start, start[1:], strict=False)]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]


def test_gru_multiplies_small_classes_together():
    """Every row is in one block and at a place of its own class; classes of a few words share a product."""
    rng = np.random.default_rng(3)
    cls = np.sort(np.append(np.zeros(5000, int), rng.integers(0, 64, 1500)))
    hs, seen, room = rng.random((len(cls), 3)).astype(np.float32), [], gru._Room()
    blocks = list(gru._blocks(cls, 64))
    for k, m, most, s, e, places in blocks:
        x = gru._block(hs[s:e], m - k, most, places, room)
        assert x.shape[:2] == (m - k, most) and (k + places // most == cls[s:e]).all() and (x.reshape(-1, 3)[places] == hs[s:e]).all()
        assert np.isclose(x.sum(), hs[s:e].sum(), rtol=1e-4)  # all other rows are zero
        seen += range(s, e)
    assert seen == list(range(len(cls))) and len(blocks) < 20

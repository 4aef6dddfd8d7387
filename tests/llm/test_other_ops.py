"""URLs, vectors and the pipeline against brute force."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from pigmentum.llm import mtree, queries, urls

D = "/root/testdata/sf0.001"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_url_rules(spark):
    made = [None, "", "no scheme", "http://", "http://COM/en/", "http://a.com/en/1", "http://acom/en/1", "https://x.example.com/en/77?q", "https://example.com/en/8", "ftp://net/de/", "http://example.net/de/8#a", "http://example.net/de/9", "http://b.org/es/?x://y.com/en/", "http://b.org/es", "x://y://com/en/", "http://h\n.com/en/a"]
    rows = [(i, u) for i, u in enumerate(made * 2)] + [(None, "http://q.com/en/z")]
    table = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    got = urls.judge(table).collect()
    want = []
    for i, u in rows:
        h, p = parts(u)
        best = None
        for rule, verdict in urls.RULES:
            name, _, start = rule.partition("/")
            if (h == name or h.endswith("." + name)) and p.startswith("/" + start) and (best is None or len(rule) > len(best[0])):
                best = rule, verdict
        want.append((i, h, p, best and best[0], best and best[1]))
    key = lambda x: repr(x)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got), key=key) == sorted(want, key=key)
    assert all(r.verdict in ("allow", "block") for r in got)
    assert urls.judge(table.limit(0)).count() == 0


def test_url_model_tells_sides_apart(spark):
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choices(letters, k=8))
    rows = [(i, "http://" + (f"a.com/en/{word('xyzq')}" if i % 2 else f"b.net/de/{word('aeio')}")) for i in range(600)]
    rows += [(1000 + i, "http://other.info/" + word("xyzq" if i % 2 else "aeio")) for i in range(100)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string").repartition(4)).collect()}
    right = sum(got[1000 + i].verdict == ("block" if i % 2 else "allow") for i in range(100))
    assert right >= 95


def test_url_model_is_a_distribution():
    counts = np.zeros(urls.SYMBOLS ** (urls.ORDER + 1))
    keys, _ = urls._codes(["http://a.com/x", "http://b.org/yy?z=1"])
    np.add.at(counts, keys, 1)
    p = np.exp(urls._log_model(counts)).reshape(-1, urls.SYMBOLS)
    assert np.allclose(p.sum(axis=1), 1) and (p > 0).all()


def brute_top(vectors, k):
    """vectors: (id, list or None) rows."""
    ok = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % 100 == 0:
            s = sorted((-max(min(sum(a * b for a, b in zip(q, v, strict=False)), 2**63 - 1), -(2**63)), j) for j, v in ok if j != i)[:k]
            out += [(i, rank + 1, j, -score) for rank, (score, j) in enumerate(s)]
    return sorted(out)


def test_top_k_exact(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(16)]) for i in range(1500)]
    rows += [(5000 + i, [0.5] * 16) for i in range(300)] + [(7000, [0.5] * 16), (7001, None), (7002, [1.0, None]), (7003, [float("nan")] * 16), (7004, [float("inf")]), (7005, []), (None, [0.1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = mtree.top_k(mtree.whole_vectors(table), F.col("vec_id") % 100 == 0, 10, block=400, queries=5)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 10)
    assert mtree.top_k(mtree.whole_vectors(table.limit(0)), F.col("vec_id") % 100 == 0).count() == 0
    huge = [(i, [float(rng.randint(-(2**40), 2**40))] * 3) for i in range(0, 300, 50)]
    small = [(i, [v[0] / 2**30] * 3) for i, v in huge]
    for case in (small, huge):  # beyond doubles, products are whole numbers clipped to a long
        t = spark.createDataFrame(case, "vec_id long, embedding array<double>")
        assert sorted(tuple(r) for r in mtree.top_k(mtree.whole_vectors(t), F.col("vec_id") % 100 == 0, 10).collect()) == brute_top(case, 10)


def test_mtree_skips_work():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 400, (40, 8))
    x = np.floor(centres[rng.integers(0, 40, 6000)] + rng.normal(0, 5, (6000, 8)))
    tree, ids = mtree.MTree(x), np.arange(6000)
    for i in range(0, 6000, 600):
        want = sorted((-float(s), int(j)) for j, s in enumerate(x @ x[i]) if j != i)[:10]
        assert [(-s, j) for s, j in tree.search(x[i], 10, ids, i)] == want
    assert tree.computed < 0.5 * 10 * 6000


def test_repeated_ids_are_queries_of_their_own(spark, tmp_path):
    rng = random.Random(4)
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])] + [(i % 150, [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(600)] + [(100, [0.5, 0.5])] * 3
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = c.execute(queries.SQL["op8_top_k"]).fetchall()
    got = sorted(tuple(r) for r in queries.op8_top_k(spark, str(tmp_path)).collect())
    assert got == sorted(want) and len(got) == 10 * sum(i % 100 == 0 for i, _ in rows)


def test_cells_are_skipped_by_their_bounds():
    """On clustered vectors most cells are ruled out by a tenth product found at home, and never one that holds a higher product."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 4000, (20, 16)).round()
    cell = np.repeat(np.arange(20), 200)
    x = (centres[cell] + rng.normal(0, 50, (4000, 16))).round()
    radius = np.array([np.sqrt(((x[cell == c] - centres[c]) ** 2).sum(axis=1)).max() for c in range(20)])
    q, products = x[::100], x[::100] @ x.T
    least = np.array([np.sort(p[cell == cell[i * 100]])[-10] for i, p in enumerate(products)])
    open_ = mtree.reachable(q, least, centres, radius)
    assert open_.mean() < 0.5
    for i, p in enumerate(products):
        assert open_[i][np.unique(cell[p >= least[i]])].all()


def test_top_k_on_clusters(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 4, (8, 16))
    rows = list(enumerate((centres[np.repeat(np.arange(8), 250)] + rng.normal(0, 0.05, (2000, 16))).tolist()))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = mtree.top_k(mtree.whole_vectors(table), F.col("vec_id") % 100 == 0, 10, block=250)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 10)


def test_sql_of_top_k(spark):
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{D}/embeddings.parquet'")
    want = c.execute(queries.SQL["op8_top_k"]).fetchall()
    assert sorted(tuple(r) for r in queries.op8_top_k(spark, D).collect()) == sorted(want) and want


def test_pipeline_on_a_small_table(spark, tmp_path):
    import corpus_pipeline
    from pigmentum.llm import bpe, quality

    docs = spark.read.parquet(f"{D}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 4
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, D)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    rows = [r for r in docs.collect() if quality.accepts(quality.measure(r.text or ""))]
    # near-duplicates: Jaccard similarity of 0.8 or more over five-word shingles, directly or not
    shingles = {r.doc_id: (lambda w: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))))(r.text.lower().split()) for r in rows}
    group = {i: i for i in shingles}
    for i in sorted(shingles):
        for j in shingles:
            a, b = shingles[i], shingles[j]
            if j < i and 5 * len(a & b) >= 4 * len(a | b) and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    want = sorted(set(group.values()))
    assert sorted(r.doc_id for r in now.collect()) == want
    plan = corpus_pipeline.run(spark, D).collect()
    lengths = Counter()
    for r in plan:
        lengths[r.doc_id] += r.length
    texts = {r.doc_id: r.text for r in rows}
    assert lengths == {i: len(bpe.load().encode(texts[i])) + 1 for i in want}


def test_every_query_runs_on_the_smallest_tables(spark):
    for name, q in queries.QUERIES.items():
        df = q(spark, D)
        assert df.count() > 0, name
        assert df.columns == [c.lower() for c in df.columns]

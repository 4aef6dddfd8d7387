"""URL filter: rules first, then two character language models.

URLs that a rule decides are the accepted and rejected examples. For each side a variable-order
Markov model counts every character after contexts of no to three characters; orders are blended
by Witten-Bell smoothing, so a context gets the more weight the better it is known. The alphabet
is folded to 44 symbols, so the counts are bounded tables and both models together are one table
of log-likelihood ratios. A URL's score is its mean ratio per character; the threshold is
calibrated on a held-out fifth of the examples.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket, map_batches

#: (pattern, verdict); a pattern is a host, then a path prefix.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]

_SIGNS = "/.-_?=&%"
#: Symbols: edge, other, letters, figures, signs.
SYMBOLS = 2 + 26 + 10 + len(_SIGNS)
_FOLD = np.ones(256, np.int64)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789" + _SIGNS):
    _FOLD[ord(_c)] = _FOLD[ord(_c.upper())] = 2 + _i
ORDER = 3
BINS = 4000
_RANGE = 8.0


def host(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits (the first of equally long ones), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for text, verdict in sorted(reversed(rules), key=lambda r: len(r[0])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        out = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _codes(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(context and symbol as one number per character and final edge, end of each URL)."""
    raw = [x.encode("utf-8", "replace") for x in urls]
    size = np.array([len(x) + 1 + ORDER for x in raw], np.int64)
    flat = np.zeros(size.sum(), np.int64)
    ends = np.cumsum(size)
    inside = np.ones(len(flat), bool)
    starts = ends - size
    for i in range(ORDER):
        inside[starts + i] = False
    inside[ends - 1] = False
    flat[inside] = _FOLD[np.frombuffer(b"".join(raw), np.uint8)]
    key = flat.copy()
    for i in range(1, ORDER + 1):
        key[i:] += flat[:-i] * SYMBOLS**i
    real = inside.copy()
    real[ends - 1] = True
    return key[real], np.cumsum(size - ORDER)


def _log_model(counts: np.ndarray) -> np.ndarray:
    """log P(symbol | context) of the highest order, for every context, from its joint counts."""
    below = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for order in range(ORDER + 1):
        c = counts.reshape(-1, SYMBOLS ** (order + 1)).sum(axis=0).reshape(-1, SYMBOLS)
        total, kinds = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
        # Witten-Bell: the share of the shorter context is the share of new symbols seen
        share = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
        short = np.tile(below.reshape(-1, SYMBOLS), (len(c) // below.reshape(-1, SYMBOLS).shape[0], 1))
        below = (1 - share) * c / np.maximum(total, 1) + share * short
    return np.log(below).reshape(-1)


class UrlModel:
    """`ratio`: log P(accepted) - log P(rejected) for every context and symbol; scores below `cut` are rejected."""

    def __init__(self, accepted: np.ndarray, rejected: np.ndarray):
        self.ready = bool(accepted.any() and rejected.any())
        self.ratio = (_log_model(accepted) - _log_model(rejected)).astype(np.float32) if self.ready else np.zeros(1, np.float32)
        self.cut = 0.0

    def scores(self, urls: list[str]) -> np.ndarray:
        """Mean ratio per character, the end counted; 0 if there are no examples of both kinds."""
        if not self.ready or not urls:
            return np.zeros(len(urls))
        keys, ends = _codes(urls)
        sums = np.concatenate([[0.0], np.cumsum(self.ratio[keys], dtype=np.float64)])
        starts = np.concatenate([[0], ends[:-1]])
        return (sums[ends] - sums[starts]) / (ends - starts)


def fit(examples: DataFrame) -> UrlModel:
    """From rows (page_id, url, verdict allow or block): four fifths by page_id train, one calibrates.

    Each partition sends its counts once per context it has seen; the table of all contexts is
    bounded by the alphabet, not by the input. Without examples of both kinds, the model accepts all.
    """
    marked = examples.withColumn("held", bucket(F.col("page_id"), 5) == 0)

    def count(batches):
        totals = np.zeros((2, SYMBOLS ** (ORDER + 1)), np.int32)
        for b in batches:
            side = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for k in (0, 1):
                urls = [x or "" for x, s in zip(b.column(0).to_pylist(), side, strict=True) if s == bool(k)]
                if urls:
                    key, n = np.unique(_codes(urls)[0], return_counts=True)
                    totals[k][key] += n.astype(np.int32)
        for k in (0, 1):
            key = np.flatnonzero(totals[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k, np.int32)), pa.array(key), pa.array(totals[k][key].astype(np.int64))], ["side", "gram", "n"])

    train = marked.where(~F.col("held"))
    sums = map_batches(train, ["url", (F.col("verdict") == "allow").alias("allowed")], count, "side int, gram long, n long").groupBy("side", "gram").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, SYMBOLS ** (ORDER + 1)))
    got = sums.toArrow()  # at most two tables of SYMBOLS ** (ORDER + 1) counts
    counts[got["side"].to_numpy(), got["gram"].to_numpy()] = got["n"].to_numpy()
    model = UrlModel(counts[1], counts[0])
    if not model.ready:
        return model

    shared = examples.sparkSession.sparkContext.broadcast(model)

    def spread(batches):
        hist = np.zeros((2, BINS), np.int64)
        for b in batches:
            side = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.clip((shared.value.scores([x or "" for x in b.column(0).to_pylist()]) + _RANGE) * (BINS / (2 * _RANGE)), 0, BINS - 1).astype(np.int64)
            np.add.at(hist, (side, at), 1)
        k, at = np.nonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(hist[k, at])], ["side", "bin", "n"])

    hist = np.zeros((2, BINS))
    for r in map_batches(marked.where("held"), ["url", (F.col("verdict") == "allow").alias("allowed")], spread, "side int, bin int, n long").groupBy("side", "bin").agg(F.sum("n").alias("n")).collect():
        hist[r.side, r.bin] = r.n
    if hist.sum(axis=1).all():
        # rejected below the cut; the cut with the best sum of both sides' shares told right, middle of equals
        right = np.concatenate([[0], np.cumsum(hist[0])]) / hist[0].sum() + 1 - np.concatenate([[0], np.cumsum(hist[1])]) / hist[1].sum()
        best = np.flatnonzero(right == right.max())
        model.cut = float((best[0] + best[-1]) / 2 * (2 * _RANGE / BINS) - _RANGE)
    return model


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of (page_id, url).

    A null URL or one without :// has an empty host and path, so no rule; the models judge its
    text. Repeated rows repeat. One pass for the counts, one for the threshold, one for the
    verdicts; hosts are never grouped, so a hot one costs nothing.
    """
    rules = RULES if rules is None else rules
    bare = pages.select("page_id", "url")
    parts = bare.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}).withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    model = fit(parts.where("found is not null").select("page_id", "url", F.col("found.verdict").alias("verdict")))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            s = m.scores([x or "" for x in b.column(1).to_pylist()])
            told = [v or ("allow" if x >= m.cut else "block") for v, x in zip(b.column(5).to_pylist(), s, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:5], pa.array(told, pa.string()), pa.array(s)], ["page_id", "host", "path", "rule", "verdict", "score"])

    return map_batches(parts, ["page_id", "url", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("known")], run, "page_id long, host string, path string, rule string, verdict string, score double")

"""Quality rules on repetition: characters inside duplicated n-grams and lines.

Words become numbers, windows of several lengths become 64-bit rolling hashes in numpy (longer
ones composed of shorter ones), and equal hashes are found by one sort per length. Windows with
equal hashes are compared word by word, so a collision can't count as a repetition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, texts_of

_SPACES, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
_ODD = np.uint64(0x9E3779B97F4A7C15)
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

#: Largest share of a text's characters inside n-grams that occur twice, by n, and in repeated lines.
LIMITS = {5: 0.45, 8: 0.30, 10: 0.30}
LINE_LIMIT = 0.45


def _windows(ids: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """Rolling hashes: h(n) of a window is the sum of its words' values times powers of an odd base."""
    with np.errstate(over="ignore"):
        v = (ids.astype(np.uint64) + np.uint64(1)) * _ODD
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        v ^= v >> np.uint64(32)
        power, block, out = {1: _ODD}, {1: v}, {}
        n = 1
        while 2 * n <= max(lengths):
            block[2 * n] = block[n][:-n] * power[n] + block[n][n:]
            power[2 * n] = power[n] * power[n]
            n *= 2
        for want in lengths:
            h, have = None, 0
            for n in sorted(block, reverse=True):
                if want - have >= n:
                    h, have = (block[n], n) if h is None else (h[: len(v) - have - n + 1] * power[n] + block[n][have : len(v) - n + 1], have + n)
                    if have == want:
                        break
            out[want] = h
    return out


def _covered(h: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray | None:
    """Which words stand in a window of n words that occurs twice or more; None: none does."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.flatnonzero(s[1:] == s[:-1])
    if not len(same):
        return None
    a, b = order[same], order[same + 1]
    if any((ids[a + i] != ids[b + i]).any() for i in range(n)):  # a collision: count windows themselves
        _, inverse, count = np.unique(np.lib.stride_tricks.sliding_window_view(ids, n), axis=0, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(count[inverse.ravel()] > 1)
    else:
        twice = np.zeros(len(h), bool)
        twice[a] = twice[b] = True
        starts = np.flatnonzero(twice)
    if not len(starts):
        return None
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str, lengths: tuple[int, ...] = tuple(LIMITS)) -> dict:
    """Counts of one text; `share` has the share of its characters in repeated n-grams by n, and `line_share`."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    chars = len(text) - (len(raw) - len(raw.translate(None, _SPACES)))
    seen: dict[bytes, int] = {}
    out = {"n_words": len(words), "word_chars": chars, "n_symbols": len(raw) - len(raw.translate(None, _SYMBOLS)), "n_dup_lines": 0, "n_repeat_words": 0, "line_share": 0.0, "share": dict.fromkeys(lengths, 0.0)}
    lines = raw.split(b"\n")
    if len(lines) > 1:
        known, dup = set(), 0
        for line in lines:
            if line in known:
                out["n_dup_lines"] += 1
                dup += sum(len(w.decode("utf-8", "replace")) for w in line.split())
            elif line and not line.isspace():
                known.add(line)
        out["line_share"] = dup / max(1, chars)
    wanted = sorted({*lengths, 8})
    if len(words) <= wanted[0]:
        return out
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return out
    hashes = _windows(ids, [n for n in wanted if n <= len(words)] or [1])
    size = None
    for n in wanted:
        if n > len(words):
            break
        cover = _covered(hashes[n], ids, n)
        if cover is None:  # then no longer window occurs twice either
            break
        if n == 8:
            out["n_repeat_words"] = int(cover.sum())
        if n in lengths:
            if size is None:
                size = np.fromiter(map(len, words) if len(raw) == len(text) else (len(w.decode("utf-8", "replace")) for w in words), np.int64, len(words))
            out["share"][n] = float(size[cover].sum()) / max(1, chars)
    return out


def base_failed(m: dict) -> bool:
    return m["n_words"] < MIN_WORDS or 100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"]


def accepts(m: dict, limits: dict[int, float] = LIMITS, line_limit: float = LINE_LIMIT) -> bool:
    return not base_failed(m) and m["line_share"] <= line_limit and all(m["share"][n] <= most for n, most in limits.items())


def judge(docs: DataFrame, limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """A row per document: the counts, the shares, base_failed and kept. No shuffle.

    A null text has no words (so it fails); repeated rows are judged alike; an empty table gives
    no rows; other columns, whatever their names, aren't read.
    """
    limits = limits or LIMITS
    lengths = tuple(sorted(limits))

    def run(batches):
        for b in batches:
            m = [measure(x, lengths) for x in texts_of(b, 1)]
            longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
            cols = [pa.array([x[k] for x in m], pa.int64()) for k in longs]
            flags = [pa.array([base_failed(x) for x in m], pa.bool_()), pa.array([accepts(x, limits, line_limit) for x in m], pa.bool_())]
            shares = [pa.array([x["line_share"] for x in m], pa.float64()), *(pa.array([x["share"][n] for x in m], pa.float64()) for n in lengths)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, *flags, *shares], ["doc_id", *longs, "base_failed", "kept", "line_share", *(f"share_{n}" for n in lengths)])

    shares = "".join(f", share_{n} double" for n in lengths)
    return map_batches(docs, ["doc_id", "text"], run, f"doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_share double{shares}")


def filter_kept(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, whose text is kept."""
    i, schema = docs.columns.index("text"), docs.schema

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([accepts(measure(x)) for x in texts_of(b, i)], pa.bool_()))

    return map_batches(docs, None, run, schema)

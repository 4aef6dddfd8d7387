"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent character n-grams (one to three letters, a word edge
counting as a character) in falling order. A document is compared with each language's profile by
the out-of-place distance: the sum, over the document's n-grams, of how far each stands from its
place in the profile, and a full profile length where it isn't in it.

Counts for the profiles come from every training document: summed per partition first, then by a
shuffle, and ranked per language; only the top of each profile reaches the driver.
"""

from __future__ import annotations

import sys
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, map_batches

PROFILE = 400
#: Languages a profile table may have; beyond it the lang column isn't a language code.
MAX_LANGUAGES = 5000
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Code point -> itself plus one if it is a letter, else 0 (a word edge)."""
    out = np.zeros(sys.maxunicode + 1, np.uint64)
    for c in range(sys.maxunicode + 1):
        if chr(c).isalpha():
            out[c] = c + 1
    return out


def _codes(text: str) -> np.ndarray:
    """Letters of the lower-cased text with one word edge between words and at both ends; empty without letters."""
    c = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    c = np.concatenate([[np.uint64(0)], c, [np.uint64(0)]])
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
    return c if len(c) > 1 and c.any() else c[:0]


def _grams(c: np.ndarray) -> np.ndarray:
    """Keys of all n-grams but a lone word edge; 21 bits a character, the first of three in the high bits."""
    if not len(c):
        return c
    top = np.uint64(1 << 63)  # tells triples that begin with an edge from pairs; bit 42 does so for pairs
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = (two[:-1] << np.uint64(21)) | c[2:]
    pair = two[two != 0]
    pair = np.where(pair < np.uint64(1 << 21), pair | np.uint64(1 << 42), pair)
    return np.concatenate([c[c != 0], pair, three | top])


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
    return s[at], np.diff(np.append(at, len(s)))


def _top(keys: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent keys in order of (count falling, key)."""
    if len(keys) > k:
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.lexsort((keys, -counts))][:k]


def profiles(train: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """lang -> its n-grams' keys, most frequent first, from every row with a text and a lang."""

    def run(batches):
        parts: dict[str, list] = {}
        held = 0

        def flush(lang):
            keys = np.concatenate([x[0] for x in parts[lang]])
            order = np.argsort(keys, kind="stable")
            k = keys[order]
            at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            return k[at], np.add.reduceat(np.concatenate([x[1] for x in parts[lang]])[order], at)

        def rows():
            for lang in parts:
                keys, counts = flush(lang)
                for at in range(0, len(keys), 50_000):
                    k = keys[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.astype(np.int64)), pa.array(counts[at : at + 50_000].astype(np.int64))], ["lang", "gram", "n"])

        for b in batches:
            for lang, text in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True):
                got = _counted(_grams(_codes(text)))
                if len(got[0]):
                    parts.setdefault(lang, []).append(got)
                    held += len(got[0])
                if held > 3_000_000:
                    parts = {x: [flush(x)] for x in parts}
                    held = sum(len(x[0][0]) for x in parts.values())
                    if held > 1_500_000:  # as many different ones: they go on, to be summed by the shuffle
                        yield from rows()
                        parts, held = {}, 0
        yield from rows()

    rows = train.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = map_batches(rows, ["text", "lang"], run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the unsigned order of keys, as in _top
    order = Window.partitionBy("lang").orderBy(F.desc("n"), (F.col("gram") < 0), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    found: dict[str, list[int]] = {}
    for r in cut_lineage(top).orderBy("lang", "rank").limit(MAX_LANGUAGES * size + 1).collect():
        found.setdefault(r.lang, []).append(r.gram)
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} values of lang: not a language column")
    return found


class Classifier:
    def __init__(self, found: dict[str, list[int]], size: int = PROFILE):
        self.langs, self.size = sorted(found), size
        grams = [np.array(found[x], np.int64).astype(np.uint64) for x in self.langs]
        self.keys = np.unique(np.concatenate([*grams, np.empty(0, np.uint64)]))
        self.rank = np.full((len(self.langs), len(self.keys) + 1), -1, np.int32)
        for row, g in zip(self.rank, grams, strict=True):
            row[np.searchsorted(self.keys, g)] = np.arange(len(g))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and how much nearer than no match it is, 0 to 1; ties to the smaller name."""
        codes = _codes(text or "")
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        own = _top(*_counted(_grams(codes)), self.size)
        at = np.searchsorted(self.keys, own)
        at = np.where((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == own), at, len(self.keys))
        rank = self.rank[:, at]
        distance = np.where(rank < 0, self.size, np.minimum(np.abs(rank - np.arange(len(own))), self.size)).sum(axis=1)
        best = int(distance.argmin())
        return self.langs[best], 1.0 - float(distance[best]) / (self.size * len(own))


def fit(docs: DataFrame, size: int = PROFILE) -> Classifier:
    return Classifier(profiles(docs, size), size)


def predict(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, lang_pred, score for every row, from the text alone.

    A null text or one without letters, and any text when nothing was learnt, is `und` with score
    0. Repeated rows repeat; an empty table gives no rows; other columns aren't read.
    """

    def run(batches):
        for b in batches:
            out = [model.predict(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_batches(docs, ["doc_id", "text"], run, "doc_id long, lang_pred string, score double")


def filter_known(docs: DataFrame, model: Classifier, least: float = 0.0) -> DataFrame:
    """The rows of docs, all columns as they are, whose text is in a learnt language with a score of `least` or more."""
    i, schema = docs.columns.index("text"), docs.schema

    def run(batches):
        for b in batches:
            out = [model.predict(x) for x in b.column(i).to_pylist()]
            yield b.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in out], pa.bool_()))

    return map_batches(docs, None, run, schema)

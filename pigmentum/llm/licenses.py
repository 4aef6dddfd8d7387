"""License scan by template-markup matching.

A template is a license's wording with two kinds of markup: ``<<beginOptional>> ... <<endOptional>>``
around wording that may be missing, and ``<<var;name=...;words=0-12>>`` where any such number of
words may stand. Each template is compiled to an automaton over words; a text holds the license
where the automaton accepts, that is, where all mandatory wording stands exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, texts_of
from .license_texts import TEMPLATES

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Everything but the words' bytes becomes a space; A-Z become a-z.
_TABLE = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else c if c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of figures, letters and non-ASCII characters, A-Z lower-cased."""
    return text.encode("utf-8", "replace").translate(_TABLE).split()


class Automaton:
    """States are places in the template; an edge reads one given word, any word, or nothing."""

    def __init__(self, template: str):
        self.word: list[dict[bytes, int]] = [{}]
        self.any: list[list[int]] = [[]]
        self.free: list[list[int]] = [[]]
        self.mandatory: list[bytes] = []
        opened: list[int] = []
        at = 0
        for mark, text in re.findall(r"<<([^>]*)>>|([^<]+)", template):
            if mark == "beginOptional":
                opened.append(at)
            elif mark == "endOptional":
                self.free[opened.pop()].append(at)
            elif mark:
                low, high = map(int, re.search(r"words=(\d+)-(\d+)", mark).groups())
                skipped = []
                for i in range(high):
                    if i >= low:
                        skipped.append(at)
                    new = self._state()
                    self.any[at].append(new)
                    at = new
                for s in skipped:
                    self.free[s].append(at)
            for w in words_of(text):
                new = self._state()
                self.word[at][w] = new
                at = new
                if not opened:
                    self.mandatory.append(w)
        self.end = at
        self.after = [self._closure(s) for s in range(len(self.word))]
        #: words that a match can begin with; None: any word
        first = self.after[0]
        self.starts = None if any(self.any[s] for s in first) else {w for s in first for w in self.word[s]}

    def _state(self) -> int:
        for x in (self.word, self.any, self.free):
            x.append({} if x is self.word else [])
        return len(self.word) - 1

    def _closure(self, s: int) -> frozenset[int]:
        seen, todo = {s}, [s]
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def match(self, words: list[bytes], at: int) -> int | None:
        """The end of the longest match that starts at the word, or None."""
        now, best, i = self.after[0], None, at
        while now:
            if self.end in now:
                best = i
            if i == len(words):
                break
            w, nxt = words[i], set()
            for s in now:
                if (t := self.word[s].get(w)) is not None:
                    nxt |= self.after[t]
                for t in self.any[s]:
                    nxt |= self.after[t]
            now, i = nxt, i + 1
        return best


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.phrases = {tuple(words_of(p)): label for p, label in phrases.items()}
        self.templates = {label: Automaton(t) for label, t in templates.items()}

    def base(self, words: list[bytes], norm: bytes) -> Iterator[tuple[int, str]]:
        """(first word, label) of every place of every phrase; norm: the words between single spaces."""
        for phrase, label in self.phrases.items():
            what = b" " + b" ".join(phrase) + b" "
            at, before, n = norm.find(what), 0, 0
            while at >= 0:
                n += norm.count(b" ", before, at)
                yield n, label
                before, at = at, norm.find(what, at + 1)

    def found(self, words: list[bytes], norm: bytes) -> Iterator[tuple[int, int, str]]:
        """(first word, end, label) of every place where a template's automaton accepts."""
        places: dict[bytes, list[int]] | None = None
        for label, a in self.templates.items():
            if not all(b" " + w + b" " in norm for w in set(a.mandatory)):
                continue
            if places is None:
                places = {}
                for i, w in enumerate(words):
                    places.setdefault(w, []).append(i)
            starts = range(len(words)) if a.starts is None else sorted(i for w in a.starts for i in places.get(w, ()))
            past = 0
            for i in starts:
                if i >= past and (end := a.match(words, i)) is not None:
                    yield i, end, label
                    past = end

    def scan(self, text: str) -> dict:
        words = words_of(text)
        out = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "spans": []}
        norm = b" " + b" ".join(words) + b" "
        base = sorted(self.base(words, norm))
        spans = sorted(self.found(words, norm))
        if base:
            out |= {"n_base": len(base), "first_word": base[0][0], "last_word": base[-1][0]}
        labels = {x for _, x in base}
        out["base_labels"] = ",".join(sorted(labels))
        out["labels"] = ",".join(sorted(labels | {x for *_, x in spans}))
        # the longer the wording found, the surer: half for two words, near 1 for a whole license
        most = max([0, *(e - s for s, e, _ in spans), *(2 for _ in base)])
        out["score"] = most / (most + 2)
        out["spans"] = spans
        return out


@cache
def scanner() -> Scanner:
    return Scanner(TEMPLATES, PHRASES)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """A row per document: base phrase places, labels, score, and spans (first word, end, label).

    A null text counts as empty: no words, no labels, score 0. A text is searched whole, in time
    linear in its length. Repeated rows repeat, a null doc_id stays null; an empty table gives no
    rows; other columns aren't read.
    """

    def run(batches):
        s = scanner() if templates is None and phrases is None else Scanner(templates or TEMPLATES, phrases or PHRASES)
        span = pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("label", pa.string())])
        kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
        for b in batches:
            got = [s.scan(x) for x in texts_of(b, 1)]
            spans = pa.array([[dict(zip(("first_word", "end_word", "label"), x, strict=True)) for x in g["spans"]] for g in got], pa.list_(span))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[k] for g in got], kind) for k, kind in kinds.items()), spans], ["doc_id", *kinds, "spans"])

    return map_batches(docs, ["doc_id", "text"], run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first_word:long,end_word:long,label:string>>")

"""Token counts with a whole-token shortcut.

Offline, every vocabulary string is encoded alone; the ones that come back as a single token are
proven whole tokens. A pre-token that is such a string counts one without any merging. Only other
pre-tokens are merged, each once per worker while it stays in a bounded table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import CACHE_PIECES, ByteBpe, load
from .common import map_batches, texts_of


def whole_tokens(bpe: ByteBpe) -> set[str]:
    """Vocabulary strings that are one pre-token and that the library encodes alone as one token."""
    out = set()
    for i, raw in enumerate(bpe.bytes_of):
        try:
            s = raw.decode()
        except UnicodeDecodeError:
            continue
        if s and s not in bpe.special and (pieces := bpe.pre_tokens(s)) and len(pieces) == 1 and bpe._merge(s) == np.uint32(i).tobytes():
            out.add(s)
    return out


class TokenCounter(dict):
    """pre-token -> number of tokens; starts with the proven whole tokens."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self.whole = dict.fromkeys(whole_tokens(bpe), 1)
        self.update(self.whole)

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE_PIECES:
            self.clear()
            self.update(self.whole)
        # not a whole token: merged; a very long one by halves, as in `bpe`
        n = len(self.bpe._merge(piece)) // 4 if len(piece) <= self.bpe.leaf else len(self.bpe._plain(piece))
        if len(piece) < 64:
            self[piece] = n
        return n

    def _plain(self, text: str) -> int:
        return sum(map(self.__getitem__, self.bpe.pre_tokens(text)))

    def count(self, text: str) -> int:
        special = self.bpe._special
        if special is None or not special.search(text):
            return self._plain(text)
        return sum(map(self._plain, special.split(text))) + len(special.findall(text))


_LOADED: dict[str | None, TokenCounter] = {}


def counter(path: str | None = None) -> TokenCounter:
    if path not in _LOADED:
        _LOADED[path] = TokenCounter(load(path))
    return _LOADED[path]


def count_tokens(docs: DataFrame, limit: int = 1024, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row, without a shuffle.

    A null text counts as empty: no bytes, no tokens. Repeated rows repeat, a null doc_id stays
    null; an empty table gives no rows; other columns aren't read.
    """

    def run(batches):
        c = counter(path)
        for b in batches:
            texts = texts_of(b, 1)
            n = np.array([c.count(x) for x in texts], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(docs, ["doc_id", "text"], run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

"""Byte-level BPE encoding and decoding by tree concatenation.

A long text is halved down to leaves, the leaves are encoded independently (in threads when the
text is very long), and at every join a window of tokens around the seam is encoded again and
grown until it agrees with both sides. A join is exact for one of two reasons:

* the window ends where a non-space byte is followed by a space: the pre-tokenizer always cuts
  there, whatever stands further left or right; or
* the window ends inside one run of letters, digits or signs, and its outermost token equals the
  side's token at that place: a byte-pair encoding is the canonical one exactly if every two
  neighbouring tokens are what their concatenation encodes to, and each such pair then occurs in
  an encoding that is already known to be right.

Where neither holds the window grows, at last over both halves.

Leaves are cut into pre-tokens; each is merged once and looked up afterwards. The class of a
character beyond common Latin text (letter, number, space, sign) could differ between Unicode
versions, so it is asked of the tokenizers library's own pre-tokenizer, once per character and
worker; such characters then go the same way as all others.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, texts_of

LEAF_BYTES = 8192
#: From this length on, the leaves of a text are encoded in threads.
PARALLEL_BYTES = 1 << 20
#: Pieces kept per worker; the table is emptied when it is full.
CACHE_PIECES = 500_000

#: Outside this set Unicode tables might differ; the library is asked.
_UNSTABLE = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ‐-‧‰-⁞€]")
#: The letters and numbers of that set, and the pre-tokenizer's rule for texts inside it.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")

#: A character of that set for each class, which stands for others of the class when texts are cut.
_LETTER, _NUMBER, _SIGN, _SPACE = "é", "²", "§", "\t"
#: 0: never a cut inside a run; else letters, digits, signs. The apostrophe starts contractions.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = 3


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_NONE: set[str] = set()


class _Pieces(dict):
    """piece -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        ids = self.encode(piece)
        if len(piece) < 64:
            self[piece] = ids
        return ids


class _Classes(dict):
    """code point -> a character of the same class in the library's pre-tokenizer, itself where tables agree."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if not _UNSTABLE.match(c):
            out = c
        else:
            one = lambda x: len(self.bpe.hf.pre_tokenizer.pre_tokenize_str(x + c)) == 1
            out = _LETTER if one("a") else _NUMBER if one("1") else _SIGN if one("!") else _SPACE
        self[code] = out
        return out

    def run_class(self, code: int) -> int:
        """The class of a run that may be cut at the character, as in _CLASS."""
        if code < 128:
            return int(_CLASS[code])
        c = self[code]
        return 0 if c.isspace() else 1 if re.match(f"[{_L}]", c) else 2 if re.match(f"[{_N}]", c) else 3


class _Text:
    """A text's bytes, and where its trees may cut it."""

    def __init__(self, bpe: ByteBpe, text: str):
        self.data = text.encode()
        self.of = None
        if len(self.data) > bpe.leaf and not text.isascii():
            codes, at = np.unique(np.frombuffer(text.encode("utf-32-le"), "<u4"), return_inverse=True)
            n = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
            kind = np.array([bpe.classes.run_class(int(c)) for c in codes], np.uint8)
            space = np.array([bpe.classes[int(c)].isspace() or c < 33 or c == 127 for c in codes])
            #: of every byte: its character's class, whether that is a space, whether a character starts there
            self.of, self.space = (np.repeat(x[at], n[at]) for x in (kind, space))
            self.starts = (np.frombuffer(self.data, np.uint8) & 0xC0) != 0x80

    def safe(self, p: int) -> bool:
        """A space after something else: there is always a cut."""
        if self.of is None:
            return self.data[p] == 32 and 32 < self.data[p - 1] < 127
        return self.data[p] == 32 and not self.space[p - 1]

    def in_run(self, p: int) -> bool:
        if self.of is None:
            return bool(_CLASS[self.data[p]] != 0 and _CLASS[self.data[p]] == _CLASS[self.data[p - 1]])
        return bool(self.starts[p] and self.of[p] != 0 and self.of[p] == self.of[p - 1])


class ByteBpe:
    """One tokenizer file, loaded once per Python worker by `load`."""

    def __init__(self, path: str, leaf_bytes: int = LEAF_BYTES):
        import tiktoken
        from public_tokenizers import PATTERN

        self.path, self.leaf, self.pattern = path, max(4, leaf_bytes), PATTERN
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of, vocab = _byte_chars(), spec["model"]["vocab"]
        raw = lambda token: bytes(of[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            if token not in self.special:
                self.bytes_of[i] = raw(token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        ranks: dict[bytes, int] = {}
        for token in [*(c for c in of if c in vocab), *merged]:
            ranks.setdefault(raw(token), len(ranks))
        self.id_of_rank = np.array([vocab["".join(c)] for c in dict.fromkeys([*(c for c in of if c in vocab), *merged])], "<u4")
        self.same_ids = bool((self.id_of_rank == np.arange(len(self.id_of_rank))).all())
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.array([len(b) for b in self.bytes_of], np.int64)
        self.pieces = _Pieces(self._merge)
        self.classes = _Classes(self)
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    @cached_property
    def hf(self):
        """The library's own tokenizer; loaded when a character's class is first asked."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _merge(self, piece: str) -> bytes:
        if _UNSTABLE.search(piece):  # its own pattern isn't to cut it
            ids = np.array(self.core._core_bpe.encode_single_piece(piece.encode()), "<u4").tobytes()
        else:
            ids = bytes(self.core._core_bpe.encode_to_tiktoken_buffer(piece, _NONE))
        return ids if self.same_ids else self.id_of_rank[np.frombuffer(ids, "<u4")].tobytes()

    def pre_tokens(self, text: str) -> list[str]:
        if not _UNSTABLE.search(text):
            return _PIECE.findall(text)
        return [text[m.start() : m.end()] for m in _PIECE.finditer(text.translate(self.classes))]

    def _flat(self, data: bytes) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.pre_tokens(data.decode()))), "<u4")

    def _tree(self, text: _Text, lo: int, hi: int, leaves: dict | None = None) -> np.ndarray:
        mid = self._middle(text.data, lo, hi)
        if mid is None:
            return leaves[lo] if leaves else self._flat(text.data[lo:hi])
        return self._join(text, self._tree(text, lo, mid, leaves), self._tree(text, mid, hi, leaves), lo, mid, hi)

    def _middle(self, data: bytes, lo: int, hi: int) -> int | None:
        """Where [lo, hi) is halved, on a character's first byte; None: it is a leaf."""
        if hi - lo <= self.leaf:
            return None
        mid = (lo + hi) // 2
        while mid > lo and data[mid] & 0xC0 == 0x80:
            mid -= 1
        return mid if mid > lo else None

    def _leaves(self, data: bytes, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        mid = self._middle(data, lo, hi)
        if mid is None:
            yield lo, hi
        else:
            yield from self._leaves(data, lo, mid)
            yield from self._leaves(data, mid, hi)

    def _join(self, text: _Text, left: np.ndarray, right: np.ndarray, lo: int, mid: int, hi: int) -> np.ndarray:
        w, data, safe, usable = 4, text.data, text.safe, lambda p: text.safe(p) or text.in_run(p)
        while True:
            before = mid - np.cumsum(self.length[left[::-1][:w]])  # token starts, going left
            after = mid + np.cumsum(self.length[right[:w]])  # token ends, going right
            # the outermost usable cut on each side; index + 1 tokens are replaced there
            i = next((k for k in range(len(before) - 1, -1, -1) if before[k] == lo or usable(before[k])), None)
            j = next((k for k in range(len(after) - 1, -1, -1) if after[k] == hi or usable(after[k])), None)
            if i is not None and j is not None:
                p, q = int(before[i]), int(after[j])
                middle = self._flat(data[p:q])
                if (p == lo or safe(p) or middle[0] == left[len(left) - i - 1]) and (q == hi or safe(q) or middle[-1] == right[j]):
                    return np.concatenate([left[: len(left) - i - 1], middle, right[j + 1 :]])
            if w >= len(left) and w >= len(right):  # nothing to agree with: the whole stretch again
                return self._flat(data[lo:hi])
            w *= 2

    def _plain(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        whole = _Text(self, text)
        data = whole.data
        if len(data) < PARALLEL_BYTES:
            return self._tree(whole, 0, len(data))
        spans = list(self._leaves(data, 0, len(data)))
        with ThreadPoolExecutor(2) as pool:
            leaves = dict(zip((lo for lo, _ in spans), pool.map(lambda s: self._flat(data[s[0] : s[1]]), spans), strict=True))
        return self._tree(whole, 0, len(data), leaves)

    def encode(self, text: str) -> np.ndarray:
        """The library's ids without added tokens; special strings become their ids, its default."""
        if self._special is None or not self._special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4")]
            at = m.end()
        return np.concatenate([*out, self._plain(text[at:])])

    def decode(self, ids) -> str:
        """As the library's decode with special tokens kept; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")


_LOADED: dict[tuple, ByteBpe] = {}


def load(path: str | None = None, leaf_bytes: int = LEAF_BYTES) -> ByteBpe:
    key = (path or default_path(), leaf_bytes)
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(*key)
    return _LOADED[key]


#: Texts encoded at once, so that a batch's token arrays stay small.
GROUP = 128


def encoded(batches: Iterator[pa.RecordBatch], path: str | None = None, leaf_bytes: int = LEAF_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, ids, decoded) of batches (doc_id, text): the operator's work inside a worker.

    Callers that only need something derived from ids and texts put it behind this in the same pass.
    """
    bpe = load(path, leaf_bytes)
    for b in batches:
        for at in range(0, b.num_rows, GROUP):
            some = b.slice(at, GROUP)
            ids = [bpe.encode(x) for x in texts_of(some, 1)]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = pa.array(np.concatenate(ids).astype(np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array([bpe.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])


def encode_decode(docs: DataFrame, path: str | None = None, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """doc_id, ids array<int>, decoded string: every text's tokens and what they decode to.

    A null text counts as empty and gives no ids and an empty decoded text. Rows repeat as they
    are, a null doc_id stays null; an empty table gives no rows; other columns aren't read. Works
    row by row, without a shuffle.
    """
    return map_batches(docs, ["doc_id", "text"], lambda batches: encoded(batches, path, leaf_bytes), "doc_id long, ids array<int>, decoded string")

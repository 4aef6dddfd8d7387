"""Token ids of a lower-casing BPE tokenizer whose words end in a mark, as the tokenizers library gives them.

White space ends a word and is dropped, and no rule looks beyond it, so words are encoded one by one
and kept in a bounded table per worker. ASCII and the Latin letters and signs for which the library's own
normaliser and splitter say what they are get split and merged here; words with other characters
(their normal form, case and classes follow the library's tables) are encoded by the library.
"""

from __future__ import annotations

import json
import re
from functools import cached_property

import numpy as np

#: Words whose ids a worker keeps.
CACHE_WORDS = 600_000

#: Characters beyond ASCII whose class the library is asked for: Latin letters, general punctuation.
LATIN = [*range(0xA1, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]
_WORD = re.compile(r"[^ \t-\r]+")
#: Stands for the end of a word; no UTF-8 text holds the byte.
_END = b"\xff"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Table(dict):
    """word -> its ids as little-endian bytes; emptied when full."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) < 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


class WordBpe:
    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        end = spec["model"]["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            word = token.endswith(end) and len(token) > len(end)
            return bytes(of[c] for c in (token[: -len(end)] if word else token)) + (_END if word else b"")

        vocab = spec["model"]["vocab"]
        # a word's last byte joins its end first, then the merges in their order
        ranks: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        for b in range(255):
            ranks[bytes([b]) + _END] = len(ranks)
        ids = {raw(token): i for token, i in vocab.items()}
        for m in spec["model"]["merges"]:
            ranks.setdefault(raw("".join(m if isinstance(m, list) else m.split(" "))), len(ranks))
        self.kind = "<u2" if max(vocab.values()) < 1 << 16 else "<u4"
        self.id_of = np.array([ids.get(b, 0) for b in ranks], self.kind)
        self.core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        letters = "".join(c for c in map(chr, LATIN) if self._is(c, "a"))
        signs = "".join(c for c in map(chr, LATIN) if self._is(c, "!"))
        self._latin = re.compile(f"[\x00-\x7f{re.escape(letters + signs)}]*")
        low = re.escape("".join(sorted({c.lower() for c in letters})))
        # fixed values of this tokenizer: letters, contractions, single figures, and runs of signs
        self.split = re.compile(rf"[a-z{low}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^a-z0-9 \t-\r{low}]+").findall
        self.pieces, self.words = _Table(self._merge), _Table(self._whole)

    @cached_property
    def hf(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _is(self, c: str, like: str) -> bool:
        """Whether the library lower-cases the character as Python does, to one that stays as it is and is of the other one's class."""
        low = c.lower()
        same = len(low) == 1 and self.hf.normalizer.normalize_str(c) == low == self.hf.normalizer.normalize_str(low)
        return same and len(self.hf.pre_tokenizer.pre_tokenize_str(like + low)) == 1

    def _merge(self, piece: str) -> bytes:
        return self.id_of[self.core.encode_single_piece(piece.encode() + _END)].tobytes()

    def _whole(self, word: str) -> bytes:
        return np.array(self.hf.encode(word, add_special_tokens=False).ids, self.kind).tobytes()

    def _plain(self, text: str) -> list[bytes]:
        if text.isascii() or self._latin.fullmatch(text):
            return list(map(self.pieces.__getitem__, self.split(text.lower())))
        out = []
        for w in _WORD.findall(text):
            if self._latin.fullmatch(w):
                out += map(self.pieces.__getitem__, self.split(w.lower()))
            else:
                out.append(self.words[w])
        return out

    def encode(self, text: str) -> np.ndarray:
        """The library's ids without added tokens; special strings become their ids, its default."""
        if self._special is None or not self._special.search(text):
            return np.frombuffer(b"".join(self._plain(text)), self.kind)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [*self._plain(text[at : m.start()]), np.array([self.special[m[0]]], self.kind).tobytes()]
            at = m.end()
        return np.frombuffer(b"".join([*out, *self._plain(text[at:])]), self.kind)


_LOADED: dict[str, WordBpe] = {}


def load(path: str | None = None) -> WordBpe:
    path = path or default_path()
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]

"""Public tokenizers, applied through a cache of words.

For the two layouts of public tokenizers that occur here, a text's ids are the
ids of its space-separated words put together, each word encoded once:

* byte-level BPE without normaliser: a word carries the blank before it. This
  holds where white space is single blanks and line feeds between words; any
  other text goes through the tokenizer as a whole.
* lower-casing BPE that drops white space: holds for every text.

A new word is split by the tokenizer's own pattern and merged by its BPE model,
or, if it has characters outside plain Latin ones or a special token, encoded by
the whole tokenizer. Tokenizers of any other layout encode whole texts.
"""

from __future__ import annotations

import json
import zlib
from array import array

import numpy as np
import regex
from tokenizers import Tokenizer

from weftspark.llm.common import cache, single_thread, sole

BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
_PLAIN = regex.compile(r"[\x21-\x7EÀ-ɏ]+")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level BPE: itself where printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()


class _Generations(dict):
    """A cache that forgets what was not used lately: at the limit, the older half goes.

    The limit is of entries and of characters (80 for each entry); keys of more than
    `longest` characters are worked out each time, so unspaced scripts cannot fill the memory.
    """

    def __init__(self, make, limit: int, longest: int = 1000):
        super().__init__()
        self.make, self.limit, self.longest, self.size, self.older = make, limit, longest, 0, {}

    def __missing__(self, key: str):
        value = self.older.get(key, self)
        if value is self:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        self[key] = value
        self.size += len(key)
        return value

    def age(self) -> None:
        if len(self) > self.limit or self.size > 80 * self.limit:
            self.older = dict(self)
            self.clear()
            self.size = 0


class WordEncoder:
    """ids of texts as little-endian bytes, 2 or 4 of them for each id."""

    def __init__(self, path: str, limit: int = 500_000):
        single_thread()
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.special = [t["content"] for t in spec["added_tokens"]]
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = model["type"] == "BPE" and not model["dropout"] and not model["byte_fallback"] and spec["post_processor"] is None
        self.kind = "whole"
        if plain and spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            self.kind, self.pattern = "byte", regex.compile(BYTE_PATTERN)
        elif plain and pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("pattern", {}).get("Regex") == WORD_PATTERN and [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.kind, self.pattern = "word", regex.compile(WORD_PATTERN)
        self.pieces = _Generations(self._piece, 7 * limit // 10)
        self.inner = _Generations(lambda w: self._word(" " + w) if self.kind == "byte" else self._word(w), limit)
        self.first = _Generations(self._word, limit // 2)
        self.feed = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isascii():  # only the blank is not printable here
            letters = piece.replace(" ", _LETTERS[32])
        else:
            letters = piece.encode().decode("latin-1").translate(_LETTERS)
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()

    def _word(self, word: str) -> bytes | None:
        """None for what must not be taken by itself: nothing, or white space within."""
        bare = word[1:] if word[:1] == " " else word
        if not bare:
            return b"" if self.kind == "word" else None
        if _PLAIN.fullmatch(bare) and not any(s in bare for s in self.special):
            if self.kind == "word":
                word = bare.lower()
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(word)))
        if self.kind == "byte" and bare.split() != [bare]:
            return None
        return self._whole(word)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.kind == "word":
            out = b"".join(map(self.inner.__getitem__, text.replace("\n", " ").split(" ")))
        elif self.kind == "byte":
            parts: list[bytes | None] = []
            for line in text.split("\n"):
                words = line.split(" ")
                parts.append(self.feed)
                parts.append(self.first[words[0]])
                del words[0]
                parts.extend(map(self.inner.__getitem__, words))
            parts[0] = b""
            try:
                out = b"".join(parts)
            except TypeError:  # a None among them
                out = self._whole(text)
        else:
            out = self._whole(text)
        for cache in (self.pieces, self.inner, self.first):
            cache.age()
        return out

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode(text), self.dtype)


_ENCODERS: dict[str, WordEncoder] = cache()


def encoder(path: str, words: int = 500_000) -> WordEncoder:
    """One encoder per Python worker and file, so that the cache (of so many words) outlives a task."""
    sole(_ENCODERS)
    key = f"{path} {words}"
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(path, words)
    return _ENCODERS[key]


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())

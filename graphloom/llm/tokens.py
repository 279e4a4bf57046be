"""Exact tokenizer ids through a cache of words, looked up once a batch of texts.

The tokenizers library spends most of its time on words it has met before. For
the two layouts below, a text can be cut where the library itself always cuts,
so the ids of a text are those of its words, one after another:

* ``byte``: byte-level BPE with the usual pattern. No piece has white space
  after another character, so a cut before a space that follows a character
  that is not white space is safe.
* ``word``: lower-casing BPE that drops white space; a cut at a space or line
  feed is safe.

Anything else (other layouts, added tokens inside the text, characters beyond
Latin, white space on which libraries differ) goes to the library as it is.
The cache is bounded: at ``max_words`` its words become the old generation, of
which those that come again are taken over, and the rest goes at the next bound.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

_PATTERN = {
    "byte": regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"),
    "word": regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"),
}
#: Characters of which all versions of Unicode say the same.
_PLAIN = re.compile(r"[\t\n\r -~¡-įı-ɏ]*").fullmatch
_RUNS = re.compile(r"\s*\S+|\s+").findall
_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁯　﻿]").search


def _byte_letters() -> dict[int, str]:
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in keep}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return out


_LETTERS = _byte_letters()


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class _Unsafe(Exception):
    pass


class _Cache(dict):
    """Keys to ids in two generations of at most ``most`` entries."""

    __slots__ = ("make", "most", "old")

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.most:
            self.old = self.copy()
            self.clear()
        self[key] = got
        return got


class Encoder:
    """Ids of whole texts, as packed little-endian integers of ``dtype``."""

    def __init__(self, path: str, max_words: int = 250_000):
        from tokenizers import Tokenizer

        self.path, self.max_words = path, max_words
        with open(path, "rb") as f:
            spec = json.loads(f.read())
        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.model = self.tok.model
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 65536 else "<u4")
        self.packed = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.size)]
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.layout = self._layout(spec)
        self.words = _Cache(self.word, max_words)
        self.runs = _Cache(self.library, max_words // 10)
        self.parts = _Cache(self.tokenize, max_words)
        self.marks = _Cache(self.tokenize, max_words // 4)

    def _layout(self, spec: dict) -> str:
        model, pre, norm = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback") or model.get("unk_token") or model.get("continuing_subword_prefix"):
            return "other"
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized")):
            return "other"
        if norm is None and pre == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            return "byte"
        steps = [n.get("type") for n in (norm or {}).get("normalizers", [])]
        cut = (pre.get("pretokenizers") or [{}])[0]
        if steps == ["NFC", "Replace", "Lowercase"] and cut.get("invert") and cut.get("behavior") == "Removed" and cut.get("pattern") == {"Regex": _PATTERN["word"].pattern}:
            return "word"
        return "other"

    def library(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def tokenize(self, piece: str) -> bytes:
        """Ids of what the library doesn't cut any further."""
        if not piece:
            return b""
        mapped = piece.replace(" ", "Ġ") if piece.isascii() and piece.isprintable() else "".join([_LETTERS[b] for b in piece.encode()])
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(mapped)])

    def word(self, word: str) -> bytes:
        """Ids of a word as it stands after a space; the letters in it are words of their own in the cache."""
        if self.layout == "word":
            if not word:
                return b""
            if not _PLAIN(word):
                return self.library(word)
            if word.isalpha():
                low = word.lower()
                return self.tokenize(word) if low == word else self.words[low]
            return b"".join([self.words[p] if p.isalpha() else self.marks[p] for p in _PATTERN["word"].findall(word.lower())])
        if word == "\0":
            return self.marks["\n"]
        if not word or word[-1].isspace() or _ODD(word[-1]):
            raise _Unsafe
        if word[0] == "\0":  # a line feed, not after a space
            word = "\n" + word[1:]
            if word[1].isspace() or _ODD(word[1]):
                raise _Unsafe
            if not _PLAIN(word):
                return self.library(word)
            return self.marks["\n"] + b"".join([self.marks[p] for p in _PATTERN["byte"].findall(word[1:])])
        if not _PLAIN(word):
            return self.library(" " + word)
        if word.isalpha():
            return self.tokenize(" " + word)
        if word[-1] in ".," and word[:-1].isalpha():
            return self.words[word[:-1]] + self.marks[word[-1]]
        return b"".join([self.words[p[1:]] if p[0] == " " and p[1:].isalpha() else self.marks[p] for p in _PATTERN["byte"].findall(" " + word)])

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a text; null counts as empty."""
        if not text:
            return b""
        if self.layout == "other" or "\0" in text or any(a in text for a in self.added):
            return self.library(text)
        if self.layout == "word":
            return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))
        # A single line feed between other characters is a piece of its own: what stands before it is a word.
        lines = text[0] != "\n" and "\n\n" not in text and " \n" not in text
        first, *rest = (text.replace("\n", " \0") if lines else text).split(" ")
        try:
            if first and (first[-1].isspace() or _ODD(first[-1])):
                raise _Unsafe
            return (self.library(first) if first else b"") + b"".join(map(self.words.__getitem__, rest)) if rest else self.library(text)
        except _Unsafe:
            if _ODD(text):
                return self.library(text)
            return b"".join(map(self.runs.__getitem__, _RUNS(text)))

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode(text), self.dtype)

    def many(self, texts: Iterable[str | None], chars: int = 2_000_000) -> Iterator[np.ndarray]:
        """Ids of each text, in order; texts are taken together up to so many characters, and each of their pieces is looked up once."""
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t or "")
            if size >= chars:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def _pieces(self, texts: list[str | None]) -> pa.Array:
        """What the library's pattern cuts each text into, for texts that ``_cuts`` allows; some pieces may be empty, none has a NUL.

        The whole match is put back, as a group would take several times as long."""
        text = pa.array(texts, pa.large_string())
        if self.layout == "word":
            return pc.ascii_split_whitespace(pc.replace_substring_regex(text, r"'s|'t|'re|'ve|'m|'ll|'d|[^\s\p{L}\p{N}]+|\p{N}", r" \0 "))
        marked = pc.replace_substring_regex(text, r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]+| ?\p{N}+|\n", "\0\\0\0")
        return pc.split_pattern(pc.replace_substring(marked, " ", "\0 "), "\0")

    def _cuts(self, text: str) -> bool:
        """Whether a text has only characters of which all patterns say the same, and no white space next to another."""
        if self.layout == "other" or not _PLAIN(text) or any(a in text for a in self.added):
            return False
        return self.layout == "word" or not ("\t" in text or "\r" in text or "  " in text or "\n\n" in text or " \n" in text)

    def _together(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        alone, tails = {}, []
        for i, t in enumerate(texts):
            if t and self._cuts(t):
                tails.append(t.lower() if self.layout == "word" else t)
            else:
                alone[i] = self.ids(t)
                tails.append(None)
        if len(alone) == len(texts):
            yield from alone.values()
            return
        cut = self._pieces(tails)
        flat = cut.flatten().dictionary_encode()
        words = flat.dictionary.cast(pa.string())
        words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\0")[0].as_py().split("\0")  # to_pylist takes ten times as long
        found = [self.parts[w] for w in words]
        table = np.frombuffer(b"".join(found), self.dtype)
        n = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        at = np.cumsum(n) - n
        which = flat.indices.to_numpy()
        size = n[which]
        upto = np.concatenate([[0], np.cumsum(size)])
        out = table[np.repeat(at[which] - upto[:-1], size) + np.arange(upto[-1])]
        stops = upto[np.cumsum(pc.fill_null(pc.list_value_length(cut), 0).to_numpy(zero_copy_only=False))].tolist()
        start = 0
        for i, stop in enumerate(stops):
            yield alone[i] if i in alone else out[start:stop]
            start = stop


@lru_cache(maxsize=4)
def encoder(path: str, max_words: int = 250_000) -> Encoder:
    """One encoder a worker process and tokenizer file; tasks that follow share its cache."""
    return Encoder(path, max_words)

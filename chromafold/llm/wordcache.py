"""Tokenise documents by tokenising each distinct word of a worker's input once."""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import regex


class WordIds(dict):
    """Word bytes -> index into a flat table of token ids.

    A tokenizer that never joins bytes across ASCII white space gives a document the concatenation of
    its words' ids, so each distinct word is encoded once per worker. The table is only a cache: it is
    dropped when it outgrows ``max_words`` or ``max_bytes`` and refills.
    """

    def __init__(self, encode_words, max_words: int = 700_000, max_bytes: int = 64 << 20):
        super().__init__()
        self.encode_words, self.max_words, self.max_bytes = encode_words, max_words, max_bytes
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.pending: list[bytes] = []
        self.held = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 15, np.int32)  # ends[i + 1]: end of entry i in flat; wider when that is needed
        self.filled = 0

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        self.pending.append(word)
        return i

    def _grow(self) -> None:
        coded = self.encode_words(self.pending)
        lens = np.fromiter(map(len, coded), np.int64, len(coded))
        total = int(lens.sum())
        at = int(self.ends[self.filled])
        while len(self.flat) < at + total:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.ends) < self.filled + len(coded) + 1:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        if at + total >= 1 << 31:
            self.ends = self.ends.astype(np.int64)
        self.flat[at : at + total] = np.fromiter(chain.from_iterable(coded), np.uint32, total)
        self.ends[self.filled + 1 : self.filled + 1 + len(coded)] = at + np.cumsum(lens)
        self.filled += len(coded)
        self.held += sum(map(len, self.pending))
        self.pending = []

    def ids(self, text: bytes) -> np.ndarray:
        """Token ids of a document."""
        if len(self) > self.max_words or self.held > self.max_bytes:
            self.reset()
        words = text.split()
        if not words:
            return np.zeros(0, np.uint32)
        at = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        if self.pending:
            self._grow()
        begin, end = self.ends[at], self.ends[at + 1]
        lens = end - begin
        stop = np.cumsum(lens, dtype=lens.dtype)
        return self.flat[np.repeat(begin - stop + lens, lens) + np.arange(int(stop[-1]), dtype=lens.dtype)]


def byte_letters() -> dict[int, str]:
    """Byte -> the printable character that stands for it in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others take the characters from U+0100 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


#: Words of these characters are the same in normal form C and need no context to be lower-cased.
SIMPLE = re.compile("[\x21-\x7e\xc0-\u012f\u0131-\u024f]+")
#: Fixed value: the pre-tokeniser's pattern in word_bpe_49k.json.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_loaded: dict[str, WordIds] = {}


class WordEncoder:
    """Ids of single words by a ``tokenizers`` file of the lower-casing, byte-level kind.

    Plain words are split here and their parts go to the merge model alone, each distinct part once;
    words with anything unusual (marks, controls, special tokens) go through the whole tokenizer.
    """

    def __init__(self, path: str, max_parts: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        split = spec["pre_tokenizer"].get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.plain = split == WORD_PATTERN and kinds == ["NFC", "Replace", "Lowercase"]
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(special) if special else "(?!)").search
        self.letters = byte_letters()
        self.parts: dict[str, list[int]] = {}
        self.max_parts = max_parts
        self.find = regex.compile(WORD_PATTERN).findall

    def part(self, part: str) -> list[int]:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= self.max_parts:
                self.parts.clear()
            coded = part if part.isascii() else part.encode("utf-8").decode("latin-1").translate(self.letters)  # the parts hold no spaces or controls
            ids = self.parts[part] = [t.id for t in self.model.tokenize(coded)]
        return ids

    def __call__(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = []
        plain, simple, special, part = self.plain, SIMPLE.fullmatch, self.special, self.part
        for raw in words:
            word = raw.decode("utf-8")
            if plain and simple(word) and not special(word):
                word = word.lower()
                parts = (word,) if word.isalpha() else self.find(word)
                out.append(part(parts[0]) if len(parts) == 1 else [x for p in parts for x in part(p)])
            else:
                out.append(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return out


def tokenizer_words(path: str) -> WordIds:
    """The worker's cache for a ``tokenizers`` file whose pre-tokeniser drops white space."""
    if path not in _loaded:
        _loaded[path] = WordIds(WordEncoder(path))
    return _loaded[path]

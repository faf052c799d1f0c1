"""Byte-level BPE vocabulary files: pre-tokens, merge ranks, and token counts by heap-and-linked-list merging.

A text's count is its initial symbols (bytes) minus the merges made; no identifiers are emitted. Pairs wait in a heap
by merge rank, then place; symbols form a linked list, so a pre-token of n bytes takes O(n log n) however long it is.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from heapq import heapify, heappop, heappush
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .columns import set_aside, values

#: Fixed value: the pre-token pattern of byte-level BPE, in the notation of Unicode properties.
PRETOKEN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code point ranges (hexadecimal) that Unicode 16 made letters or numbers, which Python may not know yet.
LATER_LETTERS = "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B 1138E-1138E 11390-113B5 113B7-113B7 113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0"
LATER_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
CACHE_WORDS = 1 << 18
CACHE_CHARS = 64


def _ranges(chars: list[int]) -> str:
    out, start = [], None
    for c, following in zip(chars, [*chars[1:], None]):
        start = c if start is None else start
        if following != c + 1:
            out.append(re.escape(chr(start)) + ("-" + re.escape(chr(c)) if c > start else ""))
            start = None
    return "".join(out)


@lru_cache(3)
def pretoken_regex(top: int = sys.maxunicode + 1) -> re.Pattern:
    """The same pattern for Python's ``re`` over texts whose code points lie below ``top``.

    Letters, numbers and white space are listed by code point: Python knows no class for letters, its digits are decimal
    ones only, and its spaces include four separators (U+001C to U+001F) that are no white space here. Sets without code
    points beyond 0xFFFF are looked up in a bit map."""
    later = lambda told: {c for r in told.split() for c in range(int(r.split("-")[0], 16), int(r.split("-")[1], 16) + 1)}
    known = dict.fromkeys(later(LATER_LETTERS), "L") | dict.fromkeys(later(LATER_NUMBERS), "N")
    held: dict[str, list[int]] = {"L": [], "N": [], "space": []}
    for c in range(top):
        if chr(c).isspace() and not 0x1C <= c <= 0x1F:
            held["space"].append(c)
        elif (kind := known.get(c) or unicodedata.category(chr(c))[0]) in held:
            held[kind].append(c)
    letter, number, space = (_ranges(held[k]) for k in ("L", "N", "space"))
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def pretokens(text: str) -> list[str]:
    """Pre-tokens of a text without added tokens, in one pass."""
    top = 0x80 if text.isascii() else sys.maxunicode + 1 if _BEYOND.search(text) else 0x10000
    return pretoken_regex(top).findall(text)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: printable Latin-1 bytes stand for themselves, the others
    take the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTable:
    """Merge ranks of one vocabulary file, and cached token counts of pre-tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.first = [0] * 256
        for ch, b in alphabet.items():
            self.first[b] = vocab[ch]
        self.base = max(vocab.values()) + 1
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(vocab[a] * self.base + vocab[b], r)
            self.merged.append(vocab[a + b])
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.split_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.cache = WordCache(lambda word: self.symbols(word.encode("utf-8")))

    def symbols(self, raw: bytes) -> int:
        """Symbols left of one pre-token after all merges."""
        n = len(raw)
        if n == 1:
            return 1
        rank, base, first = self.rank, self.base, self.first
        held = [first[b] for b in raw]
        heap = [r << 32 | i for i in range(n - 1) if (r := rank.get(held[i] * base + held[i + 1])) is not None]
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            a = held[i]
            if a < 0 or (j := after[i]) >= n or rank.get(a * base + held[j]) != top >> 32:
                continue  # one of the two has been merged meanwhile
            held[i] = a = self.merged[top >> 32]
            held[j] = -1
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (r := rank.get(a * base + held[k])) is not None:
                    heappush(heap, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank.get(held[h] * base + a)) is not None:
                heappush(heap, r << 32 | h)
        return left

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; strings of added tokens inside it count as one token each."""
        if not text:
            return 0
        if self.split_added is not None and (found := self.split_added.findall(text)):
            return len(found) + sum(self.count(part) for part in self.split_added.split(text))
        return sum(map(self.cache.__getitem__, pretokens(text)))


class WordCache(dict):
    """What ``make`` gives for a pre-token, kept for short ones; started afresh when full, so memory is bounded."""

    def __init__(self, make: Callable[[str], Any], most: int = CACHE_WORDS):
        self.make, self.most = make, most

    def __missing__(self, word: str) -> Any:
        made = self.make(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[word] = made
        return made


@lru_cache(2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def count_tokens(docs: DataFrame, vocab_path: str, text_col: str = "text", limit: int = 512) -> DataFrame:
    """All columns of ``docs`` plus ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``vocab_path`` is a byte-level BPE vocabulary file that every executor can open. Null texts count as empty: no
    bytes, no tokens. A text of any length is scanned once, a pre-token of n bytes takes O(n log n). Other columns may be
    null; repeated rows count alike; an empty table gives an empty result. Columns of ``docs`` with the name of a result
    are replaced, others keep their values whatever their names. No shuffle.
    """
    ship(docs.sparkSession)

    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        count = merge_table(vocab_path).count
        return pa.array([count(t) for t in values(texts)], pa.int64())

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows, back = set_aside(docs, n_bytes=F.octet_length(text).cast("long"), n_tokens=tokens(text))
    return rows.select(*back("n_bytes", "n_tokens", "over_limit"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

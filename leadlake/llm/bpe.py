"""Byte-pair merging shared by the token count and the codec.

A tokenizer file gives the vocabulary and the ordered merges. Texts are cut where
the file's splitter certainly cuts, so that what a cut-off piece becomes does not
depend on its neighbours and can be remembered. Everything here is a helper of
one task; Spark deals the texts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from heapq import heapify, heappop, heappush

#: A space after a character that is no white space (nor might be counted as such) always starts a new word.
_CUT = re.compile("(?<=[^\\s\x85᠎​⁠﻿]) ")
_UNSAFE_SPACE = re.compile("[\\s\x85᠎​⁠﻿] ")

#: One word of plain letters, with at most one common mark behind it: no splitter is needed to see that.
_PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([,.]?)")

#: The words of an ASCII piece whose only white space is one leading space, here standing for ``{0}``.
_ASCII_WORDS = "'(?:s|t|re|ve|m|ll|d)|{0}?[A-Za-z]+|{0}?[0-9]+|{0}?[^{0}A-Za-z0-9]+"

_ID_BITS = 32
ID = (1 << _ID_BITS) - 1

#: Pieces remembered per Python worker and generation.
MEMORY = 250_000
#: Longer pieces are not remembered.
LONGEST_REMEMBERED = 64


def printable_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Bytes that print as themselves keep their character; the others follow from code point 256 on.
    """
    kept = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges, splitter and token bytes of a byte-level BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"]:
            raise ValueError("only byte-level BPE files without a normalizer are read")
        vocab: dict[str, int] = model["vocab"]
        to_byte = printable_bytes()
        self.symbol = {c: vocab[c] for c in to_byte}
        #: By pair of ids: rank and new id in one number. Ranks count from 1, so that no entry is 0.
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"], 1):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merge.setdefault((vocab[left], vocab[right]), rank << _ID_BITS | vocab[left + right])
        self.token_bytes = {i: bytes(to_byte[c] for c in token) for token, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes |= {i: content.encode() for content, i in self.added.items()}
        self.decimal = {i: str(i) for i in self.token_bytes}
        self._added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        # The file's own splitter, as its Unicode tables decide what a letter is; the vocabulary is not loaded a second time for it.
        bare = spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}
        self._split = Tokenizer.from_str(json.dumps(bare)).pre_tokenizer.pre_tokenize_str
        self._printable = {b: c for c, b in to_byte.items()}
        self._space = self._printable[0x20]
        self._ascii_words = re.compile(_ASCII_WORDS.format(self._space)).findall

    def parts(self, text: str) -> list[str]:
        """Text between added tokens (even places) and the added tokens (odd places)."""
        return self._added.split(text) if self._added else [text]

    def printable(self, text: str) -> str:
        """A text's bytes in the file's printable form."""
        if text.isascii() and text.isprintable():  # of these, only the space has another form
            return text.replace(" ", self._space)
        return "".join(map(self._printable.__getitem__, text.encode()))

    def words(self, piece: str) -> list[str]:
        """A piece's words in printable form."""
        if piece.isascii() and piece.isprintable() and piece != " " and piece.rfind(" ") <= 0:
            return self._ascii_words(piece.replace(" ", self._space))
        if found := _PLAIN.fullmatch(piece):
            return [self.printable(x) for x in found.groups() if x]
        return [word for word, _ in self._split(piece)]

    def symbols(self, word: str) -> list[int]:
        """Ids of the single bytes of a word in the file's printable form."""
        return list(map(self.symbol.__getitem__, word))

    def merged(self, word: list[int]) -> tuple[list[int], int]:
        """Merge a word's symbols; the remaining ids and the number of merges.

        A heap gives the adjacent pair of lowest rank, leftmost first; a doubly linked
        list of places keeps neighbours. An entry whose pair has changed since is
        skipped. A word of n bytes takes n log n steps, however long it is.
        """
        n = len(word)
        if n < 2:
            return word, 0
        get, ids = self.merge.get, list(word)
        bits = n.bit_length()
        place = (1 << bits) - 1
        heap = [found << bits | i for i, pair in enumerate(zip(word, word[1:])) if (found := get(pair))]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            entry = heappop(heap)
            i, found = entry & place, entry >> bits
            j = after[i]
            if j >= n or get((ids[i], ids[j])) != found:
                continue
            merges += 1
            ids[i] = new = found & ID
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := get((new, ids[k])):
                    heappush(heap, found << bits | i)
            h = before[i]
            if h >= 0 and (found := get((ids[h], new))):
                heappush(heap, found << bits | h)
        return [x for x in ids if x >= 0], merges


def pieces(text: str) -> list[str]:
    """Cut at spaces that certainly start a word; each piece but the first has lost its leading space."""
    return _CUT.split(text) if _UNSAFE_SPACE.search(text) else text.split(" ")


class Remembered(dict):
    """``fn`` of a piece, remembered within a bound; a plain look-up when the piece is known.

    When a generation is full it becomes the older one, and the one before is let go.
    """

    def __init__(self, fn: Callable, bound: int = MEMORY):
        super().__init__()
        self.fn, self.bound, self.older = fn, bound, {}

    def __missing__(self, piece: str):
        value = self.older.get(piece)
        if value is None:
            value = self.fn(piece)
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= self.bound:
                self.older = dict(self)
                self.clear()
            self[piece] = value
        return value


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once per Python worker."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]

"""Byte-pair work on a whole Arrow batch: each different piece, word and fragment is treated once.

Texts are cut at spaces by Arrow and the pieces dictionary-encoded; only the different pieces
go to Python, their words are found by one pass of a pattern over all of them, and what comes of
a piece is put back in place by index. Nothing is kept from one batch to the next, so memory is
bounded by a batch's bytes. A helper of one task; Spark deals the batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from leadlake.llm.bpe import Vocabulary, printable_bytes

#: Bytes of text cut at once. Its pieces and the lists made of them take twenty times as much, in each of an executor's workers.
AT_ONCE = 2 << 20
#: Code points that may be counted as white space (one of these before a space makes the space no certain cut).
_SPACES = "".join(c for c in map(chr, range(0x10000)) if c.isspace()) + "\x85᠎​⁠﻿"
_UNSAFE = "[" + "".join(rf"\x{{{ord(c):x}}}" for c in _SPACES) + "] "
#: The words of ASCII pieces, which a line feed parts.
_WORDS = re.compile("\n|'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^ A-Za-z0-9\n]+").findall

#: Longest fragments that are merged side by side, by class; longer ones one by one.
WIDTHS = (4, 8, 12, 16, 24, 48)
_NONE = np.int32(np.iinfo(np.int32).max)


class Ragged(NamedTuple):
    """Lists of numbers end to end: list k is ``flat[ends[k]:ends[k + 1]]``."""

    flat: np.ndarray
    ends: np.ndarray

    def taken(self, index: np.ndarray, ends: np.ndarray) -> Ragged:
        """Lists put together: list k is the lists ``index[ends[k]:ends[k + 1]]`` end to end."""
        sizes = np.diff(self.ends)[index]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        places = np.repeat(self.ends[index] - upto[:-1], sizes) + np.arange(upto[-1])
        return Ragged(self.flat[places], upto[ends])


class Cut(NamedTuple):
    """Texts as pieces: text k has the pieces ``index[ends[k]:ends[k + 1]]`` of the different ``pieces``."""

    pieces: list[str]
    index: np.ndarray
    ends: np.ndarray


def plain_texts(texts: pa.Array, vocab: Vocabulary) -> np.ndarray:
    """Texts in which every space is a certain cut and no added token stands."""
    odd = pc.match_substring_regex(texts, _UNSAFE)
    for content in vocab.added:
        odd = pc.or_(odd, pc.match_substring(texts, content))
    return ~odd.to_numpy(zero_copy_only=False)


def cut(texts: pa.Array) -> Cut:
    parts = pc.split_pattern(texts, " ")
    flat = parts.flatten()
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False)))).astype(np.int64)
    first = np.zeros(len(flat), bool)
    first[ends[:-1]] = True
    later, starts = (flat.filter(pa.array(mask)).dictionary_encode() for mask in (~first, first))
    index = np.empty(len(flat), np.int64)
    index[~first] = later.indices.to_numpy()
    index[first] = starts.indices.to_numpy() + len(later.dictionary)
    return Cut([" " + p for p in later.dictionary.to_pylist()] + starts.dictionary.to_pylist(), index, ends)


def words(pieces: Sequence[str], vocab: Vocabulary) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of all pieces as bytes, and each piece's words by index and end."""
    easy, hard = [], []
    for k, p in enumerate(pieces):
        (easy if p and p.isascii() and p.isprintable() and p != " " and p.rfind(" ") <= 0 else hard).append(k)
    counts = np.zeros(len(pieces), np.int64)
    found = pa.array(_WORDS("\n".join([pieces[k] for k in easy])), pa.string()).cast(pa.binary())
    if easy:
        parted = pc.equal(found, b"\n").to_numpy(zero_copy_only=False)
        counts[easy] = np.bincount(np.cumsum(parted)[~parted], minlength=len(easy))
        found = found.filter(pa.array(~parted))
    to_byte = printable_bytes()
    listed = [[bytes(map(to_byte.__getitem__, w)) for w in vocab.words(pieces[k])] if pieces[k] else [] for k in hard]
    counts[hard] = [len(ws) for ws in listed]
    rest = pa.array([w for ws in listed for w in ws], pa.binary())
    coded = pa.concat_arrays([found, rest]).dictionary_encode()
    # words lie in the order easy, hard; pieces do not
    order = np.array(easy + hard, np.int64)
    stored = np.concatenate(([0], np.cumsum(counts[order])))
    begins = np.empty(len(pieces), np.int64)
    begins[order] = stored[:-1]
    ends = np.concatenate(([0], np.cumsum(counts)))
    places = np.repeat(begins - ends[:-1], counts) + np.arange(ends[-1])
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)[places], ends


def _bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary array's bytes and offsets."""
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8))[ends[0] : ends[-1]], ends - ends[0]


class Merger:
    """Ids of words, merged side by side after forced cuts."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        shown = printable_bytes()
        added = set(vocab.added.values())
        #: By two bytes: whether they stand side by side in some token.
        self.joinable = np.zeros((256, 256), bool)
        for i, token in vocab.token_bytes.items():
            if i not in added:
                pairs = np.frombuffer(token, np.uint8)
                self.joinable[pairs[:-1], pairs[1:]] = True
        self.symbol = np.zeros(256, np.int32)
        for c, b in shown.items():
            self.symbol[b] = vocab.symbol[c]
        keys = np.array([left << 32 | right for left, right in vocab.merge], np.int64)
        found = np.array(list(vocab.merge.values()), np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], (found[order] >> 32).astype(np.int32)
        self.made = np.zeros(int(self.ranks.max(initial=0)) + 1, np.int32)
        self.made[self.ranks] = (found[order] & 0xFFFFFFFF).astype(np.int32)
        left, right = np.meshgrid(self.symbol, self.symbol, indexing="ij")
        self.first = self.rank(left.ravel(), right.ravel()).reshape(256, 256)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of pairs of ids, ``_NONE`` where there is none or an id is missing."""
        if not len(self.keys):
            return np.full(len(left), _NONE)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.ranks[at], _NONE)

    def ids(self, different: pa.Array) -> Ragged:
        """The ids of each word: cut where two bytes never meet inside a token, encode the different fragments alone, join."""
        data, ends = _bytes_of(different)
        if not len(data):
            return Ragged(np.empty(0, np.int32), np.zeros(len(different) + 1, np.int64))
        apart = np.zeros(len(data) + 1, bool)
        apart[1:-1] = ~self.joinable[data[:-1], data[1:]]
        apart[ends] = True
        bounds = np.nonzero(apart)[0]
        fragments = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
        coded = fragments.dictionary_encode()
        merged = self.merged(*_bytes_of(coded.dictionary))
        return merged.taken(coded.indices.to_numpy().astype(np.int64), np.searchsorted(bounds, ends))

    def merged(self, data: np.ndarray, ends: np.ndarray) -> Ragged:
        """Merge each fragment's pair of lowest rank, leftmost first, until none is left."""
        sizes = np.diff(ends)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low = 0
        for width in WIDTHS:
            rows = np.nonzero((sizes > low) & (sizes <= width))[0]
            done += self._side_by_side(rows, data, ends[rows], sizes[rows], width) if len(rows) else []
            low = width
        single = [(k, self.vocab.merged(self.symbol[data[ends[k] : ends[k + 1]]].tolist())[0]) for k in np.nonzero(sizes > low)[0].tolist()]
        lengths = np.zeros(len(sizes), np.int64)
        for rows, _, size in done:
            lengths[rows] = size
        for k, ids in single:
            lengths[k] = len(ids)
        upto = np.concatenate(([0], np.cumsum(lengths)))
        flat = np.empty(upto[-1], np.int32)
        for rows, ids, size in done:
            cols = np.arange(ids.shape[1])
            used = cols < size[:, None]
            flat[(upto[rows][:, None] + cols)[used]] = ids[used]
        for k, ids in single:
            flat[upto[k] : upto[k + 1]] = ids
        return Ragged(flat, upto)

    def _side_by_side(self, rows, data, starts, size, width):
        """Fragments of up to ``width`` bytes as rows of a matrix; yields finished (rows, ids, sizes)."""
        cols = np.arange(width + 1)
        inside = cols < size[:, None]
        raw = np.where(inside, data[np.minimum(starts[:, None] + cols, len(data) - 1)], 0)
        ids = np.where(inside, self.symbol[raw], -1)
        ranks = np.where(inside[:, 1:], self.first[raw[:, :-1], raw[:, 1:]], _NONE)
        while len(rows):
            best = ranks.argmin(axis=1)
            every = np.arange(len(rows))
            found = ranks[every, best]
            live = found != _NONE
            if not live.all():
                yield rows[~live], ids[~live], size[~live]
                rows, ids, ranks, size, best, found = (x[live] for x in (rows, ids, ranks, size, best, found))
                every = np.arange(len(rows))
                if not len(rows):
                    return
            ids[every, best] = self.made[found]
            behind = cols > best[:, None]
            ids = np.take_along_axis(ids, np.minimum(cols + behind, width), axis=1)
            ids[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(cols[:-1] + behind[:, :-1], width - 1), axis=1)
            size = size - 1
            here = ids[every, best]
            ranks[every, best] = self.rank(here, ids[every, best + 1])
            before = np.nonzero(best)[0]
            ranks[before, best[before] - 1] = self.rank(ids[before, best[before] - 1], here[before])
            ranks[:, -1] = _NONE  # what was moved away from the end

    def pieces(self, pieces: Sequence[str]) -> Ragged:
        """The ids of each piece."""
        different, index, ends = words(pieces, self.vocab)
        return self.ids(different).taken(index, ends)


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Stretches of at most ``AT_ONCE`` bytes, or one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > start and total + n > AT_ONCE:
            yield texts.slice(start, k - start)
            start, total = k, 0
        total += n
    if len(texts) > start:
        yield texts.slice(start)


def joined(parts: pa.Array, lists: Ragged, separator: str | bytes) -> pa.Array:
    """Per list of numbers, the ``parts`` of these numbers joined."""
    listed = pa.LargeListArray.from_arrays(pa.array(lists.ends), parts.take(pa.array(lists.flat)))
    return pc.binary_join(listed, pa.scalar(separator, listed.type.value_type))


def per_text(texts: pa.Array, vocab: Vocabulary, plain: Callable[[pa.Array], Iterable], other: Callable[[str], object]) -> list:
    """Results in order: ``plain`` of the plain texts of a stretch, ``other`` of each other one. Nulls count as empty.

    Only one stretch at a time is copied and worked on.
    """
    out: list = []
    for stretch in slices(texts):
        some = pc.fill_null(stretch.cast(pa.large_string()), "")
        simple = plain_texts(some, vocab)
        told = iter(plain(some.filter(pa.array(simple))) if simple.any() else ())
        out += [next(told) if alone else other(some[k].as_py()) for k, alone in enumerate(simple.tolist())]
    return out

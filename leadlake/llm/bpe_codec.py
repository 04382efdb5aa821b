"""BPE encoding and decoding with forced-boundary splitting.

A merge can only join two neighbouring bytes if some vocabulary token holds them
side by side. Where a text's neighbouring bytes never meet inside any token, a
token boundary is certain; the fragments between such places are encoded on
their own and their ids are put together again. ``round_trip`` works on whole Arrow
batches, each different fragment once (``bpe_batch``); ``encode`` goes text by text, and
remembers what becomes of fragments, words and pieces per Python worker within a bound.

Nulls encode as empty texts: no ids, decoded to the empty text. Rows are handled
one by one; repeated rows, empty tables and very long texts need no special case
(a fragment of n bytes takes n log n steps). Columns named like a result are
replaced by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.apart import Apart
from leadlake.llm.bpe import ID, Remembered, Vocabulary, pieces, vocabulary
from leadlake.llm.bpe_batch import Merger, Ragged, cut, joined, per_text
from leadlake.llm.ship import ship_code, small_batches

#: Bytes up to which a fragment is merged by looking through all its ranks.
SHORT = 48
#: Stands for no merge; larger than any rank and id.
NO_MERGE = 1 << 62

ROUND_TRIP = ("n_tokens", "ids_sha256", "decoded_sha256")

_codecs: dict[str, Codec] = {}


class Codec:
    """Encodes and decodes whole texts as the tokenizer of a file does."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        added = set(vocab.added.values())
        shown = {vocab.token_bytes[i]: c for c, i in vocab.symbol.items()}
        #: Pairs of bytes, in the file's printable form, that stand side by side in some token.
        self.joinable = {
            (shown[t[k : k + 1]], shown[t[k + 1 : k + 2]]) for i, t in vocab.token_bytes.items() if i not in added for k in range(len(t) - 1)
        }
        self.fragment = Remembered(self._fragment)
        self.word = Remembered(self._word)
        self.spaced = Remembered(lambda piece: self._piece(" " + piece))
        self.merger = Merger(vocab)
        every = range(max(vocab.token_bytes) + 1)
        self.shown = pa.array([str(i) for i in every], pa.large_string())
        self.held = pa.array([vocab.token_bytes.get(i, b"") for i in every], pa.large_binary())

    def fragments(self, word: str) -> list[str]:
        """Cut a word (in the file's printable form) where two bytes meet that meet in no token."""
        joinable = self.joinable
        if joinable.issuperset(zip(word, word[1:])):  # noqa: B905
            return [word]
        cuts = [i for i, pair in enumerate(zip(word, word[1:]), 1) if pair not in joinable]  # noqa: B905
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def _fragment(self, fragment: str) -> tuple[int, ...]:
        """Merge the pair of lowest rank, leftmost first, until none is left.

        For a short fragment, looking through all ranks is quicker than keeping a heap of them.
        """
        ids = self.vocab.symbols(fragment)
        if len(ids) > SHORT:
            return tuple(self.vocab.merged(ids)[0])
        get = self.vocab.merge.get
        ranks = list(map(get, zip(ids, ids[1:]), repeat(NO_MERGE)))  # noqa: B905
        while ranks and (found := min(ranks)) != NO_MERGE:
            i = ranks.index(found)
            ids[i : i + 2] = [found & ID]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NO_MERGE)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NO_MERGE)
        return tuple(ids)

    def _word(self, word: str) -> tuple[int, ...]:
        cut = self.fragments(word)
        return tuple(chain.from_iterable(map(self.fragment.__getitem__, cut))) if len(cut) > 1 else self._fragment(word)

    def _piece(self, piece: str) -> tuple[int, ...]:
        words = self.vocab.words(piece)
        return tuple(chain.from_iterable(map(self.word.__getitem__, words))) if len(words) != 1 else self.word[words[0]]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for k, part in enumerate(self.vocab.parts(text)):
            if k % 2:
                ids.append(self.vocab.added[part])
            elif part:
                first, *rest = pieces(part)
                ids.extend(self._piece(first))
                ids.extend(chain.from_iterable(map(self.spaced.__getitem__, rest)))
        return ids

    def bytes_of(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.vocab.token_bytes.__getitem__, ids))

    def decode(self, ids: Sequence[int]) -> str:
        return self.bytes_of(ids).decode("utf-8", "replace")

    def decimals(self, ids: Sequence[int]) -> str:
        return ",".join(map(self.vocab.decimal.__getitem__, ids))

    def both_ways(self, texts: pa.Array) -> list[tuple[int, str, str]]:
        """Per text: number of ids, ids as decimals joined by commas, and the text they decode to."""
        return per_text(texts, self.vocab, self._plain_both_ways, self._one_both_ways)

    def digests(self, texts: pa.Array) -> list[tuple[int, str, str]]:
        """As ``both_ways`` with digests for the ids and the text, taken stretch by stretch: a batch's ids are never held together."""
        return per_text(texts, self.vocab, lambda some: map(_digested, self._plain_both_ways(some)), lambda text: _digested(self._one_both_ways(text)))

    def _one_both_ways(self, text: str) -> tuple[int, str, str]:
        ids = self.encode(text)
        return len(ids), self.decimals(ids), self.decode(ids)

    def _plain_both_ways(self, texts: pa.Array) -> Iterator[tuple[int, str, str]]:
        """Ids of the different pieces, then decimals and bytes of these, then of the texts.

        Bytes are put together before they are decoded, as a character may lie across tokens.
        """
        pieces, index, ends = cut(texts)
        ids = self.merger.pieces(pieces)
        sizes = np.diff(ids.ends)
        n = np.add.reduceat(sizes[index], ends[:-1])
        used = sizes[index] > 0  # an empty first piece has no ids, and no comma
        lists = Ragged(index[used], np.concatenate(([0], np.cumsum(used)))[ends])
        listed = joined(joined(self.shown, ids, ","), lists, ",")
        back = joined(joined(self.held, ids, b""), lists, b"")
        for k, decimals, raw in zip(n.tolist(), listed.to_pylist(), back.to_pylist(), strict=True):
            yield k, decimals, raw.decode("utf-8", "replace")


def _digested(told: tuple[int, str, str]) -> tuple[int, str, str]:
    n, ids, back = told
    return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(vocabulary(path))
    return _codecs[path]


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids of each whole text as ``out`` (array of int)."""
    ship_code(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        coder = codec(path)
        return pa.array([coder.encode(x.as_py() or "") for x in texts], pa.list_(pa.int32()))

    return docs.withColumn(out, ids(F.col(text)))


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of an array of ids as ``out``; null ids give the empty text, unknown ids fail."""
    ship_code(docs.sparkSession)

    @F.arrow_udf("string")
    def texts(rows: pa.Array) -> pa.Array:
        coder = codec(path)
        return pa.array([coder.decode(x.as_py() or []) for x in rows], pa.string())

    return docs.withColumn(out, texts(F.col(ids)))


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Encode each text, decode the ids again, and add digests of both.

    Adds ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas) and
    ``decoded_sha256`` (of the decoded text in UTF-8). The ids themselves do not
    leave the task, so nothing but the digests is passed on.
    """
    ship_code(docs.sparkSession)
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def digests(texts: pa.Array) -> pa.Array:
        told = codec(path).digests(texts)
        pa.default_memory_pool().release_unused()  # the worker waits for other batches and jobs, which may need it
        kinds = (pa.int64(), pa.string(), pa.string())
        return pa.StructArray.from_arrays([pa.array([row[k] for row in told], kind) for k, kind in enumerate(kinds)], list(ROUND_TRIP))

    held = Apart(docs)
    told = held.df.withColumn("told", digests(F.col(held[text])))
    return held.back(told, {c: F.col("told")[c] for c in ROUND_TRIP})

"""Token counts by heap-and-linked-list byte-pair merging.

The number of tokens of a word is its bytes less the merges it allows, so no
token is ever written out: ``Vocabulary.merged`` pops the adjacent pair of lowest
rank from a heap, joins it in a linked list and counts. The different pieces of an Arrow
batch are looked at once (``bpe_batch``), and counts of words are remembered per Python
worker within a bound.

Nulls count as empty texts: 0 bytes, 0 tokens, not over the limit. Rows are
handled one by one, so repeated rows get the same counts each and an empty table
gives an empty table. Columns named like a result are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.bpe import Remembered, Vocabulary, pieces, printable_bytes, vocabulary
from leadlake.llm.bpe_batch import cut, per_text, words
from leadlake.llm.ship import ship_code

_counters: dict[str, TokenCounter] = {}


class TokenCounter:
    """Counts the tokens of whole texts as the tokenizer of ``path`` would give them."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.word = Remembered(self._word)
        self.spaced = Remembered(lambda piece: self._piece(" " + piece))
        self.raw = Remembered(lambda word: len(word) - self.vocab.merged(list(map(self.symbol.__getitem__, word)))[1])
        self.symbol = {b: vocab.symbol[c] for c, b in printable_bytes().items()}

    def _word(self, word: str) -> int:
        return len(word) - self.vocab.merged(self.vocab.symbols(word))[1]

    def _piece(self, piece: str) -> int:
        return sum(map(self.word.__getitem__, self.vocab.words(piece))) if piece else 0

    def count(self, text: str) -> int:
        total = 0
        for k, part in enumerate(self.vocab.parts(text)):
            if k % 2:
                total += 1
            elif part:
                first, *rest = pieces(part)
                total += self._piece(first) + sum(map(self.spaced.__getitem__, rest))
        return total


    def counts(self, texts: pa.Array) -> list[int]:
        """The number of tokens of each text of a batch."""
        return per_text(texts, self.vocab, self._plain_counts, self.count)

    def _plain_counts(self, texts: pa.Array) -> list[int]:
        pieces, index, ends = cut(texts)
        different, inside, upto = words(pieces, self.vocab)
        sizes = np.array([self.raw[w] for w in different.to_pylist()], np.int64)
        before = np.concatenate(([0], np.cumsum(sizes[inside])))
        of_piece = before[upto[1:]] - before[upto[:-1]]
        return np.add.reduceat(of_piece[index], ends[:-1]).tolist()


def counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(vocabulary(path))
    return _counters[path]


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) to each row.

    ``path`` is a byte-level BPE file in the tokenizers format, at the same place on
    every executor. One pass without a shuffle; only the text goes to Python.
    """
    ship_code(docs.sparkSession)

    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        return pa.array(counter(path).counts(texts), pa.int64())

    return (
        docs.withColumn("n_tokens", tokens(F.col(text)))
        .withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )

"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths run over fixed-length windows, each
filter's maximum over the window is kept, and a softmax over those maxima gives the
language. The network is trained in numpy on the driver, on a bounded sample of windows
of labelled texts; it has some ten thousand numbers and is sent to the executors with
the function. A text is cut into windows that cover it whole, windows are put together
in batches across texts, and a text's probabilities are the mean of its windows'.

Null texts and texts without a letter are ``und`` with score 0, as is everything if
nothing was labelled. Empty and very long texts need no special case; repeated rows get
the same result each. Null labels are not learnt from; rows with a null id are held out.
An empty table stays empty. Columns named like a result are replaced by it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlake.functions.reliability import small_side
from leadlake.llm.apart import Apart
from leadlake.llm.ship import ship_code

UNKNOWN = "und"
WIDTHS = (2, 3, 4)
FILTERS, EMBEDDED = 16, 8
#: Bytes of a window; the last one of a text is filled up with zero bytes.
LENGTH = 256
#: Windows that go through the network at once.
BATCH = 256

#: Bounds of the training sample: texts per language, texts in all (but one per language at least), windows per text.
TEXTS, ALL_TEXTS, WINDOWS = 300, 64 * 300, 3
#: Parts of a language in which the lowest hashes are looked for first.
SALTS = 32
#: Probabilities that are held at once: texts times languages.
CELLS = 1 << 20
EPOCHS, STEP, RATE = 6, 64, 0.01
SEED = 7

_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    """``tables[w][k]``: what byte values add to the filters of width w at place k; ``bias[w]``, and the output layer."""

    languages: list[str]
    tables: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def pair_tables(self) -> dict[int, list[np.ndarray]]:
        """Tables over pairs of bytes, so that a filter takes two places in one look-up."""
        both = {}
        for w, t in self.tables.items():
            both[w] = [(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(1 << 16, -1) if k + 1 < w else t[k] for k in range(0, w, 2)]
        return both


def windows(data: bytes) -> np.ndarray:
    """A text's bytes as rows of ``LENGTH``, the last one filled up."""
    rows = max(1, -(-len(data) // LENGTH))
    out = np.zeros(rows * LENGTH, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(rows, LENGTH)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(net: Network, pairs: dict[int, list[np.ndarray]], rows: np.ndarray) -> np.ndarray:
    """The softmax of each window."""
    pair = rows[:, :-1].astype(np.uint16) << 8 | rows[:, 1:]
    pooled = []
    for w in WIDTHS:
        n = LENGTH - w + 1
        total = np.take(pairs[w][0], pair[:, :n], axis=0)
        for k, table in enumerate(pairs[w][1:], 1):
            total += np.take(table, pair[:, 2 * k : 2 * k + n] if 2 * k + 1 < w else rows[:, 2 * k : 2 * k + n], axis=0)
        pooled.append(np.maximum(total.max(axis=1) + net.bias[w], 0))
    return _softmax(np.concatenate(pooled, axis=1) @ net.out + net.out_bias)


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str]) -> Network:
    """Fit embedding, filters and output by gradient steps (Adam) on windows and the places of their languages."""
    rng = np.random.default_rng(SEED)
    normal = lambda *shape: (rng.standard_normal(shape) * np.sqrt(2 / shape[0])).astype(np.float32)
    weights = {"embed": rng.standard_normal((256, EMBEDDED)).astype(np.float32) * 0.3}
    for w in WIDTHS:
        weights |= {f"f{w}": normal(w * EMBEDDED, FILTERS), f"b{w}": np.zeros(FILTERS, np.float32)}
    weights |= {"out": normal(FILTERS * len(WIDTHS), len(languages)), "out_bias": np.zeros(len(languages), np.float32)}
    mean, square = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    steps = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), STEP):
            chosen = order[at : at + STEP]
            x, y = rows[chosen], labels[chosen]
            n = len(x)
            vectors = weights["embed"][x]
            pooled, tops, seen = [], {}, {}
            for w in WIDTHS:
                seen[w] = np.concatenate([vectors[:, k : LENGTH - w + 1 + k] for k in range(w)], axis=2)
                total = seen[w] @ weights[f"f{w}"] + weights[f"b{w}"]
                tops[w] = total.argmax(axis=1)
                pooled.append(np.take_along_axis(total, tops[w][:, None, :], axis=1)[:, 0])
            raw = np.concatenate(pooled, axis=1)
            hidden = np.maximum(raw, 0)
            wrong = _softmax(hidden @ weights["out"] + weights["out_bias"])
            wrong[np.arange(n), y] -= 1
            wrong /= n
            grad = {"out": hidden.T @ wrong, "out_bias": wrong.sum(axis=0), "embed": np.zeros_like(weights["embed"])}
            back = (wrong @ weights["out"].T) * (raw > 0)
            for i, w in enumerate(WIDTHS):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                own = np.take_along_axis(seen[w], tops[w][:, :, None], axis=1)
                grad[f"f{w}"] = np.einsum("nfe,nf->ef", own, g)
                grad[f"b{w}"] = g.sum(axis=0)
                into = np.einsum("nf,ef->nfe", g, weights[f"f{w}"]).reshape(n, FILTERS, w, EMBEDDED)
                byte = np.stack([np.take_along_axis(x, tops[w] + k, axis=1) for k in range(w)], axis=2)
                np.add.at(grad["embed"], byte.ravel(), into.reshape(-1, EMBEDDED))
            steps += 1
            for k, g in grad.items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                weights[k] -= RATE * (mean[k] / (1 - 0.9**steps)) / (np.sqrt(square[k] / (1 - 0.999**steps)) + 1e-8)
    tables = {w: np.stack([weights["embed"] @ weights[f"f{w}"][k * EMBEDDED : (k + 1) * EMBEDDED] for k in range(w)]) for w in WIDTHS}
    return Network(languages, tables, {w: weights[f"b{w}"] for w in WIDTHS}, weights["out"], weights["out_bias"])


def held_out(key: str = "doc_id") -> Column:
    """Rows never learnt from: one in five by the checksum of the id as text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


def sample(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> list[tuple[str, str]]:
    """(language, excerpt): a bounded sample of the rows that may be learnt from.

    Per language the ``TEXTS`` different texts of lowest hash (fewer if there are so many
    languages that these would be more than ``ALL_TEXTS``), and of each ``WINDOWS``
    stretches spread over the whole text. Every language is learnt.
    """
    learnt = docs.where(~held_out(key) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    n_languages = learnt.select(lang).distinct().count()
    texts = max(1, min(TEXTS, ALL_TEXTS // max(1, n_languages)))
    size = F.length("text")
    starts = [F.floor(size * k / WINDOWS).cast("int") for k in range(WINDOWS)]
    cut = F.array_distinct(F.array(*[F.substring("text", s + 1, F.lit(LENGTH)) for s in starts]))
    hashed = learnt.select(F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    # languages and hashes alone are ranked; excerpts are cut from the chosen texts only
    few = hashed.select("lang", "h").distinct().withColumn("s", F.pmod(F.xxhash64("h"), F.lit(SALTS)))  # copies count once
    for keys in (["lang", "s"], ["lang"]):  # by salt first, so that the last task of a language has SALTS * texts rows at most
        few = few.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(F.col("r") <= texts)
    chosen = hashed.join(small_side(few.select("lang", "h")), ["lang", "h"])  # at most ALL_TEXTS rows, or one per language
    cuts = chosen.select("lang", "h", cut.alias("cut")).groupBy("lang", "h").agg(F.min("cut").alias("cut"))
    rows = cuts.select("lang", F.explode("cut").alias("cut")).where("cut != ''").collect()  # at most texts * WINDOWS short strings per language
    return sorted((r[0], r[1]) for r in rows)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Network | None:
    """The network of a table's labelled rows; None if there are none."""
    told = sample(docs, text, lang, key)
    if not told:
        return None
    languages = sorted({a for a, _ in told})
    place = {a: i for i, a in enumerate(languages)}
    cut = [windows(b.encode())[:1] for _, b in told]
    return train(np.concatenate(cut), np.array([place[a] for a, _ in told]), languages)


_pairs: dict[str, dict[int, list[np.ndarray]]] = {}


def identify(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (its mean probability) to each row, from the text alone. No shuffle."""
    ship_code(docs.sparkSession)
    if net is None:
        return docs.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    mark = hash(net.out.tobytes())

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predicted(texts: pa.Array) -> pa.Array:
        step = max(1, CELLS // len(net.languages))
        return pa.concat_arrays([part(texts.slice(a, step)) for a in range(0, max(1, len(texts)), step)])

    def part(texts: pa.Array) -> pa.Array:
        if mark not in _pairs:
            _pairs.clear()
            _pairs[mark] = net.pair_tables()
        pairs = _pairs[mark]
        sums = np.zeros((len(texts), len(net.languages)))
        counts = np.zeros(len(texts))
        held: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if held:
                rows, owner = np.concatenate(held), np.concatenate(owners)
                for a in range(0, len(rows), BATCH):
                    part = owner[a : a + BATCH]
                    np.add.at(sums, part, probabilities(net, pairs, rows[a : a + BATCH]))
                    np.add.at(counts, part, 1)
                held.clear()
                owners.clear()
                size = 0

        for i, x in enumerate(texts):
            t = x.as_py()
            if t and any(m.group().isalpha() for m in _LETTER.finditer(t)):
                held.append(windows(t.encode()))
                owners.append(np.full(len(held[-1]), i))
                size += len(held[-1])
                if size >= 16 * BATCH:
                    flush()
        flush()
        known = counts > 0
        means = sums / np.maximum(counts, 1)[:, None]
        best = means.argmax(axis=1)
        names = [net.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        scores = np.where(known, np.clip(means.max(axis=1, initial=0.0), 0, 1), 0.0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    held = Apart(docs)
    told = held.df.withColumn("told", predicted(F.col(held[text])))
    return held.back(told, {c: F.col("told")[c] for c in ("lang_pred", "score")})

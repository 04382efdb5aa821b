"""Secret scans by dictionary-primed zstandard novelty.

Three kinds of secrets have a fixed form: assignments of a value to a telling name
(``assign``), access key ids (``access``) and long hexadecimal runs (``hex``). Other
secrets have none, but they tell something new: a candidate string near a sensitive
word is compressed behind the text around it, with a dictionary primed with that
text and with common identifiers and placeholders. If its marginal compressed bytes
are a large share of its length, nothing around it explains it, and it is reported
(``novel``). It is compressed in pieces too short for zstandard to code their letters by
frequency, so a small alphabet is no explanation. A string of letters alone is also
explained if its pairs of letters are those of words.

Spans are in code points, end exclusive, ordered by start, then by kind as listed
above. Spans of one kind never overlap; a novel span overlaps no other span. Nulls
and empty texts have no spans; very long texts are searched whole; repeated rows get
the same spans each; an empty table stays empty. Columns named like a result are
replaced by it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, pairwise
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.llm.ship import ship_code, small_batches

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "novel")
SPANS = "array<struct<kind: string, start: int, end: int>>"

#: Fixed patterns and lengths of the base kinds.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_ASSIGN_VALUE, _ACCESS_LENGTH = 8, 16

#: Words that make a string behind them a candidate.
_SENSITIVE = re.compile(
    r"pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|private|credential|\bauth|bearer|signature|session[_-]?id|cookie",
    re.IGNORECASE | re.ASCII,
)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Characters behind a sensitive word in which a candidate may start.
REACH = 64
#: Characters on either side that prime the dictionary.
AROUND = 2048
#: A string is novel if its marginal compressed bytes are at least this share of its length.
NOVELTY = 0.7
#: Characters of a piece; with the 16 before it fewer than the 64 from which literals are entropy coded.
PIECE = 40
#: Identifiers and placeholders that explain a string without making it a secret.
IDENTIFIERS = (
    "0123456789abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ xxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXX 0000000000000000 "
    "11111111111111111 aaaaaaaaaaaaaaaa changeme change_me example EXAMPLE placeholder your_api_key_here your-secret-here "
    "insert_token_here client_id client_secret access_token refresh_token secret_access_key private_key public_key session_id "
    "authorization_code authentication credentials configuration environment_variable process.env os.environ getenv "
    "application/json username password_hash password_reset_token get_secret_value set_password validate_token "
    "expected_signature content_type user_agent request_id response_body database_url connection_string "
).encode()

#: Words whose pairs of letters are those of plain words.
WORDS = (
    "the and that this with from have will your which their would there about information internationalization responsibilities "
    "administration representation communication understanding development environment organization implementation application "
    "configuration characterization accountability straightforward notwithstanding unconstitutional recommendations acknowledgement "
    "get set value user name service request response handler manager provider factory controller interface connection message "
    "psychological cultural neural physical mechanism hypothesis photograph electricity temperature industrial agriculture pharmaceutical "
    "knowledge thought working night school world public difficult society quickly complex because justice objective transfer "
    "und der die das nicht mit sich auf werden einer auch nach durch gesellschaft verantwortung datenschutz grundverordnung "
    "wissenschaft rechtsschutzversicherung geschwindigkeit zusammenarbeit bundesregierung unternehmen "
    "les des une dans pour que par sur avec gouvernement environnement responsabilité développement administrativement "
    "los las una para como desarrollo administraciones responsabilidades internacionalmente conocimiento constitucional "
    "gli della che per con sviluppo amministrazione responsabilmente precipitevolissimevolmente "
    "uma não para desenvolvimento constitucionalmente het een van voor verantwoordelijkheid gemeenschappelijk ontwikkeling "
)


def _pairs() -> dict[tuple[str, str], float]:
    """For pairs of letters, how much more often (logarithm) the second follows the first in words than in random strings."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    seen = Counter(pair for w in (WORDS + IDENTIFIERS.decode().replace("_", " ")).lower().split() if len(set(w)) < 26 for pair in pairwise(w))
    total = {a: sum(seen[a, b] for b in letters) for a in letters}
    return {(a, b): log(26 * (seen[a, b] + 0.3) / (total[a] + 0.3 * 26)) for a in letters for b in letters}


_PAIRS = _pairs()


def _words_alone(own: str) -> bool:
    """Whether a string has only letters and is more likely words than random."""
    return own.isalpha() and sum(_PAIRS[pair] for pair in pairwise(own.lower())) > 0


def _novelty(text: str, start: int, end: int) -> float:
    """Marginal compressed bytes of a string, piece by piece behind its surroundings, as a share of its length."""
    own = text[start:end]
    left = text[max(0, start - AROUND) : start].replace(own, " ")
    right = text[end : end + AROUND].replace(own, " ")
    pieces, total = -(-len(own) // PIECE), 0
    for k in range(pieces):
        a, b = len(own) * k // pieces, len(own) * (k + 1) // pieces
        behind = (left + own[max(0, a - AROUND) : a])[-AROUND:]
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS + (right + behind).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packer = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
        before = behind[-16:]
        total += len(packer.compress((before + own[a:b]).encode())) - len(packer.compress(before.encode()))
    return total / len(own)


def _candidates(text: str) -> Iterator[tuple[int, int]]:
    """Strings that start at most ``REACH`` characters behind a sensitive word, each once.

    A string found too far behind one word is kept for the next one, so the text is
    gone through about twice, however many words and strings it has.
    """
    seen, ahead = 0, _CANDIDATE.search(text)
    for near in _SENSITIVE.finditer(text):
        at = max(near.end(), seen)
        while ahead:
            if ahead.start() < at:
                ahead = _CANDIDATE.search(text, at)
            elif ahead.start() <= near.end() + REACH:
                yield ahead.span()
                at = seen = ahead.end()
            else:
                break


def find(text: str | None) -> list[tuple[str, int, int]]:
    """The spans of one whole text: kind, start, end."""
    if not text:
        return []
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _ACCESS_LENGTH]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    found.sort()
    starts, reached = [a for a, _, _ in found], list(accumulate((b for _, _, b in found), max))
    novel = []
    for start, end in _candidates(text):
        before = bisect_left(starts, end)
        if before and reached[before - 1] > start:  # overlaps a base span
            continue
        if not _words_alone(text[start:end]) and _novelty(text, start, end) >= NOVELTY:
            novel.append((start, 3, end))
    return [(KINDS[kind], start, end) for start, kind, end in sorted(found + novel)]


def mask(text: str | None) -> str | None:
    """The text with every secret replaced by the name of its kind; overlapping spans become one."""
    out, at = [], 0
    for kind, start, end in find(text):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def masked_texts(texts: pa.Array) -> pa.Array:
    """A batch with its secrets masked; texts without any are not copied one by one."""
    changed: dict[int, str] = {}
    for k, x in enumerate(texts):
        text = x.as_py()
        if (new := mask(text)) is not text:
            changed[k] = new
    if not changed:
        return texts
    at = np.zeros(len(texts), bool)
    at[list(changed)] = True
    return pc.replace_with_mask(texts, pa.array(at), pa.array(list(changed.values()), texts.type))


def secret_spans(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """Add the spans of each whole text as ``out``, an array of (kind, start, end)."""
    ship_code(docs.sparkSession)

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        rows = [[{"kind": k, "start": a, "end": b} for k, a, b in find(x.as_py())] for x in texts]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    return docs.withColumn(out, spans(F.col(text)))


def mask_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace the secrets in each text; texts without any stay as they are, nulls stay null."""
    ship_code(docs.sparkSession)
    small_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        return masked_texts(texts)

    return docs.withColumn(text, masked(F.col(text)))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

"""Personal data by fixed forms and by bootstrapped contexts.

Four kinds have a fixed form (``email``, ``ip``, ``card``, ``phone``). Their instances
are seeds: the two words before an instance are a lexical pattern, and patterns and
instances make a graph. Of a word with a digit or an @ only that counts, and the text's
start stands for words that are missing. Round by round a pattern's confidence is the share of its
occurrences that are trusted instances, and an instance's trust is the chance that not
all of its patterns are wrong. Patterns that stay confident, with enough different
trusted instances, find further identifiers (``context``): strings with several digits
behind such words that no fixed form covers.

Everything is built-in functions. Texts are read once; what is kept of them are spans
and the characters before them. Occurrences are added up per pattern and instance
before the rounds, so frequent ones are a row each. Found spans go back to the texts by
a digest of the text, which copies share.

Spans are in code points, end exclusive, ordered by start, then by kind as listed
above. Base spans never depend on the method; a context span overlaps none of them.
Nulls and empty texts have no spans. Repeated rows get the same spans each. An empty
table stays empty. Very long texts and runs of one kind of character take linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions.reliability import checkpointed, small_side
from leadlake.llm.apart import Apart
from leadlake.llm.text import let, no_spans, places, running_totals, spans

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "context")

#: The base kinds' forms. Possessive runs and the checks before them change no match; they keep
#: a search from starting anew inside a run that has just failed.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

#: A word with a digit or an @ in it: every instance starts in one. Such words may be identifiers; their least length and digits.
MARKED = r"(?<!\S)\S*?[0-9@]\S*+"
SHORTEST, LONGEST, FEWEST_DIGITS = 6, 64, 4

ROUNDS = 3
#: Trusted instances and confidence that a pattern needs to find others.
LEAST_INSTANCES, LEAST_CONFIDENCE = 3, 0.8
#: A pattern's word about one instance never counts for more.
MOST_TRUST = 0.95


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right: every second digit from the right counts twice, less 9 above 9."""

    def value(k: Column) -> Column:
        d = F.ascii(F.substring(digits, -1 - k, F.lit(1))) - 48
        twice = d * 2
        return F.when(k % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(places(F.length(digits)), F.lit(0), lambda acc, k: acc + value(k)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return let(_digits(match), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def _occurrence(s: Column, kind: int, pattern: Column) -> Column:
    return F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["match"].alias("match"), pattern.alias("pattern"))


def _marked(text: Column) -> Column:
    """The marked words: array of (start, kind -1, end, match, pattern).

    The pattern is the two words before a word, in lower case: of marked ones the class
    ``0`` or ``@``, before the text's start an empty one. Gaps between marked words hold
    the others, so two gaps and two marked words tell it.
    """

    def last_two(gap: Column) -> Column:
        words = F.filter(F.split(F.lower(gap), r"\s+"), lambda w: w != "")
        return let(words, lambda w: F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), F.lit(2)))

    def told(found: Column, gaps: Column, classes: Column) -> Column:
        def pattern(k: Column) -> Column:
            word = lambda j: F.coalesce(F.get(classes, j), F.lit(""))
            behind = lambda w, j: F.when(F.size(w) > 0, F.element_at(w, -1)).otherwise(word(j - 1))
            earlier = F.when(k > 0, behind(F.get(gaps, k - 1), k - 1)).otherwise("")
            own = F.get(gaps, k)
            first = F.when(F.size(own) == 2, F.get(own, 0)).when(F.size(own) == 1, word(k - 1)).otherwise(earlier)
            return F.concat_ws(" ", first, behind(own, k))

        return F.transform(found, lambda s, k: _occurrence(s, -1, pattern(k)))

    def placed(found: Column) -> Column:
        gaps = F.transform(found, lambda s: last_two(s["left"]))
        classes = F.transform(found, lambda s: F.when(F.contains(s["match"], F.lit("@")), "@").otherwise("0"))
        return let(gaps, lambda g: let(classes, lambda c: told(found, g, c)))

    return let(spans(text, MARKED), placed)


def _with_patterns(base: Column, marked: Column) -> Column:
    """Base instances with the pattern of the marked word in which each starts."""

    def merged(both: Column) -> Column:
        before = running_totals(F.transform(both, lambda o: (o["kind"] < 0).cast("int")))
        named = lambda n: F.transform(both, lambda o, k: _occurrence(o, 0, F.get(marked, F.get(n, k) - 1)["pattern"]).withField("kind", o["kind"]))
        return let(before, lambda n: F.filter(named(n), lambda o: o["kind"] >= 0))

    return F.when(F.size(base) > 0, let(F.sort_array(F.concat(base, marked)), merged)).otherwise(base)


def _base(text: Column, digit: Column) -> Column:
    def one(k: int, kind: str) -> Column:
        wanted = F.contains(text, F.lit(NEEDS[kind])) & digit if NEEDS[kind] and kind != "email" else F.contains(text, F.lit("@")) if kind == "email" else digit
        found = F.when(wanted, spans(text, PATTERNS[kind])).otherwise(no_spans())
        return F.transform(F.filter(found, lambda s: _valid(kind, s["match"])), lambda s: _occurrence(s, k, F.lit(None).cast("string")))

    return F.sort_array(F.concat(*[one(k, kind) for k, kind in enumerate(BASE_KINDS)]))


def _candidates(marked: Column, base: Column) -> Column:
    """Identifier-like words, without marks around them, that overlap no base span."""

    def trimmed(s: Column) -> Column:
        lead = F.length(F.regexp_extract(s["match"], "^[^A-Za-z0-9]*", 0))
        core = F.regexp_extract(s["match"], "^[^A-Za-z0-9]*+(.*[A-Za-z0-9])", 1)
        return let(core, lambda c: F.struct((s["start"] + lead).alias("start"), (s["start"] + lead + F.length(c)).alias("end"), c.alias("match"), s["pattern"].alias("pattern")))

    def wanted(s: Column) -> Column:
        size, digits = F.length(s["match"]), F.length(_digits(s["match"]))
        return size.between(SHORTEST, LONGEST) & (digits >= FEWEST_DIGITS) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    words = F.filter(marked, lambda s: s["match"].rlike("[0-9]"))
    return F.transform(F.filter(F.transform(words, trimmed), wanted), lambda s: _occurrence(s, len(BASE_KINDS), s["pattern"]))


def occurrences(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep…, digest, base, candidates): what the texts hold. One pass over them, stored without them."""
    whole = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(*keep, whole.alias("_text")).withColumn("_digit", F.col("_text").rlike("[0-9]"))
    read = read.withColumn("base", _base(F.col("_text"), F.col("_digit")))
    none = F.array().cast("array<struct<start: int, kind: int, end: int, match: string, pattern: string>>")
    read = read.withColumn("_marked", F.when(F.col("_digit") | (F.size("base") > 0), _marked(F.col("_text"))).otherwise(none))
    read = read.withColumns({"base": _with_patterns(F.col("base"), F.col("_marked")), "candidates": _candidates(F.col("_marked"), F.col("base"))})
    return checkpointed(read.select(*keep, F.unhex(F.md5("_text")).alias("digest"), "base", "candidates"))


def graph(found: DataFrame) -> DataFrame:
    """(pattern, instance, n, seed): occurrences added up per pattern and instance."""
    told = found.select(F.explode(F.concat("base", "candidates")).alias("o")).where("o.pattern is not null")
    edges = told.select("o.pattern", F.lower("o.match").alias("instance"), (F.col("o.kind") < len(BASE_KINDS)).alias("seed"))
    return checkpointed(edges.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed")))


def confident_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, confidence) of the patterns that may find others, after ``rounds`` rounds."""
    trust = edges.select("*", F.col("seed").cast("double").alias("trust"))
    for k in range(rounds):
        scored = trust.groupBy("pattern").agg(
            (F.sum(F.col("n") * F.col("trust")) / F.sum("n")).alias("confidence"), F.sum((F.col("trust") >= 0.5).cast("long")).alias("trusted")
        )
        patterns = scored.where((F.col("trusted") >= LEAST_INSTANCES) & (F.col("confidence") >= LEAST_CONFIDENCE)).select("pattern", "confidence")
        if k + 1 < rounds:
            doubt = F.sum(F.log(1 - F.least("confidence", F.lit(MOST_TRUST))))
            told = edges.join(small_side(patterns), "pattern").groupBy("instance").agg((1 - F.exp(doubt)).alias("told"))
            held = edges.join(small_side(told), "instance", "left")
            trust = checkpointed(held.select(*edges.columns, F.when(F.col("seed"), 1.0).otherwise(F.coalesce("told", F.lit(0.0))).alias("trust")))
    return patterns


def personal_data(docs: DataFrame, keep: list[str], text: str = "text", out: str = "pii") -> DataFrame:
    """The ``keep`` columns of each row and its spans as ``out``, an array of (start, kind, end); kind is a place in ``KINDS``."""
    held = Apart(docs.select(*dict.fromkeys([*keep, text])))
    own = [held[c] for c in keep]
    found = occurrences(held.df, held[text], own)
    patterns = small_side(confident_patterns(graph(found)))
    told = found.select("digest", F.explode("candidates").alias("o")).select("digest", "o.start", "o.kind", "o.end", "o.pattern")
    new = told.join(patterns, "pattern", "left_semi").groupBy("digest").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("_new"))
    base = F.transform("base", lambda o: F.struct(o["start"].alias("start"), o["kind"].alias("kind"), o["end"].alias("end")))
    none = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    joined = found.join(small_side(new), "digest", "left")
    spans_ = F.sort_array(F.concat(base, F.coalesce("_new", none))).alias(out)
    return joined.select(*[F.col(c).alias(name) for c, name in zip(own, keep, strict=True) if name != out], spans_)


def listed(found: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

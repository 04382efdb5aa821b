"""Column helpers over whole texts, in built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def places(n: Column | int) -> Column:
    """0, 1, … n - 1; an empty array if n is not positive."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))


def matches(text: Column | str, pattern: str) -> Column:
    """All matches of a pattern, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def words_of(text: Column | str, pattern: str = WORD) -> Column:
    """The words of a text; none for null."""
    return F.coalesce(matches(text, pattern), F.array().cast("array<string>"))


CHUNK = 256


def running_totals(lengths: Column) -> Column:
    """Sums of all elements before each element.

    Appending to an array copies it, so sums are taken inside chunks and over chunks:
    n * CHUNK + (n / CHUNK)^2 copies instead of n^2.
    """

    def prefix(values: Column, start: Column) -> Column:
        step = F.aggregate(
            values,
            F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, v: F.struct((acc["at"] + v).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        )
        return step["out"]

    def chunked(values: Column) -> Column:
        chunks = F.transform(places(F.ceil(F.size(values) / CHUNK).cast("int")), lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK)))
        sums = lambda cs: F.transform(cs, lambda c: F.aggregate(c, F.lit(0), lambda a, v: a + v))
        return let(chunks, lambda cs: let(prefix(sums(cs), F.lit(0)), lambda starts: F.flatten(F.transform(cs, lambda c, k: prefix(c, F.get(starts, k))))))

    return let(lengths, lambda v: F.when(F.size(v) <= CHUNK, prefix(v, F.lit(0))).otherwise(chunked(v)))


SPAN = "struct<start: int, end: int, match: string, left: string>"


def spans(text: Column | str, pattern: str) -> Column:
    """Matches of a pattern with their place: array of (start, end, match, left), in code points, end exclusive.

    The gaps between matches come from a split by the same pattern, so the place of a
    match is the length of all gaps and matches before it. ``left`` is the gap
    before the match.
    """
    text = F.col(text) if isinstance(text, str) else text

    def placed(found: Column, gaps: Column) -> Column:
        before = running_totals(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m)))

        def one(at: Column, k: Column) -> Column:
            start, match = at + F.length(F.get(gaps, k)), F.get(found, k)
            return F.struct(
                start.cast("int").alias("start"), (start + F.length(match)).cast("int").alias("end"), match.alias("match"), F.get(gaps, k).alias("left")
            )

        return F.transform(before, one)

    def some(found: Column) -> Column:
        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda gaps: placed(found, gaps))).otherwise(no_spans())

    return let(matches(text, pattern), some)


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")

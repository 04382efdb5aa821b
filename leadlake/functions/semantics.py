"""Column rules shared by all operators, each written once.

Text keys ignore case, accents and trailing spaces; rates are computed in whole
numbers so that they are exact; no rule reads the wall clock.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_KEY_COLLATION = "UNICODE_CI_AI_RTRIM"
EXACT_SUM = "decimal(38,2)"
EXACT_AVG = "decimal(38,6)"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ci_key(c: Column | str) -> Column:
    """Grouping and comparison key that ignores case, accents and trailing spaces."""
    return F.collate(as_col(c), TEXT_KEY_COLLATION)


def phone_key(c: Column | str) -> Column:
    """A plain key that phones equal without case, accents and trailing spaces share.

    Texts of printable ASCII are equal then if their lower-case forms are; all others share
    one key. Rows found by the key still have to be compared.
    """
    text = as_col(c)
    return F.when(text.rlike(r"^[\x20-\x7e]*$"), F.lower(F.rtrim(text))).otherwise(F.lit("?"))


def is_blank(c: Column | str) -> Column:
    """Missing in the sense of the intake forms: NULL or the empty string."""
    c = as_col(c).cast("string")
    return c.isNull() | (c == "")


def blank_to_null(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(c.cast("string") != "", c)


def any_blank(cols: Sequence[str]) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | is_blank(c)
    return out


def count_where(cond: Column, weight: Column | None = None) -> Column:
    """Number of rows meeting ``cond``; NULL on empty input, as a sum is."""
    one = F.lit(1) if weight is None else weight
    return F.sum(F.when(cond, one).otherwise(0)).cast("bigint")


def pct1(part: Column, whole: Column) -> Column:
    """100*part/whole to one decimal, half up, NULL when ``whole`` is 0 (both non-negative)."""
    part, whole = part.cast("decimal(20,0)"), whole.cast("decimal(20,0)")
    tenths = F.floor((part * 2000 + whole) / F.nullif(whole * 2, F.lit(0).cast("decimal(20,0)")))
    return (tenths.cast("double") / 10).cast("double")


def mean1(total: Column, n: Column) -> Column:
    """total/n to one decimal, half up, NULL when ``n`` is 0 (non-negative totals)."""
    total, n = total.cast("decimal(20,0)"), n.cast("decimal(20,0)")
    tenths = F.floor((total * 20 + n) / F.nullif(n * 2, F.lit(0).cast("decimal(20,0)")))
    return tenths.cast("double") / 10


def exact_sum(c: Column | str) -> Column:
    """Decimal sum in the widest type, so it cannot overflow however many rows there are."""
    return F.sum(as_col(c).cast("decimal(28,2)")).cast(EXACT_SUM)


def mean_money(total: Column, n: Column, digits: int = 6) -> Column:
    """Average amount, rounded half up; NULL when ``n`` is 0."""
    whole = F.nullif(n.cast("decimal(18,0)"), F.lit(0).cast("decimal(18,0)"))
    return F.round(total.cast("decimal(30,2)") / whole, digits).cast(f"decimal(38,{digits})")


def enum_rank(c: Column | str, values: Sequence[str]) -> Column:
    """Position in the declared order: the sort order of value-list columns."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), as_col(c))


def lower_value(c: Column | str) -> Column:
    """Canonical spelling of a value-list entry."""
    return F.lower(F.rtrim(as_col(c)))


def moment(value: str | dt.datetime | dt.date) -> Column:
    """A zoneless timestamp literal."""
    if isinstance(value, dt.datetime):
        text = value.isoformat(sep=" ")
    elif isinstance(value, dt.date):
        text = f"{value.isoformat()} 00:00:00"
    else:
        text = value
    return F.lit(text).cast("timestamp_ntz")


def months_before(as_of: str | dt.datetime, months: int) -> Column:
    """``as_of`` minus whole months: keeps the time of day, clamps the day of the month."""
    return moment(as_of) - F.expr(f"interval {int(months)} month")


def day_range(
    c: Column | str, date_from: str | None, date_to: str | None, whole_last_day: bool
) -> Column:
    """Range filter that stays pushable.

    With ``whole_last_day`` every moment of the last day counts; without it the
    range ends at that day's midnight.
    """
    c = as_col(c)
    cond = F.lit(True)
    if date_from:
        cond = cond & (c >= moment(date_from))
    if date_to and whole_last_day:
        cond = cond & (c < moment(dt.date.fromisoformat(date_to) + dt.timedelta(days=1)))
    elif date_to:
        cond = cond & (c <= moment(date_to))
    return cond


def month_key(c: Column | str) -> Column:
    return F.date_format(as_col(c), "yyyy-MM")


def iso_instant(c: Column | str) -> Column:
    return F.date_format(as_col(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def search_any(cols: Sequence[Column | str], term: str, literal: bool = True) -> Column:
    """Any of ``cols`` contains ``term``, ignoring case and accents.

    With ``literal=False`` the signs ``%`` and ``_`` in the term are wildcards
    (then case is ignored and accents are not, since LIKE has no accent-free form).
    """
    out = F.lit(False)
    for c in cols:
        if literal:
            hit = F.contains(ci_key(c), ci_key(F.lit(term)))
        else:
            hit = as_col(c).ilike(f"%{term}%")
        out = out | F.coalesce(hit, F.lit(False))
    return out


def pad_number(c: Column | str, prefix: str = "PAT-", width: int = 5) -> Column:
    """Prefix and zero-padded number; longer numbers are never cut."""
    return F.format_string(f"{prefix}%0{width}d", as_col(c).cast("bigint"))


def leading_number(c: Column | str) -> Column:
    """The number at the start of a text, 0 if there is none."""
    text = F.regexp_extract(
        F.trim(as_col(c).cast("string")), r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0
    )
    amount = text.try_cast("double").cast("decimal(38,6)")
    return F.coalesce(amount, F.lit(0).cast("decimal(38,6)"))


def shown(c: Column | str) -> Column:
    """Text of a value inside a sentence; NULL is written out."""
    return F.coalesce(as_col(c).cast("string"), F.lit("null"))


def sentence(*parts: Column | str) -> Column:
    """Join literal texts (str) and values (Column)."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else shown(p) for p in parts])


def top_k(df: DataFrame, n: int | None, *order: Column) -> DataFrame:
    """The first ``n`` rows in a total order (all rows when ``n`` is None)."""
    ordered = df.orderBy(*order)
    return ordered if n is None else ordered.limit(n)


def first_per_key(df: DataFrame, keys: Sequence[Column | str], *order: Column) -> DataFrame:
    """The first row of each key. Rank limits are applied before the shuffle too,
    so a key with very many rows sends one row per input task."""
    from pyspark.sql import Window

    w = Window.partitionBy(*[as_col(k) for k in keys]).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")

"""Pages of a totally ordered list: early ones by a top-k, late ones by range, and by cursor.

A top-k keeps as many rows per task as the page's last place, which for a late page is nearly all of
them. For a late page the sort keys alone are dealt into ranges, ranges are counted, and only the
range that holds the page is put in order; the page's rows are then looked up by their key.
A cursor needs neither: it asks for the rows behind the last one seen.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions import semantics as S
from leadlake.functions.lookup import POINTS, among
from leadlake.functions.reliability import checkpointed

#: Pages that end behind this place are found by ranges.
EARLY = 50_000


class SortKey(NamedTuple):
    """A sort expression under a name. NULLs come first ascending and last descending."""

    name: str
    value: Column
    descending: bool = False

    def ordered(self) -> Column:
        return self.value.desc_nulls_last() if self.descending else self.value.asc_nulls_first()

    def stored(self) -> Column:
        """The order on a column that holds the value under the key's name."""
        return self._replace(value=F.col(self.name)).ordered()


def order_by(keys: Sequence[SortKey]) -> list[Column]:
    return [k.ordered() for k in keys]


def page(df: DataFrame, page_no: int, limit: int, keys: Sequence[SortKey], cap: int | None = None, early: int = EARLY) -> DataFrame:
    """One page in order. The last key must be a unique column of ``df`` (its ``id``)."""
    size = min(limit, cap) if cap else limit
    first = (page_no - 1) * size
    if first + size <= early:
        return df.orderBy(*order_by(keys)).offset(first).limit(size)
    return _by_ranges(df, first, size, keys)


def _by_ranges(df: DataFrame, first: int, size: int, keys: Sequence[SortKey]) -> DataFrame:
    unique = keys[-1].name
    dealt = df.select(*[k.value.alias(k.name) for k in keys]).repartitionByRange(*[k.stored() for k in keys])
    ranges = checkpointed(dealt.withColumn("_range", F.spark_partition_id()))  # a new sample would cut elsewhere
    counts = sorted(ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())  # a row per range
    before, wanted, skip = 0, [], 0
    for number, n in counts:
        if before < first + size and before + n > first:
            if not wanted:
                skip = first - before
            wanted.append(number)
        before += n
    cut = ranges.where(F.col("_range").isin(wanted)).orderBy(*[k.stored() for k in keys]).offset(skip).limit(size)
    ids = cut.select(F.col(unique))
    rows = among(df, unique, ids) if size <= POINTS else df.join(checkpointed(ids), unique, "left_semi").select(*df.columns)
    return rows.orderBy(*order_by(keys))


def cursor(keys: Sequence[SortKey], row: Mapping) -> dict:
    """What :func:`rows_after` has to be told of a page's last row."""
    return {k.name: row[k.name] for k in keys}


def rows_after(df: DataFrame, last: Mapping | None, limit: int, keys: Sequence[SortKey]) -> DataFrame:
    """The first ``limit`` rows behind ``last`` (see :func:`cursor`), in order; from the start if it is None.

    The condition is on the sort keys themselves, so it reaches the scan where they are plain columns, and
    the top-k holds ``limit`` rows per task however deep the reader has come. The frame has the sort
    keys as columns of their names, to take the next cursor from.
    """
    named = df.withColumns({k.name: k.value for k in keys if k.name not in df.columns})
    if last is not None:
        # behind in the first key; or equal there and behind in the second; and so on
        behind, equal = F.lit(False), F.lit(True)
        for k in keys:
            given = S.moment(last[k.name]) if isinstance(last[k.name], dt.datetime) else F.lit(last[k.name])
            if last[k.name] is None:
                here = F.lit(False) if k.descending else k.value.isNotNull()
                same = k.value.isNull()
            else:
                here = (k.value < given) | k.value.isNull() if k.descending else k.value > given
                same = k.value == given
            behind = behind | (equal & F.coalesce(here, F.lit(False)))
            equal = equal & F.coalesce(same, F.lit(False))
        named = named.where(behind)
    return named.orderBy(*order_by(keys)).limit(limit)

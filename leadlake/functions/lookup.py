"""Finding the few rows of a large table that a batch names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.functions.reliability import checkpointed, sized_side

#: Up to so many different values are written into the filter itself.
POINTS = 1000


def among(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` is one of the values of a one-column frame; nulls match nothing.

    A few values become an IN filter, which files are asked with: row groups whose statistics
    or Bloom filter exclude them are not read. More are broadcast while they are counted to
    be few enough, and only then ``df`` is shuffled.
    """
    kind = df.schema[column].dataType
    asked = values.select(F.col(values.columns[0]).try_cast(kind).alias(column)).where(F.col(column).isNotNull())
    asked = checkpointed(asked.distinct())
    listed = [r[0] for r in asked.limit(POINTS + 1).collect()]
    if len(listed) <= POINTS:
        return df.where(F.col(column).isin(listed)) if listed else df.where(F.lit(False))
    return df.join(sized_side(asked), column, "left_semi").select(*df.columns)

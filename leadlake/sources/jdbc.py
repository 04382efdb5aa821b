"""The tables in a relational database, through Spark's JDBC source.

Needs the database's driver jar on the class path. Rows are read in parallel by
ranges of the id; the ranges cover every id, whatever its form.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.schema import TABLES, has_id, spark_type
from leadlake.sources.tables import Tables, finish, stored

ID_STARTS = "123456789abcdef"


def id_ranges(starts: Sequence[str] = ID_STARTS, column: str = "id") -> list[str]:
    """Predicates that split all ids by their beginning, each id in exactly one."""
    bounds = sorted(starts)
    first, last = f"{column} < '{bounds[0]}'", f"{column} >= '{bounds[-1]}'"
    inner = [f"{column} >= '{a}' AND {column} < '{b}'" for a, b in zip(bounds, bounds[1:])]
    return [first, *inner, last]


def read_table(
    spark: SparkSession, url: str, table: str, properties: Mapping[str, str], starts: Sequence[str] = ID_STARTS
) -> DataFrame:
    """One table, in one task per range between ``starts``: give more of them for a large table,
    and such that fit its ids if these are no hex digests."""
    if has_id(table):
        df = spark.read.jdbc(url, table, predicates=id_ranges(starts), properties=dict(properties))
    else:
        df = spark.read.jdbc(url, table, properties=dict(properties))
    return finish(df.select(*[F.col(c.name).cast(spark_type(c.kind)).alias(c.name) for c in TABLES[table]]), table)


def read_database(
    spark: SparkSession, url: str, properties: Mapping[str, str], starts: Mapping[str, Sequence[str]] | None = None
) -> Tables:
    """All tables, each read when first used; ``starts`` gives single tables their own id ranges."""
    own = starts or {}
    return Tables(
        {name: (lambda name=name: read_table(spark, url, name, properties, own.get(name, ID_STARTS))) for name in TABLES}
    )


def append_table(df: DataFrame, table: str, url: str, properties: Mapping[str, str]) -> None:
    """Append rows to a database table (computed columns are left to the database)."""
    stored(df, table).write.jdbc(url, table, mode="append", properties=dict(properties))

"""Checks of references, unique keys and value domains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlake.functions import semantics as S
from leadlake.schema import REFERENCES, UNIQUE_KEYS, has_id
from leadlake.sources.tables import Tables, enum_violations


def fk_violations(t: Tables) -> DataFrame:
    """References without a row: child table and column, the missing id, how many rows name it.

    Each table is read once for all its references. References are counted per id
    before the check, so how many rows name an id does not matter.
    """
    named = []
    for child in dict.fromkeys(c for c, _, _ in REFERENCES):
        refs = [
            F.struct(
                F.lit(column).alias("column_name"), F.lit(parent).alias("parent"),
                F.col(column).cast("string").alias("missing_id"),
            )
            for c, column, parent in REFERENCES if c == child
        ]
        named.append(
            t[child].select(F.inline(F.array(*refs))).where("missing_id IS NOT NULL")
            .groupBy(F.lit(child).alias("table_name"), "column_name", "parent", "missing_id")
            .agg(F.count(F.lit(1)).alias("rows"))
        )
    ids = [
        t[parent].select(F.lit(parent).alias("parent"), F.col("id").cast("string").alias("missing_id"))
        for parent in dict.fromkeys(p for _, _, p in REFERENCES)
    ]
    missing = reduce(DataFrame.unionByName, named).join(
        reduce(DataFrame.unionByName, ids), ["parent", "missing_id"], "left_anti"
    )
    return missing.select("table_name", "column_name", "missing_id", "rows")


def orphans(t: Tables, child: str, column: str) -> DataFrame:
    """Rows of ``child`` whose ``column`` names a missing row."""
    parent = next(p for c, k, p in REFERENCES if (c, k) == (child, column))
    ids = t[parent].select(F.col("id").alias(column))
    return t[child].where(F.col(column).isNotNull()).join(ids, column, "left_anti").select(*t[child].columns)


def key_violations(t: Tables) -> DataFrame:
    """Keys held by several rows, and values outside their domain.

    Text keys compare without case, accents and trailing spaces. They are counted as
    stored first, so the slower accent-free grouping sees each spelling once.
    """
    found = []
    keys = [(table, ("id",)) for table in t if has_id(table)]
    keys += [(table, key) for table, many in UNIQUE_KEYS.items() for key in many]
    for table, key in keys:
        df = t[table]
        counted = df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
        text = [c for c in key if isinstance(df.schema[c].dataType, T.StringType) and c != "id"]
        if text:
            counted = counted.groupBy(*[S.ci_key(c).alias(f"_{c}") if c in text else F.col(c) for c in key]).agg(
                F.sum("rows").alias("rows"), *[F.min(c).alias(c) for c in text]
            )
        value = F.lower(F.rtrim(F.concat_ws("|", *key)))
        found.append(
            counted.where("rows > 1").select(
                F.lit("unique").alias("rule"), F.lit(table).alias("table_name"),
                F.lit(",".join(key)).alias("column_name"), value.alias("value"), "rows",
            )
        )
    domain = enum_violations(t).select(F.lit("domain").alias("rule"), "table_name", "column_name", "value", "rows")
    return reduce(DataFrame.unionByName, found + [domain])

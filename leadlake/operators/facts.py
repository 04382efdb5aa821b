"""Shared aggregation steps: shrink the facts by id first, name them afterwards.

Dashboards group large facts by the *name* of a small dimension. Joining first
would shuffle or replicate around the fact; instead each fact is partially
aggregated by the id columns (map-side, so a key holding a third of all rows
costs one row per task), and only the aggregate meets the dimension.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions import semantics as S
from leadlake.sources.tables import Tables

# Columns a lead cell may be keyed by; every measure below is additive over cells.
CELL_KEYS = ("lead_stage", "lead_source", "campaign_name", "speciality_id", "facility_id", "doctor_id")


def lead_cells(t: Tables, *keys: str | Column) -> DataFrame:
    """Leads as additive cells: ``leads``, ``customers`` and the given keys.

    Reads ``t.lead_cube`` when a bundle has prepared one, else the leads themselves.
    """
    source = t["lead_cube"] if "lead_cube" in t else t.leads.withColumn("n", F.lit(1).cast("bigint"))
    return source.groupBy(*keys).agg(
        F.sum("n").alias("leads"),
        S.count_where(F.col("lead_stage") == "customer", F.col("n")).alias("customers"),
    )


def revenue_per_lead(t: Tables) -> DataFrame:
    """One row per billed lead: ``revenue``, ``bills`` (from ``t.lead_bills`` when a bundle has prepared it)."""
    if "lead_bills" in t:
        return t["lead_bills"].select("lead_id", F.col("total_value").alias("revenue"), "bills")
    return t.revenue.groupBy("lead_id").agg(
        S.exact_sum("total_value").alias("revenue"), F.count(F.lit(1)).alias("bills")
    )


def revenue_cells(t: Tables, *keys: str) -> DataFrame:
    """Revenue of leads by lead columns. Both join sides are unique in the lead id,
    so no lead's share of the bills can skew the join."""
    if "revenue_cube" in t:
        source = t["revenue_cube"]
    else:
        source = t.leads.select(F.col("id").alias("lead_id"), *keys).join(revenue_per_lead(t), "lead_id")
    return source.groupBy(*keys).agg(
        F.sum("revenue").cast(S.EXACT_SUM).alias("revenue"), F.sum("bills").alias("bills")
    )


def name_by(
    cells: DataFrame, names: Mapping[str, tuple[DataFrame, str]], measures: Sequence[str]
) -> DataFrame:
    """Replace id keys by dimension names and add up cells whose names are equal.

    ``names`` maps an id column to (dimension, output column). Joins are inner.
    The joined sides are aggregates and dimensions; Spark broadcasts the smaller
    one when its measured size allows and shuffles otherwise.
    """
    for key, (dim, out) in names.items():
        cells = cells.join(dim.select(F.col("id").alias(key), F.col("name").alias(out)), key)
    outs = [out for _, out in names.values()]
    return _regroup(cells, outs, measures)


def _regroup(cells: DataFrame, text_keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    types = dict(cells.dtypes)
    keyed = cells.groupBy(*[S.ci_key(k).alias(f"_{k}") for k in text_keys]).agg(
        *[F.min(k).alias(k) for k in text_keys],
        *[F.sum(m).cast(types[m]).alias(m) for m in measures],
    )
    return keyed.select(*text_keys, *measures)


def merge_spellings(cells: DataFrame, key: str, measures: Sequence[str]) -> DataFrame:
    """Add up cells whose text keys differ only in case, accents or trailing spaces."""
    return _regroup(cells, [key], measures)

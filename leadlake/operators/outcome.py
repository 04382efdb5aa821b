"""What a write job returns."""

from __future__ import annotations

from collections.abc import Mapping
from types import MappingProxyType
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions.reliability import checkpointed
from leadlake.sources.tables import Tables


class Outcome(NamedTuple):
    """New tables, refused input rows (with ``reason``) and the accepted input rows.

    ``appended`` holds the new rows of tables that only grew, ``changed`` names the tables with
    updated or deleted rows: what a sink has to write.
    """

    tables: Tables
    rejects: DataFrame
    accepted: DataFrame
    appended: Mapping[str, DataFrame] = MappingProxyType({})
    changed: tuple[str, ...] = ()


def split_rejects(
    batch: DataFrame, *rules: tuple[Column, str], once: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Split a batch by its first broken rule; returns (accepted, rejects with ``reason``).

    With ``once`` the judged batch is checkpointed, so that the joins behind the rules run
    once however often a job reads the two parts.
    """
    reason = F.lit(None).cast("string")
    for cond, text in reversed(rules):
        reason = F.when(cond, F.lit(text)).otherwise(reason)
    judged = batch.withColumn("reason", reason)
    if once:
        judged = checkpointed(judged)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")

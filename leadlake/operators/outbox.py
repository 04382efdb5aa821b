"""Outgoing events: one JSON message per event and active webhook."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions import semantics as S
from leadlake.operators.listing import active_webhooks
from leadlake.sources.tables import Tables

SOURCE = "leadlake"
LEAD_CREATED, STAGE_CHANGED = "lead_created", "lead_stage_changed"


def _payload(fields: Sequence[Column | str]) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def lead_created_events(leads: DataFrame) -> DataFrame:
    """Events of new leads: the accepted intake rows."""
    return leads.select(
        F.lit(LEAD_CREATED).alias("event_type"), F.col("id").cast("string").alias("entity_id"),
        _payload(leads.columns).alias("data"),
    )


def stage_changed_events(changes: DataFrame, actor=None) -> DataFrame:
    """Events of accepted stage changes (``id``, ``stage``, ``substage``)."""
    fields = [
        F.col("id"), F.col("stage").alias("lead_stage"), F.col("substage").alias("lead_substage"),
        F.lit(actor).cast("string").alias("changed_by"),
    ]
    return changes.select(
        F.lit(STAGE_CHANGED).alias("event_type"), F.col("id").cast("string").alias("entity_id"),
        _payload(fields).alias("data"),
    )


def envelope(event: Column, data: Column, moment: Column, source: str = SOURCE, test: bool = False) -> Column:
    """Message text around a payload that is JSON already."""
    head = [event.alias("event"), S.iso_instant(moment).alias("timestamp"), F.lit(source).alias("source")]
    if test:
        head.append(F.lit(True).alias("test"))
    text = F.to_json(F.struct(*head))
    return F.concat(F.regexp_replace(text, r"\}$", ""), F.lit(',"data":'), data, F.lit("}"))


def route(events: DataFrame, hooks: DataFrame, moment: Column, source: str = SOURCE, test: bool = False) -> DataFrame:
    """Join events (``event_type``, ``entity_id``, ``data``) to hooks (``event_type``, ``url``).

    The hook table has one row per event type, so Spark broadcasts it by its size.
    """
    targets = hooks.select(S.ci_key("event_type").alias("_event"), "url")  # as the hooks' key compares
    return events.withColumn("_event", S.ci_key("event_type")).join(targets, "_event").select(
        "event_type", "entity_id", "url",
        envelope(F.col("event_type"), F.col("data"), moment, source, test).alias("body"),
    )


def event_outbox(t: Tables, events: DataFrame, as_of, source: str = SOURCE, test: bool = False) -> DataFrame:
    return route(events, active_webhooks(t), S.moment(as_of), source, test)

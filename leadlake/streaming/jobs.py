"""The event-driven parts as Structured Streaming jobs.

Each job is restartable: Spark's checkpoint numbers the micro-batches and holds the keyed state,
and what a micro-batch writes itself lies under its number, so a repeated batch
replaces its own output and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leadlake.operators import outbox as O
from leadlake.operators import stage_engine as G
from leadlake.operators.outcome import Outcome
from leadlake.schema import columns
from leadlake.sources.tables import Tables, commit_snapshot, committed_versions, file_system, load_tables

STATE_COLUMNS = ("id", *G.STATE)


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of parquet files with a declared schema."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _start(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def append_files(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream to a folder of parquet files, each row once."""
    return _start(stream.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint, available_now)


# --- stage engine ----------------------------------------------------------------------

#: Sequence numbers of one slice: a lead's events of different slices are different keys.
SLICE_NUMBERS = 1_000_000_000
#: Keys that leads are dealt to. A key's call costs milliseconds, so it shall hold some hundred leads;
#: a micro-batch writes the state of the keys it names.
BUCKETS = 256
_FACTS = {
    "attempts": "long", "changed": "boolean", "stage": "string", "substage": "string", "at_change": "long", "at_miss": "long", "followup": "int",
}
_FIRST = {"attempts": 0, "changed": False, "stage": None, "substage": None, "at_change": -1, "at_miss": -1, "followup": -1}  # -1: none yet


def _folded(old: dict[str, np.ndarray], events: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Facts per lead after some more events, each lead's taken in order of their sequence; and which leads had any."""
    leads, code = np.unique(np.concatenate([old["lead_id"], events["lead_id"]]), return_inverse=True)
    had, code = code[: len(old["lead_id"])], code[len(old["lead_id"]) :]
    new = {"lead_id": leads}
    for c, first in _FIRST.items():
        new[c] = np.full(len(leads), first, object if first is None else None)
        new[c][had] = old[c]
    order = np.lexsort((events["seq"], code))
    code, rows = code[order], {c: v[order] for c, v in events.items()}
    upto = np.cumsum(rows["attempt"])
    starts = np.concatenate(([0], np.nonzero(np.diff(code))[0] + 1))
    before = (upto - rows["attempt"])[starts]
    sizes = np.diff(np.concatenate((starts, [len(code)])))
    run = upto - np.repeat(before, sizes) + new["attempts"][code]
    # rows are in order, so the last one of a lead stays
    for c, where, value in (
        ("attempts", np.ones(len(code), bool), run), ("changed", rows["changed"], rows["changed"]), ("stage", rows["changed"], rows["stage"]),
        ("substage", rows["changed"], rows["substage"]), ("at_change", rows["changed"], run), ("at_miss", rows["missed"], run),
        ("followup", rows["followup"] >= 0, rows["followup"]),
    ):
        new[c][code[where]] = value[where]
    return new, np.unique(code)


def _fold(tell: bool):
    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        events = {c: np.concatenate([f[c].to_numpy() for f in parts]) for c in parts[0].columns}
        names = ("lead_id", *_FACTS)
        kinds = {c: events["lead_id"].dtype if c == "lead_id" else np.array([_FIRST[c]]).dtype for c in names}
        held = dict(zip(names, state.get, strict=True)) if state.exists else {c: [] for c in names}
        new, touched = _folded({c: np.array(held[c], kinds[c]) for c in names}, events)
        state.update(tuple(new[c].tolist() for c in names))
        if tell:
            yield pd.DataFrame({"lead_id": new["lead_id"][touched], "slice": key[1], **{c: new[c][touched] for c in _FACTS}})

    return fold


def stage_facts(events: DataFrame, numbers: int = SLICE_NUMBERS, buckets: int = BUCKETS, tell: bool = True) -> DataFrame:
    """What a stream of log events (see :func:`stage_engine.log_events`) comes to so far, per lead
    and slice of the sequence: keyed state that Spark keeps. With ``tell``, each micro-batch gives its leads' new facts.

    No lead is read: the facts are sums and last values, whatever state the lead started in. A key is a
    bucket of leads in a slice, folded by arrays; a lead with very many events has many slices,
    which are folded in different tasks.
    """
    first = F.lit("1970-01-01").cast("date")
    rows = events.where(F.col("lead_id").isNotNull()).select(
        F.pmod(F.xxhash64("lead_id"), F.lit(int(buckets))).alias("bucket"), F.expr(f"seq div {int(numbers)}L").alias("slice"),
        "lead_id", "seq", F.col("attempt").cast("long"), "missed", F.col("change").isNotNull().alias("changed"),
        F.col("change.stage").alias("stage"), F.col("change.substage").alias("substage"),
        F.coalesce(F.date_diff("followup_date", first), F.lit(-1)).alias("followup"),
    )
    lead = rows.schema["lead_id"].dataType.simpleString()
    told = ", ".join(f"{c} {kind}" for c, kind in _FACTS.items())
    kept = ", ".join(f"{c} array<{kind}>" for c, kind in {"lead_id": lead, **_FACTS}.items())
    return rows.groupBy("bucket", "slice").applyInPandasWithState(
        _fold(tell), f"lead_id {lead}, slice long, {told}", kept, "update", GroupStateTimeout.NoTimeout
    )


def stage_stream(
    events: DataFrame, checkpoint: str, available_now: bool = True, numbers: int = SLICE_NUMBERS, buckets: int = BUCKETS,
    sink: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Advance lead stages from a stream of log events. :func:`lead_state` reads the result.

    State and progress live in the query's checkpoint, so a restarted query (with the same ``numbers`` and
    ``buckets``) goes on where the last finished micro-batch ended, and each event counts once. Events go by
    their sequence; one that comes in a later micro-batch than its successors counts as the last of its
    slice so far. ``sink`` gets each micro-batch's new facts.
    """
    writer = stage_facts(events, numbers, buckets, sink is not None).writeStream.outputMode("update")
    writer = writer.foreachBatch(sink) if sink else writer.format("noop")
    return _start(writer, checkpoint, available_now)


def streamed_facts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The facts per lead (as :func:`stage_engine.summarise` gives them) after the last finished micro-batch."""
    fs, root = file_system(spark, f"{checkpoint}/state")
    if not fs.exists(root):
        raise FileNotFoundError(f"no finished micro-batch under {checkpoint}")
    state = spark.read.format("statestore").load(checkpoint).select("key.slice", "value.groupState.*")
    state = state.select("slice", F.inline(F.arrays_zip("lead_id", *_FACTS)))
    known = lambda c: F.when(F.col(c) >= 0, F.col(c))
    slices = state.select(
        "lead_id", F.col("slice").alias("_slice"), F.col("attempts").alias("_attempts"),
        F.when(F.col("changed"), F.struct("stage", "substage")).alias("_change"), known("at_change").alias("_at_change"),
        known("at_miss").alias("_at_miss"), F.date_add(F.lit("1970-01-01").cast("date"), known("followup")).alias("_followup"),
    )
    return G.joined_slices(slices)


def lead_state(spark: SparkSession, leads: DataFrame, checkpoint: str) -> DataFrame:
    """Current state of the leads: ``leads`` as they were when the stream began, and all events since."""
    return G.with_facts(leads.select(*STATE_COLUMNS), streamed_facts(spark, checkpoint))


# --- events out and audit --------------------------------------------------------------


def outbox_stream(events: DataFrame, hooks: DataFrame, moment: str = "occurred_at", source: str = O.SOURCE) -> DataFrame:
    """Messages for a stream of events (``event_type``, ``entity_id``, ``data``, a time column)."""
    return O.route(events, hooks.where("is_active"), F.col(moment), source)


def audit_stream(changes: DataFrame) -> DataFrame:
    """Audit rows for a stream of recorded changes.

    Input: ``entity_type``, ``entity_id``, ``action``, ``occurred_at`` and optionally
    ``user_id``, ``old_values``, ``new_values``, ``ip_address``.
    """
    out = changes.withColumnRenamed("occurred_at", "created_at")
    for c in ("user_id", "old_values", "new_values", "ip_address"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    key = F.md5(F.concat_ws(
        "|", "entity_type", "entity_id", "action", F.col("created_at").cast("string"), "old_values", "new_values"))
    return out.withColumn("id", key).select(*columns("audit_logs"))


# --- settings --------------------------------------------------------------------------


def upsert_stream(
    stream: DataFrame, lake: str, job: Callable[[Tables, DataFrame], Outcome], changed: tuple[str, ...],
    checkpoint: str, available_now: bool = True,
) -> StreamingQuery:
    """Apply a write job to each micro-batch and commit the result as the next lake version.

    Batch ``n`` of a query started at version ``v`` commits version ``v + n + 1``, and is
    skipped if that version is there, so a repeated batch changes nothing. One writer
    per lake.
    """
    spark = stream.sparkSession
    first = _first_version(spark, lake, checkpoint)

    def step(batch: DataFrame, number: int) -> None:
        version = first + number + 1
        if version in committed_versions(spark, lake):
            return
        done = job(load_tables(spark, lake), batch)
        _drop_unfinished(spark, lake, changed, version)
        commit_snapshot(spark, lake, version, done.tables, changed)

    return _start(stream.writeStream.foreachBatch(step), checkpoint, available_now)


def _first_version(spark: SparkSession, lake: str, checkpoint: str) -> int:
    """Lake version a query started from, remembered beside its checkpoint."""
    fs, path = file_system(spark, f"{checkpoint}_start")
    if not fs.exists(path):
        known = committed_versions(spark, lake)
        row = spark.createDataFrame([(known[-1] if known else -1,)], "version bigint")
        row.coalesce(1).write.json(f"{checkpoint}_start")
    return spark.read.schema("version bigint").json(f"{checkpoint}_start").first()["version"]


def _drop_unfinished(spark: SparkSession, lake: str, tables: tuple[str, ...], version: int) -> None:
    """Remove what a failed attempt at this uncommitted version left behind."""
    for table in tables:
        fs, path = file_system(spark, f"{lake}/{table}/version={version}")
        if fs.exists(path):
            fs.delete(path, True)
    fs, path = file_system(spark, f"{lake}/_commits/{version}")
    if fs.exists(path):
        fs.delete(path, True)


def spend_job(as_of) -> Callable[[Tables, DataFrame], Outcome]:
    from leadlake.operators.writes import upsert_ad_spend

    return lambda t, batch: upsert_ad_spend(t, batch, as_of)


def webhook_job(as_of, actor=None) -> Callable[[Tables, DataFrame], Outcome]:
    from leadlake.operators.writes import upsert_webhooks

    return lambda t, batch: upsert_webhooks(t, batch, as_of, actor)


def settings_job(as_of) -> Callable[[Tables, DataFrame], Outcome]:
    from leadlake.operators.writes import upsert_settings

    return lambda t, batch: upsert_settings(t, batch, as_of)


__all__ = [
    "append_files", "audit_stream", "lead_state", "outbox_stream", "read_stream", "settings_job", "spend_job",
    "stage_facts", "stage_stream", "streamed_facts", "upsert_stream", "webhook_job",
]

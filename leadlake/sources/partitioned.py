"""Tables in month folders that write jobs change in place, month by month.

``<path>/<table>/month=YYYY-MM/`` holds a fact's rows by the date that never changes
(``MONTHS``); small tables are one partition, ``month=all``. A job is run on the months its batch
touches: the batch's ids are looked up first (an IN filter on one column, which Parquet's
statistics and Bloom filters answer for most row groups), only the months found are read and
judged, and their folders are replaced, and no others. New
rows are appended as files of their own. So a one-row update reads and writes one month.

The new months are written once, into a hidden folder beside the tables, before the first folder
is replaced, as they were read from what they replace; then each is moved to its place, as
Spark's dynamic partition overwrite does it. What else a job kept on the way is deleted as soon as
nothing to come reads it. There is one writer, and a change that was broken off, inside a table
or between two, is finished by ``write`` of the same ``Change``, which
may be repeated. Readers that need one state of all tables while a job
writes use the snapshots of :mod:`leadlake.sources.tables`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlake.functions import semantics as S
from leadlake.functions.lookup import among
from leadlake.functions.reliability import Scratch, checkpointed, dealt, fit_partitions, reclaim, small_side
from leadlake.operators.outcome import Outcome
from leadlake.schema import TABLES, has_id, struct_type
from leadlake.sources.tables import BY_PHONE, Tables, file_system, finish, stored

#: The date by which a table is cut into months. No job changes it.
MONTHS = {
    "patients": "created_at", "leads": "enquiry_date", "interactions": "interaction_date",
    "appointments": "appointment_date", "revenue": "billed_date", "audit_logs": "created_at",
}
#: Columns that jobs look rows up by: they get Bloom filters.
LOOKUPS = {
    "patients": ("id", "phone_key"), "leads": ("id", "patient_id"), "interactions": ("id", "lead_id"),
    "appointments": ("id", "lead_id", "patient_id"), "revenue": ("id", "lead_id", "patient_id"), "audit_logs": ("entity_id",),
}


class Touch(NamedTuple):
    """Rows that a job may change: those of ``table`` whose ``column`` is in ``source.named``.

    ``source`` is ``batch`` or a table whose rows were found by an earlier touch.
    """

    table: str
    column: str
    source: str
    named: str


_LEADS_BY_ID = (Touch("leads", "id", "batch", "id"),)
_LEADS_OF_ROWS = (Touch("leads", "id", "batch", "lead_id"),)
#: What the write jobs change in place. Jobs that only append touch nothing.
TOUCHES: dict[str, tuple[Touch, ...]] = {
    "ingest_leads": (),
    "create_patients": (),
    "log_emails": (Touch("leads", "id", "batch", "lead_id"),),
    "update_leads": _LEADS_BY_ID,
    "change_stage": _LEADS_BY_ID,
    "save_ai": _LEADS_BY_ID,
    "ingest_interactions": _LEADS_OF_ROWS,
    "book_appointments": (*_LEADS_OF_ROWS,),
    "post_revenue": (*_LEADS_OF_ROWS,),
    "set_visit_status": (Touch("appointments", "id", "batch", "id"), Touch("leads", "id", "appointments", "lead_id")),
    "delete_leads": (*_LEADS_BY_ID, Touch("interactions", "lead_id", "batch", "id")),
    "delete_interactions": (Touch("interactions", "id", "batch", "id"),),
    "update_patients": (Touch("patients", "id", "batch", "id"),),
    "delete_patients": (
        Touch("patients", "id", "batch", "id"), Touch("leads", "patient_id", "batch", "id"),
        Touch("interactions", "lead_id", "leads", "id"),
    ),
    "merge_patients": (
        Touch("patients", "id", "batch", "secondary_id"), Touch("patients", "id", "batch", "primary_id"),
        *(Touch(fact, "patient_id", "batch", "secondary_id") for fact in ("leads", "appointments", "revenue")),
    ),
}


class Change(NamedTuple):
    """Results of a job, still to be written: whole months, in files below ``staged`` until they are
    moved to their place (``changed`` and the outcome's tables read them until then), and
    checkpointed rows to append. ``gone`` are months without rows left."""

    outcome: Outcome
    months: Mapping[str, Sequence[str | None]]
    changed: Mapping[str, DataFrame]
    appended: Mapping[str, DataFrame]
    staged: str
    gone: Mapping[str, Sequence[str | None]]


class PartitionedLake:
    """The tables below ``path``; those not stored there are taken from ``others``.

    ``schema`` gives a table's stored types (ids are text by default).
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: Callable[[str], T.StructType] = struct_type,
        others: Mapping[str, DataFrame] | None = None,
    ):
        self.spark, self.path, self.schema, self.others = spark, path, schema, dict(others or {})

    # --- files -------------------------------------------------------------------------

    def folder(self, table: str) -> str:
        return f"{self.path}/{table}"

    def is_stored(self, table: str) -> bool:
        fs, root = file_system(self.spark, self.folder(table))
        return fs.exists(root)

    def read(self, table: str, folder: str | None = None) -> DataFrame:
        """The stored rows with ``month`` (and a patient's ``phone_key``)."""
        fields = list(self.schema(table).fields)
        if table == "patients":
            fields.append(T.StructField("phone_key", T.StringType()))
        return self.spark.read.schema(T.StructType([*fields, T.StructField("month", T.StringType())])).parquet(folder or self.folder(table))

    def _laid_out(self, table: str, rows: DataFrame) -> DataFrame:
        out = stored(rows, table)
        out = out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema(table)])
        if table == "patients":
            out = out.withColumn("phone_key", S.phone_key("primary_phone"))
        month = S.month_key(MONTHS[table]) if table in MONTHS else F.lit("all")
        return out.withColumn("month", month)

    def _write(self, table: str, laid_out: DataFrame, mode: str, folder: str | None = None) -> None:
        order = ["month"] + (["id"] if has_id(table) else [])
        writer = dealt(laid_out, ["month"]).sortWithinPartitions(*order).write.mode(mode).partitionBy("month")
        for c in LOOKUPS.get(table, ()):
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        # a table of one row group each would otherwise get filters for a million values
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(folder or self.folder(table))

    def create(self, t: Mapping[str, DataFrame], names: Sequence[str] | None = None) -> PartitionedLake:
        """Write tables for the first time (all by default)."""
        for table in names or list(TABLES):
            self._write(table, self._laid_out(table, t[table]), "errorifexists")
            reclaim(self.spark)
        return self

    # --- reading -----------------------------------------------------------------------

    def frame(self, table: str, months: Sequence[str | None] | None = None) -> DataFrame:
        """A table as the operators see it, whole or only some months of it."""
        rows = self.read(table)
        if months is not None:
            known = [m for m in months if m is not None]
            cond = F.col("month").isin(known) if known else F.lit(False)
            rows = rows.where(cond | F.col("month").isNull() if None in months else cond)
        return finish(rows.select(*self.schema(table).names), table)

    def tables(self, months: Mapping[str, Sequence[str | None]] | None = None) -> Tables:
        """All tables; of those in ``months`` only these months."""
        months = months or {}
        kept = [table for table in TABLES if self.is_stored(table)]
        fit_partitions(self.spark, [self.folder(table) for table in kept])
        frames = {table: (lambda table=table: self.frame(table, months.get(table))) for table in kept}
        if "patients" in kept:
            frames[BY_PHONE] = lambda: self.read("patients").select("phone_key", "primary_phone", "id")
        return Tables({**self.others, **frames})

    def touched(self, touches: Sequence[Touch], batch: DataFrame) -> dict[str, list[str | None]]:
        """The months of the rows that a batch may change, by table. Only keys and months are read."""
        found, months = {"batch": batch}, {}
        for touch in touches:
            if not self.is_stored(touch.table):
                continue
            rows = among(self.read(touch.table), touch.column, found[touch.source].select(touch.named))
            found[touch.table] = rows
            listed = [r["month"] for r in rows.select("month").distinct().collect()]
            months[touch.table] = sorted({*months.get(touch.table, ()), *listed}, key=lambda m: (m is None, m or ""))
        return months

    # --- changes -----------------------------------------------------------------------

    def prepare(self, job: Callable[..., Outcome], batch: DataFrame, *args, **kwargs) -> Change:
        """Run a write job on the months its batch touches; nothing is written to the tables."""
        staged = f"{self.path}/.staged-{uuid.uuid4().hex}"
        try:
            return self._prepared(staged, job, batch, *args, **kwargs)
        except BaseException:
            self._drop(staged)
            raise

    def _prepared(self, staged: str, job: Callable[..., Outcome], batch: DataFrame, *args, **kwargs) -> Change:
        changed, gone, given = {}, {}, {id(df) for df in self.others.values()}

        def made(tables: Tables) -> list[DataFrame]:
            return [df for df in tables.built() if id(df) not in given]

        with Scratch(self.spark) as scratch:
            batch = checkpointed(batch.select("*"))  # a frame of its own: the caller's would keep its shuffles
            months = self.touched(TOUCHES.get(job.__name__, ()), batch)
            scratch.sweep(batch)
            done = job(self.tables(months), batch, *args, **kwargs)
            tables, accepted = done.tables, done.accepted
            sources = {table: tables[table] for table in done.changed if self.is_stored(table)}
            scratch.sweep(done.rejects, accepted, *done.appended.values(), *made(tables))
            rejects = checkpointed(done.rejects)
            accepted = accepted if scratch.holds(accepted) else checkpointed(accepted)
            appended = {table: checkpointed(self._laid_out(table, rows)) for table, rows in done.appended.items() if self.is_stored(table)}
            kept = (rejects, accepted, *done.appended.values(), *appended.values())
            scratch.sweep(*kept, *made(tables))
            for table, rows in sources.items():
                folder = f"{staged}/{table}"
                self._write(table, self._laid_out(table, rows), "errorifexists", folder)
                changed[table] = self.read(table, folder)
                left = {r["month"] for r in changed[table].select("month").distinct().collect()}
                gone[table] = [month for month in months.get(table, ()) if month not in left]
                tables = tables.replace(**{table: finish(changed[table].select(*self.schema(table).names), table)})
                scratch.sweep(*kept, *made(tables))
        return Change(Outcome(tables, rejects, accepted, done.appended, done.changed), months, changed, appended, staged, gone)

    def write(self, change: Change) -> Outcome:
        """Replace the touched months and append the new rows. Doing it again changes nothing."""
        fs, staged = file_system(self.spark, change.staged)
        for table in change.changed if fs.exists(staged) else ():
            if table in change.months and not change.months[table]:
                continue  # no row of the batch was found
            self._move(f"{change.staged}/{table}", self.folder(table))
            for month in change.gone[table]:  # all rows of the month are gone
                self._drop(f"{self.folder(table)}/month={'__HIVE_DEFAULT_PARTITION__' if month is None else month}")
        self._drop(change.staged)
        with Scratch(self.spark) as scratch:
            for table, rows in change.appended.items():
                there = among(self.read(table).select("id"), "id", rows.select("id")) if has_id(table) else None
                fresh = rows if there is None else rows.join(small_side(there), "id", "left_anti").select(*rows.columns)
                if not fresh.isEmpty():
                    self._write(table, fresh, "append")
                scratch.sweep()
        done = change.outcome
        return Outcome(self.tables(), done.rejects, done.accepted, done.appended, done.changed)

    def _drop(self, folder: str) -> None:
        fs, path = file_system(self.spark, folder)
        fs.delete(path, True)

    def _move(self, staged: str, folder: str) -> None:
        """Put the months that are still below ``staged`` in the place of those in ``folder``."""
        fs, root = file_system(self.spark, staged)
        for status in fs.listStatus(root) if fs.exists(root) else ():
            name = status.getPath().getName()
            if name.startswith("month="):
                _, target = file_system(self.spark, f"{folder}/{name}")
                fs.delete(target, True)
                if not fs.rename(status.getPath(), target):
                    raise OSError(f"{status.getPath()} could not be moved to {target}")

    def run(self, job: Callable[..., Outcome], batch: DataFrame, *args, **kwargs) -> Outcome:
        """Run a write job and write what it changed; the outcome's tables are the new ones."""
        return self.write(self.prepare(job, batch, *args, **kwargs))

"""Audit rows: of two states of a table, or one per request of a batch.

``audit_rows`` compares two states. ``request_audit`` goes by the requests themselves, as a server
would that handles one after the other: each row shows the values that its request met.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlake.functions import semantics as S
from leadlake.functions.lookup import among
from leadlake.functions.numbering import cut_points, slice_of
from leadlake.functions.reliability import checkpointed, small_side
from leadlake.operators.keyed import typed
from leadlake.schema import columns

CLOCK_COLUMNS = ("created_at", "updated_at")
STAGE_COLUMNS = ("lead_stage", "lead_substage")


def _json(fields: Column) -> Column:
    return F.to_json(fields, {"ignoreNullFields": "false"})


def audit_rows(before: DataFrame, after: DataFrame, as_of, actor=None, entity: str = "lead", ip: str | None = None) -> DataFrame:
    """Audit rows of the entities that differ between two states.

    CREATE (new row), DELETE (old id), STAGE_CHANGE (old stage, new stage and substage, if
    either moved) and UPDATE (old row and the other changed fields). An entity whose stage
    and other fields changed has one row of each of the last two.
    """
    names = [c for c in before.columns if c not in ("id", *CLOCK_COLUMNS)]
    old = before.select("id", F.struct(*before.columns).alias("old"))
    new = after.select("id", F.struct(*after.columns).alias("new"))
    both = old.join(new, "id", "full_outer")
    differs = {c: ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in names}
    other_change = F.lit(False)
    for c, cond in differs.items():
        if c not in STAGE_COLUMNS:
            other_change = other_change | cond
    created, deleted = F.col("old").isNull(), F.col("new").isNull()
    staged = F.lit(False)
    for c in STAGE_COLUMNS:
        if c in differs:
            staged = staged | differs[c]
    actions = (
        F.when(created, F.array(F.lit("CREATE")))
        .when(deleted, F.array(F.lit("DELETE")))
        .otherwise(F.array_compact(F.array(F.when(staged, "STAGE_CHANGE"), F.when(other_change, "UPDATE"))))
    )
    both = both.select("*", F.explode(actions).alias("_action"))
    action = F.col("_action")
    changed = F.map_filter(
        F.map_from_arrays(
            F.array(*[F.lit(c) for c in names]),
            F.array(*[F.struct(d.alias("hit"), F.col(f"new.{c}").cast("string").alias("v")) for c, d in differs.items()]),
        ),
        lambda c, v: v["hit"] & ~c.isin(*STAGE_COLUMNS),
    )
    changed = F.transform_values(changed, lambda _, v: v["v"])

    has_stage = "lead_stage" in names
    old_values = F.when(action == "DELETE", _json(F.struct("id"))).when(action == "UPDATE", _json(F.col("old")))
    new_values = F.when(action == "CREATE", _json(F.col("new"))).when(action == "UPDATE", _json(changed))
    if has_stage:
        old_values = old_values.when(action == "STAGE_CHANGE", _json(F.struct("old.lead_stage")))
        new_values = new_values.when(action == "STAGE_CHANGE", _json(F.struct("new.lead_stage", "new.lead_substage")))
    rows = both.select(
        F.lit(actor).alias("user_id"), F.lit(entity).alias("entity_type"), F.col("id").cast("string").alias("entity_id"),
        action.alias("action"), old_values.alias("old_values"), new_values.alias("new_values"),
        F.lit(ip).cast("string").alias("ip_address"), S.moment(as_of).alias("created_at"),
    )
    key = F.md5(F.concat_ws("|", "entity_type", "entity_id", "action", F.col("created_at").cast("string"), "old_values", "new_values"))
    return rows.withColumn("id", key).select(*columns("audit_logs"))


def update_requests(patch: DataFrame, allowed: Sequence[str], seq: Column | str = "seq") -> DataFrame:
    """Accepted partial updates (``id``, ``seq``, ``fields``) as requests; only ``allowed`` fields count."""
    given = F.map_filter("fields", lambda c, _: c.isin(*allowed))
    return patch.select("id", S.as_col(seq).alias("seq"), F.lit("UPDATE").alias("action"), given.alias("fields"))


def stage_requests(changes: DataFrame, seq: Column | str = "seq") -> DataFrame:
    """Accepted stage changes (``id``, ``seq``, ``stage``, ``substage``) as requests."""
    names = F.array(*[F.lit(c) for c in STAGE_COLUMNS])
    fields = F.map_from_arrays(names, F.array(F.col("stage").cast("string"), F.col("substage").cast("string")))
    return changes.select("id", S.as_col(seq).alias("seq"), F.lit("STAGE_CHANGE").alias("action"), fields.alias("fields"))


def met_values(requests: DataFrame, fields: Sequence[str], rows: int | None = None) -> DataFrame:
    """Add, per field, the value that earlier requests of the same entity gave it last: ``_f`` (struct of ``v``; null if none did).

    Two levels, so that an entity with very many requests is spread over tasks: the last value given
    before a request in its slice of the sequence, else the last one of the slices before.
    ``rows`` is the number of requests a slice shall hold.
    """
    cuts = cut_points(requests, "seq", rows)
    dealt = ["id", "_slice"] if cuts else ["id"]
    cut = requests.withColumn("_slice", slice_of("seq", cuts)).repartition(*dealt)
    inside = Window.partitionBy("id", "_slice").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)

    def given(c: str) -> Column:
        # an empty substage stands for the stage
        value = F.col("fields")[c]
        if c == "lead_substage":
            value = F.coalesce(S.blank_to_null(value), F.col("fields")["lead_stage"])
        return F.when(F.map_contains_key("fields", c), F.struct(value.alias("v")))

    found = cut.select("*", *[F.last(given(c), ignorenulls=True).over(inside).alias(f"_in_{c}") for c in fields])
    if not cuts:
        return found.select(*requests.columns, *[F.col(f"_in_{c}").alias(f"_{c}") for c in fields])
    last = cut.groupBy("id", "_slice").agg(*[F.max_by(given(c), F.when(given(c).isNotNull(), F.col("seq"))).alias(f"_of_{c}") for c in fields])
    earlier = Window.partitionBy("id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("id", "_slice", *[F.last(f"_of_{c}", ignorenulls=True).over(earlier).alias(f"_up_{c}") for c in fields])
    both = found.join(carried, ["id", "_slice"])
    return both.select(*requests.columns, *[F.coalesce(f"_in_{c}", f"_up_{c}").alias(f"_{c}") for c in fields])


def request_audit(
    before: DataFrame, requests: DataFrame, fields: Sequence[str], as_of, actor=None, table: str = "leads", entity: str = "lead",
    ip: str | None = None, rows: int | None = None,
) -> DataFrame:
    """One audit row per request of a batch (``id``, ``seq``, ``action``, ``fields``), with ``seq``.

    UPDATE has the row as the request met it and the fields it gave; STAGE_CHANGE the stage it met
    and what it gave; DELETE the id. Values a request met are those earlier requests of the batch gave
    last, else the stored ones. ``fields`` lists what requests may set. The clock columns are left out
    of the old row, since the batch has one clock.
    """
    known = list(dict.fromkeys([*fields, *STAGE_COLUMNS]))
    kept = checkpointed(requests)
    stored = small_side(among(before, "id", kept.select("id")).drop(*CLOCK_COLUMNS))
    met = met_values(kept, known, rows).join(stored, "id")
    old = [
        F.when(F.col(f"_{c}").isNotNull(), typed(F.col(f"_{c}.v"), table, c, before)).otherwise(F.col(c)).alias(c)
        if c in known else F.col(c)
        for c in stored.columns
    ]
    action = F.col("action")
    told = met.select("*", F.struct(*old).alias("_old"))
    old_values = (
        F.when(action == "STAGE_CHANGE", _json(F.struct("_old.lead_stage")))
        .when(action == "UPDATE", _json(F.col("_old"))).otherwise(_json(F.struct("id")))
    )
    out = told.select(
        "seq", F.lit(actor).alias("user_id"), F.lit(entity).alias("entity_type"), F.col("id").cast("string").alias("entity_id"),
        "action", old_values.alias("old_values"), F.when(action != "DELETE", _json(F.col("fields"))).alias("new_values"),
        F.lit(ip).cast("string").alias("ip_address"), S.moment(as_of).alias("created_at"),
    )
    key = F.md5(F.concat_ws("|", "entity_type", "entity_id", "action", F.col("created_at").cast("string"), F.col("seq").cast("string")))
    return out.withColumn("id", key).select("seq", *columns("audit_logs"))

"""Nested documents: a lead or patient with arrays of what belongs to it.

A row holds one array per child table, so a parent with very many children
cannot be one row. Its document is written in parts of about ``part_rows``
children each: part 0, 1, …, ``parts`` in total, every child in exactly one
part, each array newest first, and the parts put together in their order are newest
first too. Nearly every parent has one part, which is the whole document.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlake.functions.numbering import cut_points, slice_of
from leadlake.functions.reliability import small_side
from leadlake.sources.tables import Tables

PART_ROWS = 10_000


def _as_is(df: DataFrame) -> DataFrame:
    return df


def nested(
    parents: DataFrame, key: str, children: Mapping[str, tuple], part_rows: int, newest_first: bool = True,
) -> DataFrame:
    """Attach arrays to ``parents``. ``children`` maps an array name to (rows, time column) or
    (rows, time column, function adding names); child rows carry ``key`` and ``id``.
    Children never meet each other; they are counted before names are added."""
    counts = None
    for df, *_ in children.values():
        per_parent = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        counts = per_parent if counts is None else counts.unionByName(per_parent)
    # Only parents that need more than one part; few by definition, and checked before broadcasting.
    split = small_side(
        counts.groupBy(key)
        .agg(F.ceil(F.max("_n") / part_rows).cast("int").alias("parts"))
        .where("parts > 1")
    )
    if split.isEmpty():
        split, out = None, parents.withColumn("parts", F.lit(1)).withColumn("part", F.lit(0))
    else:
        out = (
            parents.join(split, key, "left")
            .withColumn("parts", F.coalesce("parts", F.lit(1)))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        )
    for name, (df, when, *rest) in children.items():
        add_names = rest[0] if rest else _as_is
        rows = add_names(_with_part(df, split, key, when, part_rows, newest_first))
        body = [c for c in rows.columns if c not in (when, "id", key, "part")]
        arrays = (
            rows.repartition(*([key, "part"] if split is not None else [key]))  # by both, so that a split parent's parts spread out
            .groupBy(key, "part")
            .agg(F.sort_array(F.collect_list(F.struct(when, "id", *body)), asc=not newest_first).alias(name))
        )
        out = out.join(arrays, [key, "part"], "left")
    empty = {n: F.coalesce(F.col(n), F.array().cast(out.schema[n].dataType)) for n in children}
    return out.withColumns(empty)


def _with_part(
    df: DataFrame, split: DataFrame | None, key: str, when: str, part_rows: int, newest_first: bool, slice_rows: int | None = None,
) -> DataFrame:
    """Add ``part``: 0, or for children of split parents their rank by part_rows.

    A split parent has many children, so their time is cut into slices of about equally many
    rows (quantiles); ranks are taken inside slices, and slices are added up: no task sees more of a parent than a
    slice, however many of its children lie in one day. Without a split parent nothing is ranked.
    """
    if split is None:
        return df.withColumn("part", F.lit(0))
    marked = df.join(split.withColumnRenamed("parts", "_parts"), key, "left")
    whole = marked.where("_parts is null").drop("_parts").withColumn("part", F.lit(0))
    # a missing time counts as the earliest, as it sorts in both directions
    clock = F.coalesce(F.unix_micros(F.col(when).cast("timestamp")), F.lit(-(1 << 62)))
    many = marked.where("_parts is not null").drop("_parts").withColumn("_at", clock)
    many = many.withColumn("_slice", slice_of("_at", cut_points(many, "_at", slice_rows))).repartition(key, "_slice")
    turn = F.desc_nulls_last if newest_first else F.asc_nulls_first
    inside = Window.partitionBy(key, "_slice").orderBy(turn(when), turn("id"))
    earlier = Window.partitionBy(key).orderBy(turn("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = many.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(key, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = many.withColumn("_rank", F.row_number().over(inside) - 1).join(before, [key, "_slice"])
    part = F.floor((F.col("_before") + F.col("_rank")) / part_rows).cast("int")
    return whole.unionByName(placed.withColumn("part", part).select(*df.columns, "part"))


def _named(df: DataFrame, dim: DataFrame, key: str, out: str, how: str = "left") -> DataFrame:
    return df.join(dim.select(F.col("id").alias(key), F.col("name").alias(out)), key, how)


def lead_360(t: Tables, part_rows: int = PART_ROWS) -> DataFrame:
    """Lead with names and arrays of interactions, appointments and revenue, newest first."""
    people = t.patients.select(
        F.col("id").alias("patient_id"), F.col("full_name").alias("patient_name"), "primary_phone",
        F.col("email").alias("patient_email"), "city", "patient_type",
    )
    head = t.leads.withColumnRenamed("id", "lead_id").join(people, "patient_id")
    head = _named(head, t.facilities, "facility_id", "facility_name", "inner")
    head = _named(head, t.specialities, "speciality_id", "speciality_name", "inner")
    head = _named(head, t.doctors, "doctor_id", "doctor_name")
    head = _named(head, t.users, "assigned_to", "agent_name")

    def visit_names(df: DataFrame) -> DataFrame:
        df = _named(df, t.doctors, "doctor_id", "doctor_name")
        return _named(df, t.facilities, "facility_id", "facility_name")

    return nested(
        head,
        "lead_id",
        {
            "interactions": (
                t.interactions, "interaction_date", lambda df: _named(df, t.users, "agent_id", "agent_name")),
            "appointments": (t.appointments, "appointment_date", visit_names),
            "revenue": (t.revenue, "billed_date"),
        },
        part_rows,
    )


def patient_360(t: Tables, variant: str = "history", part_rows: int = PART_ROWS) -> DataFrame:
    """Patient with the array of its leads.

    ``history``: with facility, by creation time; ``enquiry``: without facility, by enquiry date.
    """
    if variant == "history":
        when, places = "created_at", ["facility_id"]
        cols = ["lead_stage", "lead_substage", "enquiry_date", "lead_source", "speciality", "doctor", "facility"]
    elif variant == "enquiry":
        when, places = "enquiry_date", []
        cols = ["lead_stage", "enquiry_type", "speciality", "doctor"]
    else:
        raise ValueError(f"unknown variant: {variant}")

    def names(df: DataFrame) -> DataFrame:
        df = _named(df, t.specialities, "speciality_id", "speciality", "inner")
        df = _named(df, t.doctors, "doctor_id", "doctor")
        if places:
            df = _named(df, t.facilities, "facility_id", "facility", "inner")
        return df.select("patient_id", "part", "id", when, *cols)

    own = [c for c in cols if c in t.leads.columns]
    leads = t.leads.select("patient_id", "id", when, *own, "speciality_id", "doctor_id", *places)
    return nested(
        t.patients.withColumnRenamed("id", "patient_id"), "patient_id", {"leads": (leads, when, names)}, part_rows
    )

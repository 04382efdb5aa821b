"""Duplicate patients: detection and merge.

Group members stay one row each: a placeholder name or an empty phone can put a
third of all patients into one group, which no single row could hold. Group sizes
are counted first, the largest groups are picked, and only then are their members
looked up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions import semantics as S
from leadlake.functions.reliability import bounded, checkpointed, small_side
from leadlake.operators.keyed import known_ids
from leadlake.operators.outcome import Outcome, split_rejects
from leadlake.operators.profiles import PART_ROWS, nested
from leadlake.sources.tables import Tables

TOP_GROUPS = 50


def name_form() -> Column:
    """Name as compared: trimmed, lower case (accents are ignored when grouping)."""
    return F.lower(F.trim("full_name"))


def phone_form() -> Column:
    """Last eight digits of the phone; shorter numbers whole, '' if it has no digit."""
    return F.right(F.regexp_replace("primary_phone", "[^0-9]", ""), F.lit(8))


def _groups(patients: DataFrame, form: Column, n: int | None) -> DataFrame:
    """Groups of at least two: ``key``, ``count``; the ``n`` largest.

    Counting by the plain text first keeps the wide pass on fast binary keys and
    leaves the accent-free grouping one row per spelling.
    """
    spellings = patients.groupBy(form.alias("key")).agg(F.count(F.lit(1)).alias("count"))
    groups = (
        spellings.groupBy(S.ci_key("key").alias("_key"))
        .agg(F.min("key").alias("key"), F.sum("count").alias("count"))
        .where("count > 1")
        .select("key", "count")
    )
    if n is None:
        return groups
    return bounded(S.top_k(groups, n, F.desc("count"), F.col("key")), n)


def _members(t: Tables, kind: str, form: Column, n: int | None) -> DataFrame:
    groups = _groups(t.patients, form, n).withColumn("_key", S.ci_key("key"))
    people = t.patients.select(
        S.ci_key(form).alias("_key"), "id", "full_name", "primary_phone", "created_at"
    )
    return people.join(groups, "_key").select(
        F.lit(kind).alias("type"), "key", "count", "id", "full_name", "primary_phone", "created_at"
    )


def duplicates_by_name(t: Tables, n: int | None = TOP_GROUPS) -> DataFrame:
    """Members of the ``n`` largest groups with the same name."""
    return _members(t, "name", name_form(), n)


def duplicates_by_phone(t: Tables, n: int | None = TOP_GROUPS) -> DataFrame:
    """Members of the ``n`` largest groups with the same last eight phone digits."""
    return _members(t, "phone", phone_form(), n)


def duplicate_groups(t: Tables, n: int | None = TOP_GROUPS) -> DataFrame:
    """Name groups and phone groups; a phone group with exactly a name group's members is left out.

    Two groups hold the same patients when both sizes equal the number of patients
    they share, so counting shared patients decides it without comparing id lists.
    """
    names, phones = _groups(t.patients, name_form(), n), _groups(t.patients, phone_form(), n)
    n_side = names.select(
        S.ci_key("key").alias("_n"), F.col("key").alias("name_key"), F.col("count").alias("name_count")
    )
    p_side = phones.select(
        S.ci_key("key").alias("_p"), F.col("key").alias("phone_key"), F.col("count").alias("phone_count")
    )
    people = t.patients.select(
        "id", "full_name", "primary_phone", "created_at",
        S.ci_key(name_form()).alias("_n"), S.ci_key(phone_form()).alias("_p"),
    )
    if n is not None:
        n_side, p_side = bounded(n_side, n), bounded(p_side, n)
    tagged = people.join(n_side, "_n", "left").join(p_side, "_p", "left").drop("_n", "_p")
    repeated = (
        tagged.where("name_key IS NOT NULL AND phone_key IS NOT NULL")
        .groupBy("name_key", "phone_key", "name_count", "phone_count")
        .agg(F.count(F.lit(1)).alias("shared"))
        .where("shared = name_count AND shared = phone_count")
        .select("phone_key")
    )
    if n is not None:
        repeated = bounded(repeated, n)  # at most one row per name group
    who = ("id", "full_name", "primary_phone", "created_at")
    by_name = tagged.where("name_key IS NOT NULL").select(
        F.lit("name").alias("type"), F.col("name_key").alias("key"), F.col("name_count").alias("count"), *who
    )
    by_phone = tagged.where("phone_key IS NOT NULL").join(repeated, "phone_key", "left_anti").select(
        F.lit("phone").alias("type"), F.col("phone_key").alias("key"), F.col("phone_count").alias("count"), *who
    )
    return by_name.unionByName(by_phone)


def duplicate_documents(t: Tables, n: int | None = TOP_GROUPS, part_rows: int = PART_ROWS) -> DataFrame:
    """Duplicate groups as documents: members by creation time and the sorted ids,
    split into parts where a group is too large for one row."""
    rows = duplicate_groups(t, n).withColumn("group_id", F.concat_ws(":", "type", "key"))
    groups = rows.select("group_id", "type", "key", "count").distinct()
    members = rows.select("group_id", "id", "created_at", "full_name", "primary_phone")
    docs = nested(groups, "group_id", {"members": (members, "created_at")}, part_rows, newest_first=False)
    return docs.withColumn("ids", F.array_sort(F.transform("members", lambda m: m["id"]))).drop("group_id")


def resolve_mapping(mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Follow chains of merges (a into b, b into c) to their end.

    Input: ``secondary_id``, ``primary_id`` and optionally ``seq`` (the first request
    for a secondary counts). Returns (secondary_id, primary_id) with final primaries,
    and the requests caught in a cycle. Each round doubles the followed distance, so
    n requests need at most log2(n) rounds; what still moves then is a cycle.
    """
    order = F.col("seq") if "seq" in mapping.columns else F.col("primary_id")
    links = S.first_per_key(
        mapping.where(F.col("secondary_id") != F.col("primary_id")), ["secondary_id"], order, F.col("primary_id")
    ).select("secondary_id", F.col("primary_id").alias("target"))
    links = checkpointed(links.withColumn("moved", F.lit(True)))
    total = links.count()
    for _ in range(max(1, math.ceil(math.log2(total + 1)) + 1)):
        ahead = links.select(F.col("secondary_id").alias("target"), F.col("target").alias("_next"))
        links = checkpointed(
            links.drop("moved")
            .join(ahead, "target", "left")
            .select(
                "secondary_id",
                F.coalesce("_next", "target").alias("target"),
                F.col("_next").isNotNull().alias("moved"),
            )
        )
        if links.where("moved").isEmpty():
            break
    done = links.where("NOT moved").select("secondary_id", F.col("target").alias("primary_id"))
    return done, links.where("moved").select("secondary_id")


def merge_patients(t: Tables, mapping: DataFrame) -> Outcome:
    """Move leads, appointments and revenue of secondary patients to their primary and
    delete the secondaries. Requests without a known primary, or in a cycle, change nothing.
    """
    blank = S.is_blank("primary_id") | S.is_blank("secondary_id")
    judged = mapping.join(known_ids(t.patients, mapping, "primary_id"), "primary_id", "left")
    usable, refused = split_rejects(
        judged,
        (blank, "primary_id and secondary_ids required"),
        (F.col("_known").isNull(), "primary patient not found"),
        (F.col("primary_id") == F.col("secondary_id"), "primary is among the secondaries"), once=True,
    )
    usable, refused = usable.drop("_known"), refused.drop("_known")
    moves, cyclic = resolve_mapping(usable)
    cycles = usable.join(cyclic, "secondary_id", "left_semi").withColumn("reason", F.lit("merge cycle"))
    moves = small_side(moves.select(F.col("secondary_id").alias("patient_id"), F.col("primary_id").alias("_to")))

    def moved(df: DataFrame) -> DataFrame:
        return df.join(moves, "patient_id", "left").withColumn(
            "patient_id", F.coalesce("_to", "patient_id")
        ).select(*df.columns)

    gone = moves.select(F.col("patient_id").alias("id"))
    tables = t.replace(
        leads=moved(t.leads),
        appointments=moved(t.appointments),
        revenue=moved(t.revenue),
        patients=t.patients.join(gone, "id", "left_anti"),
    )
    rejects = refused.unionByName(cycles, allowMissingColumns=True)
    return Outcome(tables, rejects, usable, changed=("leads", "appointments", "revenue", "patients"))

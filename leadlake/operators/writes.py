"""Write jobs: intake, updates, upserts and deletes over whole batches.

Each job takes the tables and a batch and returns an :class:`Outcome`: the new
tables, the refused rows with their reason, the accepted rows, and what was appended to or
changed in which table. Batches carry a unique whole number ``seq``: the order in which
single requests would have come.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions import semantics as S
from leadlake.functions.numbering import running_number
from leadlake.functions.lookup import among
from leadlake.functions.reliability import checkpointed, small_side
from leadlake.operators import stage_engine as G
from leadlake.operators.keyed import (
    MakeId, check_batch, column_kinds, empty_rules, enum_rules, join_rejects, last_per_key, mark_known, require_row, stable_ids, typed,
    update_rows, upsert, with_changes, without_ids,
)
from leadlake.operators.outcome import Outcome, split_rejects
from leadlake.schema import LEAD_STAGES, REFERENCES
from leadlake.sources.tables import BY_PHONE, Tables, apply_defaults, finish

# --- fixed values: fields an update may set ---
LEAD_FIELDS = (
    "facility_id", "speciality_id", "doctor_id", "assigned_to", "enquiry_type", "medical_concern", "urgency",
    "lead_source", "lead_medium", "campaign_name", "utm_source", "utm_medium", "utm_campaign", "utm_term",
    "utm_content", "followup_date",
)
PATIENT_FIELDS = ("full_name", "email", "city", "age", "gender", "patient_type")
# --- end of fixed values ---


# --- shared steps ----------------------------------------------------------------------


def _next_number(patients: DataFrame) -> int:
    """Highest patient number so far."""
    number = F.regexp_extract("unique_pid", r"(\d+)$", 1).try_cast("bigint")
    return patients.agg(F.max(number).alias("top")).first()["top"] or 0


def _new_patients(t: Tables, rows: DataFrame, as_of, make_id: MakeId) -> DataFrame:
    """Number and complete new patients (one row per phone, with ``seq``); keeps ``seq``."""
    numbered = running_number(rows, "seq", out="_n").withColumn(
        "unique_pid", S.pad_number(F.col("_n") + F.lit(_next_number(t.patients)))
    )
    made = numbered.withColumn("id", make_id("patients", F.col("seq")))
    return apply_defaults(made, "patients", as_of, blanks=True).withColumn(
        "id", F.col("id").cast(t.patients.schema["id"].dataType)
    )


def _append(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Add completed rows, in the target's types."""
    return target.unionByName(
        rows.select(*[F.col(c).cast(target.schema[c].dataType).alias(c) for c in target.columns])
    )


def _complete(batch: DataFrame, table: str, as_of, make_id: MakeId) -> DataFrame:
    made = make_id(table, F.col("seq"))
    rows = batch.withColumn("id", F.coalesce("id", made) if "id" in batch.columns else made)
    return finish(apply_defaults(rows, table, as_of, blanks=True), table)


def patch_rows(
    t: Tables, table: str, patch: DataFrame, allowed: Sequence[str], as_of, missing: str, empty: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Partial update: ``patch`` has ``id``, ``seq`` and ``fields`` (map of text values).

    A field that is absent keeps its value, one that is present sets it, also to NULL.
    Later requests of a batch win field by field.
    """
    target = t[table]
    given = F.array_intersect(F.map_keys("fields"), F.array(*[F.lit(c) for c in allowed]))
    wide = patch.select("*", *[F.col("fields")[c].alias(c) for c in allowed])
    parents = {c: p for child, c, p in REFERENCES if child == table}
    rules = [(F.size(given) == 0, empty)]
    kinds = column_kinds(table)
    for c in allowed:
        present = F.map_contains_key("fields", c)
        rules += [(present & cond, text) for cond, text in empty_rules(table, wide, [c])]
        if kinds[c] in ("int", "date", "ts", "money", "bool"):
            readable = F.col(c).try_cast(target.schema[c].dataType).isNotNull()
            rules.append((F.col(c).isNotNull() & ~readable, f"invalid {c}"))
    rules += enum_rules(table, wide.select(*allowed))
    for c in allowed:
        if c in parents:
            wide = mark_known(wide, t[parents[c]].select(F.col("id").cast("string").alias("id")), c, f"_known_{c}")
            rules.append((~S.is_blank(c) & F.col(f"_known_{c}").isNull(), f"unknown {c}"))
    wide, not_found = require_row(target, wide, missing)
    ok, bad = split_rejects(wide, *rules, once=True)
    latest = ok.groupBy("id").agg(
        *[
            F.max_by(F.struct(F.col(c).alias("v")), F.when(F.map_contains_key("fields", c), F.col("seq"))).alias(f"_{c}")
            for c in allowed
        ]
    )
    new = {
        c: F.when(F.col(f"_{c}").isNotNull(), typed(F.col(f"_{c}.v"), table, c, target)).otherwise(F.col(c))
        for c in allowed
    }
    after = with_changes(target.join(small_side(latest), "id", "left"), target.columns, new, as_of)
    rejects = join_rejects(not_found.select(*patch.columns, "reason"), bad.select(*patch.columns, "reason"))
    return after, rejects, ok.select(*patch.columns)


# --- leads -----------------------------------------------------------------------------


def ingest_leads(t: Tables, batch: DataFrame, as_of, make_id: MakeId | None = None) -> Outcome:
    """New leads. The patient is found by phone or created (once per phone, numbered in sequence)."""
    make_id = make_id or stable_ids(as_of)
    required = ("full_name", "primary_phone", "facility_id", "speciality_id", "lead_source")
    more = enum_rules("patients", batch)
    if "stage" in batch.columns:
        more.append((~S.is_blank("stage") & ~S.lower_value("stage").isin(*LEAD_STAGES), "invalid stage"))
    ok, rejects = check_batch(t, "leads", batch, required, ", ".join(required) + " required", *more, fresh=True)
    phone = ok.withColumn("_phone", S.ci_key("primary_phone"))
    met = checkpointed(phone.join(_by_phone(t, phone), "_phone", "left"))
    fresh = S.first_per_key(met.where("_old IS NULL"), ["_phone"], F.col("seq")).drop("_old", "_phone")
    patients = _new_patients(t, fresh, as_of, make_id)
    created = patients.select(S.ci_key("primary_phone").alias("_phone"), F.col("id").alias("_new"))
    placed = met.join(created, "_phone", "left").withColumn("patient_id", F.coalesce("_old", "_new"))
    renames = {"stage": "lead_stage", "substage": "lead_substage"}
    for short, name in renames.items():
        if short in placed.columns:
            placed = placed.withColumnRenamed(short, name)
    leads = _complete(placed.drop("_old", "_new", "_phone"), "leads", as_of, make_id)
    tables = t.replace(patients=_append(t.patients, patients), leads=_append(t.leads, leads))
    return Outcome(tables, rejects, leads, {"patients": patients, "leads": leads})


def update_leads(t: Tables, patch: DataFrame, as_of) -> Outcome:
    leads, rejects, ok = patch_rows(
        t, "leads", patch, LEAD_FIELDS, as_of, "unknown lead", "nothing to set"
    )
    return Outcome(t.replace(leads=leads), rejects, ok, changed=("leads",))


def change_stage(t: Tables, batch: DataFrame, as_of=None) -> Outcome:
    """Manual stage changes (``id``, ``seq``, ``stage``, ``substage``); the last one per lead stays."""
    ok, bad = split_rejects(
        batch,
        (S.is_blank("stage"), "stage required"),
        (~F.col("stage").isin(*LEAD_STAGES), "stage is not in the list"),
    )
    ok, missing = require_row(t.leads, ok, "unknown lead", once=True)
    events = G.change_events(
        ok.withColumnRenamed("id", "lead_id"), F.col("stage"), F.coalesce(S.blank_to_null("substage"), F.col("stage"))
    )
    leads = G.advance(t.leads, events, as_of, batch=True)
    return Outcome(t.replace(leads=leads), join_rejects(bad, missing), ok, changed=("leads",))


def save_ai(t: Tables, batch: DataFrame, as_of) -> Outcome:
    """Store scores (``id``, ``seq``, ``ai_score``, ``ai_priority``, ``ai_reason``, ``ai_next_action``)."""
    ok, bad = split_rejects(batch, *enum_rules("leads", batch))
    ok, missing = require_row(t.leads, ok, "unknown lead")
    new = {
        "ai_score": F.col("b_ai_score").cast("int"),
        "ai_priority": S.lower_value(F.coalesce(S.blank_to_null("b_ai_priority"), F.lit("medium"))),
        "ai_reason": S.blank_to_null("b_ai_reason"),
        "ai_next_action": S.blank_to_null("b_ai_next_action"),
    }
    leads = update_rows(t.leads, last_per_key(ok, ["id"]), new, as_of)
    return Outcome(t.replace(leads=leads), join_rejects(bad, missing), ok, changed=("leads",))


def _referenced(t: Tables, column: str, wanted: DataFrame) -> DataFrame:
    """Those of the given ids that appointments or bills point to."""
    found = [among(t[table].select(column), column, wanted.select("id")) for table in ("appointments", "revenue")]
    used = found[0].unionByName(found[1]).select(F.col(column).alias("id"))
    return small_side(used.distinct().withColumn("_used", F.lit(True)))


def _by_phone(t: Tables, batch: DataFrame) -> DataFrame:
    """Ids of the patients whose phone a batch names, by phone key.

    Patients with a stored plain key are looked up by it first; then, as always, phones are compared.
    """
    patients = t.patients
    if BY_PHONE in t:
        patients = among(t[BY_PHONE], "phone_key", batch.select(S.phone_key("primary_phone").alias("phone_key")))
    asked = small_side(batch.select("_phone").distinct())
    met = patients.select(S.ci_key("primary_phone").alias("_phone"), F.col("id").alias("_old")).join(asked, "_phone", "left_semi")
    return small_side(met)


def delete_leads(t: Tables, ids: DataFrame) -> Outcome:
    """Delete leads with their interactions; leads with appointments or bills are refused."""
    wanted = ids.select("id").distinct()
    known, missing = require_row(t.leads, wanted, "unknown lead", once=True)
    ok, blocked = split_rejects(
        known.join(_referenced(t, "lead_id", known), "id", "left"),
        (F.col("_used").isNotNull(), "lead has appointments or revenue"), once=True,
    )
    ok = ok.select("id")
    tables = t.replace(
        leads=without_ids(t.leads, ok), interactions=without_ids(t.interactions, ok, column="lead_id")
    )
    return Outcome(tables, join_rejects(missing, blocked.drop("_used")), ok, changed=("leads", "interactions"))


# --- interactions ----------------------------------------------------------------------


def ingest_interactions(
    t: Tables, batch: DataFrame, as_of, actor=None, make_id: MakeId | None = None
) -> Outcome:
    """Log interactions and advance the stages of their leads. Missing values: type call,
    agent the actor, date the clock."""
    make_id = make_id or stable_ids(as_of)
    if actor is not None:
        own = F.col("agent_id") if "agent_id" in batch.columns else F.lit(None)
        batch = batch.withColumn("agent_id", F.coalesce(S.blank_to_null(own), F.lit(actor)).cast(
            t.interactions.schema["agent_id"].dataType))
    ok, rejects = check_batch(t, "interactions", batch, ("lead_id", "outcome"), "lead or outcome is missing", fresh=True)
    rows = _complete(ok, "interactions", as_of, make_id)
    kept = ok.select("lead_id", "seq", "interaction_type", "outcome",
                     F.col("followup_date").cast("date").alias("followup_date"))
    leads = G.advance(t.leads, G.interaction_events(kept, "seq"), as_of, batch=True)
    tables = t.replace(interactions=_append(t.interactions, rows), leads=leads)
    return Outcome(tables, rejects, rows, {"interactions": rows}, ("leads",))


def delete_interactions(t: Tables, ids: DataFrame) -> Outcome:
    """Delete interactions; attempt counts stay as they are."""
    ok, missing = require_row(t.interactions, ids.select("id").distinct(), "unknown interaction")
    return Outcome(t.replace(interactions=without_ids(t.interactions, ok)), missing, ok, changed=("interactions",))


def log_emails(t: Tables, deliveries: DataFrame, as_of, make_id: MakeId | None = None) -> Outcome:
    """Delivered e-mails (status below 300) of a lead become interactions; stages do not move."""
    make_id = make_id or stable_ids(as_of)
    sent, failed = split_rejects(
        deliveries,
        (S.is_blank("lead_id"), "no lead"),
        (F.coalesce(F.col("status") >= 300, F.lit(True)), "not delivered"),
    )
    ok, unknown = check_batch(t, "interactions", sent, ("lead_id",), "no lead", fresh=True)
    rows = _complete(
        ok.withColumns({
            "interaction_type": F.lit("email"),
            "outcome": F.lit("Email sent"),
            "notes": S.sentence("Subject: ", F.col("subject")),
            "interaction_date": S.moment(as_of),
        }),
        "interactions", as_of, make_id,
    )
    tables = t.replace(interactions=_append(t.interactions, rows))
    return Outcome(tables, join_rejects(failed, unknown), rows, {"interactions": rows})


# --- appointments and revenue ----------------------------------------------------------


def _to_customers(t: Tables, rows: DataFrame, state: tuple[str, str], as_of) -> DataFrame:
    """Leads of ``rows`` become customers with the given substage."""
    hit = rows.select(F.col("lead_id").alias("id")).distinct()
    new = {"lead_stage": F.lit(state[0]), "lead_substage": F.lit(state[1])}
    return update_rows(t.leads, hit, new, as_of)


def book_appointments(t: Tables, batch: DataFrame, as_of, make_id: MakeId | None = None) -> Outcome:
    make_id = make_id or stable_ids(as_of)
    required = ("lead_id", "patient_id", "facility_id", "appointment_date")
    ok, rejects = check_batch(t, "appointments", batch, required, ", ".join(required) + " required", fresh=True)
    rows = _complete(ok.drop("visit_status"), "appointments", as_of, make_id)
    tables = t.replace(
        appointments=_append(t.appointments, rows), leads=_to_customers(t, rows, G.BOOKED, as_of)
    )
    return Outcome(tables, rejects, rows, {"appointments": rows}, ("leads",))


def set_visit_status(t: Tables, batch: DataFrame, as_of) -> Outcome:
    """Visit status changes (``id``, ``seq``, ``visit_status``, ``notes``). The last status and the
    last non-empty note per appointment stay; a visit makes its lead a customer."""
    ok, bad = split_rejects(batch, (S.is_blank("visit_status"), "visit_status required"), *enum_rules("appointments", batch))
    ok, missing = require_row(t.appointments, ok, "unknown appointment", once=True)
    seq = F.col("seq")
    latest = ok.groupBy("id").agg(
        F.max_by("visit_status", seq).alias("status"),
        F.max_by("notes", F.when(~S.is_blank("notes"), seq)).alias("notes"),
        F.max(S.lower_value("visit_status") == "visited").alias("visited"),
    )
    new = {
        "visit_status": S.lower_value("b_status"), "notes": F.coalesce(F.col("b_notes"), F.col("notes")),
    }
    visited = among(t.appointments.select("id", "lead_id"), "id", latest.where("visited").select("id"))
    tables = t.replace(
        appointments=update_rows(t.appointments, latest, new, as_of),
        leads=_to_customers(t, visited, G.VISITED, as_of),
    )
    return Outcome(tables, join_rejects(bad, missing), ok, changed=("appointments", "leads"))


def post_revenue(t: Tables, batch: DataFrame, as_of, make_id: MakeId | None = None) -> Outcome:
    """Bills; missing amounts are 0, the billed date defaults to the clock."""
    make_id = make_id or stable_ids(as_of)
    required = ("appointment_id", "lead_id", "patient_id")
    amounts = [c for c in ("consultation_value", "procedure_value", "package_value") if c in batch.columns]
    unreadable = F.lit(False)
    for c in amounts:
        unreadable = unreadable | (~S.is_blank(c) & F.col(c).cast("string").try_cast("decimal(12,2)").isNull())
    ok, rejects = check_batch(
        t, "revenue", batch, required, ", ".join(required) + " required", (unreadable, "amount is not a number"), fresh=True)
    ok = ok.withColumns({c: F.col(c).cast("string").try_cast("decimal(12,2)") for c in amounts})
    rows = _complete(ok, "revenue", as_of, make_id)
    tables = t.replace(revenue=_append(t.revenue, rows), leads=_to_customers(t, rows, G.BILLED, as_of))
    return Outcome(tables, rejects, rows, {"revenue": rows}, ("leads",))


# --- patients --------------------------------------------------------------------------


def create_patients(t: Tables, batch: DataFrame, as_of, make_id: MakeId | None = None) -> Outcome:
    """New patients; a phone that exists, or came earlier in the batch, is refused."""
    make_id = make_id or stable_ids(as_of)
    ok, bad = check_batch(t, "patients", batch, ("full_name", "primary_phone"), "name or phone is missing")
    ok = ok.withColumn("_phone", S.ci_key("primary_phone"))
    met = checkpointed(ok.join(_by_phone(t, ok), "_phone", "left"))
    first = S.first_per_key(met.where("_old IS NULL"), ["_phone"], F.col("seq"))
    accepted = first.drop("_phone", "_old")
    taken = met.join(accepted.select("seq"), "seq", "left_anti").withColumn(
        "reason", F.lit("phone is taken")
    )
    rows = _new_patients(t, accepted, as_of, make_id)
    return Outcome(
        t.replace(patients=_append(t.patients, rows)),
        join_rejects(bad, taken.select(*batch.columns, "reason")), rows, {"patients": rows},
    )


def update_patients(t: Tables, patch: DataFrame, as_of) -> Outcome:
    patients, rejects, ok = patch_rows(
        t, "patients", patch, PATIENT_FIELDS, as_of, "unknown patient", "nothing to set"
    )
    return Outcome(t.replace(patients=patients), rejects, ok, changed=("patients",))


def delete_patients(t: Tables, ids: DataFrame) -> Outcome:
    """Delete patients with their leads and those leads' interactions; refused while
    appointments or bills point to the patient or to one of the leads."""
    wanted, missing = require_row(t.patients, ids.select("id").distinct(), "unknown patient", once=True)
    own = checkpointed(among(t.leads.select("id", "patient_id"), "patient_id", wanted.select("id")))
    by_lead = own.join(_referenced(t, "lead_id", own), "id", "left_semi").select(F.col("patient_id").alias("id"))
    used = by_lead.unionByName(_referenced(t, "patient_id", wanted).select("id")).distinct().withColumn("_used", F.lit(True))
    ok, blocked = split_rejects(
        wanted.join(used, "id", "left"), (F.col("_used").isNotNull(), "patient has appointments or revenue"),
        once=True,
    )
    ok = ok.select("id")
    gone = own.join(ok.select(F.col("id").alias("patient_id")), "patient_id", "left_semi")
    tables = t.replace(
        patients=without_ids(t.patients, ok),
        leads=without_ids(t.leads, ok, column="patient_id"),
        interactions=without_ids(t.interactions, gone, column="lead_id"),
    )
    return Outcome(tables, join_rejects(missing, blocked.drop("_used")), ok, changed=("patients", "leads", "interactions"))


# --- directory -------------------------------------------------------------------------


def _upsert_directory(
    t: Tables, table: str, batch: DataFrame, mode: str, required: Sequence[str], text: str,
    fields: Sequence[str], as_of, make_id: MakeId | None, unique: str | None = None, taken_text: str = "",
) -> Outcome:
    """Rows without id are created; rows with id update: all ``fields`` (replace) or the
    non-blank ones (patch). Later rows of a batch win."""
    if mode not in ("replace", "patch"):
        raise ValueError(f"unknown mode: {mode}")
    make_id = make_id or stable_ids(as_of)
    target = t[table]
    creates = batch.where(F.col("id").isNull()).drop("id")
    ok, bad = check_batch(t, table, creates, required, text)
    if unique:
        ok = ok.withColumn("_u", S.ci_key(unique))
        met = ok.join(target.select(S.ci_key(unique).alias("_u"), F.lit(True).alias("_old")), "_u", "left")
        first = S.first_per_key(met.where("_old IS NULL"), ["_u"], F.col("seq")).drop("_u", "_old")
        taken = met.join(first.select("seq"), "seq", "left_anti").drop("_u", "_old").withColumn(
            "reason", F.lit(taken_text))
        ok, bad = first, join_rejects(bad, taken)
    rows = _complete(ok, table, as_of, make_id)

    updates = batch.where(F.col("id").isNotNull())
    updates, missing = require_row(target, updates, "not found")
    if mode == "replace":
        changes, broken = check_batch(t, table, updates, (), "", *empty_rules(table, updates, fields))
        latest = last_per_key(changes, ["id"])
        new = {c: typed(F.col(f"b_{c}"), table, c, target) for c in fields}
    else:
        changes, broken = check_batch(t, table, updates, (), "")
        latest = changes.groupBy("id").agg(
            *[F.max_by(c, F.when(~S.is_blank(c), F.col("seq"))).alias(c) for c in fields]
        )
        new = {c: F.coalesce(typed(F.col(f"b_{c}"), table, c, target), F.col(c)) for c in fields}
    after = update_rows(target, latest.select("id", *fields), new, as_of)
    return Outcome(t.replace(**{table: _append(after, rows)}), join_rejects(bad, missing, broken), rows, changed=(table,))


def upsert_facilities(t: Tables, batch: DataFrame, mode: str, as_of, make_id: MakeId | None = None) -> Outcome:
    fields = ("name", "type", "city", "region", "is_active") + (("address",) if mode == "replace" else ())
    return _upsert_directory(t, "facilities", batch, mode, ("name",), "name required", fields, as_of, make_id)


def create_specialities(t: Tables, batch: DataFrame, as_of, make_id: MakeId | None = None) -> Outcome:
    """New specialities; names are unique."""
    creates = batch.withColumn("id", F.lit(None).cast(t.specialities.schema["id"].dataType))
    return _upsert_directory(
        t, "specialities", creates, "patch", ("name",), "name required", ("name",), as_of, make_id,
        unique="name", taken_text="speciality exists",
    )


def upsert_doctors(t: Tables, batch: DataFrame, mode: str, as_of, make_id: MakeId | None = None) -> Outcome:
    fields = (
        ("name", "speciality_id", "facility_id", "consult_type", "is_active")
        if mode == "replace" else ("name", "availability", "is_active")
    )
    required = ("name", "speciality_id", "facility_id")
    return _upsert_directory(
        t, "doctors", batch, mode, required, ", ".join(required) + " required", fields, as_of, make_id
    )


def upsert_users(t: Tables, batch: DataFrame, mode: str, as_of, make_id: MakeId | None = None) -> Outcome:
    """Users; an e-mail that exists is refused. Password hashes arrive ready-made."""
    return _upsert_directory(
        t, "users", batch, mode, ("name", "email", "password_hash"), "name, e-mail or password is missing",
        ("name", "role", "is_active"), as_of, make_id, unique="email", taken_text="e-mail is taken",
    )


# --- settings --------------------------------------------------------------------------


def _key_id(table: str, *key: str) -> Column:
    """The id of a new row: a hash of its key, the same on every run."""
    return F.md5(F.concat_ws("|", F.lit(table), *[F.lower(F.rtrim(c)) for c in key]))


def upsert_ad_spend(t: Tables, batch: DataFrame, as_of, month: str | None = None) -> Outcome:
    """Spend per channel and month (``seq``, ``channel``, ``monthly_spend`` as text, optionally
    ``month``); what is not a number counts as 0, the month defaults to the clock's."""
    given = S.blank_to_null("month") if "month" in batch.columns else F.lit(None).cast("string")
    fallback = F.lit(month) if month else S.month_key(S.moment(as_of))
    ok, bad = split_rejects(batch, (S.is_blank("channel"), "channel required"))
    rows = ok.withColumn("month", F.coalesce(given, fallback)).withColumn(
        "monthly_spend", S.leading_number("monthly_spend").try_cast("decimal(12,2)")
    )
    rows, overflow = split_rejects(rows, (F.col("monthly_spend").isNull(), "amount out of range"))
    last = last_per_key(rows, [S.ci_key("channel"), S.ci_key("month")])
    full = apply_defaults(last, "ad_spend", as_of, _key_id("ad_spend", "channel", "month"))
    spend = upsert(t.ad_spend, full, ["channel", "month"], "ad_spend", ["monthly_spend"], as_of)
    return Outcome(t.replace(ad_spend=spend), join_rejects(bad, overflow), rows, changed=("ad_spend",))


def upsert_webhooks(t: Tables, batch: DataFrame, as_of, actor=None) -> Outcome:
    """Webhook per event type; known ones get the new address and become active."""
    ok, bad = split_rejects(batch, (S.any_blank(("event_type", "url")), "event_type and url required"))
    rows = last_per_key(ok, [S.ci_key("event_type")]).withColumns({
        "is_active": F.lit(True),
        "created_by": F.lit(actor).cast(t.webhooks.schema["created_by"].dataType),
    })
    full = apply_defaults(rows, "webhooks", as_of, _key_id("webhooks", "event_type"))
    hooks = upsert(t.webhooks, full, ["event_type"], "webhooks", ["url", "is_active"], as_of)
    return Outcome(t.replace(webhooks=hooks), bad, ok, changed=("webhooks",))


def disable_webhooks(t: Tables, events: DataFrame, as_of) -> Outcome:
    """Deactivate the webhooks of the given event types."""
    off = events.select(S.ci_key("event_type").alias("_k")).distinct().withColumn("_off", F.lit(True))
    joined = t.webhooks.withColumn("_k", S.ci_key("event_type")).join(off, "_k", "left")
    new = {"is_active": F.when(F.col("_off"), F.lit(False)).otherwise(F.col("is_active"))}
    hooks = with_changes(joined, t.webhooks.columns, new, as_of)
    none = events.limit(0).withColumn("reason", F.lit("").cast("string"))
    return Outcome(t.replace(webhooks=hooks), none, events, changed=("webhooks",))


def email_settings(batch: DataFrame, default_name: str = "CRM") -> DataFrame:
    """E-mail settings (``seq``, ``sendgrid_key``, ``from_email``, ``from_name``) as setting rows."""
    name = F.coalesce(S.blank_to_null("from_name"), F.lit(default_name)).alias("from_name")
    complete = batch.where(~S.any_blank(("sendgrid_key", "from_email")))
    return complete.select(
        "seq", F.lit("email_config").alias("setting_key"),
        F.to_json(F.struct("sendgrid_key", "from_email", name)).alias("setting_value"),
    )


def upsert_settings(t: Tables, batch: DataFrame, as_of) -> Outcome:
    """Settings by key (``seq``, ``setting_key``, ``setting_value`` holding JSON)."""
    ok, bad = split_rejects(
        batch,
        (S.is_blank("setting_key"), "setting_key required"),
        (F.try_parse_json("setting_value").isNull(), "setting_value is not JSON"),
    )
    last = last_per_key(ok, [S.ci_key("setting_key")])
    full = apply_defaults(last, "system_settings", as_of, _key_id("system_settings", "setting_key"))
    settings = upsert(t.system_settings, full, ["setting_key"], "system_settings", ["setting_value"], as_of)
    return Outcome(t.replace(system_settings=settings), bad, ok, changed=("system_settings",))


def read_settings(t: Tables, schema: str = "from_email string, from_name string") -> DataFrame:
    """Settings with their JSON value as columns of ``schema``."""
    return t.system_settings.select("setting_key", F.from_json("setting_value", schema).alias("v")).select(
        "setting_key", "v.*"
    )

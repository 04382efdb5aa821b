"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.functions import semantics as S
from leadlake.functions.reliability import ensure_checkpoint_dir
from leadlake.operators import audit as A
from leadlake.operators import dashboards as D
from leadlake.operators import dedupe as M
from leadlake.operators import features as X
from leadlake.operators import integrity as I
from leadlake.operators import listing as L
from leadlake.operators import outbox as O
from leadlake.operators import profiles as P
from leadlake.operators import search as Q
from leadlake.operators import stage_engine as G
from leadlake.operators import views as V
from leadlake.operators import writes as W
from leadlake.plans.bundles import dashboard
from leadlake.sources.batches import NEW_ID, load_batch
from leadlake.schema import TABLES, columns
from leadlake.sources.fixtures import CLOCK, FIXTURES, load_fixture, spark_schema
from leadlake.sources.partitioned import PartitionedLake
from leadlake.sources.tables import (
    Tables, apply_defaults, commit_snapshot, enum_violations, insert_ignore, load_tables, to_documents, with_total_value,
)
from leadlake.streaming.jobs import (
    append_files, audit_stream, lead_state, outbox_stream, read_stream, spend_job, stage_stream, upsert_stream,
)

Query = Callable[[SparkSession, str], DataFrame]


def over_tables(fn: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(load_fixture(spark, sf_dir))


def with_batch(name: str, fn: Callable[[Tables, DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = load_fixture(spark, sf_dir)
        return fn(t, load_batch(spark, sf_dir, t, name))

    return run


def _ids(array: str, field: str = "id", sep: str = ",", missing: str = "-"):
    return F.array_join(
        F.transform(array, lambda x: F.coalesce(x[field].cast("string"), F.lit(missing))), sep
    )


def _by_name(*functions) -> dict[str, Callable]:
    return {f.__name__: f for f in functions}


def _lead_360(t: Tables) -> DataFrame:
    money = F.aggregate("revenue", F.lit(0).cast(S.EXACT_SUM), lambda a, x: (a + x["total_value"]).cast(S.EXACT_SUM))
    return P.lead_360(t).select(
        "lead_id", "patient_name", "facility_name", "speciality_name", "doctor_name", "agent_name", "part", "parts",
        _ids("interactions").alias("interaction_ids"),
        _ids("interactions", "agent_name").alias("interaction_agents"),
        _ids("appointments").alias("appointment_ids"),
        _ids("appointments", "facility_name").alias("appointment_facilities"),
        _ids("revenue").alias("revenue_ids"), money.alias("revenue_sum"),
    )


def _patient_360(t: Tables, variant: str, field: str, out: str) -> DataFrame:
    return P.patient_360(t, variant).select(
        "patient_id", "full_name", "part", "parts", _ids("leads").alias("lead_ids"), _ids("leads", field).alias(out)
    )


def _duplicate_documents(t: Tables) -> DataFrame:
    return M.duplicate_documents(t).select(
        "type", "key", "count", "part", "parts", F.array_join("ids", ",").alias("ids"),
        _ids("members", "full_name", "|").alias("names"), _ids("members", "primary_phone", "|").alias("phones"),
    )


def _merge(t: Tables, requests: DataFrame) -> DataFrame:
    return _merged(M.merge_patients(t, requests))


def _merged(done) -> DataFrame:
    out = done.rejects.select(
        F.col("reason").alias("entity"), F.col("secondary_id").alias("id"), F.col("primary_id").alias("patient_id")
    )
    for entity, df in (("lead", done.tables.leads), ("appointment", done.tables.appointments), ("revenue", done.tables.revenue)):
        out = out.unionByName(df.select(F.lit(entity).alias("entity"), "id", "patient_id"))
    return out.unionByName(done.tables.patients.select(F.lit("patient").alias("entity"), "id", F.col("id").alias("patient_id")))


def _known_requests(t: Tables, requests: DataFrame) -> DataFrame:
    known = t.patients.select(F.col("id").alias("primary_id"))
    return M.resolve_mapping(requests.join(known, "primary_id", "left_semi"))[0]


_TABLE_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    **_by_name(
        V.leads_full, V.dashboard_stats, V.revenue_summary,
        D.leads_by_source, D.leads_by_speciality, D.revenue_total, D.recent_leads, D.channel_conversion,
        D.top_campaigns, D.funnel, D.speciality_conversion, D.top_doctors, D.facility_conversion,
        D.revenue_by_speciality_all, D.no_show_rate, D.revenue_breakdown, D.revenue_by_month,
        D.revenue_by_channel, D.revenue_by_speciality, D.revenue_by_facility, D.high_value_patients,
        D.revenue_by_payment_status, D.facility_leads, D.exec_summary,
        L.list_leads, L.visible_leads, L.list_appointments, L.list_revenue, L.list_patients,
        L.list_facilities, L.list_specialities, L.list_users, L.lead_interactions, L.audit_trail,
        L.list_webhooks, L.active_webhooks,
        M.duplicates_by_name, M.duplicates_by_phone, M.duplicate_groups,
        G.attempt_numbers, G.apply_interactions, G.latest_followup,
    ),
    **{
        f.__name__: (lambda t, f=f: f(t, CLOCK))
        for f in (D.at_risk_leads, D.leads_by_month, D.speciality_trend, D.channel_trend)
    },
    "filter_leads": lambda t: L.list_leads(
        t, stage="Interested ", source="organic", date_from="1997-01-01", date_to="1999-12-31"),
    "search_leads": lambda t: L.list_leads(t, search="PATIENT 12"),
    "page_info": lambda t: L.page_info(L.filter_leads(t.leads, stage="customer"), 1, 2000, cap=L.LEAD_PAGE_CAP),
    "sort_leads": lambda t: L.sort_leads(L.list_leads(t), "source", "asc"),
    "lead_page": lambda t: L.lead_page(t, 3, 50, "stage"),
    "lead_page_late": lambda t: L.lead_page(t, 6, 50, "stage", early=0),
    "leads_after": lambda t: _leads_after(t),
    "lead_page_by_facility": lambda t: L.lead_page(t, 2, 900, "facility", "ASC"),
    "appointments_in_range": lambda t: L.list_appointments(
        t, status="no_show", date_from="1998-01-01", date_to="1998-12-31"),
    "appointment_page": lambda t: L.appointment_page(t, 2),
    "revenue_page": L.revenue_page,
    "revenue_list_summary": lambda t: L.revenue_list_summary(
        t, facility_id=3, date_from="1997-01-01", date_to="1999-12-31"),
    "patient_page": lambda t: L.patient_page(t, search="10"),
    "list_doctors": lambda t: L.list_doctors(t).withColumn("consult_type", F.array_join("consult_type", "|")),
    "ad_spend_for": lambda t: L.ad_spend_for(t, as_of=CLOCK),
    "lead_360": _lead_360,
    "patient_360": lambda t: _patient_360(t, "history", "facility", "facilities"),
    "patient_360_enquiry": lambda t: _patient_360(t, "enquiry", "enquiry_type", "types"),
    "duplicate_documents": _duplicate_documents,
    "duplicates_by_name_all": lambda t: M.duplicates_by_name(t, n=None),
    "duplicates_by_phone_all": lambda t: M.duplicates_by_phone(t, n=None),
    "duplicate_groups_all": lambda t: M.duplicate_groups(t, n=None),
    "classify": lambda t: G.classify(t.interactions).select("id", "is_attempt", "is_no_response"),
}

_BATCH_QUERIES: dict[str, tuple[str, Callable[[Tables, DataFrame], DataFrame]]] = {
    "resolve_mapping": ("merge_requests", _known_requests),
    "merge_patients": ("merge_requests", _merge),
    "apply_events": ("event_log", G.apply_events),
}


# --- write jobs: new tables and refused rows as one frame (entity, key, detail) ---------


def _report(done, reject_key: str, tables: dict[str, list[str]]) -> DataFrame:
    out = done.rejects.select(
        F.concat(F.lit("reject "), F.col("reason")).alias("entity"),
        F.col(reject_key).cast("string").alias("key"), F.lit("").alias("detail"),
    )
    for table, (key, *cols) in tables.items():
        df = done.tables[table]
        if table == "doctors":
            df = df.withColumn("consult_type", F.array_join("consult_type", ","))
        shown = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cols]
        out = out.unionByName(df.select(
            F.lit(table).alias("entity"), F.col(key).cast("string").alias("key"),
            F.concat_ws("|", *shown).alias("detail"),
        ))
    return out


def numbered_ids(table: str, seq):
    """Whole-number ids like those of the fixtures."""
    return seq + F.lit(NEW_ID)


def _patch(batch: DataFrame, **flags: str) -> DataFrame:
    """Requests whose fields are present where their flag column says so."""
    entries = F.map_from_arrays(
        F.array(*[F.lit(c) for c in flags]),
        F.array(*[F.struct(F.col(f).alias("on"), (F.col(c) if c in batch.columns else F.lit("x")).alias("v"))
                  for c, f in flags.items()]),
    )
    fields = F.transform_values(F.map_filter(entries, lambda _, e: e["on"]), lambda _, e: e["v"])
    return batch.select("id", "seq", fields.alias("fields"))


PATCH_FLAGS = {
    "campaign_name": "has_campaign", "urgency": "has_urgency", "doctor_id": "has_doctor", "followup_date": "has_followup",
    "lead_stage": "has_stage",
}
LEAD_STATE = ["id", "lead_stage", "lead_substage", "updated_at"]
#: Columns shown of the tables that a job writes.
SHOWN: dict[str, dict[str, list[str]]] = {
    "ingest_leads": {
        "patients": ["id", "unique_pid", "full_name", "primary_phone", "email", "city", "patient_type"],
        "leads": ["id", "patient_id", "facility_id", "doctor_id", "assigned_to", "lead_source", "enquiry_type", "urgency",
                  "campaign_name", "lead_stage", "lead_substage", "ai_score", "enquiry_date"],
    },
    "update_leads": {"leads": ["id", "campaign_name", "urgency", "doctor_id", "followup_date", "lead_stage", "updated_at"]},
    "change_stage": {"leads": LEAD_STATE},
    "delete_leads": {"leads": ["id", "lead_stage"], "interactions": ["id", "lead_id"]},
    "ingest_interactions": {
        "interactions": ["id", "lead_id", "agent_id", "interaction_type", "outcome", "notes", "followup_date"],
        "leads": ["id", "lead_stage", "lead_substage", "attempt_count", "followup_date"],
    },
    "set_visit_status": {"appointments": ["id", "visit_status", "notes", "updated_at"], "leads": LEAD_STATE},
}
_WRITE_QUERIES = {
    "ingest_leads": ("lead_intake", lambda t, b: _report(
        W.ingest_leads(t, b, CLOCK, numbered_ids), "seq", SHOWN["ingest_leads"])),
    "update_leads": ("lead_patches", lambda t, b: _report(
        W.update_leads(t, _patch(b, **PATCH_FLAGS), CLOCK), "seq", SHOWN["update_leads"])),
    "change_stage": ("stage_changes", lambda t, b: _report(W.change_stage(t, b, CLOCK), "seq", SHOWN["change_stage"])),
    "save_ai": ("scores", lambda t, b: _report(
        W.save_ai(t, b, CLOCK), "seq", {"leads": ["id", "ai_score", "ai_priority", "ai_reason", "ai_next_action", "updated_at"]})),
    "delete_leads": ("lead_deletes", lambda t, b: _report(
        W.delete_leads(t, b), "id", SHOWN["delete_leads"])),
    "ingest_interactions": ("new_interactions", lambda t, b: _report(
        W.ingest_interactions(t, b, CLOCK, 3, numbered_ids), "seq", SHOWN["ingest_interactions"])),
    "delete_interactions": ("interaction_deletes", lambda t, b: _report(
        W.delete_interactions(t, b), "id", {"interactions": ["id", "lead_id"]})),
    "book_appointments": ("bookings", lambda t, b: _report(
        W.book_appointments(t, b, CLOCK, numbered_ids), "seq",
        {"appointments": ["id", "lead_id", "patient_id", "facility_id", "doctor_id", "appointment_date", "consult_type",
                          "visit_status", "notes"], "leads": LEAD_STATE})),
    "set_visit_status": ("visit_changes", lambda t, b: _report(
        W.set_visit_status(t, b, CLOCK), "seq", SHOWN["set_visit_status"])),
    "post_revenue": ("bills", lambda t, b: _report(
        W.post_revenue(t, b, CLOCK, numbered_ids), "seq",
        {"revenue": ["id", "appointment_id", "lead_id", "consultation_value", "procedure_value", "package_value",
                     "total_value", "payment_status", "billed_date"], "leads": LEAD_STATE})),
    "create_patients": ("patient_forms", lambda t, b: _report(
        W.create_patients(t, b, CLOCK, numbered_ids), "seq",
        {"patients": ["id", "unique_pid", "full_name", "primary_phone", "email", "city", "patient_type"]})),
    "update_patients": ("patient_patches", lambda t, b: _report(
        W.update_patients(t, _patch(b, city="has_city", age="has_age", full_name="has_name"), CLOCK), "seq",
        {"patients": ["id", "full_name", "city", "age", "updated_at"]})),
    "upsert_facilities": ("facility_forms", lambda t, b: _report(
        W.upsert_facilities(t, b, "replace", CLOCK, lambda table, seq: seq + F.lit(1_000_000)), "seq",
        {"facilities": ["id", "name", "type", "city", "region", "address", "is_active"]})),
    "upsert_facilities_patch": ("facility_forms", lambda t, b: _report(
        W.upsert_facilities(t, b, "patch", CLOCK, lambda table, seq: seq + F.lit(1_000_000)), "seq",
        {"facilities": ["id", "name", "type", "city", "region", "address", "is_active"]})),
    "create_specialities": ("speciality_forms", lambda t, b: _report(
        W.create_specialities(t, b, CLOCK, lambda table, seq: F.concat(F.lit("new-"), seq.cast("string"))), "seq",
        {"specialities": ["id", "name", "description", "is_active"]})),
    "upsert_doctors": ("doctor_forms", lambda t, b: _report(
        W.upsert_doctors(t, b, "replace", CLOCK, numbered_ids), "seq",
        {"doctors": ["id", "name", "speciality_id", "facility_id", "consult_type", "availability", "is_active"]})),
    "upsert_doctors_patch": ("doctor_forms", lambda t, b: _report(
        W.upsert_doctors(t, b, "patch", CLOCK, numbered_ids), "seq",
        {"doctors": ["id", "name", "speciality_id", "facility_id", "consult_type", "availability", "is_active"]})),
    "upsert_users": ("user_forms", lambda t, b: _report(
        W.upsert_users(t, b, "replace", CLOCK, numbered_ids), "seq",
        {"users": ["id", "name", "email", "role", "is_active", "updated_at"]})),
    "upsert_users_patch": ("user_forms", lambda t, b: _report(
        W.upsert_users(t, b, "patch", CLOCK, numbered_ids), "seq",
        {"users": ["id", "name", "email", "role", "is_active", "updated_at"]})),
    "upsert_ad_spend": ("spends", lambda t, b: _report(
        W.upsert_ad_spend(t, b, CLOCK), "seq", {"ad_spend": ["channel", "month", "monthly_spend", "updated_at"]})),
    "upsert_webhooks": ("hook_forms", lambda t, b: _report(
        W.upsert_webhooks(t, b, CLOCK, 5), "seq", {"webhooks": ["event_type", "url", "is_active", "created_by"]})),
    "disable_webhooks": ("hook_stops", lambda t, b: _report(
        W.disable_webhooks(t, b, CLOCK), "event_type", {"webhooks": ["event_type", "url", "is_active"]})),
    "upsert_settings": ("setting_forms", lambda t, b: _report(
        W.upsert_settings(t, b, CLOCK), "seq", {"system_settings": ["setting_key", "setting_value"]})),
    "log_emails": ("deliveries", lambda t, b: _report(
        W.log_emails(t, b, CLOCK, numbered_ids), "seq",
        {"interactions": ["id", "lead_id", "agent_id", "interaction_type", "outcome", "notes"]})),
    "apply_scores": ("score_replies", lambda t, b: _report(
        X.apply_scores(t, b, CLOCK), "seq", {"leads": ["id", "ai_score", "ai_priority", "ai_reason", "ai_next_action"]})),
    "parse_scores": ("score_replies", lambda t, b: X.parse_scores(b).drop("seq")),
    "event_outbox": ("stage_changes", lambda t, b: _outbox(t, b)),
    "created_outbox": ("lead_intake", lambda t, b: _created_outbox(t, b)),
    "audit_rows": ("event_log", lambda t, b: _audit(t, b)),
    "apply_defaults": ("lead_intake", lambda t, b: apply_defaults(
        b.withColumn("patient_id", F.col("seq")), "leads", CLOCK, F.col("seq"), blanks=True).select(
            "id", "enquiry_type", "urgency", "lead_source", "lead_stage", "lead_substage", "attempt_count", "ai_score",
            "ai_priority", "campaign_name", "enquiry_date")),
    "insert_ignore": ("speciality_forms", lambda t, b: insert_ignore(
        t.specialities, apply_defaults(
            b.withColumn("id", F.concat(F.lit("new-"), F.col("seq").cast("string"))), "specialities", CLOCK
        ).withColumn("seq", F.substring("id", 5, 20).cast("bigint")), [("name",)], "seq").select("id", "name", "description")),
}


def _outbox(t: Tables, changes: DataFrame) -> DataFrame:
    done = W.change_stage(t, changes, CLOCK)
    sent = O.event_outbox(t, O.stage_changed_events(done.accepted, "7"), CLOCK)
    body = F.from_json(
        "body",
        "event string, timestamp string, source string,"
        " data struct<id: bigint, lead_stage: string, lead_substage: string, changed_by: string>",
    )
    return sent.select("event_type", "entity_id", "url", body.alias("b")).select(
        "event_type", "entity_id", "url", "b.event", "b.timestamp", "b.source", "b.data.id", "b.data.lead_stage",
        "b.data.lead_substage", "b.data.changed_by",
    )


def _created_outbox(t: Tables, intake: DataFrame) -> DataFrame:
    """Messages of new leads; a hook for them is added, whatever hooks there are."""
    made = W.ingest_leads(t, intake, CLOCK, numbered_ids).accepted
    hook = t.webhooks.limit(1).withColumns({"event_type": F.lit("Lead_Created"), "url": F.lit("https://example.com/new"), "is_active": F.lit(True)})
    hooks = t.webhooks.where("lower(event_type) <> 'lead_created'").unionByName(hook)
    sent = O.event_outbox(t.replace(webhooks=hooks), O.lead_created_events(made), CLOCK)
    data = "id bigint, patient_id bigint, lead_source string, lead_stage string, facility_id bigint, campaign_name string"
    body = F.from_json("body", f"event string, timestamp string, source string, data struct<{data.replace(' ', ': ').replace(',:', ',')}>")
    return sent.select("event_type", "entity_id", "url", body.alias("b")).select(
        "event_type", "entity_id", "url", "b.event", "b.timestamp", "b.source", "b.data.*")


def _request_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial updates and stage changes of the same leads as one batch of requests."""
    t = load_fixture(spark, sf_dir)
    patches, changes = (load_batch(spark, sf_dir, t, name) for name in ("lead_patches", "stage_changes"))
    done = W.update_leads(t, _patch(patches, **PATCH_FLAGS), CLOCK).accepted
    moved = W.change_stage(t, changes, CLOCK).accepted
    requests = A.update_requests(done, W.LEAD_FIELDS, F.col("seq") * 2).union(A.stage_requests(moved, F.col("seq") * 2 + 1))
    rows = A.request_audit(t.leads, requests, W.LEAD_FIELDS, CLOCK, 7, rows=1000)
    value = lambda side, c: F.get_json_object(f"{side}_values", f"$.{c}").alias(f"{side}_{c}")
    fields = ("lead_stage", "lead_substage", "campaign_name", "urgency", "doctor_id")
    return rows.select(
        "seq", "user_id", "entity_type", "entity_id", "action", "created_at", value("old", "patient_id"),
        *[value(side, c) for side in ("old", "new") for c in fields])


def _leads_after(t: Tables) -> DataFrame:
    """The fourth page of the lead list by stage, by the cursor of the third one's last lead."""
    third = L.lead_page(t, 3, 50, "stage").collect()
    order = L.lead_order("stage")
    last = t.leads.where(F.col("id") == third[-1]["id"]).select(*[k.value.alias(k.name) for k in order]).first().asDict()
    return L.leads_after(t, last, 50, "stage").drop("sort_key")


def _audit(t: Tables, log: DataFrame) -> DataFrame:
    after = G.advance(t.leads, G.log_events(log), CLOCK)
    rows = A.audit_rows(t.leads, after, CLOCK, 7)
    return rows.select(
        "user_id", "entity_type", "entity_id", "action", "created_at",
        F.get_json_object("old_values", "$.lead_stage").alias("old_stage"),
        F.get_json_object("new_values", "$.lead_stage").alias("new_stage"),
        F.get_json_object("new_values", "$.followup_date").alias("new_followup"),
        F.get_json_object("new_values", "$.attempt_count").alias("new_count"),
    )


def _broken(t: Tables) -> Tables:
    """Tables with violations: new patients and untouched leads removed, e-mails and stages overwritten."""
    return t.replace(
        patients=t.patients.where("patient_type = 'existing'").withColumn("gender", F.lower("city")),
        users=t.users.withColumn("email", F.initcap("role")),
        leads=t.leads.where("lead_stage <> 'untouched'").withColumn("urgency", F.col("lead_source")),
        facilities=t.facilities.where("is_active"),
    )


_TABLE_QUERIES.update({
    **_by_name(X.score_features, X.followup_features, X.insight_features, W.read_settings),
    "fk_violations": lambda t: I.fk_violations(_broken(t)),
    "orphans": lambda t: I.orphans(_broken(t), "leads", "patient_id").select("id", "patient_id"),
    "key_violations": lambda t: I.key_violations(_broken(t)),
    "enum_violations": lambda t: enum_violations(_broken(t)),
    "with_total_value": lambda t: with_total_value(t.revenue.drop("total_value")).select("id", "total_value"),
    "to_documents": lambda t: to_documents(t.leads.select("id", "lead_stage", "doctor_id", "attempt_count")),
    "dashboard_summary": lambda t: D.labelled_documents(dashboard(t, "summary", CLOCK)),
    "dashboard_marketing": lambda t: D.labelled_documents(dashboard(t, "marketing", CLOCK)),
    "dashboard_cxo": lambda t: D.labelled_documents(dashboard(t, "cxo", CLOCK)),
    "dashboard_finance": lambda t: D.labelled_documents(dashboard(t, "finance", CLOCK)),
})


# --- streams: the events table as a file stream, run to its end -------------------------


def _event_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Interactions or audit rows derived from the events table while it streams in."""
    path = f"{sf_dir}/events.parquet"
    # a pattern, as the stream source takes folders and patterns but no single file
    stream = read_stream(spark, f"{sf_dir}/events.parque[t]", spark.read.parquet(path).schema)
    stream.createOrReplaceTempView("stream_events")
    rows = spark.sql(FIXTURES[table].replace("from events", "from stream_events"))
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in rows.schema if f.dataType.typeName() == "timestamp"})


def _workspace(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/job-{uuid.uuid4().hex}"


def _finished(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def _stage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, home = load_fixture(spark, sf_dir), _workspace(spark)
    events = G.interaction_events(_event_stream(spark, sf_dir, "interactions"))
    _finished(stage_stream(events, f"{home}/checkpoint"))
    return lead_state(spark, t.leads, f"{home}/checkpoint")


def _outbox_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, home = load_fixture(spark, sf_dir), _workspace(spark)
    log = _event_stream(spark, sf_dir, "audit_logs")
    events = log.where("action = 'STAGE_CHANGE'").select(
        F.lit(O.STAGE_CHANGED).alias("event_type"), "entity_id", F.col("new_values").alias("data"),
        F.col("created_at").alias("occurred_at"))
    _finished(append_files(outbox_stream(events, t.webhooks), f"{home}/outbox", f"{home}/checkpoint"))
    sent = spark.read.parquet(f"{home}/outbox")
    return sent.select("event_type", "entity_id", "url", F.get_json_object("body", "$.data.k").alias("k"))


def _audit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = _workspace(spark)
    log = _event_stream(spark, sf_dir, "audit_logs").drop("id").withColumnRenamed("created_at", "occurred_at")
    _finished(append_files(audit_stream(log), f"{home}/audit", f"{home}/checkpoint"))
    return spark.read.parquet(f"{home}/audit").drop("id", "old_values", "ip_address")


def _upsert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, home = load_fixture(spark, sf_dir), _workspace(spark)
    commit_snapshot(spark, f"{home}/lake", 0, t, ["ad_spend"])
    talks = _event_stream(spark, sf_dir, "interactions")
    spends = talks.select(
        F.col("id").alias("seq"), F.upper("interaction_type").alias("channel"),
        F.col("lead_id").cast("string").alias("monthly_spend"), S.month_key("interaction_date").alias("month"))
    _finished(upsert_stream(spends, f"{home}/lake", spend_job(CLOCK), ("ad_spend",), f"{home}/checkpoint"))
    return load_tables(spark, f"{home}/lake").ad_spend.select("channel", "month", "monthly_spend")


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all tables as a snapshot and read them back: rows and a digest of all values per table."""
    back = commit_snapshot(spark, _workspace(spark), 1, load_fixture(spark, sf_dir))
    out = None
    for table in TABLES:
        df = back[table].withColumn("consult_type", F.array_join("consult_type", ",")) if table == "doctors" else back[table]
        names = columns(table) + (["total_value"] if table == "revenue" else [])
        line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in names])
        part = F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")
        told = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(part), F.lit(0)).alias("digest"))
        told = told.select(F.lit(table).alias("table_name"), "rows", "digest")
        out = told if out is None else out.unionByName(told)
    return out


#: Jobs run on month folders: job, batch, what to do with the batch, arguments, key of refused rows.
_LAKE_JOBS = {
    "ingest_leads": (W.ingest_leads, "lead_intake", None, (CLOCK, numbered_ids), "seq"),
    "update_leads": (W.update_leads, "lead_patches", lambda b: _patch(b, **PATCH_FLAGS), (CLOCK,), "seq"),
    "change_stage": (W.change_stage, "stage_changes", None, (CLOCK,), "seq"),
    "delete_leads": (W.delete_leads, "lead_deletes", None, (), "id"),
    "ingest_interactions": (W.ingest_interactions, "new_interactions", None, (CLOCK, 3, numbered_ids), "seq"),
    "set_visit_status": (W.set_visit_status, "visit_changes", None, (CLOCK,), "seq"),
}


def _in_months(name: str) -> Query:
    """A write job on month folders: touched months are replaced, new rows appended, and all read back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        job, batch_name, made, args, key = _LAKE_JOBS[name]
        t = load_fixture(spark, sf_dir)
        batch = load_batch(spark, sf_dir, t, batch_name)
        lake = PartitionedLake(spark, f"{_workspace(spark)}/lake", spark_schema, t).create(t, list(SHOWN[name]))
        return _report(lake.run(job, made(batch) if made else batch, *args), key, SHOWN[name])

    return run


def _indexed(spark: SparkSession, sf_dir: str, search: Callable[[Tables, Q.SearchIndex], DataFrame]) -> DataFrame:
    """A search over patients of which half are indexed at first and the others added."""
    t = load_fixture(spark, sf_dir)
    early = F.col("id") % 2 == 0
    index = Q.SearchIndex(spark, f"{_workspace(spark)}/search").build(t.patients.where(early)).add(t.patients.where(~early))
    return search(t, index)


def _months_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load_fixture(spark, sf_dir)
    lake = PartitionedLake(spark, f"{_workspace(spark)}/lake", spark_schema, t)
    lake.create(t, ["patients", "leads", "appointments", "revenue"])
    return _merged(lake.run(M.merge_patients, load_batch(spark, sf_dir, t, "merge_requests")))


def _delete_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Take in new leads first: their new patients have no visits yet and can be deleted."""
    t = load_fixture(spark, sf_dir)
    ids = load_batch(spark, sf_dir, t, "patient_deletes")
    done = W.delete_patients(W.ingest_leads(t, load_batch(spark, sf_dir, t, "lead_intake"), CLOCK, numbered_ids).tables, ids)
    return _report(done, "id", {
        "patients": ["id", "patient_type"], "leads": ["id", "patient_id"], "interactions": ["id", "lead_id"]})


_SESSION_QUERIES: dict[str, Query] = {
    "delete_patients": _delete_patients,
    "stage_stream": _stage_stream,
    "outbox_stream": _outbox_stream,
    "audit_stream": _audit_stream,
    "upsert_stream": _upsert_stream,
    "load_tables": _round_trip,
    "search_leads_indexed": lambda spark, sf_dir: _indexed(spark, sf_dir, lambda t, i: Q.search_leads(t, i, "PATIENT 12")),
    "patient_search_indexed": lambda spark, sf_dir: _indexed(spark, sf_dir, lambda t, i: Q.search_patients(t, i, "10")),
    "request_audit": _request_audit,
    **{f"{name}_in_months": _in_months(name) for name in _LAKE_JOBS},
    "merge_patients_in_months": _months_merge,
}


def queries() -> dict[str, Query]:
    found = {k: over_tables(f) for k, f in _TABLE_QUERIES.items()}
    found.update({k: with_batch(b, f) for k, (b, f) in {**_BATCH_QUERIES, **_WRITE_QUERIES}.items()})
    found.update(_SESSION_QUERIES)
    return found

"""The thirteen tables: column types, defaults, value domains, keys and references."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T

# --- fixed values: the value domains of the data model, in their sort order ---
USER_ROLES = ("admin", "cxo", "marketing", "finance", "agent", "calling_agent")
FACILITY_TYPES = ("hospital", "clinic", "diagnostic_center")
CONSULT_TYPES = ("opd", "surgery", "tele", "visiting")
AVAILABILITY = ("available", "unavailable", "on_leave")
GENDERS = ("male", "female", "other")
PATIENT_TYPES = ("new", "existing")
ENQUIRY_TYPES = ("appointment", "consultation", "procedure", "package", "emergency", "teleconsult")
URGENCIES = ("low", "medium", "high", "emergency")
LEAD_SOURCES = (
    "google_ads", "meta_ads", "organic", "direct", "referral",
    "walk_in", "whatsapp", "call", "aggregator",
)
LEAD_STAGES = (
    "untouched", "attempted", "interested", "customer", "not_interested",
    "ineligible", "invalid", "unanswered", "potential",
)
AI_PRIORITIES = ("high", "medium", "low")
INTERACTION_TYPES = ("call", "whatsapp", "email", "sms", "visit", "note")
VISIT_STATUSES = ("booked", "confirmed", "visited", "no_show", "cancelled", "rescheduled")
PAYMENT_STATUSES = ("pending", "partial", "paid", "refunded")
# --- end of fixed values ---

RESTRICTED_ROLES = ("agent", "calling_agent")


class Col(NamedTuple):
    name: str
    kind: str
    default: object = None  # AS_OF stands for the job's clock
    required: bool = False


AS_OF = object()

_SPARK_TYPES = {
    "id": T.StringType(),
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "bool": T.BooleanType(),
    "date": T.DateType(),
    "ts": T.TimestampNTZType(),
    "money": T.DecimalType(12, 2),
    "set": T.StringType(),
}


def _created(updated: bool = True) -> list[Col]:
    cols = [Col("created_at", "ts", AS_OF)]
    return cols + ([Col("updated_at", "ts", AS_OF)] if updated else [])


TABLES: dict[str, list[Col]] = {
    "users": [
        Col("id", "id", required=True),
        Col("name", "string", required=True),
        Col("email", "string", required=True),
        Col("password_hash", "string", required=True),
        Col("role", "string", "agent"),
        Col("is_active", "bool", True),
        *_created(),
    ],
    "facilities": [
        Col("id", "id", required=True),
        Col("name", "string", required=True),
        Col("type", "string", "clinic"),
        Col("city", "string"),
        Col("region", "string"),
        Col("address", "string"),
        Col("is_active", "bool", True),
        *_created(updated=False),
    ],
    "specialities": [
        Col("id", "id", required=True),
        Col("name", "string", required=True),
        Col("description", "string"),
        Col("is_active", "bool", True),
        *_created(updated=False),
    ],
    "doctors": [
        Col("id", "id", required=True),
        Col("name", "string", required=True),
        Col("speciality_id", "id", required=True),
        Col("facility_id", "id", required=True),
        Col("consult_type", "set", "opd"),
        Col("availability", "string", "available"),
        Col("is_active", "bool", True),
        *_created(updated=False),
    ],
    "patients": [
        Col("id", "id", required=True),
        Col("unique_pid", "string"),
        Col("full_name", "string", required=True),
        Col("primary_phone", "string", required=True),
        Col("email", "string"),
        Col("city", "string"),
        Col("age", "int"),
        Col("gender", "string"),
        Col("patient_type", "string", "new"),
        *_created(),
    ],
    "leads": [
        Col("id", "id", required=True),
        Col("patient_id", "id", required=True),
        Col("facility_id", "id", required=True),
        Col("speciality_id", "id", required=True),
        Col("doctor_id", "id"),
        Col("assigned_to", "id"),
        Col("enquiry_type", "string", "appointment"),
        Col("medical_concern", "string"),
        Col("urgency", "string", "medium"),
        Col("lead_source", "string", "direct"),
        Col("lead_medium", "string"),
        Col("campaign_name", "string"),
        Col("utm_source", "string"),
        Col("utm_medium", "string"),
        Col("utm_campaign", "string"),
        Col("utm_term", "string"),
        Col("utm_content", "string"),
        Col("lead_stage", "string", "untouched"),
        Col("lead_substage", "string", "Fresh Lead"),
        Col("followup_date", "date"),
        Col("attempt_count", "int", 0),
        Col("ai_score", "int", 50),
        Col("ai_priority", "string", "medium"),
        Col("ai_reason", "string"),
        Col("ai_next_action", "string"),
        Col("enquiry_date", "ts", AS_OF),
        *_created(),
    ],
    "interactions": [
        Col("id", "id", required=True),
        Col("lead_id", "id", required=True),
        Col("agent_id", "id"),
        Col("interaction_type", "string", "call"),
        Col("outcome", "string", required=True),
        Col("notes", "string"),
        Col("followup_date", "date"),
        Col("duration_mins", "int"),
        Col("seq", "long"),  # order of arrival over all batches
        Col("interaction_date", "ts", AS_OF),
        *_created(updated=False),
    ],
    "appointments": [
        Col("id", "id", required=True),
        Col("lead_id", "id", required=True),
        Col("patient_id", "id", required=True),
        Col("facility_id", "id", required=True),
        Col("doctor_id", "id"),
        Col("appointment_date", "ts", required=True),
        Col("consult_type", "string", "opd"),
        Col("visit_status", "string", "booked"),
        Col("notes", "string"),
        *_created(),
    ],
    "revenue": [
        Col("id", "id", required=True),
        Col("appointment_id", "id", required=True),
        Col("lead_id", "id", required=True),
        Col("patient_id", "id", required=True),
        Col("consultation_value", "money", 0),
        Col("procedure_value", "money", 0),
        Col("package_value", "money", 0),
        Col("payment_status", "string", "pending"),
        Col("notes", "string"),
        Col("billed_date", "ts", AS_OF),
        *_created(),
    ],
    "audit_logs": [
        Col("id", "id", required=True),
        Col("user_id", "id"),
        Col("entity_type", "string", required=True),
        Col("entity_id", "id", required=True),
        Col("action", "string", required=True),
        Col("old_values", "string"),
        Col("new_values", "string"),
        Col("ip_address", "string"),
        *_created(updated=False),
    ],
    "system_settings": [
        Col("id", "id", required=True),
        Col("setting_key", "string", required=True),
        Col("setting_value", "string"),
        Col("updated_by", "id"),
        *_created(),
    ],
    "webhooks": [
        Col("id", "id", required=True),
        Col("event_type", "string", required=True),
        Col("url", "string", required=True),
        Col("is_active", "bool", True),
        Col("created_by", "id"),
        *_created(),
    ],
    "ad_spend": [
        Col("id", "id", required=True),
        Col("channel", "string", required=True),
        Col("month", "string", required=True),
        Col("monthly_spend", "money", 0),
        *_created(),
    ],
}

ENUMS: dict[tuple[str, str], tuple[str, ...]] = {
    ("users", "role"): USER_ROLES,
    ("facilities", "type"): FACILITY_TYPES,
    ("doctors", "availability"): AVAILABILITY,
    ("patients", "gender"): GENDERS,
    ("patients", "patient_type"): PATIENT_TYPES,
    ("leads", "enquiry_type"): ENQUIRY_TYPES,
    ("leads", "urgency"): URGENCIES,
    ("leads", "lead_source"): LEAD_SOURCES,
    ("leads", "lead_stage"): LEAD_STAGES,
    ("leads", "ai_priority"): AI_PRIORITIES,
    ("interactions", "interaction_type"): INTERACTION_TYPES,
    ("appointments", "consult_type"): CONSULT_TYPES,
    ("appointments", "visit_status"): VISIT_STATUSES,
    ("revenue", "payment_status"): PAYMENT_STATUSES,
}

# child table, child column, parent table
REFERENCES: list[tuple[str, str, str]] = [
    ("doctors", "speciality_id", "specialities"),
    ("doctors", "facility_id", "facilities"),
    ("leads", "patient_id", "patients"),
    ("leads", "facility_id", "facilities"),
    ("leads", "speciality_id", "specialities"),
    ("leads", "doctor_id", "doctors"),
    ("leads", "assigned_to", "users"),
    ("interactions", "lead_id", "leads"),
    ("interactions", "agent_id", "users"),
    ("appointments", "lead_id", "leads"),
    ("appointments", "patient_id", "patients"),
    ("appointments", "facility_id", "facilities"),
    ("appointments", "doctor_id", "doctors"),
    ("revenue", "appointment_id", "appointments"),
    ("revenue", "lead_id", "leads"),
    ("revenue", "patient_id", "patients"),
]

# natural keys other than the primary key; they compare without case, accents or trailing spaces
UNIQUE_KEYS: dict[str, list[tuple[str, ...]]] = {
    "users": [("email",)],
    "specialities": [("name",)],
    "patients": [("primary_phone",)],
    "system_settings": [("setting_key",)],
    "webhooks": [("event_type",)],
    "ad_spend": [("channel", "month")],
}


# columns with a default that may still be set to NULL
NULLABLE_DEFAULTS = {("leads", "urgency"), ("leads", "ai_score"), ("leads", "ai_priority"), ("system_settings", "setting_value")}


# several values of a list in one column
SETS: dict[tuple[str, str], tuple[str, ...]] = {("doctors", "consult_type"): CONSULT_TYPES}


def not_null(table: str) -> set[str]:
    """Columns that must not be emptied by an update."""
    return {
        c.name for c in TABLES[table]
        if c.required or (c.default is not None and (table, c.name) not in NULLABLE_DEFAULTS)
    }


def struct_type(table: str) -> T.StructType:
    """The stored schema of a table; ``total_value`` is computed on load, not stored."""
    return T.StructType([T.StructField(c.name, _SPARK_TYPES[c.kind], True) for c in TABLES[table]])


def spark_type(kind: str) -> T.DataType:
    return _SPARK_TYPES[kind]


def columns(table: str) -> list[str]:
    return [c.name for c in TABLES[table]]


def has_id(table: str) -> bool:
    return table in TABLES and TABLES[table][0].name == "id"

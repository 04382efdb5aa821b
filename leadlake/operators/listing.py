"""Filtered, searched, sorted and paged lists."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlake.functions import paging
from leadlake.functions import semantics as S
from leadlake.functions.paging import SortKey, order_by, rows_after
from leadlake.functions.reliability import bounded
from leadlake.operators.views import join_lead_names
from leadlake.schema import LEAD_SOURCES, LEAD_STAGES, RESTRICTED_ROLES
from leadlake.sources.tables import Tables

LEAD_PAGE_CAP = 500
DEFAULT_PAGE = 50

_LEAD_LIST = (
    "l.id", "l.lead_stage", "l.lead_substage", "l.lead_source", "l.lead_medium", "l.campaign_name",
    "l.enquiry_type", "l.medical_concern", "l.urgency", "l.followup_date", "l.ai_score", "l.ai_priority",
    "l.ai_reason", "l.ai_next_action", "l.enquiry_date", "l.created_at",
    "p.id AS patient_id", "p.full_name AS patient_name", "p.primary_phone", "p.email AS patient_email",
    "p.city", "p.patient_type",
    "f.id AS facility_id", "f.name AS facility_name",
    "sp.id AS speciality_id", "sp.name AS speciality_name",
    "d.id AS doctor_id", "d.name AS doctor_name",
    "u.id AS agent_id", "u.name AS agent_name",
)

# --- fixed values: sort keys of the list and their columns ---
SORT_KEYS = {
    "name": "patient_name", "phone": "primary_phone", "date": "enquiry_date", "ai_score": "ai_score",
    "stage": "lead_stage", "follow-up": "followup_date", "source": "lead_source",
    "facility": "facility_name", "speciality": "speciality_name", "doctor": "doctor_name",
}
# --- end of fixed values ---
_ENUM_SORTS = {"lead_stage": LEAD_STAGES, "lead_source": LEAD_SOURCES}
_TEXT_SORTS = {"patient_name", "primary_phone", "facility_name", "speciality_name", "doctor_name"}
_OWN_SORTS = {"enquiry_date", "ai_score", "lead_stage", "followup_date", "lead_source"}


def filter_leads(
    leads: DataFrame, stage=None, source=None, speciality_id=None, facility_id=None, doctor_id=None,
    assigned_to=None, date_from=None, date_to=None,
) -> DataFrame:
    """Optional filters on the lead's own columns; both end days are whole days."""
    chosen = {
        "lead_stage": stage, "lead_source": source, "speciality_id": speciality_id,
        "facility_id": facility_id, "doctor_id": doctor_id, "assigned_to": assigned_to,
    }
    for column, value in chosen.items():
        if value not in (None, ""):
            if column in ("lead_stage", "lead_source"):
                value = str(value).rstrip().lower()
            leads = leads.where(F.col(column) == value)
    if date_from or date_to:
        leads = leads.where(S.day_range("enquiry_date", date_from, date_to, whole_last_day=True))
    return leads


def visible_to(df: DataFrame, user_id, role: str, column: str = "assigned_to") -> DataFrame:
    """Rows one user may see: restricted roles see only what is assigned to them."""
    return df.where(F.col(column) == user_id) if role in RESTRICTED_ROLES else df


def visible_leads(t: Tables) -> DataFrame:
    """(user, lead) pairs of all restricted users at once; other roles see every lead."""
    agents = t.users.where(F.col("role").isin(*RESTRICTED_ROLES)).select(
        F.col("id").alias("user_id"), "role"
    )
    return t.leads.select(F.col("id").alias("lead_id"), F.col("assigned_to").alias("user_id")).join(
        agents, "user_id"
    )


def list_leads(t: Tables, search: str | None = None, literal: bool = True, **filters) -> DataFrame:
    """All matching leads with names: 30 columns, unordered."""
    rows = join_lead_names(filter_leads(t.leads, **filters), t)
    if search:
        rows = rows.where(S.search_any(["p.full_name", "p.primary_phone", "p.email"], search, literal))
    return rows.selectExpr(*_LEAD_LIST)


def newest(column: str) -> list[SortKey]:
    """Latest first, then by id."""
    return [SortKey(column, F.col(column), True), SortKey("id", F.col("id"))]


def lead_order(sort_by: str = "date", direction: str = "DESC") -> list[SortKey]:
    """Sort keys of the lead list: unknown keys sort by enquiry date, value lists in
    their declared order, texts without case and accents; the id breaks ties."""
    column = SORT_KEYS.get(sort_by, "enquiry_date")
    if column in _ENUM_SORTS:
        key = S.enum_rank(column, _ENUM_SORTS[column])
    elif column in _TEXT_SORTS:
        key = S.ci_key(column)
    else:
        key = F.col(column)
    ascending = (direction or "").upper() == "ASC"
    return [SortKey("sort_key", key, not ascending), SortKey("id", F.col("id"))]


def sort_leads(df: DataFrame, sort_by: str = "date", direction: str = "DESC") -> DataFrame:
    return df.orderBy(*order_by(lead_order(sort_by, direction)))


def lead_page(
    t: Tables, page: int = 1, limit: int = DEFAULT_PAGE, sort_by: str = "date", direction: str = "DESC",
    search: str | None = None, user: tuple | None = None, cap: int | None = LEAD_PAGE_CAP, early: int = paging.EARLY,
    **filters,
) -> DataFrame:
    """One page of the lead list, of ``limit`` rows but at most ``cap`` (None: no such bound).
    Pages behind the first ``early`` leads are found by ranges (see :mod:`leadlake.functions.paging`).

    When neither search nor sort needs a joined column, the page is cut on the
    leads alone and only its rows are joined (each lead has its references).
    """
    leads = filter_leads(t.leads, **filters)
    if user is not None:
        leads = visible_to(leads, *user)
    order = lead_order(sort_by, direction)
    if not search and SORT_KEYS.get(sort_by, "enquiry_date") in _OWN_SORTS:
        cut = paging.page(leads, page, limit, order, cap, early)
        return sort_leads(list_leads(t.replace(leads=bounded(cut, limit))), sort_by, direction)
    return paging.page(list_leads(t.replace(leads=leads), search), page, limit, order, cap, early)


def leads_after(
    t: Tables, last: Mapping | None = None, limit: int = DEFAULT_PAGE, sort_by: str = "date", direction: str = "DESC",
    user: tuple | None = None, **filters,
) -> DataFrame:
    """The lead list by cursor: the ``limit`` leads behind ``last`` (``sort_key`` and ``id`` of the last
    lead seen), with ``sort_key``. However deep the reader is, a task keeps ``limit`` leads.
    """
    leads = filter_leads(t.leads, **filters)
    if user is not None:
        leads = visible_to(leads, *user)
    order = lead_order(sort_by, direction)
    if SORT_KEYS.get(sort_by, "enquiry_date") in _OWN_SORTS:
        cut = bounded(rows_after(leads, last, limit, order), limit)
        rows = list_leads(t.replace(leads=cut)).withColumn("sort_key", order[0].value)
    else:
        rows = rows_after(list_leads(t.replace(leads=leads)), last, limit, order)
    return rows.orderBy(*order_by(order))


def page_info(df: DataFrame, page: int = 1, limit: int = DEFAULT_PAGE, cap: int | None = None) -> DataFrame:
    """Row count of a list and its number of pages, in one row. ``cap`` is that of the list's pages:
    ``LEAD_PAGE_CAP`` for the lead list, none for the others."""
    size = min(limit, cap) if cap else limit
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(page).alias("page"), F.lit(size).alias("limit"),
        F.ceil(F.col("total") / size).cast("bigint").alias("pages"),
    )


def _names(df: DataFrame, key: str, out: str) -> DataFrame:
    return df.select(F.col("id").alias(key), F.col("name").alias(out))


def _filter_appointments(
    a: DataFrame, status=None, facility_id=None, doctor_id=None, date_from=None, date_to=None
) -> DataFrame:
    """Optional filters on the appointment's own columns."""
    for column, value in {"visit_status": status, "facility_id": facility_id, "doctor_id": doctor_id}.items():
        if value not in (None, ""):
            if column == "visit_status":
                value = str(value).rstrip().lower()
            a = a.where(F.col(column) == value)
    if date_from or date_to:
        a = a.where(S.day_range("appointment_date", date_from, date_to, whole_last_day=False))
    return a


def list_appointments(t: Tables, **filters) -> DataFrame:
    """Appointments with names; the speciality is that of the appointment's lead."""
    a = _filter_appointments(t.appointments, **filters)
    columns = a.columns
    people = t.patients.select(
        F.col("id").alias("patient_id"), F.col("full_name").alias("patient_name"), "primary_phone"
    )
    fields = t.leads.select(F.col("id").alias("lead_id"), "speciality_id")
    return (
        a.join(people, "patient_id")
        .join(fields, "lead_id")
        .join(_names(t.facilities, "facility_id", "facility_name"), "facility_id")
        .join(_names(t.specialities, "speciality_id", "speciality_name"), "speciality_id")
        .join(_names(t.doctors, "doctor_id", "doctor_name"), "doctor_id", "left")
        .select(*columns, "patient_name", "primary_phone", "doctor_name", "facility_name", "speciality_name")
    )


def appointment_page(t: Tables, page: int = 1, limit: int = DEFAULT_PAGE, **filters) -> DataFrame:
    """Latest appointments first. All filters are on the appointment's own columns, so the page
    is cut before its rows are joined (each appointment has its references)."""
    order = newest("appointment_date")
    cut = paging.page(_filter_appointments(t.appointments, **filters), page, limit, order)
    return list_appointments(t.replace(appointments=bounded(cut, limit))).orderBy(*order_by(order))


def _billed(t: Tables, facility_id=None, speciality_id=None, date_from=None, date_to=None) -> DataFrame:
    """Revenue with its lead's references, under the revenue list's filters."""
    r = t.revenue
    if date_from or date_to:
        r = r.where(S.day_range("billed_date", date_from, date_to, whole_last_day=False))
    leads = filter_leads(t.leads, facility_id=facility_id, speciality_id=speciality_id)
    return r.join(leads.select(F.col("id").alias("lead_id"), "facility_id", "speciality_id", "doctor_id"), "lead_id")


def list_revenue(t: Tables, **filters) -> DataFrame:
    """Bills with patient, facility, speciality and doctor names (the last three of the lead)."""
    people = t.patients.select(F.col("id").alias("patient_id"), F.col("full_name").alias("patient_name"))
    return (
        _billed(t, **filters)
        .join(people, "patient_id")
        .join(_names(t.facilities, "facility_id", "facility_name"), "facility_id")
        .join(_names(t.specialities, "speciality_id", "speciality_name"), "speciality_id")
        .join(_names(t.doctors, "doctor_id", "doctor_name"), "doctor_id", "left")
        .select(*t.revenue.columns, "patient_name", "facility_name", "speciality_name", "doctor_name")
    )


def revenue_page(t: Tables, page: int = 1, limit: int = DEFAULT_PAGE, **filters) -> DataFrame:
    """Latest bills first. Only a filter on the lead's columns is joined before the page is cut;
    names are joined to the page's rows (each bill has its references)."""
    order = newest("billed_date")
    dates = {k: filters.pop(k, None) for k in ("date_from", "date_to")}
    r = t.revenue
    if dates["date_from"] or dates["date_to"]:
        r = r.where(S.day_range("billed_date", dates["date_from"], dates["date_to"], whole_last_day=False))
    if any(v not in (None, "") for v in filters.values()):
        r = r.join(filter_leads(t.leads, **filters).select(F.col("id").alias("lead_id")), "lead_id", "left_semi")
    cut = paging.page(r.select(*t.revenue.columns), page, limit, order)
    return list_revenue(t.replace(revenue=bounded(cut, limit))).orderBy(*order_by(order))


def revenue_list_summary(t: Tables, **filters) -> DataFrame:
    """Total, count and average of the filtered bills; 0 when there are none.

    Bills are added up per lead before they meet the leads.
    """
    dates = {k: filters.pop(k, None) for k in ("date_from", "date_to")}
    r = t.revenue.where(S.day_range("billed_date", dates["date_from"], dates["date_to"], whole_last_day=False))
    per_lead = r.groupBy("lead_id").agg(S.exact_sum("total_value").alias("v"), F.count(F.lit(1)).alias("n"))
    leads = filter_leads(t.leads, **filters).select(F.col("id").alias("lead_id"))
    none = F.lit(0)
    sums = per_lead.join(leads, "lead_id").agg(
        F.coalesce(F.sum("v"), none).cast(S.EXACT_SUM).alias("total"),
        F.coalesce(F.sum("n"), none).cast("bigint").alias("count"),
    )
    mean = F.coalesce(S.mean_money(F.col("total"), F.col("count")), none.cast(S.EXACT_AVG))
    return sums.withColumn("avg", mean)


def list_patients(t: Tables, search: str | None = None, literal: bool = True) -> DataFrame:
    rows = t.patients
    if search:
        rows = rows.where(S.search_any(["full_name", "primary_phone", "email"], search, literal))
    return rows


def patient_page(t: Tables, page: int = 1, limit: int = DEFAULT_PAGE, search: str | None = None) -> DataFrame:
    """Newest patients first."""
    return paging.page(list_patients(t, search), page, limit, newest("created_at"))


def list_doctors(t: Tables, facility_id=None, speciality_id=None) -> DataFrame:
    """Active doctors with speciality and facility names."""
    d = t.doctors.where("is_active")
    for column, value in {"facility_id": facility_id, "speciality_id": speciality_id}.items():
        if value not in (None, ""):
            d = d.where(F.col(column) == value)
    columns = d.columns
    return (
        d.join(_names(t.specialities, "speciality_id", "speciality_name"), "speciality_id")
        .join(_names(t.facilities, "facility_id", "facility_name"), "facility_id")
        .select(*columns, "speciality_name", "facility_name")
        .orderBy(S.ci_key("name"), "id")
    )


def list_facilities(t: Tables) -> DataFrame:
    return t.facilities.where("is_active").orderBy(S.ci_key("name"), "id")


def list_specialities(t: Tables) -> DataFrame:
    return t.specialities.where("is_active").orderBy(S.ci_key("name"), "id")


def list_users(t: Tables) -> DataFrame:
    """Users without their password hash."""
    return t.users.select("id", "name", "email", "role", "is_active", "created_at").orderBy(S.ci_key("name"), "id")


def lead_interactions(t: Tables, keep_unassigned: bool = False, ordered: bool = True) -> DataFrame:
    """Interactions with the agent's name, newest first per lead; those without an agent are
    left out unless asked for."""
    agents = _names(t.users, "agent_id", "agent_name")
    rows = t.interactions.join(agents, "agent_id", "left" if keep_unassigned else "inner")
    rows = rows.select(*t.interactions.columns, "agent_name")
    return rows.orderBy("lead_id", F.desc("interaction_date"), F.desc("id")) if ordered else rows


def audit_trail(t: Tables, n: int = 100, entity_type: str = "lead", ordered: bool = True) -> DataFrame:
    """The newest ``n`` log rows per entity, newest first, with the user's name.

    The rank limit is applied before the shuffle too, so an entity with very many
    rows sends at most ``n`` per input task; names are joined to what remains.
    """
    newest = Window.partitionBy("entity_id").orderBy(F.desc("created_at"), F.desc("id"))
    kept = (
        t.audit_logs.where(F.col("entity_type") == entity_type)
        .withColumn("_rn", F.row_number().over(newest))
        .where(F.col("_rn") <= n)
        .drop("_rn")
    )
    rows = kept.join(_names(t.users, "user_id", "user_name"), "user_id", "left").select(
        *t.audit_logs.columns, "user_name"
    )
    return rows.orderBy("entity_id", F.desc("created_at"), F.desc("id")) if ordered else rows


def ad_spend_for(t: Tables, month: str | None = None, as_of=None) -> DataFrame:
    """Spend per channel of one month, the clock's month by default."""
    wanted = F.lit(month) if month else S.month_key(S.moment(as_of))
    return t.ad_spend.where(F.col("month") == wanted).select("channel", "monthly_spend")


def list_webhooks(t: Tables) -> DataFrame:
    return t.webhooks.orderBy("event_type")


def active_webhooks(t: Tables) -> DataFrame:
    return t.webhooks.where("is_active").select("event_type", "url").orderBy("event_type")

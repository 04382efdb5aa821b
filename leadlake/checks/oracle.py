"""DuckDB SQL twins of the registered queries."""

from __future__ import annotations

import re

from leadlake.checks.oracle_more import MORE_SQL
from leadlake.checks.oracle_writes import WRITES_SQL
from leadlake.schema import TABLES
from leadlake.sources.batches import BATCHES
from leadlake.sources.fixtures import fixture_sql

AS_OF = "timestamp '2001-08-01 00:00:00'"


def _needs(text: str) -> list[str]:
    """Fixture and batch names a text reads, inner ones first."""
    order: list[str] = []

    def visit(body: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b([cb]_[a-z_]+)\b", body)):
            source = _source(name)
            if source is None or name in order:
                continue
            visit(source)
            if name not in order:
                order.append(name)

    visit(text)
    return order


def _source(name: str) -> str | None:
    if name[:2] == "c_" and name[2:] in TABLES:
        return fixture_sql(name[2:])
    if name[:2] == "b_" and name[2:] in BATCHES:
        return BATCHES[name[2:]]
    return None


def with_fixtures(text: str) -> str:
    """Prefix a SELECT (or its own WITH list) by the fixtures and batches it reads."""
    ctes = [f"{n} as materialized ({_source(n)})" for n in _needs(text)]
    body = text.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {', '.join(ctes)}, {body[len('with recursive '):]}"
    if body.lower().startswith("with "):
        return f"with {', '.join(ctes)}, {body[5:]}"
    return f"with {', '.join(ctes)} {body}"


def pct1(part: str, whole: str) -> str:
    part, whole = f"({part})::hugeint", f"({whole})::hugeint"
    return f"(case when {whole} > 0 then (2000 * {part} + {whole}) // (2 * {whole}) end)::double / 10"


def avg6(money: str, n: str) -> str:
    """Exact average of a two-digit amount to six digits, half up."""
    cents = f"(({money}) * 100)::hugeint"
    micro = f"((2 * {cents} * 10000 + ({n})::hugeint) // (2 * ({n})::hugeint))"
    return f"({micro}::decimal(30,0) * 0.000001::decimal(7,6))::decimal(38,6)"


def avg0(money: str, n: str) -> str:
    return f"((2 * (({money}) * 100)::hugeint + 100 * ({n})::hugeint) // (200 * ({n})::hugeint))::bigint"


def total(c: str) -> str:
    return f"coalesce(sum({c}), 0)::decimal(38,2)"


def where_count(cond: str) -> str:
    return f"sum(case when {cond} then 1 else 0 end)::bigint"


CUSTOMERS = where_count("lead_stage = 'customer'")
RATE = pct1("sum(case when lead_stage = 'customer' then 1 else 0 end)", "count(*)")

LEAD_JOINS = """c_leads l join c_patients p on p.id = l.patient_id join c_facilities f on f.id = l.facility_id
 join c_specialities sp on sp.id = l.speciality_id left join c_doctors d on d.id = l.doctor_id
 left join c_users u on u.id = l.assigned_to"""

STATS = f"""select count(*) as total_leads, {CUSTOMERS} as total_customers,
 {where_count("lead_stage = 'interested'")} as total_interested,
 {where_count("lead_stage = 'untouched'")} as total_untouched,
 {where_count("lead_stage = 'attempted'")} as total_attempted,
 {where_count("lead_stage = 'not_interested'")} as total_lost,
 {RATE} as conversion_rate,
 ((20 * sum(ai_score)::hugeint + count(ai_score)) // (2 * count(ai_score)))::double / 10 as avg_ai_score,
 {where_count("lead_stage = 'attempted' and attempt_count = 0")} as at_risk_leads from c_leads"""

BY_NAME = """select {dim}.name as {out}, count(*) as total_leads, %s as customers, %s as conversion_rate
 from c_leads l join c_{table} {dim} on {dim}.id = l.{key} group by {dim}.name""" % (CUSTOMERS, RATE)

REV = "sum(r.total_value)::decimal(38,2)"

VIEW_SQL = {
    "leads_full": f"""select l.id as lead_id, l.lead_stage, l.lead_substage, l.lead_source, l.campaign_name,
 l.enquiry_type, l.medical_concern, l.followup_date, l.attempt_count, l.ai_score, l.ai_priority, l.enquiry_date,
 p.id as patient_id, p.full_name as patient_name, p.primary_phone, p.email, p.city, p.patient_type,
 f.id as facility_id, f.name as facility_name, f.type as facility_type, sp.id as speciality_id,
 sp.name as speciality_name, d.id as doctor_id, d.name as doctor_name, u.id as agent_id, u.name as agent_name,
 u.role as agent_role from {LEAD_JOINS}""",
    "dashboard_stats": STATS,
    "revenue_summary": f"""select {REV} as total_revenue, {avg6('sum(r.total_value)', 'count(*)')} as avg_revenue_per_lead,
 count(*) as paid_leads, sp.name as speciality, f.name as facility from c_revenue r join c_leads l on l.id = r.lead_id
 join c_facilities f on f.id = l.facility_id join c_specialities sp on sp.id = l.speciality_id group by sp.name, f.name""",
}

MONTH = "strftime({}, '%Y-%m')"

DASHBOARD_SQL = {
    "leads_by_source": "select lead_source, count(*) as count from c_leads group by lead_source",
    "leads_by_speciality": """select sp.name as speciality, count(*) as count from c_leads l
 join c_specialities sp on sp.id = l.speciality_id group by sp.name""",
    "revenue_total": f"select {total('total_value')} as total_revenue, count(*) as revenue_count from c_revenue",
    "recent_leads": """select l.id, l.lead_stage, l.lead_source, l.enquiry_date, p.full_name as patient_name,
 sp.name as speciality_name from c_leads l join c_patients p on p.id = l.patient_id
 left join c_specialities sp on sp.id = l.speciality_id order by l.enquiry_date desc nulls last, l.id limit 10""",
    "at_risk_leads": f"""select l.id, p.full_name, p.primary_phone, l.followup_date, sp.name as speciality_name
 from c_leads l join c_patients p on p.id = l.patient_id join c_specialities sp on sp.id = l.speciality_id
 where l.lead_stage = 'attempted' and (l.followup_date is null or l.followup_date <= cast({AS_OF} as date))
 order by l.followup_date nulls first, l.id limit 20""",
    "channel_conversion": f"""select lead_source as channel, count(*) as total_leads, {CUSTOMERS} as customers,
 {RATE} as conversion_rate from c_leads group by lead_source""",
    "top_campaigns": f"""select campaign_name, count(*) as total_leads, {CUSTOMERS} as customers from c_leads
 where campaign_name is not null and campaign_name <> '' group by campaign_name
 order by total_leads desc, campaign_name limit 10""",
    "funnel": f"""select count(*) as total_leads, {where_count("lead_stage <> 'untouched'")} as contacted,
 (select count(*) from c_appointments) as total_appointments,
 (select count(*) from c_appointments where visit_status = 'visited') as visited from c_leads""",
    "speciality_conversion": BY_NAME.format(dim="sp", out="speciality", table="specialities", key="speciality_id"),
    "top_doctors": f"""select d.name as doctor, sp.name as speciality, count(*) as total_leads, {CUSTOMERS} as customers
 from c_leads l join c_doctors d on d.id = l.doctor_id join c_specialities sp on sp.id = l.speciality_id
 group by d.name, sp.name order by total_leads desc, doctor, speciality limit 10""",
    "facility_conversion": BY_NAME.format(dim="f", out="facility", table="facilities", key="facility_id"),
    "revenue_by_speciality_all": f"""select sp.name as speciality, {total('r.total_value')} as revenue, count(r.id) as count
 from c_leads l join c_specialities sp on sp.id = l.speciality_id left join c_revenue r on r.lead_id = l.id
 group by sp.name""",
    "no_show_rate": f"""select count(*) as total_appointments, {where_count("visit_status = 'no_show'")} as no_shows,
 {where_count("visit_status = 'visited'")} as visited,
 {pct1("sum(case when visit_status = 'no_show' then 1 else 0 end)", "count(*)")} as no_show_rate from c_appointments""",
    "leads_by_month": f"""select {MONTH.format('enquiry_date')} as month, count(*) as total_leads, {CUSTOMERS} as customers,
 {RATE} as conversion_rate from c_leads where enquiry_date >= {AS_OF} - interval 12 month group by 1""",
    "speciality_trend": f"""select {MONTH.format('l.enquiry_date')} as month, sp.name as speciality, count(*) as total_leads
 from c_leads l join c_specialities sp on sp.id = l.speciality_id
 where l.enquiry_date >= {AS_OF} - interval 6 month group by 1, 2""",
    "channel_trend": f"""select {MONTH.format('enquiry_date')} as month, lead_source as channel, count(*) as total_leads
 from c_leads where enquiry_date >= {AS_OF} - interval 6 month group by 1, 2""",
    "revenue_breakdown": f"""select {total('total_value')} as total_revenue, {total('consultation_value')} as total_consultation,
 {total('procedure_value')} as total_procedure, {total('package_value')} as total_package, count(*) as revenue_count,
 {avg6('sum(total_value)', 'count(*)')} as avg_revenue from c_revenue""",
    "revenue_by_month": f"""select {MONTH.format('billed_date')} as month, {total('total_value')} as revenue,
 {total('consultation_value')} as consultation, {total('procedure_value')} as proc_value, count(*) as count
 from c_revenue group by 1 order by 1 limit 12""",
    "revenue_by_channel": f"""select l.lead_source as channel, {REV} as revenue, count(*) as count,
 {avg0('sum(r.total_value)', 'count(*)')} as avg_value from c_leads l join c_revenue r on r.lead_id = l.id
 group by l.lead_source""",
    "revenue_by_speciality": f"""select sp.name as speciality, {REV} as revenue, count(*) as count,
 {avg0('sum(r.total_value)', 'count(*)')} as avg_value from c_leads l join c_revenue r on r.lead_id = l.id
 join c_specialities sp on sp.id = l.speciality_id group by sp.name""",
    "revenue_by_facility": f"""select f.name as facility, {REV} as revenue, count(*) as count from c_leads l
 join c_revenue r on r.lead_id = l.id join c_facilities f on f.id = l.facility_id group by f.name""",
    "high_value_patients": f"""select p.full_name, p.primary_phone, p.city, {REV} as total_revenue, count(*) as visit_count,
 max(r.billed_date) as last_visit from c_patients p join c_revenue r on r.patient_id = p.id
 group by p.id, p.full_name, p.primary_phone, p.city order by total_revenue desc, p.id limit 20""",
    "revenue_by_payment_status": f"""select payment_status, count(*) as count, {total('total_value')} as revenue
 from c_revenue group by payment_status""",
    "facility_leads": f"""select f.name, count(*) as leads, {CUSTOMERS} as customers from c_leads l
 join c_facilities f on f.id = l.facility_id group by f.name""",
}


def sections(parts: dict[str, str]) -> str:
    """Results of several statements as (section, value) JSON lines; moments as Spark writes them."""
    lines = []
    for name, sql in parts.items():
        for c in ("enquiry_date", "last_visit"):
            if name in ("recentLeads", "highValue") and c in sql:
                sql = f"select * replace (strftime({c}, '%Y-%m-%dT%H:%M:%S.000') as {c}) from ({sql})"
                break
        lines.append(f"select '{name}' as section, to_json(s)::varchar as value from ({sql}) s")
    return " union all ".join(lines)


def _pick(**names: str) -> str:
    return sections({k: {**VIEW_SQL, **DASHBOARD_SQL}[v] for k, v in names.items()})


DOCUMENT_SQL = {
    "to_documents": """select to_json(s)::varchar as value from
 (select id, lead_stage, doctor_id, attempt_count from c_leads) s""",
    "exec_summary": sections({
        "stats": STATS,
        "revenue": f"select {total('total_value')} as total from c_revenue",
        "bySource": DASHBOARD_SQL["leads_by_source"],
        "byFacility": DASHBOARD_SQL["facility_leads"],
    }),
    "dashboard_summary": _pick(
        stats="dashboard_stats", bySource="leads_by_source", bySpeciality="leads_by_speciality", revenue="revenue_total",
        recentLeads="recent_leads", atRisk="at_risk_leads"),
    "dashboard_marketing": sections({
        "stats": STATS,
        "bySource": f"select channel as lead_source, total_leads, customers, conversion_rate from ({DASHBOARD_SQL['channel_conversion']})",
        "byCampaign": DASHBOARD_SQL["top_campaigns"],
    }),
    "dashboard_cxo": _pick(
        stats="dashboard_stats", revenue="revenue_total", byChannel="channel_conversion", funnel="funnel",
        bySpeciality="speciality_conversion", byDoctor="top_doctors", byFacility="facility_conversion",
        revBySpeciality="revenue_by_speciality_all", noShow="no_show_rate", leadsByMonth="leads_by_month",
        specTrend="speciality_trend", channelTrend="channel_trend"),
    "dashboard_finance": _pick(
        summary="revenue_breakdown", byMonth="revenue_by_month", byChannel="revenue_by_channel",
        bySpeciality="revenue_by_speciality", byFacility="revenue_by_facility", highValue="high_value_patients",
        byPaymentStatus="revenue_by_payment_status"),
}


IN_MONTHS = (
    "ingest_leads", "update_leads", "change_stage", "delete_leads", "ingest_interactions", "set_visit_status", "merge_patients",
)


def oracle_sql() -> dict[str, str]:
    every = {**VIEW_SQL, **DASHBOARD_SQL, **MORE_SQL, **WRITES_SQL, **DOCUMENT_SQL}
    # on month folders a job comes to the same rows
    every["search_leads_indexed"] = every["search_leads"]
    every |= {f"{name}_in_months": every[name] for name in IN_MONTHS}
    return {k: with_fixtures(v) for k, v in every.items()}

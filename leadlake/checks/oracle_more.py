"""SQL twins of the lists, documents, duplicate, stage, write and text operators."""

from __future__ import annotations

from leadlake.schema import LEAD_STAGES, columns

LEAD_LIST = """l.id, l.lead_stage, l.lead_substage, l.lead_source, l.lead_medium, l.campaign_name, l.enquiry_type,
 l.medical_concern, l.urgency, l.followup_date, l.ai_score, l.ai_priority, l.ai_reason, l.ai_next_action,
 l.enquiry_date, l.created_at, p.id as patient_id, p.full_name as patient_name, p.primary_phone,
 p.email as patient_email, p.city, p.patient_type, f.id as facility_id, f.name as facility_name,
 sp.id as speciality_id, sp.name as speciality_name, d.id as doctor_id, d.name as doctor_name,
 u.id as agent_id, u.name as agent_name"""
JOINS = """c_leads l join c_patients p on p.id = l.patient_id join c_facilities f on f.id = l.facility_id
 join c_specialities sp on sp.id = l.speciality_id left join c_doctors d on d.id = l.doctor_id
 left join c_users u on u.id = l.assigned_to"""


def rank(column: str, values) -> str:
    return "case " + column + "".join(f" when '{v}' then {i}" for i, v in enumerate(values)) + " end"


APPOINTMENTS = """select a.*, p.full_name as patient_name, p.primary_phone, d.name as doctor_name,
 f.name as facility_name, sp.name as speciality_name from c_appointments a join c_patients p on p.id = a.patient_id
 join c_leads l on l.id = a.lead_id join c_facilities f on f.id = a.facility_id
 join c_specialities sp on sp.id = l.speciality_id left join c_doctors d on d.id = a.doctor_id"""
REVENUE = """select r.*, p.full_name as patient_name, f.name as facility_name, sp.name as speciality_name,
 d.name as doctor_name from c_revenue r join c_leads l on l.id = r.lead_id join c_patients p on p.id = r.patient_id
 join c_facilities f on f.id = l.facility_id join c_specialities sp on sp.id = l.speciality_id
 left join c_doctors d on d.id = l.doctor_id"""
DOCTOR_COLS = ", ".join(
    "d." + c if c != "consult_type" else "array_to_string(string_split(d.consult_type, ','), '|') as consult_type"
    for c in columns("doctors")
)
SUMMARY = """select coalesce(sum(r.total_value), 0)::decimal(38,2) as total, count(*) as count,
 coalesce(((2 * (sum(r.total_value) * 100)::hugeint * 10000 + count(*)) // (2 * count(*)))::decimal(30,0)
  * 0.000001::decimal(7,6), 0)::decimal(38,6) as avg
 from c_revenue r join c_leads l on l.id = r.lead_id where l.facility_id = 3
 and r.billed_date >= timestamp '1997-01-01' and r.billed_date <= timestamp '1999-12-31'"""

LISTS = {
    "list_leads": f"select {LEAD_LIST} from {JOINS}",
    "filter_leads": f"""select {LEAD_LIST} from {JOINS} where l.lead_stage = 'interested' and l.lead_source = 'organic'
 and l.enquiry_date >= timestamp '1997-01-01' and l.enquiry_date < timestamp '2000-01-01'""",
    "search_leads": f"""select {LEAD_LIST} from {JOINS} where contains(lower(p.full_name), 'patient 12')
 or contains(p.primary_phone, 'patient 12') or contains(coalesce(p.email, ''), 'patient 12')""",
    "page_info": """select count(*) as total, 1 as page, 500 as limit, ((count(*) + 499) // 500)::bigint as pages
 from c_leads where lead_stage = 'customer'""",
    "sort_leads": f"select {LEAD_LIST} from {JOINS}",
    "lead_page": f"""select {LEAD_LIST} from {JOINS} order by {rank('l.lead_stage', LEAD_STAGES)} desc, l.id
 limit 50 offset 100""",
    "lead_page_late": f"""select {LEAD_LIST} from {JOINS} order by {rank('l.lead_stage', LEAD_STAGES)} desc, l.id
 limit 50 offset 250""",
    "leads_after": f"""select {LEAD_LIST} from {JOINS} order by {rank('l.lead_stage', LEAD_STAGES)} desc, l.id
 limit 50 offset 150""",
    "lead_page_by_facility": f"""select {LEAD_LIST} from {JOINS} order by lower(f.name), l.id limit 500 offset 500""",
    "visible_leads": """select l.id as lead_id, u.id as user_id, u.role from c_leads l join c_users u
 on u.id = l.assigned_to where u.role in ('agent', 'calling_agent')""",
    "list_appointments": APPOINTMENTS,
    "appointments_in_range": APPOINTMENTS + """ where a.visit_status = 'no_show'
 and a.appointment_date >= timestamp '1998-01-01' and a.appointment_date <= timestamp '1998-12-31'""",
    "appointment_page": APPOINTMENTS + " order by a.appointment_date desc, a.id limit 50 offset 50",
    "list_revenue": REVENUE,
    "revenue_page": REVENUE + " order by r.billed_date desc, r.id limit 50",
    "revenue_list_summary": SUMMARY,
    "list_patients": "select * from c_patients",
    "patient_search_indexed": """select * from c_patients where contains(lower(full_name), '10') or contains(primary_phone, '10')
 or contains(coalesce(email, ''), '10')""",
    "patient_page": """select * from c_patients where contains(lower(full_name), '10') or contains(primary_phone, '10')
 or contains(coalesce(email, ''), '10') order by created_at desc, id limit 50""",
    "list_doctors": f"""select {DOCTOR_COLS}, sp.name as speciality_name, f.name as facility_name from c_doctors d
 join c_specialities sp on sp.id = d.speciality_id join c_facilities f on f.id = d.facility_id where d.is_active""",
    "list_facilities": "select * from c_facilities where is_active",
    "list_specialities": "select * from c_specialities where is_active",
    "list_users": "select id, name, email, role, is_active, created_at from c_users",
    "lead_interactions": """select i.*, u.name as agent_name from c_interactions i join c_users u on u.id = i.agent_id""",
    "audit_trail": """select a.*, u.name as user_name from c_audit_logs a left join c_users u on u.id = a.user_id
 where a.entity_type = 'lead'
 qualify row_number() over (partition by a.entity_id order by a.created_at desc, a.id desc) <= 100""",
    "ad_spend_for": "select channel, monthly_spend from c_ad_spend where month = '2001-08'",
    "list_webhooks": "select * from c_webhooks",
    "active_webhooks": "select event_type, url from c_webhooks where is_active",
}

PROFILES = {
    "lead_360": """select l.id as lead_id, p.full_name as patient_name, f.name as facility_name,
 sp.name as speciality_name, d.name as doctor_name, u.name as agent_name, 0 as part, 1 as parts,
 coalesce(i.ids, '') as interaction_ids, coalesce(i.agents, '') as interaction_agents,
 coalesce(a.ids, '') as appointment_ids, coalesce(a.names, '') as appointment_facilities,
 coalesce(r.ids, '') as revenue_ids, coalesce(r.total, 0)::decimal(38,2) as revenue_sum
 from """ + JOINS + """
 left join (select lead_id, string_agg(i.id::varchar, ',' order by interaction_date desc, i.id desc) as ids,
  string_agg(coalesce(u.name, '-'), ',' order by interaction_date desc, i.id desc) as agents
  from c_interactions i left join c_users u on u.id = i.agent_id group by lead_id) i on i.lead_id = l.id
 left join (select lead_id, string_agg(a.id::varchar, ',' order by appointment_date desc, a.id desc) as ids,
  string_agg(coalesce(f.name, '-'), ',' order by appointment_date desc, a.id desc) as names
  from c_appointments a left join c_facilities f on f.id = a.facility_id group by lead_id) a on a.lead_id = l.id
 left join (select lead_id, string_agg(id::varchar, ',' order by billed_date desc, id desc) as ids,
  sum(total_value) as total from c_revenue group by lead_id) r on r.lead_id = l.id""",
    "patient_360": """select p.id as patient_id, p.full_name, 0 as part, 1 as parts, coalesce(h.ids, '') as lead_ids,
 coalesce(h.facilities, '') as facilities from c_patients p left join (
 select l.patient_id, string_agg(l.id::varchar, ',' order by l.created_at desc, l.id desc) as ids,
  string_agg(f.name, ',' order by l.created_at desc, l.id desc) as facilities
 from c_leads l join c_specialities s on s.id = l.speciality_id join c_facilities f on f.id = l.facility_id
 group by l.patient_id) h on h.patient_id = p.id""",
    "patient_360_enquiry": """select p.id as patient_id, p.full_name, 0 as part, 1 as parts,
 coalesce(h.ids, '') as lead_ids, coalesce(h.types, '') as types from c_patients p left join (
 select l.patient_id, string_agg(l.id::varchar, ',' order by l.enquiry_date desc, l.id desc) as ids,
  string_agg(l.enquiry_type, ',' order by l.enquiry_date desc, l.id desc) as types
 from c_leads l join c_specialities s on s.id = l.speciality_id group by l.patient_id) h on h.patient_id = p.id""",
}

FORMS = """forms as (select *, lower(rtrim(trim(full_name))) as nk,
 right(regexp_replace(primary_phone, '[^0-9]', '', 'g'), 8) as pk from c_patients),
 ng as (select nk as key, count(*) as count from forms group by nk having count(*) > 1 order by 2 desc, 1 limit 50),
 pg as (select pk as key, count(*) as count from forms group by pk having count(*) > 1 order by 2 desc, 1 limit 50)"""
MEMBER = "f.id, f.full_name, f.primary_phone, f.created_at"
BOTH = f"""{FORMS}, nsets as (select g.key, g.count, list_sort(list(f.id)) as ids from forms f join ng g on g.key = f.nk
  group by all), psets as (select g.key, g.count, list_sort(list(f.id)) as ids from forms f join pg g on g.key = f.pk
  group by all), kept as (select 'name' as type, key, count from nsets union all
  select 'phone', key, count from psets where ids not in (select ids from nsets)),
 members as (select k.type, k.key, k.count, {MEMBER} from forms f join kept k on (k.type = 'name' and k.key = f.nk)
  or (k.type = 'phone' and k.key = f.pk))"""

MOVES = """reqs as (select m.* from b_merge_requests m join c_patients p on p.id = m.primary_id
  where m.primary_id <> m.secondary_id),
 walk(secondary_id, goal) as (select secondary_id, primary_id from reqs
  union all select w.secondary_id, r.primary_id from walk w join reqs r on r.secondary_id = w.goal),
 moves as (select secondary_id, goal as primary_id from walk where goal not in (select secondary_id from reqs))"""

DEDUPE = {
    "duplicates_by_name": f"""with {FORMS} select 'name' as type, g.key, g.count, {MEMBER} from forms f
 join ng g on g.key = f.nk""",
    "duplicates_by_phone": f"""with {FORMS} select 'phone' as type, g.key, g.count, {MEMBER} from forms f
 join pg g on g.key = f.pk""",
    "duplicate_groups": f"with {BOTH} select * from members",
    "duplicate_documents": f"""with {BOTH} select type, key, count, 0 as part, 1 as parts,
 string_agg(id::varchar, ',' order by id) as ids, string_agg(full_name, '|' order by created_at, id) as names,
 string_agg(primary_phone, '|' order by created_at, id) as phones from members group by type, key, count""",
    "resolve_mapping": f"with recursive {MOVES} select secondary_id, primary_id from moves",
    "merge_patients": f"""with recursive {MOVES} select 'lead' as entity, l.id, coalesce(m.primary_id, l.patient_id) as patient_id
 from c_leads l left join moves m on m.secondary_id = l.patient_id
 union all select 'appointment', a.id, coalesce(m.primary_id, a.patient_id) from c_appointments a
 left join moves m on m.secondary_id = a.patient_id
 union all select 'revenue', r.id, coalesce(m.primary_id, r.patient_id) from c_revenue r
 left join moves m on m.secondary_id = r.patient_id
 union all select 'patient', p.id, p.id from c_patients p where p.id not in (select secondary_id from moves)
 union all select case when r.primary_id = r.secondary_id then 'primary is among the secondaries'
  else 'primary patient not found' end, r.secondary_id, r.primary_id from b_merge_requests r
  where r.primary_id = r.secondary_id or r.primary_id not in (select id from c_patients)""",
}
#: The same over all groups instead of the largest ones.
DEDUPE |= {
    f"{name}_all": DEDUPE[name].replace(" order by 2 desc, 1 limit 50", "")
    for name in ("duplicates_by_name", "duplicates_by_phone", "duplicate_groups")
}

MISSED = """(contains(lower(outcome), 'no answer') or contains(lower(outcome), 'no response')
 or contains(lower(outcome), 'not reachable') or contains(lower(outcome), 'busy')
 or contains(lower(outcome), 'switched off'))"""
ATTEMPT = "interaction_type in ('call', 'whatsapp', 'sms')"


def state_sql(tries: str, changes: str | None, followups: str) -> str:
    """Final lead state from attempts (lead_id, seq, missed), changes (lead_id, seq, stage, substage) and
    follow-ups (lead_id, seq, followup_date), by ranking whole leads."""
    last = changes or "select null::bigint as lead_id, null::bigint as seq, null as stage, null as substage where false"
    return f"""tries as ({tries}), changes as ({last}), fups as ({followups}),
 hard as (select * from changes qualify row_number() over (partition by lead_id order by seq desc) = 1),
 fup as (select lead_id, arg_max(followup_date, seq) as followup_date from fups where followup_date is not null group by 1),
 base as (select l.id, coalesce(h.stage, l.lead_stage) as s0, coalesce(h.substage, l.lead_substage) as sub0,
   l.attempt_count as c0, coalesce(h.seq, -1) as cut, coalesce(f.followup_date, l.followup_date) as followup_date
  from c_leads l left join hard h on h.lead_id = l.id left join fup f on f.lead_id = l.id),
 ranked as (select t.lead_id, t.seq, t.missed, b.c0 + row_number() over (partition by t.lead_id order by t.seq) as n,
   t.seq > b.cut as tail from tries t join base b on b.id = t.lead_id),
 facts as (select lead_id, max(n) as n_last, min(case when tail then n end) as n1,
   max(case when tail then n end) as nk, max(case when tail and missed then n end) as n_miss from ranked group by 1),
 state as (select b.id, b.followup_date, coalesce(f.n_last, b.c0)::integer as attempt_count,
   case when s0 in ('untouched','attempted','unanswered') and n_miss >= 3 then 'unanswered'
    when s0 = 'untouched' and n1 is not null then 'attempted' else s0 end as lead_stage,
   case when s0 in ('untouched','attempted','unanswered') and n_miss >= 3 then 'Stale – No Response After 3 Attempts'
    when s0 = 'untouched' and n1 >= 3 then 'Attempt ' || n1 || ' – Follow-up Scheduled'
    when s0 in ('untouched','attempted') and n1 < 3 then 'Attempt ' || least(nk, 2) || ' – Follow-up Scheduled'
    else sub0 end as lead_substage from base b left join facts f on f.lead_id = b.id)"""


TALKS = f"select lead_id, id as seq, {MISSED} as missed from c_interactions where {ATTEMPT}"
LOG_TALKS = f"""select lead_id, seq, {MISSED} as missed from b_event_log where kind = 'interaction' and {ATTEMPT}"""
LOG_CHANGES = """select lead_id, seq, case kind when 'manual' then stage else 'customer' end as stage,
 case kind when 'booking' then 'Super Hot – Booked' when 'visit' then 'Visited' when 'revenue' then 'Revenue Captured'
 else coalesce(substage, stage) end as substage from b_event_log where kind <> 'interaction'"""

STAGES = {
    "classify": f"""select id, {ATTEMPT} as is_attempt, {MISSED} as is_no_response from c_interactions""",
    "attempt_numbers": f"""select i.id, i.lead_id, {MISSED} as is_no_response,
 (l.attempt_count + row_number() over (partition by i.lead_id order by i.id))::bigint as attempt_no
 from c_interactions i join c_leads l on l.id = i.lead_id where {ATTEMPT}""",
    "apply_interactions": "with " + state_sql(
        TALKS, None, "select lead_id, id as seq, followup_date from c_interactions") + " select * from state",
    "apply_events": "with " + state_sql(
        LOG_TALKS, LOG_CHANGES, "select lead_id, seq, followup_date from b_event_log") + " select * from state",
    "latest_followup": """select l.id, coalesce(i.d, l.followup_date) as followup_date from c_leads l left join (
 select lead_id, arg_max(followup_date, id) as d from c_interactions where followup_date is not null group by 1) i
 on i.lead_id = l.id""",
}

MORE_SQL: dict[str, str] = {**LISTS, **PROFILES, **DEDUPE, **STAGES}

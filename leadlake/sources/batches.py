"""Inputs of the write and event jobs, projected from the fixtures.

Like the fixtures, each text runs unchanged in Spark and in DuckDB, reads whole
tables and may build on fixtures (``c_…``) and other batches (``b_…``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from leadlake.sources.fixtures import register_base
from leadlake.sources.tables import Tables

NEW_ID = 1_000_000_000_000  # ids of rows a batch creates start here

BATCHES: dict[str, str] = {
    # Interactions, bookings, visits, bills and manual changes of all leads in one sequence.
    "event_log": """
select lead_id, id * 8 as seq, 'interaction' as kind, interaction_type, outcome, followup_date,
 cast(null as string) as stage, cast(null as string) as substage from c_interactions
union all
select lead_id, id * 8 + 1, 'booking', null, null, null, null, null from c_appointments
union all
select lead_id, id * 8 + 2, 'visit', null, null, null, null, null from c_appointments where visit_status = 'visited'
union all
select lead_id, id * 8 + 3, 'revenue', null, null, null, null, null from c_revenue
union all
select cast(entity_id as bigint), id * 8 + 4, 'manual', null, null, null,
 case user_id % 4 when 0 then 'interested' when 1 then 'untouched' when 2 then 'attempted' else 'potential' end,
 case when id % 2 = 0 then null else 'By hand' end
from c_audit_logs where action = 'STAGE_CHANGE'""",
    # Later duplicates merge into the patient of the same name, or of the same phone, before them.
    "merge_requests": """
select id as seq, id as secondary_id, case when id % 5 = 4 then id - 1 when id % 7 = 6 then id - 1
  when id % 11 = 10 then id else -1 end as primary_id
from c_patients""",
    # Intake forms: known phones, new phones (several forms may share one), blanks, unknown references.
    "lead_intake": """
select id as seq, concat('Caller ', cast(id as string)) as full_name,
 case when id % 20 = 19 then '' when id % 3 = 0 then concat(primary_phone, ' ')
  else concat('77', lpad(cast(id - id % 4 as string), 8, '0')) end as primary_phone,
 case when id % 2 = 0 then '' else email end as email, city, case when id % 9 = 8 then 'Existing' end as patient_type,
 cast(id % 26 as int) as facility_id, case id % 4 when 0 then 'ECONOMY' when 1 then 'LARGE' when 2 then 'SMALL'
  else 'PROMO' end as speciality_id,
 case when id % 5 = 0 then null else id % 9 end as doctor_id, case when id % 2 = 0 then null else id % 15 end as assigned_to,
 case id % 7 when 0 then 'Organic' when 1 then 'tv' else 'referral' end as lead_source,
 case when id % 3 = 0 then 'procedure' end as enquiry_type, case when id % 4 = 0 then '' else 'High' end as urgency,
 case when id % 6 = 0 then '' else concat('Campaign ', cast(id % 10 as string)) end as campaign_name,
 case when id % 8 = 0 then 'Interested' end as stage, case when id % 8 = 0 then 'Asked back' end as substage
from c_patients""",
    # Two requests per lead; some fields absent, some set to NULL, some values refused.
    "lead_patches": """
select id, id * 2 as seq, true as has_campaign, case when id % 4 = 0 then null else concat('New ', cast(id % 9 as string)) end as campaign_name,
 id % 2 = 0 as has_urgency, case when id % 10 = 4 then 'extreme' else 'High' end as urgency,
 id % 3 = 0 as has_doctor, cast(id % 120 as string) as doctor_id, false as has_followup, cast(null as string) as followup_date,
 false as has_stage
from c_leads
union all
select case when id % 50 = 0 then id + 100000000 else id end, id * 2 + 1, id % 5 = 0, 'Second', id % 3 = 1,
 case when id % 7 = 0 then null else 'low' end, false, null, id % 6 = 0, case when id % 12 = 0 then null else '2001-09-10' end, true
from c_leads""",
    "stage_changes": """
select case when id % 40 = 0 then lead_id + 100000000 else lead_id end as id, id as seq,
 case id % 10 when 0 then 'interested' when 1 then 'customer' when 2 then 'Customer' when 3 then '' when 4 then 'ineligible'
  when 5 then 'unanswered' when 6 then 'sold' when 7 then 'potential' when 8 then 'attempted' else 'untouched' end as stage,
 case when id % 3 = 0 then '' when id % 3 = 1 then null else concat('Sub ', cast(id % 7 as string)) end as substage
from c_interactions""",
    "scores": """
select lead_id as id, id as seq, cast(id % 101 as int) as ai_score,
 case id % 5 when 0 then 'High' when 1 then '' when 2 then 'urgent' when 3 then null else 'low' end as ai_priority,
 case when id % 4 = 0 then '' else outcome end as ai_reason, 'Call' as ai_next_action
from c_interactions""",
    # Language-model replies: fenced, plain, broken, without priority.
    "score_replies": """
select id, id as seq, case id % 5
 when 0 then concat('```json', chr(10), '{"score":', cast(ai_score as string), ',"reason":"urgent","priority":"High","nextAction":"Call"}', chr(10), '```')
 when 1 then concat('{"score":', cast(ai_score as string), ',"reason":"calm","nextAction":"Wait"}')
 when 2 then concat('Score: ', cast(ai_score as string))
 when 3 then concat('{"score":', cast(ai_score as string), ',"reason":null,"priority":"Low"}')
 else '{"score":' end as reply
from c_leads""",
    "lead_deletes": """
select id from c_leads where lead_stage in ('not_interested', 'interested', 'untouched')
union all select id + 100000000 from c_leads where lead_stage = 'untouched'""",
    "new_interactions": """
select id as seq, case when id % 30 = 0 then lead_id + 100000000 else lead_id + 3000 end as lead_id,
 case when id % 3 = 0 then agent_id end as agent_id,
 case id % 6 when 0 then null when 1 then 'Call' when 2 then 'sms' when 3 then 'note' when 4 then '' else 'whatsapp' end as interaction_type,
 case when id % 9 = 0 then '' else outcome end as outcome, case when id % 4 = 0 then '' else 'noted' end as notes, followup_date
from c_interactions""",
    "interaction_deletes": "select id from c_interactions where interaction_type = 'email'",
    "bookings": """
select id as seq, case when id % 60 = 0 then id + 100000000 else id end as lead_id, patient_id, cast(id % 26 as int) as facility_id,
 doctor_id, case when id % 11 = 0 then null else enquiry_date end as appointment_date,
 case id % 5 when 0 then null when 1 then 'TELE' when 2 then 'home' else 'opd' end as consult_type,
 case when id % 2 = 0 then '' else 'first' end as notes
from c_leads where lead_stage in ('interested', 'attempted')""",
    # Two status changes per appointment.
    "visit_changes": """
select id, id * 2 as seq, case id % 6 when 0 then 'visited' when 1 then 'Cancelled' when 2 then '' when 3 then 'lost'
  else 'no_show' end as visit_status, case when id % 2 = 0 then 'kept' else '' end as notes
from c_appointments
union all
select case when id % 70 = 0 then id + 100000000 else id end, id * 2 + 1, case id % 4 when 0 then 'rescheduled' when 1 then null else 'confirmed' end, case when id % 3 = 0 then 'moved' end
from c_appointments""",
    "bills": """
select id as seq, case when id % 90 = 0 then id + 100000000 else id end as appointment_id, lead_id, patient_id,
 case id % 5 when 0 then null when 1 then '100' when 2 then '99.95' when 3 then '' else '7' end as consultation_value,
 case when id % 33 = 0 then 'many' else '10.5' end as procedure_value,
 case id % 4 when 0 then null when 1 then 'Paid' else 'partial' end as payment_status,
 case when id % 2 = 0 then appointment_date end as billed_date
from c_appointments where visit_status = 'visited'""",
    "patient_forms": """
select id as seq, case when id % 25 = 0 then '' else concat('Walk-in ', cast(id as string)) end as full_name,
 case when id % 3 = 0 then primary_phone else concat('66', lpad(cast(id - id % 5 as string), 8, '0')) end as primary_phone,
 email, case when id % 2 = 0 then '' else city end as city, case when id % 4 = 0 then 'robot' when id % 4 = 1 then 'Existing' end as patient_type
from c_patients""",
    "patient_patches": """
select id, id * 2 as seq, true as has_city, case when id % 3 = 0 then null else 'Pune' end as city, id % 2 = 0 as has_age,
 case when id % 22 = 0 then 'old' else cast(id % 90 as string) end as age, id % 5 = 0 as has_name, case when id % 10 = 0 then '' else 'Renamed' end as full_name
from c_patients
union all
select id, id * 2 + 1, false, null, id % 4 = 0, null, false, null from c_patients where patient_type = 'new'""",
    # All patients before an intake, and those the intake may have created.
    "patient_deletes": f"""
select seq as id from b_lead_intake union all select seq + {NEW_ID} from b_lead_intake""",
    "facility_forms": """
select id as seq, cast(null as int) as id, case when id % 10 = 0 then '' else concat('Clinic ', cast(id as string)) end as name,
 case id % 4 when 0 then null when 1 then 'Hospital' when 2 then 'spa' else 'clinic' end as type, 'Pune' as city, '' as region,
 concat('Road ', cast(id as string)) as address, cast(null as boolean) as is_active
from c_users
union all
select 1000000000 + id, case when id % 12 = 0 then id + 1000 else cast(id as int) end, case when id % 5 = 0 then '' else concat('Renamed ', name) end,
 case when id % 3 = 0 then '' else 'clinic' end, null, region, null, id % 2 = 0 from c_facilities""",
    "speciality_forms": """
select p_partkey as seq, case when p_partkey % 15 = 0 then '' when p_partkey % 2 = 0 then upper(p_brand)
  when p_partkey % 7 = 0 then lower(p_type) else concat(p_brand, ' ') end as name,
 case when p_partkey % 3 = 0 then '' else p_name end as description
from part""",
    "doctor_forms": """
select id as seq, cast(null as bigint) as id, concat('Dr. ', name) as name, case when id % 6 = 0 then 'NONE' else 'LARGE' end as speciality_id,
 cast(id % 26 as int) as facility_id, case when id % 2 = 0 then null else 'opd,visiting' end as consult_type,
 case when id % 5 = 0 then 'on_leave' end as availability, cast(null as boolean) as is_active
from c_users
union all
select 1000000000 + id, id, case when id % 4 = 0 then '' else concat('Prof. ', name) end, speciality_id, facility_id, 'tele,visiting',
 case id % 3 when 0 then 'unavailable' when 1 then '' else null end, id % 2 = 0 from c_doctors""",
    "user_forms": """
select id as seq, cast(null as bigint) as id, concat('New user ', cast(id as string)) as name,
 case when id % 2 = 0 then concat('USER', cast(id % 200 as string), '@example.com') when id % 31 = 0 then ''
  else concat('new', cast(id % 400 as string), '@example.com') end as email,
 'hash' as password_hash, case id % 5 when 0 then null when 1 then 'boss' else 'Finance' end as role, cast(null as boolean) as is_active
from c_patients
union all
select 1000000000 + id, id, case when id % 4 = 0 then '' else concat(name, ' x') end, null, null, case when id % 3 = 0 then '' else 'cxo' end, id % 2 = 0
from c_users""",
    "spends": """
select id as seq, case when id % 100 = 0 then '' when id % 2 = 0 then upper(lead_source) else lead_source end as channel,
 case id % 6 when 0 then '12.5abc' when 1 then 'abc' when 2 then '1e3' when 3 then null when 4 then ' 42' else cast(ai_score as string) end as monthly_spend,
 case when id % 10 = 0 then null else concat(cast(year(enquiry_date) as string), '-', lpad(cast(month(enquiry_date) as string), 2, '0')) end as month
from c_leads""",
    "hook_forms": """
select id as seq, case when id % 17 = 0 then '' when id % 3 = 0 then upper(concat('lead_', lower(action), 'd')) when id % 3 = 1 then 'lead_deleted'
  else concat('custom_', cast(user_id as string)) end as event_type,
 case when id % 19 = 0 then null else concat('https://new.example.com/', cast(id as string)) end as url
from c_audit_logs""",
    "hook_stops": "select upper(concat('lead_', lower(action), 'd')) as event_type from c_audit_logs",
    "setting_forms": """
select id as seq, case when id % 13 = 0 then '' when id % 2 = 0 then upper(concat('email_config_', cast(id % 50 as string)))
  else concat('report_', cast(id % 20 as string)) end as setting_key,
 case when id % 7 = 0 then '{broken' else concat('{"from_email":"s', cast(id as string), '@example.com"}') end as setting_value
from c_patients""",
    "deliveries": """
select id as seq, case when id % 15 = 0 then null when id % 16 = 0 then lead_id + 100000000 else lead_id end as lead_id, agent_id,
 case when id % 5 = 0 then null else outcome end as subject, cast(case id % 4 when 0 then 500 when 1 then 299 else 202 end as int) as status
from c_interactions""",
}


def load_batch(spark: SparkSession, sf_dir: str, t: Tables, name: str) -> DataFrame:
    """One batch over the given tables."""
    text = BATCHES[name]
    register_base(spark, sf_dir, text)
    for inner in dict.fromkeys(re.findall(r"\bb_([a-z_]+)\b", text)):
        load_batch(spark, sf_dir, t, inner).createOrReplaceTempView(f"b_{inner}")
    for inner in dict.fromkeys(re.findall(r"\bc_([a-z_]+)\b", text)):
        if inner in t:
            t[inner].createOrReplaceTempView(f"c_{inner}")
    return spark.sql(text)

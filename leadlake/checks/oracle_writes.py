"""SQL twins of the write jobs and their parts.

Each twin states the job's result as (entity, key, detail) rows: the new tables and
the refused rows.
"""

from __future__ import annotations

from leadlake.checks.oracle_more import LOG_CHANGES, LOG_TALKS, MISSED, TALKS, state_sql
from leadlake.schema import ENUMS, LEAD_STAGES, TABLES, columns

NEW = 1_000_000_000_000
AS_OF = "timestamp '2001-08-01'"


def rep(entity: str, key: str, cols: list[str], source: str) -> str:
    shown = ", ".join(f"coalesce(({c})::varchar, '-')" for c in cols)
    return f"select '{entity}' as entity, ({key})::varchar as key, concat_ws('|', {shown}) as detail from {source}"


def rejected(source: str = "j", key: str = "seq") -> str:
    return f"select 'reject ' || reason as entity, {key}::varchar as key, '' as detail from {source} where reason is not null"


def union(*parts: str) -> str:
    return " union all ".join(parts)


def blank(c: str) -> str:
    return f"coalesce({c}::varchar, '') = ''"


def blanks(*cols: str) -> str:
    return "(" + " or ".join(blank(c) for c in cols) + ")"


def bad_enum(table: str, c: str) -> str:
    values = ", ".join(f"'{v}'" for v in ENUMS[(table, c)])
    return f"(not {blank(c)} and lower(rtrim({c})) not in ({values}))"


def unknown(c: str, parent: str) -> str:
    return f"(not {blank(c)} and {c} not in (select id from c_{parent}))"


def judge(batch: str, *rules: tuple[str, str]) -> str:
    cases = " ".join(f"when {cond} then '{text}'" for cond, text in rules)
    return f"j as (select b.*, case {cases} end as reason from {batch} b), ok as (select * from j where reason is null)"


def low(c: str, default: str | None = None) -> str:
    value = f"lower(rtrim(nullif({c}, '')))"
    return f"coalesce({value}, '{default}')" if default else value


def nb(c: str) -> str:
    return f"nullif({c}, '')"


def last(source: str, key: str = "id") -> str:
    return f"(select * from {source} qualify row_number() over (partition by {key} order by seq desc) = 1)"


def touched(*pairs: tuple[str, str]) -> str:
    cond = " or ".join(f"{a} is distinct from {b}" for a, b in pairs)
    return f"case when {cond} then {AS_OF} else l.updated_at end"


REQ_LEAD = ("full_name", "primary_phone", "facility_id", "speciality_id", "lead_source")
STAGES = ", ".join(f"'{s}'" for s in LEAD_STAGES)

INGEST_STEPS = "with " + ", ".join([
    judge(
        "b_lead_intake",
        (blanks(*REQ_LEAD), ", ".join(REQ_LEAD) + " required"),
        (bad_enum("patients", "patient_type"), "invalid patient_type"),
        (f"(not {blank('stage')} and lower(rtrim(stage)) not in ({STAGES}))", "invalid stage"),
        (bad_enum("leads", "enquiry_type"), "invalid enquiry_type"),
        (bad_enum("leads", "urgency"), "invalid urgency"),
        (bad_enum("leads", "lead_source"), "invalid lead_source"),
        (unknown("facility_id", "facilities"), "unknown facility_id"),
        (unknown("speciality_id", "specialities"), "unknown speciality_id"),
        (unknown("doctor_id", "doctors"), "unknown doctor_id"),
        (unknown("assigned_to", "users"), "unknown assigned_to"),
    ),
    """met as (select ok.*, lower(rtrim(ok.primary_phone)) as k, p.id as old_id from ok
 left join c_patients p on lower(rtrim(p.primary_phone)) = lower(rtrim(ok.primary_phone)))""",
    "firsts as (select * from met where old_id is null qualify row_number() over (partition by k order by seq) = 1)",
    f"""fresh as (select *, {NEW} + seq as pid, 'PAT-' || lpad((row_number() over (order by seq)
 + (select max(regexp_extract(unique_pid, '([0-9]+)$', 1)::bigint) from c_patients))::varchar, 5, '0') as upid from firsts)""",
    "placed as (select m.*, coalesce(m.old_id, f.pid) as patient_id from met m left join fresh f on f.k = m.k)",
])
INGEST = INGEST_STEPS + " " + union(
    rejected(),
    rep("patients", "id", ["unique_pid", "full_name", "primary_phone", "email", "city", "patient_type"], "c_patients"),
    rep("patients", "pid", ["upid", "full_name", "primary_phone", nb("email"), nb("city"), low("patient_type", "new")], "fresh"),
    rep("leads", "id", ["patient_id", "facility_id", "doctor_id", "assigned_to", "lead_source", "enquiry_type", "urgency",
                        "campaign_name", "lead_stage", "lead_substage", "ai_score", "enquiry_date"], "c_leads"),
    rep("leads", f"seq + {NEW}", ["patient_id", "facility_id", "doctor_id", "assigned_to", "lower(lead_source)",
                                  low("enquiry_type", "appointment"), low("urgency", "medium"), nb("campaign_name"),
                                  low("stage", "untouched"), f"coalesce({nb('substage')}, 'Fresh Lead')", "50", AS_OF], "placed"),
)

UPDATE_LEADS = "with " + judge(
    "b_lead_patches",
    ("id not in (select id from c_leads)", "unknown lead"),
    ("not (has_campaign or has_urgency or has_doctor or has_followup)", "nothing to set"),
    ("has_urgency and not " + blank("urgency") + " and lower(urgency) not in ('low','medium','high','emergency')", "invalid urgency"),
    ("has_doctor and not " + blank("doctor_id") + " and doctor_id not in (select id::varchar from c_doctors)", "unknown doctor_id"),
) + """, agg as (select id, bool_or(has_campaign) as hc, arg_max_null(campaign_name, seq) filter (where has_campaign) as vc,
 bool_or(has_urgency) as hu, arg_max_null(lower(urgency), seq) filter (where has_urgency) as vu,
 bool_or(has_doctor) as hd, arg_max_null(doctor_id, seq) filter (where has_doctor) as vd,
 bool_or(has_followup) as hf, arg_max_null(followup_date, seq) filter (where has_followup) as vf from ok group by id),
 n as (select l.*, case when hc then vc else campaign_name end as nc, case when hu then vu else urgency end as nu,
 case when hd then vd::bigint else doctor_id end as nd, case when hf then vf::date else followup_date end as nf
 from c_leads l left join agg a on a.id = l.id) """ + union(
    rejected(),
    rep("leads", "id", ["nc", "nu", "nd", "nf", "lead_stage",
                        touched(("nc", "campaign_name"), ("nu", "urgency"), ("nd", "doctor_id"), ("nf", "followup_date"))], "n l"),
)

CHANGE_RULES = judge(
    "b_stage_changes",
    (blank("stage"), "stage required"),
    (f"stage not in ({STAGES})", "stage is not in the list"),
    ("id not in (select id from c_leads)", "unknown lead"),
)
CHANGE = f"""with {CHANGE_RULES}, x as (select l.*, coalesce(o.stage, l.lead_stage) as ns,
 coalesce({nb('o.substage')}, o.stage, l.lead_substage) as nsub from c_leads l left join {last('ok')} o on o.id = l.id) """ + union(
    rejected(),
    rep("leads", "id", ["ns", "nsub", touched(("ns", "lead_stage"), ("nsub", "lead_substage"))], "x l"),
)


def ai_sql(rules: str, source: str) -> str:
    return f"""with {rules}, x as (select l.*, o.id is not null as hit, o.ai_score as s, {low('o.ai_priority', 'medium')} as p,
 {nb('o.ai_reason')} as r, {nb('o.ai_next_action')} as a from c_leads l left join {last(source)} o on o.id = l.id),
 y as (select *, case when hit then s else ai_score end as ns, case when hit then p else ai_priority end as np,
 case when hit then r else ai_reason end as nr, case when hit then a else ai_next_action end as na from x) """


SAVE_AI = ai_sql(judge("b_scores", (bad_enum("leads", "ai_priority"), "invalid ai_priority"),
                       ("id not in (select id from c_leads)", "unknown lead")), "ok") + union(
    rejected(),
    rep("leads", "id", ["ns", "np", "nr", "na", touched(("ns", "ai_score"), ("np", "ai_priority"), ("nr", "ai_reason"),
                                                      ("na", "ai_next_action"))], "y l"),
)

PARSED = """parsed as (select id, seq, replace(replace(reply, '```json', ''), '```', '') as body from b_score_replies),
 fields as (select id, seq, case when json_valid(body) then round((body::json->>'$.score')::double)::integer else 50 end as ai_score,
 case when json_valid(body) then coalesce(nullif(lower(body::json->>'$.priority'), ''), 'medium') else 'medium' end as ai_priority,
 case when json_valid(body) then body::json->>'$.reason' else 'Parse error' end as ai_reason,
 case when json_valid(body) then body::json->>'$.nextAction' else 'Follow up' end as ai_next_action from parsed)"""

DELETE_LEADS = "with " + judge(
    "(select distinct id from b_lead_deletes)",
    ("id not in (select id from c_leads)", "unknown lead"),
    ("id in (select lead_id from c_appointments union select lead_id from c_revenue)", "lead has appointments or revenue"),
) + " " + union(
    rejected(key="id"),
    rep("leads", "id", ["lead_stage"], "c_leads where id not in (select id from ok)"),
    rep("interactions", "id", ["lead_id"], "c_interactions where lead_id not in (select id from ok)"),
)

NEW_TALKS = judge(
    "(select * replace (coalesce(agent_id, 3) as agent_id) from b_new_interactions)",
    (blanks("lead_id", "outcome"), "lead or outcome is missing"),
    (bad_enum("interactions", "interaction_type"), "invalid interaction_type"),
    (unknown("lead_id", "leads"), "unknown lead_id"),
    (unknown("agent_id", "users"), "unknown agent_id"),
)
KIND = "coalesce(nullif(interaction_type, ''), 'call')"
NEW_TRIES = f"select lead_id, seq, {MISSED} as missed from ok where {KIND} in ('call', 'whatsapp', 'sms')"
INGEST_TALKS = f"with {NEW_TALKS}, " + state_sql(
    NEW_TRIES, None, "select lead_id, seq, followup_date from ok") + " " + union(
    rejected(),
    rep("interactions", "id", ["lead_id", "agent_id", "interaction_type", "outcome", "notes", "followup_date"], "c_interactions"),
    rep("interactions", f"seq + {NEW}", ["lead_id", "agent_id", low("interaction_type", "call"), "outcome", nb("notes"),
                                         "followup_date"], "ok"),
    rep("leads", "id", ["lead_stage", "lead_substage", "attempt_count", "followup_date"], "state"),
)

DELETE_TALKS = rep("interactions", "id", ["lead_id"], "c_interactions where id not in (select id from b_interaction_deletes)")


def to_customers(ids: str, substage: str) -> str:
    x = f"""(select *, case when id in ({ids}) then 'customer' else lead_stage end as ns,
 case when id in ({ids}) then '{substage}' else lead_substage end as nsub from c_leads) l"""
    return rep("leads", "id", ["ns", "nsub", touched(("ns", "lead_stage"), ("nsub", "lead_substage"))], x)


REQ_BOOK = ("lead_id", "patient_id", "facility_id", "appointment_date")
BOOK = "with " + judge(
    "b_bookings",
    (blanks(*REQ_BOOK), ", ".join(REQ_BOOK) + " required"),
    (bad_enum("appointments", "consult_type"), "invalid consult_type"),
    (unknown("lead_id", "leads"), "unknown lead_id"),
    (unknown("patient_id", "patients"), "unknown patient_id"),
    (unknown("facility_id", "facilities"), "unknown facility_id"),
    (unknown("doctor_id", "doctors"), "unknown doctor_id"),
) + " " + union(
    rejected(),
    rep("appointments", "id", ["lead_id", "patient_id", "facility_id", "doctor_id", "appointment_date", "consult_type",
                               "visit_status", "notes"], "c_appointments"),
    rep("appointments", f"seq + {NEW}", ["lead_id", "patient_id", "facility_id", "doctor_id", "appointment_date",
                                         low("consult_type", "opd"), "'booked'", nb("notes")], "ok"),
    to_customers("select lead_id from ok", "Super Hot – Booked"),
)

VISITS = "with " + judge(
    "b_visit_changes",
    (blank("visit_status"), "visit_status required"),
    (bad_enum("appointments", "visit_status"), "invalid visit_status"),
    ("id not in (select id from c_appointments)", "unknown appointment"),
) + f""", agg as (select id, arg_max(lower(visit_status), seq) as st,
 arg_max(notes, seq) filter (where coalesce(notes, '') <> '') as nt from ok group by id),
 x as (select l.*, coalesce(a.st, l.visit_status) as ns, coalesce(a.nt, l.notes) as nn from c_appointments l left join agg a on a.id = l.id) """ + union(
    rejected(),
    rep("appointments", "id", ["ns", "nn", touched(("ns", "visit_status"), ("nn", "notes"))], "x l"),
    to_customers("select a.lead_id from ok o join c_appointments a on a.id = o.id where lower(o.visit_status) = 'visited'", "Visited"),
)

REQ_BILL = ("appointment_id", "lead_id", "patient_id")
MONEY = "coalesce(try_cast(nullif({0}, '') as decimal(12,2)), 0)::decimal(12,2)"
BILLS = "with " + judge(
    "b_bills",
    (blanks(*REQ_BILL), ", ".join(REQ_BILL) + " required"),
    (" or ".join(f"(not {blank(c)} and try_cast({c} as decimal(12,2)) is null)" for c in ("consultation_value", "procedure_value")),
     "amount is not a number"),
    (bad_enum("revenue", "payment_status"), "invalid payment_status"),
    (unknown("appointment_id", "appointments"), "unknown appointment_id"),
    (unknown("lead_id", "leads"), "unknown lead_id"),
    (unknown("patient_id", "patients"), "unknown patient_id"),
) + " " + union(
    rejected(),
    rep("revenue", "id", ["appointment_id", "lead_id", "consultation_value", "procedure_value", "package_value", "total_value",
                          "payment_status", "billed_date"], "c_revenue"),
    rep("revenue", f"seq + {NEW}", ["appointment_id", "lead_id", MONEY.format("consultation_value"), MONEY.format("procedure_value"),
                                    "0.00::decimal(12,2)",
                                    f"({MONEY.format('consultation_value')} + {MONEY.format('procedure_value')})::decimal(14,2)",
                                    low("payment_status", "pending"), f"coalesce(billed_date, {AS_OF})"], "ok"),
    to_customers("select lead_id from ok", "Revenue Captured"),
)

CREATE_PATIENTS = "with " + judge(
    "b_patient_forms",
    (blanks("full_name", "primary_phone"), "name or phone is missing"),
    (bad_enum("patients", "patient_type"), "invalid patient_type"),
) + f""", met as (select *, lower(rtrim(primary_phone)) as k,
 lower(rtrim(primary_phone)) in (select lower(rtrim(primary_phone)) from c_patients) as old from ok),
 firsts as (select * from met where not old qualify row_number() over (partition by k order by seq) = 1),
 fresh as (select *, 'PAT-' || lpad((row_number() over (order by seq)
  + (select max(regexp_extract(unique_pid, '([0-9]+)$', 1)::bigint) from c_patients))::varchar, 5, '0') as upid from firsts) """ + union(
    rejected(),
    "select 'reject phone is taken', seq::varchar, '' from met where seq not in (select seq from firsts)",
    rep("patients", "id", ["unique_pid", "full_name", "primary_phone", "email", "city", "patient_type"], "c_patients"),
    rep("patients", f"seq + {NEW}", ["upid", "full_name", "primary_phone", nb("email"), nb("city"), low("patient_type", "new")], "fresh"),
)

UPDATE_PATIENTS = "with " + judge(
    "b_patient_patches",
    ("id not in (select id from c_patients)", "unknown patient"),
    ("not (has_city or has_age or has_name)", "nothing to set"),
    ("has_age and age = 'old'", "invalid age"),
) + """, agg as (select id, bool_or(has_city) as hc, arg_max_null(city, seq) filter (where has_city) as vc,
 bool_or(has_age) as ha, arg_max_null(age, seq) filter (where has_age) as va,
 bool_or(has_name) as hn, arg_max_null(full_name, seq) filter (where has_name) as vn from ok group by id),
 n as (select l.*, case when hc then vc else city end as nc, case when ha then va::integer else age end as na,
 case when hn then vn else full_name end as nn from c_patients l left join agg a on a.id = l.id) """ + union(
    rejected(),
    rep("patients", "id", ["nn", "nc", "na", touched(("nn", "full_name"), ("nc", "city"), ("na", "age"))], "n l"),
)

DELETE_PATIENTS = INGEST_STEPS + f""",
 allp as (select id, patient_type from c_patients union all select pid, {low("patient_type", "new")} from fresh),
 alll as (select id, patient_id from c_leads union all select seq + {NEW}, patient_id from placed),
 used as (select patient_id, lead_id from c_appointments union select patient_id, lead_id from c_revenue),
 dj as (select b.id, case when b.id not in (select id from allp) then 'unknown patient'
  when b.id in (select patient_id from used) or b.id in (select patient_id from alll where id in (select lead_id from used))
  then 'patient has appointments or revenue' end as reason from (select distinct id from b_patient_deletes) b),
 gone as (select id from dj where reason is null) """ + union(
    rejected("dj", "id"),
    rep("patients", "id", ["patient_type"], "allp where id not in (select id from gone)"),
    rep("leads", "id", ["patient_id"], "alll where patient_id not in (select id from gone)"),
    rep("interactions", "id", ["lead_id"], """c_interactions where lead_id not in
 (select id from alll where patient_id in (select id from gone))"""),
)



def directory(table: str, batch: str, required, text: str, must, set_sql: dict[str, str], created: list[str],
              cols: list[str], new: int, refs: list[tuple[str, str]], mode: str, unique: str | None = None, taken: str = "",
              stamp: bool = False) -> str:
    """Creates and updates of a small table; ``set_sql`` maps each updated column to the value of a row."""
    enums = [(bad_enum(t, c), f"invalid {c}") for t, c in ENUMS if t == table and c in set_sql_columns(batch)]
    ref_rules = [(unknown(c, p), f"unknown {c}") for c, p in refs]
    rules = judge(f"(select * from {batch} where id is null)", (blanks(*required), text), *enums, *ref_rules)
    first = "ok"
    extra = ""
    if unique:
        first = "firsts"
        extra = f""", met as (select *, lower(rtrim({unique})) as k, lower(rtrim({unique})) in (select lower(rtrim({unique})) from c_{table}) as old from ok),
 firsts as (select * from met where not old qualify row_number() over (partition by k order by seq) = 1)"""
    u_rules = [(f"id not in (select id from c_{table})", "not found")]
    if mode == "replace":
        for c in set_sql:
            if c in must:
                u_rules.append((f"{c} is null", f"{c} must not be empty"))
            if (table, c) in ENUMS:
                u_rules.append((f"{c} = ''", f"invalid {c}"))
    u_rules += enums + ref_rules
    cases = " ".join(f"when {c} then '{t}'" for c, t in u_rules)
    ups = f""", uj as (select b.*, case {cases} end as reason from {batch} b where id is not null), uok as (select * from uj where reason is null)"""
    if mode == "replace":
        agg = ", agg as (select * from uok qualify row_number() over (partition by id order by seq desc) = 1)"
        new_cols = [f"case when a.id is not null then {v.format('a.' + c)} else l.{c} end as n_{c}" for c, v in set_sql.items()]
    else:
        picks = ", ".join(f"arg_max({c}, seq) filter (where not {blank(c)}) as {c}" for c in set_sql)
        agg = f", agg as (select id, {picks} from uok group by id)"
        new_cols = [f"coalesce({v.format('a.' + c)}, l.{c}) as n_{c}" for c, v in set_sql.items()]
    state = f", st as (select l.*, {', '.join(new_cols)} from c_{table} l left join agg a on a.id = l.id) "
    shown = [f"n_{c}" if c in set_sql else c for c in cols]
    if stamp:
        shown[-1] = touched(*[(f"n_{c}", c) for c in set_sql])
    parts = [rejected(), rejected("uj"), rep(table, "id", shown, "st l"), rep(table, f"seq + {new}", created, first)]
    if unique:
        parts.append(f"select 'reject {taken}', seq::varchar, '' from met where seq not in (select seq from firsts)")
    return "with " + rules + extra + ups + agg + state + union(*parts)


def set_sql_columns(batch: str) -> set[str]:
    return {"b_facility_forms": {"type"}, "b_doctor_forms": {"availability"}, "b_user_forms": {"role"}}[batch]


def facilities(mode: str) -> str:
    cols = ["name", "type", "city", "region", "address", "is_active"]
    sets = {"name": "{0}", "type": "lower({0})", "city": "{0}", "region": "{0}", "is_active": "{0}"}
    if mode == "replace":
        sets["address"] = "{0}"
    return directory("facilities", "b_facility_forms", ["name"], "name required", ["name", "type", "is_active"], sets,
                     ["name", low("type", "clinic"), nb("city"), nb("region"), nb("address"), "true"], cols, 1_000_000, [], mode)


def doctors(mode: str) -> str:
    cols = ["name", "speciality_id", "facility_id", "consult_type", "availability", "is_active"]
    req = ["name", "speciality_id", "facility_id"]
    sets = {c: "{0}" for c in (["name", "speciality_id", "facility_id", "consult_type", "is_active"] if mode == "replace"
                              else ["name", "availability", "is_active"])}
    must = ["name", "speciality_id", "facility_id", "consult_type", "is_active"]
    return directory("doctors", "b_doctor_forms", req, ", ".join(req) + " required", must, sets,
                     ["name", "speciality_id", "facility_id", "coalesce(consult_type, 'opd')", low("availability", "available"), "true"],
                     cols, NEW, [("speciality_id", "specialities"), ("facility_id", "facilities")], mode)


def users(mode: str) -> str:
    sets = {"name": "{0}", "role": "lower({0})", "is_active": "{0}"}
    return directory("users", "b_user_forms", ["name", "email", "password_hash"], "name, e-mail or password is missing",
                     ["name", "role", "is_active"], sets,
                     ["name", "email", low("role", "agent"), "true", AS_OF], ["name", "email", "role", "is_active", "updated_at"],
                     NEW, [], mode, unique="email", taken="e-mail is taken", stamp=True)


SPECIALITIES = "with " + judge("b_speciality_forms", (blank("name"), "name required")) + """,
 met as (select *, lower(rtrim(name)) as k, lower(rtrim(name)) in (select lower(rtrim(name)) from c_specialities) as old from ok),
 firsts as (select * from met where not old qualify row_number() over (partition by k order by seq) = 1) """ + union(
    rejected(),
    "select 'reject speciality exists', seq::varchar, '' from met where seq not in (select seq from firsts)",
    rep("specialities", "id", ["name", "description", "is_active"], "c_specialities"),
    rep("specialities", "'new-' || seq", ["name", nb("description"), "true"], "firsts"),
)

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
SPENDS = "with " + judge("b_spends", (blank("channel"), "channel required")) + f""",
 v as (select seq, lower(rtrim(channel)) as k, channel, coalesce(month, '2001-08') as month,
  coalesce(try_cast(regexp_extract(trim(monthly_spend), '{NUMBER}') as double), 0)::decimal(12,2) as spend from ok),
 l1 as (select * from v qualify row_number() over (partition by k, month order by seq desc) = 1),
 x as (select coalesce(l.channel, n.channel) as channel, coalesce(l.month, n.month) as month,
  coalesce(n.spend, l.monthly_spend) as spend, case when l.month is null or n.spend is distinct from l.monthly_spend and n.k is not null
   then {AS_OF} else l.updated_at end as stamp from c_ad_spend l full outer join l1 n on n.k = lower(l.channel) and n.month = l.month) """ + union(
    rejected(), rep("ad_spend", "channel", ["month", "spend", "stamp"], "x"))

HOOKS = "with " + judge("b_hook_forms", (blanks("event_type", "url"), "event_type and url required")) + """,
 l1 as (select *, lower(event_type) as k from ok qualify row_number() over (partition by lower(event_type) order by seq desc) = 1),
 x as (select coalesce(l.event_type, n.event_type) as event_type, coalesce(n.url, l.url) as url,
  n.k is not null or l.is_active as act, case when l.event_type is null then 5 else l.created_by end as who
  from c_webhooks l full outer join l1 n on n.k = lower(l.event_type)) """ + union(
    rejected(), rep("webhooks", "event_type", ["url", "act", "who"], "x"))

STOPS = rep("webhooks", "event_type", ["url", "case when event_type in (select lower(event_type) from b_hook_stops) then false else is_active end"],
            "c_webhooks")

SETTINGS = "with " + judge("b_setting_forms", (blank("setting_key"), "setting_key required"),
                           ("not json_valid(setting_value)", "setting_value is not JSON")) + """,
 l1 as (select *, lower(setting_key) as k from ok qualify row_number() over (partition by lower(setting_key) order by seq desc) = 1),
 x as (select coalesce(l.setting_key, n.setting_key) as setting_key, coalesce(n.setting_value, l.setting_value) as v
  from c_system_settings l full outer join l1 n on n.k = lower(l.setting_key)) """ + union(
    rejected(), rep("system_settings", "setting_key", ["v"], "x"))

EMAILS = "with " + judge(
    "b_deliveries", (blank("lead_id"), "no lead"), ("coalesce(status >= 300, true)", "not delivered"),
    (unknown("lead_id", "leads"), "unknown lead_id"), (unknown("agent_id", "users"), "unknown agent_id"),
) + " " + union(
    rejected(),
    rep("interactions", "id", ["lead_id", "agent_id", "interaction_type", "outcome", "notes"], "c_interactions"),
    rep("interactions", f"seq + {NEW}", ["lead_id", "agent_id", "'email'", "'Email sent'", "'Subject: ' || coalesce(subject, 'null')"], "ok"),
)

OUTBOX = f"""with {CHANGE_RULES} select w.event_type, o.id::varchar as entity_id, w.url, w.event_type as event,
 '2001-08-01T00:00:00.000Z' as timestamp, 'leadlake' as source, o.id, o.stage as lead_stage, o.substage as lead_substage,
 '7' as changed_by from ok o join c_webhooks w on w.event_type = 'lead_stage_changed' and w.is_active"""

CREATED = INGEST_STEPS + f""" select 'lead_created' as event_type, (seq + {NEW})::varchar as entity_id, 'https://example.com/new' as url,
 'lead_created' as event, '2001-08-01T00:00:00.000Z' as timestamp, 'leadlake' as source, seq + {NEW} as id, patient_id,
 lower(lead_source) as lead_source, {low('stage', 'untouched')} as lead_stage, facility_id, {nb('campaign_name')} as campaign_name from placed"""

AUDIT = "with " + state_sql(LOG_TALKS, LOG_CHANGES, "select lead_id, seq, followup_date from b_event_log") + f""",
 d as (select l.id, l.lead_stage as s0, s.lead_stage as s1, l.lead_substage is distinct from s.lead_substage
   or l.lead_stage is distinct from s.lead_stage as staged,
  l.followup_date is distinct from s.followup_date as moved, s.followup_date as f1,
  l.attempt_count is distinct from s.attempt_count as counted, s.attempt_count as c1
  from c_leads l join state s on s.id = l.id)
 select 7 as user_id, 'lead' as entity_type, id::varchar as entity_id, 'STAGE_CHANGE' as action, {AS_OF} as created_at,
  s0 as old_stage, s1 as new_stage, null::varchar as new_followup, null::varchar as new_count from d where staged
 union all select 7, 'lead', id::varchar, 'UPDATE', {AS_OF}, s0, null, case when moved then f1::varchar end,
  case when counted then c1::varchar end from d where moved or counted"""

_RULES_OF_PATCHES = UPDATE_LEADS[len("with "):UPDATE_LEADS.index(", agg as")]

#: Requests of both kinds in one sequence; what a request meets is the last value given before it.
REQUESTS = f"""with {_RULES_OF_PATCHES.replace('j as', 'pj as').replace('from j', 'from pj').replace('ok as', 'po as')},
 {CHANGE_RULES}, r as (
 select id, seq * 2 as seq, 'UPDATE' as action, null as stage, null as substage, null as shown, has_campaign, campaign_name, has_urgency, urgency,
  has_doctor, doctor_id from po
 union all select id, seq * 2 + 1, 'STAGE_CHANGE', stage, coalesce({nb('substage')}, stage), substage, false, null, false, null, false, null from ok),
 m as (select *, last_value(case when stage is not null then [stage, substage] end ignore nulls) over w as ms,
  last_value(case when has_campaign then [campaign_name] end ignore nulls) over w as mc,
  last_value(case when has_urgency then [lower(rtrim(urgency))] end ignore nulls) over w as mu,
  last_value(case when has_doctor then [doctor_id] end ignore nulls) over w as md
  from r window w as (partition by id order by seq rows between unbounded preceding and 1 preceding)),
 k as (select m.*, l.patient_id, case when ms is null then l.lead_stage else ms[1] end as os,
  case when ms is null then l.lead_substage else ms[2] end as osub, case when mc is null then l.campaign_name else mc[1] end as oc,
  case when mu is null then l.urgency else mu[1] end as ou,
  case when md is null then l.doctor_id::varchar else nullif(md[1], '') end as od from m join c_leads l on l.id = m.id)
 select seq, 7 as user_id, 'lead' as entity_type, id::varchar as entity_id, action, {AS_OF} as created_at, os as old_lead_stage,
  case when action = 'UPDATE' then patient_id::varchar end as old_patient_id,
  case when action = 'UPDATE' then osub end as old_lead_substage, case when action = 'UPDATE' then oc end as old_campaign_name,
  case when action = 'UPDATE' then ou end as old_urgency, case when action = 'UPDATE' then od end as old_doctor_id,
  stage as new_lead_stage, shown as new_lead_substage, case when has_campaign then campaign_name end as new_campaign_name,
  case when has_urgency then urgency end as new_urgency, case when has_doctor then doctor_id end as new_doctor_id from k"""

BROKEN = """bp as (select * replace (lower(city) as gender) from c_patients where patient_type = 'existing'),
 bu as (select * replace (case role when 'admin' then 'Admin' when 'cxo' then 'Cxo' when 'marketing' then 'Marketing'
  when 'finance' then 'Finance' when 'agent' then 'Agent' else 'Calling_agent' end as email) from c_users),
 bl as (select * replace (lead_source as urgency) from c_leads where lead_stage <> 'untouched'),
 bf as (select * from c_facilities where is_active)"""


def missing(table: str, source: str, column: str, parent: str) -> str:
    return f"""select '{table}' as table_name, '{column}' as column_name, {column}::varchar as missing_id, count(*) as rows
 from {source} where {column} is not null and {column} not in (select id from {parent}) group by {column}"""


FK = f"with {BROKEN} " + union(*[
    missing(*x) for x in (
        ("doctors", "c_doctors", "speciality_id", "c_specialities"), ("doctors", "c_doctors", "facility_id", "bf"),
        ("leads", "bl", "patient_id", "bp"), ("leads", "bl", "facility_id", "bf"),
        ("leads", "bl", "speciality_id", "c_specialities"), ("leads", "bl", "doctor_id", "c_doctors"),
        ("leads", "bl", "assigned_to", "bu"), ("interactions", "c_interactions", "lead_id", "bl"),
        ("interactions", "c_interactions", "agent_id", "bu"), ("appointments", "c_appointments", "lead_id", "bl"),
        ("appointments", "c_appointments", "patient_id", "bp"), ("appointments", "c_appointments", "facility_id", "bf"),
        ("appointments", "c_appointments", "doctor_id", "c_doctors"), ("revenue", "c_revenue", "appointment_id", "c_appointments"),
        ("revenue", "c_revenue", "lead_id", "bl"), ("revenue", "c_revenue", "patient_id", "bp"),
    )
])

DOMAIN = union(
    """select 'patients' as table_name, 'gender' as column_name, gender as value, count(*) as rows from bp
 where gender not in ('male', 'female', 'other') group by gender""",
    """select 'leads', 'urgency', urgency, count(*) from bl where urgency not in ('low','medium','high','emergency') group by urgency""",
)

UNIQUE = f"""select 'unique' as rule, 'users' as table_name, 'email' as column_name, lower(email) as value, count(*) as rows
 from bu group by lower(email) having count(*) > 1"""

SHOW = "coalesce({0}::varchar, 'null')"


def line(*parts: str) -> str:
    return " || ".join(f"'{p[1:]}'" if p.startswith("=") else SHOW.format(p) for p in parts)


TEXT_JOIN = """c_leads l join c_patients p on p.id = l.patient_id join c_specialities sp on sp.id = l.speciality_id
 left join c_doctors d on d.id = l.doctor_id"""

def contents(table: str) -> str:
    """Rows of a table and a digest of all their values."""
    names = columns(table) + (["total_value"] if table == "revenue" else [])
    line = ", ".join(f"coalesce({c}::varchar, '-')" for c in names)
    part = f"('0x' || substr(md5(concat_ws('|', {line})), 1, 8))::bigint"
    return f"select '{table}' as table_name, count(*) as rows, coalesce(sum({part}), 0)::bigint as digest from c_{table}"


WRITES_SQL: dict[str, str] = {
    "ingest_leads": INGEST,
    "update_leads": UPDATE_LEADS,
    "change_stage": CHANGE,
    "save_ai": SAVE_AI,
    "delete_leads": DELETE_LEADS,
    "ingest_interactions": INGEST_TALKS,
    "delete_interactions": DELETE_TALKS,
    "book_appointments": BOOK,
    "set_visit_status": VISITS,
    "post_revenue": BILLS,
    "create_patients": CREATE_PATIENTS,
    "update_patients": UPDATE_PATIENTS,
    "delete_patients": DELETE_PATIENTS,
    "upsert_facilities": facilities("replace"),
    "upsert_facilities_patch": facilities("patch"),
    "create_specialities": SPECIALITIES,
    "upsert_doctors": doctors("replace"),
    "upsert_doctors_patch": doctors("patch"),
    "upsert_users": users("replace"),
    "upsert_users_patch": users("patch"),
    "upsert_ad_spend": SPENDS,
    "upsert_webhooks": HOOKS,
    "disable_webhooks": STOPS,
    "upsert_settings": SETTINGS,
    "log_emails": EMAILS,
    "parse_scores": f"with {PARSED} select id, ai_score, ai_priority, ai_reason, ai_next_action from fields",
    "apply_scores": ai_sql(PARSED, "fields") + rep("leads", "id", ["ns", "np", "nr", "na"], "y"),
    "event_outbox": OUTBOX,
    "audit_rows": AUDIT,
    "request_audit": REQUESTS,
    "created_outbox": CREATED,
    "apply_defaults": f"""select seq as id, {low('enquiry_type', 'appointment')} as enquiry_type, {low('urgency', 'medium')} as urgency,
 lower(lead_source) as lead_source, 'untouched' as lead_stage, 'Fresh Lead' as lead_substage, 0 as attempt_count, 50 as ai_score,
 'medium' as ai_priority, {nb('campaign_name')} as campaign_name, {AS_OF} as enquiry_date from b_lead_intake""",
    "insert_ignore": """select id, name, description from c_specialities union all
 select 'new-' || seq, name, description from b_speciality_forms where lower(rtrim(name)) not in (select lower(rtrim(name)) from c_specialities)
 qualify row_number() over (partition by lower(rtrim(name)) order by seq) = 1""",
    "stage_stream": "with " + state_sql(
        TALKS, None, "select lead_id, id as seq, followup_date from c_interactions") + " select * from state",
    "outbox_stream": """select 'lead_stage_changed' as event_type, a.entity_id, w.url, a.new_values::json->>'$.k' as k
 from c_audit_logs a join c_webhooks w on w.event_type = 'lead_stage_changed' where a.action = 'STAGE_CHANGE'""",
    "audit_stream": "select user_id, entity_type, entity_id, action, new_values, created_at from c_audit_logs",
    "upsert_stream": """select channel, month, monthly_spend from c_ad_spend union all
 select upper(interaction_type), strftime(interaction_date, '%Y-%m'), arg_max(lead_id, id)::decimal(12,2) from c_interactions
 where (lower(interaction_type), strftime(interaction_date, '%Y-%m')) not in (select (channel, month) from c_ad_spend)
 group by 1, 2""",
    "load_tables": union(*map(contents, TABLES)),
    "fk_violations": FK,
    "orphans": f"with {BROKEN} select id, patient_id from bl where patient_id not in (select id from bp)",
    "enum_violations": f"with {BROKEN} {DOMAIN}",
    "key_violations": f"with {BROKEN} {UNIQUE} union all select 'domain', d.* from ({DOMAIN}) d",
    "with_total_value": "select id, (consultation_value + procedure_value + package_value)::decimal(14,2) as total_value from c_revenue",
    "read_settings": """select setting_key, setting_value::json->>'$.from_email' as from_email,
 setting_value::json->>'$.from_name' as from_name from c_system_settings""",
    "score_features": "select l.id, " + line(
        "=Lead: ", "p.full_name", "=, Concern: ", "l.medical_concern", "=, Stage: ", "l.lead_stage", "=, Substage: ", "l.lead_substage",
        "=, Source: ", "l.lead_source", "=, Speciality: ", "sp.name", "=, Interactions: ",
        "(select count(*) from c_interactions i where i.lead_id = l.id)", "=, Urgency: ", "l.urgency") + f" as text from {TEXT_JOIN}",
    "followup_features": "select l.id, " + line(
        "=Patient: ", "p.full_name", "=, Concern: ", "l.medical_concern", "=, Stage: ", "l.lead_stage", "= (", "l.lead_substage",
        "=), Speciality: ", "sp.name", "=, Doctor: ", "coalesce(d.name, 'Not assigned')") + f" as text from {TEXT_JOIN}",
    "insight_features": "select l.id, " + line(
        "=Patient: ", "p.full_name", "=, Concern: ", "l.medical_concern", "=, Stage: ", "l.lead_stage", "=, Substage: ",
        "l.lead_substage", "=, Source: ", "l.lead_source", "=, AI Score: ", "l.ai_score", "=, Interactions: ", "l.attempt_count")
        + f" as text from {TEXT_JOIN}",
}

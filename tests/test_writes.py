from pyspark.sql import functions as F

from leadlake.operators import audit as A
from leadlake.operators import features as X
from leadlake.operators import integrity as I
from leadlake.operators import outbox as O
from leadlake.operators import writes as W
from leadlake.sources.batches import NEW_ID, load_batch
from leadlake.sources.fixtures import CLOCK
from tests.conftest import SF_DIR


def ids(table, seq):
    return seq + F.lit(NEW_ID)


def test_intake_keeps_references_and_numbers_in_sequence(spark, t):
    done = W.ingest_leads(t, load_batch(spark, SF_DIR, t, "lead_intake"), CLOCK, ids)
    assert I.fk_violations(done.tables).count() == 0
    assert I.key_violations(done.tables).where("rule = 'unique'").count() == 0
    top = t.patients.agg(F.max(F.regexp_extract("unique_pid", r"(\d+)$", 1).cast("int"))).first()[0]
    fresh = done.tables.patients.where(F.col("id") >= NEW_ID).orderBy("id")
    numbers = [int(r["unique_pid"][4:]) for r in fresh.collect()]
    assert numbers == list(range(top + 1, top + 1 + len(numbers)))


def test_default_ids_are_stable_across_runs(spark, t):
    batch = load_batch(spark, SF_DIR, t, "lead_intake")
    text = t.replace(
        patients=t.patients.withColumn("id", F.col("id").cast("string")),
        leads=t.leads.withColumn("id", F.col("id").cast("string")).withColumn("patient_id", F.col("patient_id").cast("string")),
    )
    done = W.ingest_leads(text, batch, CLOCK)
    leads = done.accepted.select("id", "patient_id").collect()
    assert leads == done.accepted.select("id", "patient_id").collect()
    known = {r["id"] for r in done.tables.patients.select("id").collect()}
    assert {r["patient_id"] for r in leads} <= known


def patch(spark, rows):
    return spark.createDataFrame(rows, "id bigint, seq bigint, fields map<string,string>")


def test_absent_null_and_later_fields(spark, t):
    lead = t.leads.where("campaign_name <> '' and doctor_id is not null").first()
    done = W.update_leads(t, patch(spark, [
        (lead["id"], 1, {"campaign_name": "One", "urgency": "LOW"}),
        (lead["id"], 2, {"campaign_name": None}),
        (lead["id"], 3, {"lead_stage": "customer"}),
        (lead["id"], 4, {"doctor_id": "none"}),
        (lead["id"], 5, {"facility_id": None}),
        (-1, 6, {"urgency": "low"}),
        (lead["id"], 7, {"urgency": ""}),
        (lead["id"], 8, {"followup_date": "soon"}),
        (lead["id"], 9, {"lead_medium": ""}),
    ]), CLOCK)
    after = done.tables.leads.where(F.col("id") == lead["id"]).first()
    assert (after["campaign_name"], after["urgency"], after["doctor_id"]) == (None, "low", lead["doctor_id"])
    assert after["lead_stage"] == lead["lead_stage"]
    reasons = {r["seq"]: r["reason"] for r in done.rejects.collect()}
    assert reasons == {3: "nothing to set", 4: "unknown doctor_id", 5: "facility_id must not be empty", 6: "unknown lead",
                       7: "invalid urgency", 8: "invalid followup_date"}
    assert after["lead_medium"] == ""


def test_clock_moves_only_on_real_changes(spark, t):
    lead = t.leads.first()
    same = W.update_leads(t, patch(spark, [(lead["id"], 1, {"urgency": lead["urgency"]})]), CLOCK)
    assert same.tables.leads.where(F.col("id") == lead["id"]).first()["updated_at"] == lead["updated_at"]
    moved = W.update_leads(t, patch(spark, [(lead["id"], 1, {"campaign_name": "Other"})]), CLOCK)
    assert str(moved.tables.leads.where(F.col("id") == lead["id"]).first()["updated_at"]) == CLOCK


def test_deleting_interactions_keeps_counts(spark, t):
    gone = t.interactions.select("id").limit(10)
    done = W.delete_interactions(t, gone)
    assert done.tables.interactions.count() == t.interactions.count() - 10
    assert done.tables.leads.collect() == t.leads.collect()


def test_deletes_leave_no_dangling_rows(spark, t):
    done = W.delete_leads(t, load_batch(spark, SF_DIR, t, "lead_deletes"))
    assert I.fk_violations(done.tables).count() == 0
    assert done.tables.leads.count() < t.leads.count()


def test_upserts_are_idempotent(spark, t):
    for name, job, table in (
        ("spends", lambda x, b: W.upsert_ad_spend(x, b, CLOCK), "ad_spend"),
        ("hook_forms", lambda x, b: W.upsert_webhooks(x, b, CLOCK, 1), "webhooks"),
        ("setting_forms", lambda x, b: W.upsert_settings(x, b, CLOCK), "system_settings"),
    ):
        batch = load_batch(spark, SF_DIR, t, name)
        once = job(t, batch).tables
        twice = job(once, batch).tables
        assert sorted(map(str, once[table].collect())) == sorted(map(str, twice[table].collect()))
        assert I.key_violations(once).where(F.col("table_name") == table).count() == 0


def test_patch_and_replace_of_the_directory(spark, t):
    schema = "seq bigint, id int, name string, type string, city string, region string, address string, is_active boolean"
    rows = [(1, 3, "", "", "Pune", None, None, None), (2, 3, "New name", None, "", None, "x", False)]
    patched = W.upsert_facilities(t, spark.createDataFrame(rows, schema), "patch", CLOCK, ids)
    old = t.facilities.where("id = 3").first()
    now = patched.tables.facilities.where("id = 3").first()
    assert (now["name"], now["city"], now["type"], now["address"], now["is_active"]) == (
        "New name", "Pune", old["type"], old["address"], False)
    replaced = W.upsert_facilities(t, spark.createDataFrame([(1, 3, "N", "clinic", None, None, None, True)], schema), "replace", CLOCK, ids)
    now = replaced.tables.facilities.where("id = 3").first()
    assert (now["name"], now["city"], now["address"]) == ("N", None, None)


def test_email_settings(spark, t):
    batch = spark.createDataFrame([(1, "k", "a@x", ""), (2, "", "b@x", "n")], "seq bigint, sendgrid_key string, from_email string, from_name string")
    done = W.upsert_settings(t, W.email_settings(batch), CLOCK)
    got = W.read_settings(done.tables).where("setting_key = 'email_config'").first()
    assert (got["from_email"], got["from_name"]) == ("a@x", "CRM")


def test_replies(spark):
    df = spark.createDataFrame([
        (1, '```json\n{"score": 81.6, "priority": "HIGH", "reason": "r", "nextAction": "n"}\n```'),
        (2, "no json"), (3, ""), (4, None), (5, '{"score":"70"}'), (6, '{"reason":"only"}'),
    ], "id int, reply string")
    rows = {r["id"]: tuple(r)[1:] for r in X.parse_scores(df).collect()}
    assert rows[1] == (82, "high", "r", "n")
    assert rows[2] == rows[3] == rows[4] == (50, "medium", "Parse error", "Follow up")
    assert rows[5] == (70, "medium", None, None)
    assert rows[6] == (None, "medium", "only", None)


def test_audit_actions(spark, t):
    lead_ids = [r["id"] for r in t.leads.orderBy("id").limit(4).collect()]
    a, b, c, d = lead_ids
    before = t.leads.where(F.col("id").isin(a, b, c))
    after = t.leads.where(F.col("id").isin(b, c, d)).withColumn(
        "lead_stage", F.when(F.col("id") == b, "potential").otherwise(F.col("lead_stage"))
    ).withColumn("campaign_name", F.when(F.col("id") == c, F.lit(None)).otherwise(F.lit("Z")))
    found = A.audit_rows(before, after.where(F.col("id") != -1), CLOCK, 1).collect()
    rows = {(int(r["entity_id"]), r["action"]): r for r in found}
    # b changed its stage and its campaign: one row for each
    assert set(rows) == {(a, "DELETE"), (b, "STAGE_CHANGE"), (b, "UPDATE"), (c, "UPDATE"), (d, "CREATE")}
    assert len({r["id"] for r in found}) == len(found)
    assert rows[b, "UPDATE"]["new_values"] == '{"campaign_name":"Z"}'
    assert '"lead_stage":"potential"' in rows[b, "STAGE_CHANGE"]["new_values"]
    assert rows[c, "UPDATE"]["new_values"] == '{"campaign_name":null}'
    assert rows[a, "DELETE"]["old_values"] == '{"id":%d}' % a and rows[a, "DELETE"]["new_values"] is None
    assert rows[d, "CREATE"]["old_values"] is None


def test_messages(spark, t):
    leads = t.leads.limit(2)
    sent = O.event_outbox(t, O.lead_created_events(leads), CLOCK, test=True)
    body = sent.select(F.from_json("body", "event string, test boolean, data struct<id: bigint, doctor_id: bigint>").alias("b")).select("b.*")
    assert {r["data"]["id"] for r in body.collect()} == {r["id"] for r in leads.collect()}
    assert all(r["test"] for r in body.collect())
    silent = O.event_outbox(t.replace(webhooks=t.webhooks.limit(0)), O.lead_created_events(leads), CLOCK)
    assert silent.count() == 0


def test_hooks_compare_event_names_as_their_key_does(spark):
    hooks = spark.createDataFrame([("Lead_Score_Changed ", "http://x")], "event_type string, url string")
    events = spark.createDataFrame([("lead_score_changed", "1", "{}")], "event_type string, entity_id string, data string")
    sent = O.route(events, hooks, F.to_timestamp(F.lit(CLOCK))).collect()
    assert [(r["event_type"], r["url"]) for r in sent] == [("lead_score_changed", "http://x")]


def test_set_values_are_checked_one_by_one(spark, t):
    doctor = t.doctors.select("id", "name", "speciality_id", "facility_id").first().asDict()
    rows = [(1, "opd,foo"), (2, "opd"), (3, "bar")]
    batch = spark.createDataFrame([{**doctor, "seq": s, "consult_type": c} for s, c in rows])
    from leadlake.operators.keyed import enum_rules

    (bad, _), *rest = enum_rules("doctors", batch)
    assert not rest and [r["seq"] for r in batch.where(bad).collect()] == [1, 3]


def test_status_filter_ignores_case(t):
    from leadlake.operators.listing import list_appointments

    assert list_appointments(t, status="No_Show").count() == list_appointments(t, status="no_show").count() > 0

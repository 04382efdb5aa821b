"""Write jobs on month folders: what they read and write, and that they come to the same tables."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from leadlake.functions.reliability import checkpointed, checkpoints_read
from leadlake.operators import dedupe as M
from leadlake.operators import writes as W
from leadlake.plans.inspect import plan_text
from leadlake.sources.batches import NEW_ID, load_batch
from leadlake.sources.fixtures import CLOCK, spark_schema
from leadlake.sources.partitioned import TOUCHES, PartitionedLake
from leadlake.sources.tables import BY_PHONE
from tests.conftest import SF_DIR

FACTS = ("patients", "leads", "interactions", "appointments", "revenue")


def ids(table, seq):
    return seq + F.lit(NEW_ID)


@pytest.fixture(scope="module")
def built(spark, t, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lake") / "built")
    PartitionedLake(spark, path, spark_schema, t).create(t, FACTS)
    return path


@pytest.fixture
def lake(spark, t, built, tmp_path):
    shutil.copytree(built, tmp_path / "lake")
    return PartitionedLake(spark, str(tmp_path / "lake"), spark_schema, t)


def files(lake, table):
    found = {}
    for folder, _, names in os.walk(lake.folder(table)):
        for n in names:
            if n.endswith(".parquet"):
                found[os.path.join(folder, n)] = os.stat(os.path.join(folder, n)).st_mtime_ns
    return found


def months_of(paths):
    return {p.split("month=")[1].split("/")[0] for p in paths}


def other(before, after):
    return [path for path, _ in set(before.items()) ^ set(after.items())]


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_layout_keeps_the_rows(lake, t):
    for table in FACTS:
        assert rows(lake.frame(table)) == rows(t[table].select(*lake.frame(table).columns))
    assert len(months_of(files(lake, "leads"))) > 50
    one = sorted(months_of(files(lake, "leads")))[3]
    assert "PartitionFilters: [" in plan_text(lake.frame("leads", [one])) and one in plan_text(lake.frame("leads", [one]))


def test_one_row_update_reads_and_writes_one_month(spark, lake, t):
    lead = lake.read("leads").where("lead_stage = 'interested'").first()
    before = {table: files(lake, table) for table in FACTS}
    batch = spark.createDataFrame([(lead["id"], 1, {"campaign_name": "Spring"})], "id bigint, seq bigint, fields map<string,string>")
    change = lake.prepare(W.update_leads, batch, CLOCK)
    assert change.months == {"leads": [lead["month"]]}
    read = lake.tables(change.months).leads
    assert lead["month"] in plan_text(read) and "PartitionFilters: [isnotnull(month" in plan_text(read)
    done = lake.write(change)
    after = {table: files(lake, table) for table in FACTS}
    assert {table for table in FACTS if after[table] != before[table]} == {"leads"}
    assert months_of(other(before["leads"], after["leads"])) == {lead["month"]}
    want = W.update_leads(t, batch, CLOCK).tables.leads
    assert rows(done.tables.leads) == rows(want.select(*done.tables.leads.columns))
    again = lake.write(change)  # finishing a broken-off change changes nothing
    assert rows(again.tables.leads) == rows(want.select(*done.tables.leads.columns))


def test_unknown_ids_write_nothing(spark, lake):
    before = files(lake, "leads")
    batch = spark.createDataFrame([(-5, 1, "interested", "")], "id bigint, seq bigint, stage string, substage string")
    done = lake.run(W.change_stage, batch, CLOCK)
    assert [r["reason"] for r in done.rejects.collect()] == ["unknown lead"] and files(lake, "leads") == before


def test_appended_rows_get_files_of_their_own(spark, lake, t):
    lead = t.leads.select("id").first()["id"]
    before = {table: files(lake, table) for table in FACTS}
    batch = spark.createDataFrame([(1, lead, "No answer")], "seq bigint, lead_id bigint, outcome string").withColumns(
        {"interaction_type": F.lit("call"), "followup_date": F.lit(None).cast("date"), "agent_id": F.lit(None).cast("bigint")})
    change = lake.prepare(W.ingest_interactions, batch, CLOCK, make_id=ids)
    for _ in range(2):  # repeated, the row is there once
        lake.write(change)
        now = files(lake, "interactions")
        assert set(before["interactions"].items()) < set(now.items()) and len(now) == len(before["interactions"]) + 1
    assert lake.frame("interactions").count() == t.interactions.count() + 1
    assert len(months_of(other(files(lake, "leads"), before["leads"]))) == 1


def test_a_month_without_rows_left_goes(spark, lake):
    month = lake.read("interactions").select("month").first()["month"]
    gone = lake.read("interactions").where(F.col("month") == month).select("id")
    n, left = lake.frame("interactions").count(), gone.count()
    lake.run(W.delete_interactions, gone)
    assert month not in months_of(files(lake, "interactions")) and lake.frame("interactions").count() == n - left


def test_jobs_come_to_the_same_tables(spark, lake, t):
    """One after the other on the same lake, and on frames."""
    jobs = [
        (W.ingest_leads, "lead_intake", (CLOCK, ids)), (W.set_visit_status, "visit_changes", (CLOCK,)),
        (W.book_appointments, "bookings", (CLOCK, ids)), (M.merge_patients, "merge_requests", ()),
        (W.delete_leads, "lead_deletes", ()), (W.delete_patients, "patient_deletes", ()),
    ]
    plain = t
    for job, name, args in jobs:
        batch = load_batch(spark, SF_DIR, t, name)
        plain = job(plain, batch, *args).tables
        done = lake.run(job, batch, *args)
        for table in done.changed + tuple(done.appended):
            plain = plain.replace(**{table: plain[table].select(*lake.frame(table).columns).checkpoint()})
            assert rows(lake.frame(table)) == rows(plain[table]), (job.__name__, table)


def kept_checkpoints(spark):
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return {name for name in os.listdir(folder) if name.startswith("rdd-")}


def visits_of_a_week(spark, t):
    visits = t.appointments.where("appointment_date between '1995-03-05' and '1995-03-11'").select("id")
    return checkpointed(load_batch(spark, SF_DIR, t, "visit_changes").join(visits, "id", "left_semi"))


def test_a_job_leaves_only_what_its_outcome_reads(spark, lake, t):
    batch = visits_of_a_week(spark, t)
    assert batch.count() > 5
    before = kept_checkpoints(spark)
    done = lake.run(W.set_visit_status, batch, CLOCK)
    read = {os.path.basename(f) for f in checkpoints_read([done.rejects, done.accepted])}
    assert kept_checkpoints(spark) - before == read and len(read) == 2
    assert sorted(os.listdir(lake.path)) == sorted(FACTS)
    want = W.set_visit_status(t, batch, CLOCK)
    assert rows(done.rejects) == rows(want.rejects) and rows(done.accepted) == rows(want.accepted)


def test_changed_months_are_kept_once_until_they_are_moved(spark, lake, t):
    batch = visits_of_a_week(spark, t)
    assert batch.count() > 5
    before, old = kept_checkpoints(spark), {table: files(lake, table) for table in FACTS}
    change = lake.prepare(W.set_visit_status, batch, CLOCK)
    assert len(kept_checkpoints(spark) - before) == 2  # refused and judged rows, none of the tables
    assert {table: files(lake, table) for table in FACTS} == old
    want = W.set_visit_status(t, batch, CLOCK).tables
    for table in ("appointments", "leads"):
        shown = rows(change.outcome.tables[table])
        assert shown and set(shown) <= set(rows(want[table].select(*lake.frame(table).columns)))
    lake.write(change)
    for table in ("appointments", "leads"):
        assert rows(lake.frame(table)) == rows(want[table].select(*lake.frame(table).columns))


def test_a_change_broken_off_inside_a_table_is_finished(spark, lake, t):
    gone = t.interactions.where("interaction_type = 'email' or interaction_date < '2024-01-10'").select("id")
    before = files(lake, "interactions")
    change = lake.prepare(W.delete_interactions, gone)
    staged = os.path.join(change.staged, "interactions")
    first = sorted(name for name in os.listdir(staged) if name.startswith("month="))[0]
    shutil.rmtree(os.path.join(lake.folder("interactions"), first))  # what a broken-off move leaves
    os.rename(os.path.join(staged, first), os.path.join(lake.folder("interactions"), first))
    lake.write(change)
    left = rows(t.interactions.join(gone, "id", "left_anti").select(*lake.frame("interactions").columns))
    assert rows(lake.frame("interactions")) == left and files(lake, "interactions") != before
    after = files(lake, "interactions")
    lake.write(change)
    assert files(lake, "interactions") == after


def test_a_failing_job_leaves_no_staged_months(spark, lake, monkeypatch):
    monkeypatch.setattr(lake, "read", None)
    with pytest.raises(TypeError):
        lake.prepare(W.change_stage, spark.createDataFrame([(5, 1, "interested", "")], "id bigint, seq bigint, stage string, substage string"), CLOCK)
    assert sorted(os.listdir(lake.path)) == sorted(FACTS)


def test_intake_looks_phones_up(spark, lake, t):
    known = t.patients.first()
    assert "patients_by_phone" == BY_PHONE and BY_PHONE in lake.tables()
    batch = spark.createDataFrame([(1, "New", known["primary_phone"] + "  "), (2, "Other", "٣٤"), (3, "Third", "abc")], "seq bigint, full_name string, primary_phone string")
    done = lake.run(W.create_patients, batch, CLOCK, make_id=ids)
    assert {r["seq"]: r["reason"] for r in done.rejects.collect()} == {1: "phone is taken"}
    again = spark.createDataFrame([(4, "Again", "34"), (5, "Again", "ABC "), (6, "Free", "123 99")], "seq bigint, full_name string, primary_phone string")
    done = lake.run(W.create_patients, again, CLOCK, make_id=ids)
    assert 5 in {r["seq"] for r in done.rejects.collect()} and 6 not in {r["seq"] for r in done.rejects.collect()}


def test_every_touching_job_is_listed():
    jobs = {f for f in TOUCHES if hasattr(W, f) or f == "merge_patients"}
    assert jobs == set(TOUCHES)


def scans(text, marks):
    """(path mark, whether it lies below an exchange of rows) of every scan of a table."""
    found, path = [], []
    for line in text.splitlines():
        depth = len(line) - len(line.lstrip(" :+-|*()0123456789"))
        path = [p for p in path if p[0] < depth] + [(depth, line)]
        mark = next((m for m in marks if "Scan parquet" in line and m in line), None)
        if mark:
            found.append((mark, any("Exchange hashpartitioning" in p or "Exchange rangepartitioning" in p for _, p in path)))
    return found


@pytest.mark.parametrize("name, table, batch", [
    ("change_stage", "leads", "select {lead} as id, 1L as seq, 'interested' as stage, '' as substage"),
    ("update_leads", "leads", "select {lead} as id, 1L as seq, map('campaign_name', 'x') as fields"),
    ("ingest_interactions", "leads", "select 1L as seq, {lead} as lead_id, 'busy' as outcome, 'call' as interaction_type, cast(null as date) as followup_date, cast(null as bigint) as agent_id"),
    ("set_visit_status", "appointments", "select {visit} as id, 1L as seq, 'visited' as visit_status, '' as notes"),
    ("delete_leads", "leads", "select {lead} as id"),
    ("delete_patients", "leads", "select {patient} as id"),
])
def test_one_row_batches_shuffle_no_table(spark, lake, t, name, table, batch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        stored = lake.tables()
        lead = t.leads.select("id", "patient_id").first()
        visit = t.appointments.select("id").first()["id"]
        frame = spark.sql(batch.format(lead=f"{lead['id']}L", patient=f"{lead['patient_id']}L", visit=f"{visit}L"))
        args = () if name.startswith("delete") else (CLOCK,)
        more = {"make_id": ids} if name.startswith("ingest") else {}
        done = getattr(W, name)(stored, frame, *args, **more)
        for changed in done.changed:
            text = done.tables[changed]._jdf.queryExecution().executedPlan().toString()
            seen = scans(text, [f"/{x}]" for x in FACTS])
            assert (f"/{changed}]", False) in seen and not any(below for _, below in seen), text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.maxMetadataStringLength")

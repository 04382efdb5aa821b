import pytest
from pyspark.sql import functions as F

from leadlake.operators import stage_engine as G
from leadlake.operators import writes as W
from leadlake.sources.batches import load_batch
from leadlake.sources.fixtures import CLOCK
from leadlake.sources.tables import commit_snapshot, committed_versions, load_tables
from leadlake.streaming import jobs as R
from tests.conftest import SF_DIR


def files_in_order(df, seq, folder, n):
    """``n`` files, each a later stretch of the sequence."""
    rows = df.orderBy(seq).collect()
    size = len(rows) // n + 1
    for i in range(n):
        df.sparkSession.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(folder)


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def states(df):
    return sorted(map(tuple, df.select("id", *G.STATE).collect()))


def test_any_split_into_batches_gives_the_batch_result(spark, t, tmp_path):
    log = G.log_events(load_batch(spark, SF_DIR, t, "event_log")).persist()
    want = states(G.advance(t.leads.select("id", *G.STATE), log))
    for n in (1, 5):
        home = str(tmp_path / f"n{n}")
        files_in_order(log, "seq", f"{home}/in", n)
        events = R.read_stream(spark, f"{home}/in", log.schema, files_per_trigger=1)
        run(R.stage_stream(events, f"{home}/cp", numbers=10_000 if n > 1 else R.SLICE_NUMBERS))
        assert states(R.lead_state(spark, t.leads, f"{home}/cp")) == want
    log.unpersist()


def test_restart_goes_on_and_counts_each_event_once(spark, t, tmp_path):
    home = str(tmp_path)
    log = G.log_events(load_batch(spark, SF_DIR, t, "event_log"))
    rows = log.orderBy("seq").collect()
    half = len(rows) // 2

    def add(part):
        spark.createDataFrame(part, log.schema).coalesce(1).write.mode("append").parquet(f"{home}/in")

    def start():
        events = R.read_stream(spark, f"{home}/in", log.schema, files_per_trigger=1)
        run(R.stage_stream(events, f"{home}/cp"))

    with pytest.raises(FileNotFoundError):
        R.lead_state(spark, t.leads, f"{home}/cp")
    add(rows[:half])
    start()
    part = spark.createDataFrame(rows[:half], log.schema)
    assert states(R.lead_state(spark, t.leads, f"{home}/cp")) == states(G.advance(t.leads.select("id", *G.STATE), part))
    add(rows[half:])
    start()
    # the last micro-batch was not finished: it is repeated from the state before it
    newest = max((tmp_path / "cp" / "commits").iterdir(), key=lambda p: (p.name.isdigit(), p.name))
    newest.unlink()
    (tmp_path / "cp" / "commits" / f".{newest.name}.crc").unlink(missing_ok=True)
    start()
    want = states(G.advance(t.leads.select("id", *G.STATE), log))
    assert states(R.lead_state(spark, t.leads, f"{home}/cp")) == want


def test_stage_stream_reads_no_leads_and_tells_what_moved(spark, t, tmp_path):
    home, told = str(tmp_path), []
    log = G.log_events(load_batch(spark, SF_DIR, t, "event_log")).where("lead_id < 300")
    files_in_order(log, "seq", f"{home}/in", 2)
    events = R.read_stream(spark, f"{home}/in", log.schema, files_per_trigger=1)
    run(R.stage_stream(events, f"{home}/cp", sink=lambda df, n: told.append((n, df.count()))))
    assert [n for n, _ in told] == [0, 1] and all(rows > 0 for _, rows in told)
    assert "stage_facts" in R.__all__ and R.streamed_facts(spark, f"{home}/cp").count() == log.select("lead_id").distinct().count()


def test_upserts_commit_one_version_per_batch(spark, t, tmp_path):
    lake, home = str(tmp_path / "lake"), str(tmp_path)
    commit_snapshot(spark, lake, 7, t, ["ad_spend", "webhooks", "system_settings"])
    batch = load_batch(spark, SF_DIR, t, "spends")
    files_in_order(batch, "seq", f"{home}/in", 3)
    start = lambda: R.upsert_stream(
        R.read_stream(spark, f"{home}/in", batch.schema, 1), lake, R.spend_job(CLOCK), ("ad_spend",), f"{home}/cp")
    run(start())
    assert committed_versions(spark, lake) == [7, 8, 9, 10]
    run(start())
    assert committed_versions(spark, lake) == [7, 8, 9, 10]
    want = W.upsert_ad_spend(t, batch, CLOCK).tables.ad_spend
    cols = ["channel", "month", "monthly_spend"]
    got = load_tables(spark, lake).ad_spend
    assert sorted((c.lower(), m, s) for c, m, s in map(tuple, got.select(*cols).collect())) == sorted(
        (c.lower(), m, s) for c, m, s in map(tuple, want.select(*cols).collect()))


def test_hook_and_setting_streams(spark, t, tmp_path):
    lake, home = str(tmp_path / "lake"), str(tmp_path)
    commit_snapshot(spark, lake, 0, t, ["webhooks", "system_settings"])
    for name, job, table in (("hook_forms", R.webhook_job(CLOCK, 1), "webhooks"), ("setting_forms", R.settings_job(CLOCK), "system_settings")):
        batch = load_batch(spark, SF_DIR, t, name)
        files_in_order(batch, "seq", f"{home}/{name}", 1)
        run(R.upsert_stream(R.read_stream(spark, f"{home}/{name}", batch.schema), lake, job, (table,), f"{home}/cp_{name}"))
        assert load_tables(spark, lake)[table].count() == job(t, batch).tables[table].count()


def test_outbox_and_audit_append(spark, t, tmp_path):
    home = str(tmp_path)
    log = t.audit_logs.drop("id").withColumnRenamed("created_at", "occurred_at")
    log.write.parquet(f"{home}/in")
    stream = R.read_stream(spark, f"{home}/in", log.schema)
    run(R.append_files(R.audit_stream(stream), f"{home}/audit", f"{home}/cp1"))
    assert spark.read.parquet(f"{home}/audit").count() == log.count()
    events = R.read_stream(spark, f"{home}/in", log.schema).select(
        F.lit("lead_created").alias("event_type"), "entity_id", F.col("new_values").alias("data"), "occurred_at")
    run(R.append_files(R.outbox_stream(events, t.webhooks), f"{home}/out", f"{home}/cp2"))
    assert spark.read.parquet(f"{home}/out").count() == log.count()

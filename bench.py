"""Headline timings: ``BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

The CRM tables are first written as a lake (timed as ``build_lake``); every query then
reads the lake and writes its whole result to the ``noop`` sink. Each query runs
once to warm up and then ``BENCH_RUNS`` times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from leadlake.operators import dashboards as D
from leadlake.operators import dedupe as M
from leadlake.operators import listing as L
from leadlake.operators import profiles as P
from leadlake.operators import stage_engine as G
from leadlake.operators import views as V
from leadlake.operators import writes as W
from leadlake.plans.bundles import dashboard, run_frames, shared_cubes
from leadlake.sources.batches import NEW_ID, load_batch
from leadlake.sources.fixtures import CLOCK, load_fixture, spark_schema
from leadlake.sources.tables import Tables, finish, stored
from leadlake.schema import TABLES
from leadlake.streaming.jobs import lead_state, read_stream, stage_stream


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def build_lake(spark: SparkSession, sf_dir: str, home: str) -> Tables:
    """Write the tables once, with the fixtures' id types."""
    t = load_fixture(spark, sf_dir)
    out = {}
    for name in TABLES:
        wide = t[name]
        ids = spark_schema(name)
        flat = stored(wide, name)
        flat = flat.select(*[flat[f.name].cast(f.dataType).alias(f.name) for f in ids])
        flat.write.parquet(f"{home}/{name}")
        out[name] = finish(spark.read.schema(ids).parquet(f"{home}/{name}"), name)
    return Tables(out)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    home = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("leadlake-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", f"{home}/checkpoints")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    start = time.time()
    t = build_lake(spark, sf_dir, f"{home}/lake")
    built = time.time() - start

    log = load_batch(spark, sf_dir, t, "event_log")
    log.write.parquet(f"{home}/log")
    log = spark.read.parquet(f"{home}/log")
    intake = load_batch(spark, sf_dir, t, "lead_intake")
    merges = load_batch(spark, sf_dir, t, "merge_requests")

    def ids(table, seq):
        return seq + NEW_ID

    def bundle(name: str) -> None:
        with shared_cubes(t, name, CLOCK) as ready:
            run_frames(dashboard(ready, name, CLOCK), lambda _, df: consume(df))

    def write_all(done) -> None:
        for name in ("patients", "leads", "appointments", "revenue"):
            consume(done.tables[name])

    streams = iter(range(10_000))

    def stream() -> None:
        events = G.log_events(read_stream(spark, f"{home}/log", log.schema))
        checkpoint = f"{home}/cp{next(streams)}"
        stage_stream(events, checkpoint).awaitTermination()
        consume(lead_state(spark, t.leads, checkpoint))

    def intake_job() -> None:
        done = W.ingest_leads(t, intake, CLOCK, ids)
        consume(done.tables.patients)
        consume(done.tables.leads)

    work = {
        "channel_conversion": lambda: consume(D.channel_conversion(t)),
        "leads_full": lambda: consume(V.leads_full(t)),
        "revenue_summary": lambda: consume(V.revenue_summary(t)),
        "summary_bundle": lambda: bundle("summary"),
        "marketing_bundle": lambda: bundle("marketing"),
        "cxo_bundle": lambda: bundle("cxo"),
        "finance_bundle": lambda: bundle("finance"),
        "lead_page": lambda: consume(L.lead_page(t, 3, 50, "stage")),
        "list_appointments": lambda: consume(L.list_appointments(t)),
        "audit_trail": lambda: consume(L.audit_trail(t)),
        "lead_360": lambda: consume(P.lead_360(t)),
        "duplicate_groups": lambda: consume(M.duplicate_groups(t)),
        "merge_patients": lambda: write_all(M.merge_patients(t, merges)),
        "apply_interactions": lambda: consume(G.apply_interactions(t)),
        "apply_events": lambda: consume(G.apply_events(t, log)),
        "ingest_leads": intake_job,
        "stage_stream": stream,
    }
    timings = {"build_lake": round(built, 3)}
    for name, job in work.items():
        job()
        taken = []
        for _ in range(runs):
            begin = time.time()
            job()
            taken.append(time.time() - begin)
        timings[name] = round(statistics.median(taken), 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":

    main()

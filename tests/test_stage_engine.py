"""The closed form against an ordered fold."""

import random

import pytest
from pyspark.sql import functions as F

from leadlake.operators import stage_engine as G
from leadlake.schema import LEAD_STAGES
from leadlake.sources.batches import load_batch
from tests.conftest import SF_DIR

OUTCOMES = ["No Answer", "Line BUSY now", "Interested", "Phone switched off", "Call later", "no response yet"]
KINDS = ["call", "whatsapp", "sms", "visit", "email", "note", None, ""]


def fold(state, events):
    """One event after the other."""
    stage, sub, count, due = state
    for e in sorted(events, key=lambda e: e["seq"]):
        kind = e["kind"]
        if kind == "booking":
            stage, sub = G.BOOKED
        elif kind == "visit":
            stage, sub = G.VISITED
        elif kind == "revenue":
            stage, sub = G.BILLED
        elif kind == "manual":
            stage, sub = e["stage"], e["substage"] or e["stage"]
        else:
            due = e["followup_date"] or due
            if (e["interaction_type"] or "call") in G.CONTACT_TYPES:
                count += 1
                missed = any(p in e["outcome"].lower() for p in G.NO_RESPONSE_PHRASES)
                if missed and count >= 3 and stage in G.OPEN_STAGES:
                    stage, sub = "unanswered", G.STALE_SUBSTAGE
                elif stage == "untouched":
                    stage, sub = "attempted", G.ATTEMPT_SUBSTAGE % count
                elif stage == "attempted" and count < 3:
                    sub = G.ATTEMPT_SUBSTAGE % count
    return stage, sub, count, due


def random_log(rng, leads, sizes):
    log, seq = [], list(range(1, sum(sizes) + 1))
    rng.shuffle(seq)
    at = 0
    for lead, size in zip(leads, sizes):
        for _ in range(size):
            kind = rng.choices(["interaction", "booking", "visit", "revenue", "manual"], [8, 1, 1, 1, 2])[0]
            log.append({
                "lead_id": lead, "seq": seq[at], "kind": kind,
                "interaction_type": rng.choice(KINDS), "outcome": rng.choice(OUTCOMES),
                "followup_date": rng.choice([None, None, f"2001-09-{rng.randint(10, 28)}"]),
                "stage": rng.choice(LEAD_STAGES), "substage": rng.choice([None, "", "By hand"]),
            })
            at += 1
    return log


SCHEMA = ("lead_id bigint, seq bigint, kind string, interaction_type string, outcome string,"
          " followup_date string, stage string, substage string")


def check(spark, log, starts, rows):
    frame = spark.createDataFrame([tuple(e.values()) for e in log], SCHEMA).withColumn(
        "followup_date", F.col("followup_date").cast("date"))
    leads = spark.createDataFrame(
        [(i, *s) for i, s in starts.items()],
        "id bigint, lead_stage string, lead_substage string, attempt_count int, followup_date string",
    ).withColumn("followup_date", F.col("followup_date").cast("date"))
    got = {
        r["id"]: (r["lead_stage"], r["lead_substage"], r["attempt_count"], r["followup_date"] and str(r["followup_date"]))
        for r in G.advance(leads, G.log_events(frame), rows=rows).collect()
    }
    by_lead = {}
    for e in log:
        by_lead.setdefault(e["lead_id"], []).append(e)
    want = {i: fold(s, by_lead.get(i, [])) for i, s in starts.items()}
    assert got == want


def test_closed_form_equals_fold_on_random_logs(spark):
    rng = random.Random(5)
    ids = list(range(400))
    starts = {i: (rng.choice(LEAD_STAGES), "Start", rng.randint(0, 4), rng.choice([None, "2001-09-01"])) for i in ids}
    log = random_log(rng, ids, [rng.randint(0, 14) for _ in ids])
    for rows in (3, 50, 1_000_000, None):
        check(spark, log, starts, rows)


def test_one_lead_with_most_of_the_events(spark):
    rng = random.Random(9)
    ids = [1, 2, 3]
    starts = {i: ("untouched", "Fresh Lead", 0, None) for i in ids}
    check(spark, random_log(rng, ids, [3000, 5, 0]), starts, 100)


def test_interactions_alone(spark):
    rng = random.Random(11)
    ids = list(range(300))
    starts = {i: (rng.choice(G.OPEN_STAGES), "Start", rng.randint(0, 3), None) for i in ids}
    log = [e for e in random_log(rng, ids, [rng.randint(0, 8) for _ in ids]) if e["kind"] == "interaction"]
    check(spark, log, starts, 20)


def test_native_fold_twin(spark, t):
    """The same rules as an ordered aggregate over collected events, in Spark itself."""
    log = load_batch(spark, SF_DIR, t, "event_log")
    state = G.apply_events(t, log)
    rows = {}
    for e in log.collect():
        rows.setdefault(e["lead_id"], []).append(e.asDict())
    starts = {r["id"]: (r["lead_stage"], r["lead_substage"], r["attempt_count"], r["followup_date"])
              for r in t.leads.select("id", *G.STATE).collect()}
    got = {r["id"]: tuple(r[c] for c in G.STATE) for r in state.collect()}
    assert got == {i: fold(s, rows.get(i, [])) for i, s in starts.items()}


def test_attempt_numbers_do_not_depend_on_the_slices(t):
    small = sorted(map(tuple, G.attempt_numbers(t, rows=7).collect()))
    assert small == sorted(map(tuple, G.attempt_numbers(t).collect()))


def test_stored_tables_with_hashed_ids(spark, t, tmp_path):
    """The engine goes by the stored order of arrival, whatever the ids look like."""
    from pyspark.sql import functions as F

    from leadlake.sources.tables import commit_snapshot, load_tables

    named = lambda c: F.md5(F.col(c).cast("string"))
    hashed = t.replace(
        leads=t.leads.withColumn("id", named("id")),
        interactions=t.interactions.withColumns({"id": named("id"), "lead_id": named("lead_id")}),
    )
    commit_snapshot(spark, str(tmp_path), 0, hashed, ["leads", "interactions"])
    stored = load_tables(spark, str(tmp_path))
    for job, key in ((G.latest_followup, "id"), (G.apply_interactions, "id"), (G.attempt_numbers, "id")):
        plain, got = job(t), job(stored)
        for c in {"id", "lead_id"} & set(plain.columns):
            plain = plain.withColumn(c, named(c))
        assert sorted(map(str, plain.collect())) == sorted(map(str, got.collect())), job.__name__


@pytest.mark.parametrize("far", [0, 17 * 10**14])
def test_slices_are_even_whatever_the_numbers(spark, far):
    """Also with dense numbers and one, or half of them, far away."""
    from leadlake.functions.numbering import cut_points, running_number, slice_of

    every = F.when(F.col("id") % 2 == 0, F.col("id") * 1_500_000).otherwise(F.col("id"))
    for s in (F.col("id") * 1_500_000, F.when(F.col("id") == 7, F.lit(far)).otherwise(F.col("id") + 10), every + far):
        df = spark.range(30_000).select(s.alias("s"), (F.col("id") % 3).alias("k"))
        cuts = cut_points(df, "s", 1000)
        sizes = [r["count"] for r in df.groupBy(slice_of("s", cuts).alias("x")).count().collect()]
        assert 25 <= len(sizes) <= 30 and max(sizes) <= 2 * 1000
        assert sorted(r["n"] for r in running_number(df, "s", rows=1000).collect()) == list(range(1, 30_001))
    assert cut_points(df, "s") == [] and cut_points(df.limit(0), "s", 5) == []


def test_given_ids_must_be_new(spark, t):
    from leadlake.operators import writes as W

    lead = t.leads.select("id").first()["id"]
    batch = spark.createDataFrame([(1, 5, lead), (2, 10**9, lead), (3, 10**9, lead), (4, None, lead)], "seq long, id long, lead_id long")
    from pyspark.sql import functions as F

    batch = batch.withColumns({"outcome": F.lit("ok"), "interaction_type": F.lit("call"), "followup_date": F.lit(None).cast("date"), "agent_id": F.lit(None).cast("long")})
    done = W.ingest_interactions(t, batch, "2001-08-01 00:00:00", make_id=lambda _, seq: seq + 10**10)
    assert sorted((r["seq"], r["reason"]) for r in done.rejects.collect()) == [(1, "id is taken"), (3, "id is taken")]

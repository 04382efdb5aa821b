"""Lead stages from events.

Rules per lead, in event order. A contact attempt (call, whatsapp, sms) raises the
attempt number n; with a no-response outcome and n >= 3 an open lead becomes
unanswered, otherwise an untouched lead becomes attempted, and an attempted lead
with n < 3 shows its attempt number. Bookings, visits, bills and manual changes set
stage and substage outright.

No ordered fold is needed. The final state depends on five facts of a lead's log:
its number of attempts, the last outright change, the number of attempts up to that
change, the number of attempts up to the last no-response, and the last follow-up
date. Each comes from sums and maxima, first per (lead, sequence slice) and then per
lead, so that even a lead with a third of all events is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlake.functions import semantics as S
from leadlake.functions.numbering import cut_points, running_number, slice_of
from leadlake.functions.reliability import small_side
from leadlake.sources.tables import Tables

# --- fixed values: event vocabulary and stage texts ---
CONTACT_TYPES = ("call", "whatsapp", "sms")
NO_RESPONSE_PHRASES = ("no answer", "no response", "not reachable", "busy", "switched off")
OPEN_STAGES = ("untouched", "attempted", "unanswered")
ATTEMPT_LIMIT = 3
STALE_SUBSTAGE = "Stale – No Response After 3 Attempts"
ATTEMPT_SUBSTAGE = "Attempt %d – Follow-up Scheduled"
BOOKED = ("customer", "Super Hot – Booked")
VISITED = ("customer", "Visited")
BILLED = ("customer", "Revenue Captured")
# --- end of fixed values ---

STATE = ("lead_stage", "lead_substage", "attempt_count", "followup_date")


def classify(df: DataFrame) -> DataFrame:
    """Add ``is_attempt`` and ``is_no_response`` to interactions."""
    outcome = F.lower(F.col("outcome"))
    missed = F.lit(False)
    for phrase in NO_RESPONSE_PHRASES:
        missed = missed | F.contains(outcome, F.lit(phrase))
    kind = F.coalesce(S.blank_to_null("interaction_type"), F.lit("call"))
    return df.withColumn("is_attempt", kind.isin(*CONTACT_TYPES)).withColumn(
        "is_no_response", F.coalesce(missed, F.lit(False))
    )


def attempt_numbers(t: Tables, seq: str = "seq", rows: int | None = None) -> DataFrame:
    """Each contact attempt with its number on the lead, counting on from ``attempt_count``."""
    attempts = classify(t.interactions).where("is_attempt")
    cols = dict.fromkeys(["lead_id", "id", seq])
    numbered = running_number(attempts.select(*cols, "is_no_response"), seq, ["lead_id"], "_n", rows)
    start = t.leads.select(F.col("id").alias("lead_id"), "attempt_count")
    return numbered.join(start, "lead_id").select(
        "id", "lead_id", "is_no_response",
        (F.coalesce("attempt_count", F.lit(0)) + F.col("_n")).cast("bigint").alias("attempt_no"),
    )


def interaction_events(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Interactions as events of the log."""
    return classify(df).select(
        "lead_id", F.col(seq).cast("bigint").alias("seq"),
        F.col("is_attempt").cast("int").alias("attempt"),
        (F.col("is_attempt") & F.col("is_no_response")).alias("missed"),
        "followup_date",
        F.lit(None).cast("struct<stage:string,substage:string>").alias("change"),
    )


def change_events(df: DataFrame, stage: Column, substage: Column, seq: str = "seq") -> DataFrame:
    """Outright stage changes (booking, visit, bill, manual) as events of the log."""
    return df.select(
        "lead_id", F.col(seq).cast("bigint").alias("seq"), F.lit(0).alias("attempt"),
        F.lit(False).alias("missed"), F.lit(None).cast("date").alias("followup_date"),
        F.struct(stage.alias("stage"), substage.alias("substage")).alias("change"),
    )


def log_events(log: DataFrame) -> DataFrame:
    """A mixed log (kind, seq, lead_id, interaction columns, stage, substage) as events.

    ``kind`` is interaction, booking, visit, revenue or manual.
    """
    kind = F.col("kind")
    fixed = {"booking": BOOKED, "visit": VISITED, "revenue": BILLED}
    stage, substage = F.col("stage"), F.coalesce(S.blank_to_null("substage"), F.col("stage"))
    for name, (s, sub) in fixed.items():
        stage = F.when(kind == name, F.lit(s)).otherwise(stage)
        substage = F.when(kind == name, F.lit(sub)).otherwise(substage)
    talk = kind == "interaction"
    return classify(log).select(
        "lead_id", F.col("seq").cast("bigint").alias("seq"),
        F.when(talk & F.col("is_attempt"), 1).otherwise(0).alias("attempt"),
        (talk & F.col("is_attempt") & F.col("is_no_response")).alias("missed"),
        F.when(talk, F.col("followup_date")).alias("followup_date"),
        F.when(~talk, F.struct(stage.alias("stage"), substage.alias("substage"))).alias("change"),
    )


def summarise(events: DataFrame, rows: int | None = None) -> DataFrame:
    """The five facts per lead: attempts, change, attempts_at_change, attempts_at_miss, followup.

    ``rows`` is the number of events a slice of the sequence shall hold.
    """
    cuts = cut_points(events, "seq", rows)
    # never by lead alone, however the events arrive, unless they are one slice
    dealt = ["lead_id", "_slice"] if cuts else ["lead_id"]
    seq = F.col("seq")
    run = Window.partitionBy("lead_id", "_slice").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    changed, promised = F.col("change").isNotNull(), F.col("followup_date").isNotNull()
    slices = (
        events.where((F.col("attempt") == 1) | changed | promised)
        .withColumn("_slice", slice_of("seq", cuts))
        .repartition(*dealt)
        .withColumn("_run", F.sum("attempt").over(run))
        .groupBy("lead_id", "_slice")
        .agg(
            F.sum("attempt").alias("_attempts"),
            F.max_by("change", F.when(changed, seq)).alias("_change"),
            F.max(F.when(changed, F.col("_run"))).alias("_at_change"),
            F.max(F.when(F.col("missed"), F.col("_run"))).alias("_at_miss"),
            F.max_by("followup_date", F.when(promised, seq)).alias("_followup"),
        )
    )
    return joined_slices(slices)


def joined_slices(slices: DataFrame) -> DataFrame:
    """The facts of leads from those of their slices (attempts counted inside a slice)."""
    earlier = Window.partitionBy("lead_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("_attempts").over(earlier), F.lit(0))
    return (
        slices.withColumn("_base", base)
        .groupBy("lead_id")
        .agg(
            F.sum("_attempts").alias("attempts"),
            F.max_by("_change", F.when(F.col("_change").isNotNull(), F.col("_slice"))).alias("change"),
            F.coalesce(F.max(F.col("_base") + F.col("_at_change")), F.lit(0)).alias("attempts_at_change"),
            F.coalesce(F.max(F.col("_base") + F.col("_at_miss")), F.lit(0)).alias("attempts_at_miss"),
            F.max_by("_followup", F.when(F.col("_followup").isNotNull(), F.col("_slice"))).alias("followup"),
        )
    )


def new_state(
    stage: Column, substage: Column, count: Column, attempts: Column, change: Column, at_change: Column,
    at_miss: Column,
) -> tuple[Column, Column, Column]:
    """Final stage, substage and attempt count from the start state and the log's facts."""
    s0 = F.coalesce(change["stage"], stage)
    sub0 = F.coalesce(change["substage"], substage)
    first, last = count + at_change + 1, count + attempts
    tried = attempts > at_change
    stale = s0.isin(*OPEN_STAGES) & (at_miss > at_change) & (count + at_miss >= ATTEMPT_LIMIT)
    shown = (
        F.when(tried & (s0 == "untouched") & (first >= ATTEMPT_LIMIT), first)
        .when(tried & s0.isin("untouched", "attempted") & (first < ATTEMPT_LIMIT),
              F.least(last, F.lit(ATTEMPT_LIMIT - 1)))
    )
    return (
        F.when(stale, F.lit("unanswered")).when(tried & (s0 == "untouched"), F.lit("attempted")).otherwise(s0),
        F.when(stale, F.lit(STALE_SUBSTAGE))
        .when(shown.isNotNull(), F.format_string(ATTEMPT_SUBSTAGE, shown.cast("bigint")))
        .otherwise(sub0),
        last.cast("int"),
    )


def advance(leads: DataFrame, events: DataFrame, as_of=None, rows: int | None = None, batch: bool = False) -> DataFrame:
    """Leads after the events; all other columns and leads without events stay as they are.

    With ``batch`` the events are those of one batch: what they come to is broadcast while
    it is few rows, so that the leads are not shuffled.
    """
    facts = summarise(events, rows)
    return with_facts(leads, small_side(facts) if batch else facts, as_of)


def with_facts(leads: DataFrame, facts: DataFrame, as_of=None) -> DataFrame:
    """Leads after a log that comes to ``facts`` (see :func:`summarise`)."""
    facts = facts.withColumnRenamed("lead_id", "id")
    zero = F.lit(0)
    stage, substage, count = new_state(
        F.col("lead_stage"), F.col("lead_substage"), F.coalesce("attempt_count", zero),
        F.coalesce("attempts", zero), F.col("change"), F.coalesce("attempts_at_change", zero),
        F.coalesce("attempts_at_miss", zero),
    )
    after = leads.join(facts, "id", "left").select(
        *leads.columns,
        F.struct(
            stage.alias("lead_stage"), substage.alias("lead_substage"), count.alias("attempt_count"),
            F.coalesce("followup", "followup_date").alias("followup_date"),
        ).alias("_after"),
    )
    changed = F.lit(False)
    for c in STATE:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_after.{c}"))
    new = {c: F.col(f"_after.{c}") for c in STATE}
    if as_of is not None and "updated_at" in leads.columns:
        new["updated_at"] = F.when(changed, S.moment(as_of)).otherwise(F.col("updated_at"))
    return after.withColumns(new).select(*leads.columns)


def apply_interactions(t: Tables, seq: str = "seq", rows: int | None = None) -> DataFrame:
    """State of every lead after its interactions."""
    events = interaction_events(t.interactions, seq)
    return advance(t.leads.select("id", *STATE), events, rows=rows)


def apply_events(t: Tables, log: DataFrame, rows: int | None = None) -> DataFrame:
    """State of every lead after a mixed log."""
    return advance(t.leads.select("id", *STATE), log_events(log), rows=rows)


def latest_followup(t: Tables, seq: str = "seq") -> DataFrame:
    """Follow-up date of every lead: the last one an interaction gave, else the lead's own."""
    given = F.col("followup_date").isNotNull()
    last = t.interactions.groupBy(F.col("lead_id").alias("id")).agg(
        F.max_by("followup_date", F.when(given, F.col(seq))).alias("_last")
    )
    return t.leads.select("id", "followup_date").join(last, "id", "left").select(
        "id", F.coalesce("_last", "followup_date").alias("followup_date")
    )

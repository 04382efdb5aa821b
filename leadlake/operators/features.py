"""Texts for a language model, and its replies as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.functions import semantics as S
from leadlake.operators.outcome import Outcome
from leadlake.operators.writes import save_ai
from leadlake.sources.tables import Tables

# --- fixed values: the reply used when none can be read ---
FALLBACK_SCORE, FALLBACK_REASON, FALLBACK_PRIORITY, FALLBACK_ACTION = 50, "Parse error", "medium", "Follow up"
# --- end of fixed values ---


def _named_leads(t: Tables, doctor: bool) -> DataFrame:
    leads = t.leads.join(
        t.patients.select(F.col("id").alias("patient_id"), "full_name"), "patient_id"
    ).join(t.specialities.select(F.col("id").alias("speciality_id"), F.col("name").alias("speciality")), "speciality_id")
    if doctor:
        leads = leads.join(
            t.doctors.select(F.col("id").alias("doctor_id"), F.col("name").alias("doctor")), "doctor_id", "left"
        )
    return leads


def score_features(t: Tables) -> DataFrame:
    """Scoring text per lead, with its number of interactions."""
    talks = t.interactions.groupBy(F.col("lead_id").alias("id")).agg(F.count(F.lit(1)).alias("_talks"))
    c = F.col
    text = S.sentence(
        "Lead: ", c("full_name"), ", Concern: ", c("medical_concern"), ", Stage: ", c("lead_stage"),
        ", Substage: ", c("lead_substage"), ", Source: ", c("lead_source"), ", Speciality: ", c("speciality"),
        ", Interactions: ", F.coalesce("_talks", F.lit(0)), ", Urgency: ", c("urgency"),
    )
    return _named_leads(t, False).join(talks, "id", "left").select("id", text.alias("text"))


def followup_features(t: Tables) -> DataFrame:
    """Call-script text per lead."""
    c = F.col
    text = S.sentence(
        "Patient: ", c("full_name"), ", Concern: ", c("medical_concern"), ", Stage: ", c("lead_stage"),
        " (", c("lead_substage"), "), Speciality: ", c("speciality"),
        ", Doctor: ", F.coalesce(S.blank_to_null("doctor"), F.lit("Not assigned")),
    )
    return _named_leads(t, True).select("id", text.alias("text"))


def insight_features(t: Tables) -> DataFrame:
    """Insight text per lead."""
    c = F.col
    text = S.sentence(
        "Patient: ", c("full_name"), ", Concern: ", c("medical_concern"), ", Stage: ", c("lead_stage"),
        ", Substage: ", c("lead_substage"), ", Source: ", c("lead_source"), ", AI Score: ", c("ai_score"),
        ", Interactions: ", c("attempt_count"),
    )
    return _named_leads(t, False).select("id", text.alias("text"))


def parse_scores(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Replies as score columns. Code fences are removed; text that is not JSON gives the fallback."""
    parsed = F.try_parse_json(F.regexp_replace(reply, "```json|```", ""))
    broken = F.col("_v").isNull()

    def text(path: str):
        return F.try_variant_get("_v", path, "string")

    score = F.round(F.try_variant_get("_v", "$.score", "double")).cast("int")
    priority = F.coalesce(S.blank_to_null(F.lower(text("$.priority"))), F.lit(FALLBACK_PRIORITY))
    keep = [c for c in df.columns if c != reply]
    return df.withColumn("_v", parsed).select(
        *keep,
        F.when(broken, F.lit(FALLBACK_SCORE)).otherwise(score).alias("ai_score"),
        F.when(broken, F.lit(FALLBACK_PRIORITY)).otherwise(priority).alias("ai_priority"),
        F.when(broken, F.lit(FALLBACK_REASON)).otherwise(text("$.reason")).alias("ai_reason"),
        F.when(broken, F.lit(FALLBACK_ACTION)).otherwise(text("$.nextAction")).alias("ai_next_action"),
    )


def apply_scores(t: Tables, replies: DataFrame, as_of) -> Outcome:
    """Store the scores read from replies (``id``, ``seq``, ``reply``)."""
    return save_ai(t, parse_scores(replies), as_of)

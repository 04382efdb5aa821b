"""The three reporting views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.functions import semantics as S
from leadlake.operators.facts import name_by, revenue_cells
from leadlake.sources.tables import Tables


def join_lead_names(leads: DataFrame, t: Tables) -> DataFrame:
    """Aliases l, p, f, sp (inner) and d, u (left) joined on the lead's references.

    The patient join comes first, while rows are narrow; the other sides are
    small and Spark broadcasts each one whose measured size allows.
    """
    return (
        leads.alias("l")
        .join(t.patients.alias("p"), F.expr("p.id = l.patient_id"))
        .join(t.facilities.alias("f"), F.expr("f.id = l.facility_id"))
        .join(t.specialities.alias("sp"), F.expr("sp.id = l.speciality_id"))
        .join(t.doctors.alias("d"), F.expr("d.id = l.doctor_id"), "left")
        .join(t.users.alias("u"), F.expr("u.id = l.assigned_to"), "left")
    )


def leads_full(t: Tables) -> DataFrame:
    """Every lead with patient, facility, speciality, doctor and agent: 28 columns."""
    return join_lead_names(t.leads, t).selectExpr(
        "l.id AS lead_id", "l.lead_stage", "l.lead_substage", "l.lead_source", "l.campaign_name",
        "l.enquiry_type", "l.medical_concern", "l.followup_date", "l.attempt_count", "l.ai_score",
        "l.ai_priority", "l.enquiry_date",
        "p.id AS patient_id", "p.full_name AS patient_name", "p.primary_phone", "p.email", "p.city",
        "p.patient_type",
        "f.id AS facility_id", "f.name AS facility_name", "f.type AS facility_type",
        "sp.id AS speciality_id", "sp.name AS speciality_name",
        "d.id AS doctor_id", "d.name AS doctor_name",
        "u.id AS agent_id", "u.name AS agent_name", "u.role AS agent_role",
    )


def dashboard_stats(t: Tables) -> DataFrame:
    """Lead totals in one row. On no leads the counts by stage and the rates are NULL."""
    if "lead_cube" in t:
        cells = t["lead_cube"]
    else:
        cells = t.leads.select(
            "lead_stage",
            F.lit(1).cast("bigint").alias("n"),
            F.col("ai_score").cast("bigint").alias("ai_total"),
            F.when(F.col("ai_score").isNotNull(), 1).otherwise(0).cast("bigint").alias("ai_rows"),
            F.when(F.col("attempt_count") == 0, 1).otherwise(0).cast("bigint").alias("never_tried"),
        )
    n = F.col("n")
    stage = F.col("lead_stage")
    sums = cells.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total_leads"),
        S.count_where(stage == "customer", n).alias("total_customers"),
        S.count_where(stage == "interested", n).alias("total_interested"),
        S.count_where(stage == "untouched", n).alias("total_untouched"),
        S.count_where(stage == "attempted", n).alias("total_attempted"),
        S.count_where(stage == "not_interested", n).alias("total_lost"),
        S.count_where(stage == "attempted", F.col("never_tried")).alias("at_risk_leads"),
        F.sum("ai_total").alias("_ai_total"),
        F.sum("ai_rows").alias("_ai_rows"),
    )
    return sums.select(
        "total_leads", "total_customers", "total_interested", "total_untouched", "total_attempted",
        "total_lost",
        S.pct1(F.col("total_customers"), F.col("total_leads")).alias("conversion_rate"),
        S.mean1(F.col("_ai_total"), F.col("_ai_rows")).alias("avg_ai_score"),
        "at_risk_leads",
    )


def revenue_summary(t: Tables) -> DataFrame:
    """Revenue per speciality and facility of the lead, whatever the payment status."""
    named = name_by(
        revenue_cells(t, "speciality_id", "facility_id"),
        {"speciality_id": (t.specialities, "speciality"), "facility_id": (t.facilities, "facility")},
        ["revenue", "bills"],
    )
    return named.select(
        F.col("revenue").alias("total_revenue"),
        S.mean_money(F.col("revenue"), F.col("bills")).alias("avg_revenue_per_lead"),
        F.col("bills").alias("paid_leads"),
        "speciality", "facility",
    )

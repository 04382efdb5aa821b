"""Named dashboards: several frames over one snapshot, sharing their passes over the facts.

A bundle aggregates each fact once into a cube of additive cells, keeps the cubes
for its frames, and answers every frame from them. Bills are added up by lead, by patient and by month
and status in one pass (grouping sets). Cubes are cached, in memory or on the executors' disks, not
checkpointed: after losing an executor Spark rebuilds them from the tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.functions import semantics as S
from leadlake.operators import dashboards as D
from leadlake.operators.facts import revenue_per_lead
from leadlake.operators.views import dashboard_stats
from leadlake.sources.tables import Tables

TREND_MONTHS = (6, 12)


def lead_cube(t: Tables, as_of, keys: tuple[str, ...]) -> DataFrame:
    """Leads counted by stage, the given keys, month and the trend window they fall in."""
    back = F.lit(None).cast("int")
    for months in sorted(TREND_MONTHS, reverse=True):
        back = F.when(F.col("enquiry_date") >= S.months_before(as_of, months), months).otherwise(back)
    rows = t.leads.select(
        "lead_stage", *keys, back.alias("months_back"),
        F.when(back.isNotNull(), S.month_key("enquiry_date")).alias("month"),
        F.when(F.col("attempt_count") == 0, 1).otherwise(0).alias("never_tried"),
        F.col("ai_score").cast("bigint").alias("ai_score"),
    )
    return rows.groupBy("lead_stage", *keys, "months_back", "month").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("ai_score").alias("ai_total"),
        F.count("ai_score").alias("ai_rows"),
        F.sum("never_tried").cast("bigint").alias("never_tried"),
    )


_MONEY = ("total_value", "consultation_value", "procedure_value", "package_value")


def bill_cube(t: Tables) -> DataFrame:
    """Bills by month and payment status."""
    return t.revenue.groupBy(S.month_key("billed_date").alias("month"), "payment_status").agg(
        *[F.sum(F.col(c).cast("decimal(18,2)")).alias(c) for c in _MONEY],
        F.count(F.lit(1)).alias("bills"),
    )


def bill_sets(t: Tables, *sets: tuple[str, ...]) -> DataFrame:
    """Bills added up by several sets of keys in one pass; ``grouped`` holds a bit per key that a row is not of."""
    bills = t.revenue.select(*BILL_KEYS[:2], S.month_key("billed_date").alias("month"), "payment_status", "billed_date", *_MONEY)
    return bills.groupingSets([list(s) for s in sets], *BILL_KEYS).agg(
        F.grouping_id().alias("grouped"), *[S.exact_sum(c).alias(c) for c in _MONEY],
        F.count(F.lit(1)).alias("bills"), F.max("billed_date").alias("last_visit"),
    )


BILL_KEYS = ("lead_id", "patient_id", "month", "payment_status")
BY_LEAD, BY_PATIENT, BY_MONTH = ("lead_id",), ("patient_id",), ("month", "payment_status")


def one_set(sets: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The rows of one set of keys."""
    mark = sum(1 << (len(BILL_KEYS) - 1 - k) for k, c in enumerate(BILL_KEYS) if c not in keys)
    return sets.where(F.col("grouped") == mark).drop("grouped", *[c for c in BILL_KEYS if c not in keys])


def revenue_cube(t: Tables) -> DataFrame:
    """Revenue by the source, speciality and facility of its lead."""
    keys = ("lead_source", "speciality_id", "facility_id")
    leads = t.leads.select(F.col("id").alias("lead_id"), *keys)
    return leads.join(revenue_per_lead(t), "lead_id").groupBy(*keys).agg(
        F.sum("revenue").cast(S.EXACT_SUM).alias("revenue"), F.sum("bills").alias("bills")
    )


def visit_cube(t: Tables) -> DataFrame:
    """Appointments by status."""
    return t.appointments.groupBy("visit_status").agg(F.count(F.lit(1)).alias("n"))


def prepare(t: Tables, name: str, as_of) -> Tables:
    """Add the cubes a bundle reads, cached. Call :func:`release` when its frames are written."""
    level = StorageLevel.MEMORY_AND_DISK
    cubes = {}
    if name == "summary":
        cubes["lead_cube"] = lead_cube(t, as_of, ("lead_source", "speciality_id"))
    elif name == "marketing":
        cubes["lead_cube"] = lead_cube(t, as_of, ("lead_source", "campaign_name"))
    elif name == "cxo":
        cubes["lead_cube"] = lead_cube(t, as_of, ("lead_source", "speciality_id", "facility_id", "doctor_id"))
    if name == "cxo":
        cubes["visit_cube"] = visit_cube(t)
    if name == "summary":
        cubes["bill_cube"] = bill_cube(t)
    parts = {}
    if name in ("cxo", "finance"):
        sets = bill_sets(t, BY_LEAD, BY_MONTH, *([BY_PATIENT] if name == "finance" else [])).persist(level)
        parts = {"bill_sets": sets, "bill_cube": one_set(sets, BY_MONTH), "lead_bills": one_set(sets, BY_LEAD)}
        if name == "finance":
            parts["patient_bills"] = one_set(sets, BY_PATIENT)
        cubes["revenue_cube"] = revenue_cube(t.replace(**parts))
    return t.replace(**parts, **{k: df.persist(level) for k, df in cubes.items()})


def release(t: Tables) -> None:
    for name in ("lead_cube", "revenue_cube", "bill_cube", "visit_cube", "bill_sets"):
        if name in t:
            t[name].unpersist()


def run_frames(frames: dict[str, DataFrame], action: Callable[[str, DataFrame], object], threads: int = 4) -> dict:
    """Run one action per frame, several at a time, so that small jobs fill the cluster together."""
    with ThreadPoolExecutor(threads) as pool:
        jobs = {name: pool.submit(action, name, df) for name, df in frames.items()}
        return {name: job.result() for name, job in jobs.items()}


@contextmanager
def shared_cubes(t: Tables, name: str, as_of) -> Iterator[Tables]:
    """The tables with a bundle's cubes, released at the end: run the frames inside."""
    ready = prepare(t, name, as_of)
    try:
        yield ready
    finally:
        release(ready)


def dashboard(c: Tables, name: str, as_of) -> dict[str, DataFrame]:
    """The frames of one dashboard: summary, marketing, cxo or finance.

    Nothing is cached here; with tables from ``shared_cubes`` the frames share its cubes.
    """
    if name == "summary":
        return {
            "stats": dashboard_stats(c),
            "bySource": D.leads_by_source(c),
            "bySpeciality": D.leads_by_speciality(c),
            "revenue": D.revenue_total(c),
            "recentLeads": D.recent_leads(c),
            "atRisk": D.at_risk_leads(c, as_of),
        }
    if name == "marketing":
        return {
            "stats": dashboard_stats(c),
            "bySource": D.channel_conversion(c).withColumnRenamed("channel", "lead_source"),
            "byCampaign": D.top_campaigns(c),
        }
    if name == "cxo":
        return {
            "stats": dashboard_stats(c),
            "revenue": D.revenue_total(c),
            "byChannel": D.channel_conversion(c),
            "funnel": D.funnel(c),
            "bySpeciality": D.speciality_conversion(c),
            "byDoctor": D.top_doctors(c),
            "byFacility": D.facility_conversion(c),
            "revBySpeciality": D.revenue_by_speciality_all(c),
            "noShow": D.no_show_rate(c),
            "leadsByMonth": D.leads_by_month(c, as_of),
            "specTrend": D.speciality_trend(c, as_of),
            "channelTrend": D.channel_trend(c, as_of),
        }
    if name == "finance":
        return {
            "summary": D.revenue_breakdown(c),
            "byMonth": D.revenue_by_month(c),
            "byChannel": D.revenue_by_channel(c),
            "bySpeciality": D.revenue_by_speciality(c),
            "byFacility": D.revenue_by_facility(c),
            "highValue": D.high_value_patients(c),
            "byPaymentStatus": D.revenue_by_payment_status(c),
        }
    raise ValueError(f"unknown dashboard: {name}")

"""Dashboard aggregations.

Every function returns the complete, ordered result; where a report shows only
the first rows, the count is an argument with the report's own default. The key
is always the last sort column, so results are the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions import semantics as S
from leadlake.functions.reliability import bounded
from leadlake.operators.facts import lead_cells, merge_spellings, name_by, revenue_cells
from leadlake.operators.views import dashboard_stats
from leadlake.sources.tables import Tables, to_documents


def _rate() -> Column:
    return S.pct1(F.col("customers"), F.col("leads")).alias("conversion_rate")


def within(t: Tables, date_from: str | None = None, date_to: str | None = None) -> Tables:
    """The same tables limited to enquiries, visits and bills of whole days, for dated dashboards."""
    if not (date_from or date_to):
        return t
    return t.replace(
        leads=t.leads.where(S.day_range("enquiry_date", date_from, date_to, True)),
        appointments=t.appointments.where(S.day_range("appointment_date", date_from, date_to, True)),
        revenue=t.revenue.where(S.day_range("billed_date", date_from, date_to, True)),
    )


# --- leads -----------------------------------------------------------------------------


def leads_by_source(t: Tables) -> DataFrame:
    cells = lead_cells(t, "lead_source").select("lead_source", F.col("leads").alias("count"))
    return cells.orderBy(F.desc("count"), "lead_source")


def leads_by_speciality(t: Tables) -> DataFrame:
    named = name_by(
        lead_cells(t, "speciality_id"), {"speciality_id": (t.specialities, "speciality")}, ["leads"]
    )
    return named.select("speciality", F.col("leads").alias("count")).orderBy(F.desc("count"), "speciality")


def recent_leads(t: Tables, n: int = 10) -> DataFrame:
    """Newest leads. The first ``n`` are cut before the joins: every lead has its patient,
    as intake rejects unknown references, so no join can drop one of them."""
    newest = bounded(S.top_k(
        t.leads.select("id", "lead_stage", "lead_source", "enquiry_date", "patient_id", "speciality_id"),
        n, F.desc("enquiry_date"), F.col("id"),
    ), n)
    people = t.patients.select(F.col("id").alias("patient_id"), F.col("full_name").alias("patient_name"))
    fields = t.specialities.select(F.col("id").alias("speciality_id"), F.col("name").alias("speciality_name"))
    return (
        newest.join(people, "patient_id")
        .join(fields, "speciality_id", "left")
        .select("id", "lead_stage", "lead_source", "enquiry_date", "patient_name", "speciality_name")
        .orderBy(F.desc("enquiry_date"), "id")
    )


def at_risk_leads(t: Tables, as_of, n: int | None = 20) -> DataFrame:
    """Attempted leads whose follow-up is missing or due, oldest follow-up first."""
    due = t.leads.where(
        (F.col("lead_stage") == "attempted")
        & (F.col("followup_date").isNull() | (F.col("followup_date") <= S.moment(as_of).cast("date")))
    ).select("id", "patient_id", "speciality_id", "followup_date")
    if n is not None:
        due = bounded(S.top_k(due, n, F.asc_nulls_first("followup_date"), F.col("id")), n)
    people = t.patients.select(F.col("id").alias("patient_id"), "full_name", "primary_phone")
    fields = t.specialities.select(F.col("id").alias("speciality_id"), F.col("name").alias("speciality_name"))
    return (
        due.join(people, "patient_id")
        .join(fields, "speciality_id")
        .select("id", "full_name", "primary_phone", "followup_date", "speciality_name")
        .orderBy(F.asc_nulls_first("followup_date"), "id")
    )


def channel_conversion(t: Tables) -> DataFrame:
    return (
        lead_cells(t, "lead_source")
        .select(F.col("lead_source").alias("channel"), F.col("leads").alias("total_leads"), "customers", _rate())
        .orderBy(F.desc("total_leads"), "channel")
    )


def top_campaigns(t: Tables, n: int | None = 10) -> DataFrame:
    """Campaigns by leads; spellings differing in case or trailing spaces are one campaign."""
    cells = lead_cells(t, "campaign_name").where(F.rtrim("campaign_name") != "")
    named = merge_spellings(cells, "campaign_name", ["leads", "customers"])
    return S.top_k(
        named.select("campaign_name", F.col("leads").alias("total_leads"), "customers"),
        n, F.desc("total_leads"), F.col("campaign_name"),
    )


def _visits(t: Tables) -> DataFrame:
    """Appointments as additive cells (``visit_status``, ``n``), from ``t.visit_cube`` when a bundle has prepared one."""
    return t["visit_cube"] if "visit_cube" in t else t.appointments.select("visit_status", F.lit(1).cast("bigint").alias("n"))


def funnel(t: Tables) -> DataFrame:
    """Leads, contacted leads, appointments and visits in one row, from one pass over both facts."""
    zero = F.lit(0).cast("bigint")
    if "lead_cube" in t:
        leads, n = t["lead_cube"], F.col("n")
    else:
        leads, n = t.leads, F.lit(1).cast("bigint")
    visits = _visits(t)
    steps = leads.select(
        n.alias("leads"),
        F.when(F.col("lead_stage") != "untouched", n).otherwise(zero).alias("contacted"),
        zero.alias("visits"), zero.alias("visited"),
    ).unionByName(
        visits.select(
            zero.alias("leads"), F.lit(None).cast("bigint").alias("contacted"), F.col("n").alias("visits"),
            F.when(F.col("visit_status") == "visited", F.col("n")).otherwise(zero).alias("visited"),
        )
    )
    return steps.agg(
        F.coalesce(F.sum("leads"), zero).alias("total_leads"),
        F.sum("contacted").alias("contacted"),
        F.coalesce(F.sum("visits"), zero).alias("total_appointments"),
        F.coalesce(F.sum("visited"), zero).alias("visited"),
    )


def speciality_conversion(t: Tables) -> DataFrame:
    named = name_by(
        lead_cells(t, "speciality_id"),
        {"speciality_id": (t.specialities, "speciality")}, ["leads", "customers"],
    )
    return named.select("speciality", F.col("leads").alias("total_leads"), "customers", _rate()).orderBy(
        F.desc("total_leads"), "speciality"
    )


def top_doctors(t: Tables, n: int | None = 10) -> DataFrame:
    """Doctor and speciality of the lead by leads; leads without a doctor do not count."""
    named = name_by(
        lead_cells(t, "doctor_id", "speciality_id"),
        {"doctor_id": (t.doctors, "doctor"), "speciality_id": (t.specialities, "speciality")},
        ["leads", "customers"],
    )
    return S.top_k(
        named.select("doctor", "speciality", F.col("leads").alias("total_leads"), "customers"),
        n, F.desc("total_leads"), F.col("doctor"), F.col("speciality"),
    )


def _by_facility(t: Tables) -> DataFrame:
    return name_by(
        lead_cells(t, "facility_id"), {"facility_id": (t.facilities, "facility")}, ["leads", "customers"]
    )


def facility_conversion(t: Tables) -> DataFrame:
    return _by_facility(t).select(
        "facility", F.col("leads").alias("total_leads"), "customers", _rate()
    ).orderBy(F.desc("total_leads"), "facility")


def facility_leads(t: Tables) -> DataFrame:
    return _by_facility(t).select(F.col("facility").alias("name"), "leads", "customers")


def leads_by_month(t: Tables, as_of, months: int = 12) -> DataFrame:
    recent = _since(t, as_of, months)
    return (
        lead_cells(recent, "month")
        .select("month", F.col("leads").alias("total_leads"), "customers", _rate())
        .orderBy("month")
    )


def speciality_trend(t: Tables, as_of, months: int = 6, top: int | None = None) -> DataFrame:
    """Leads per month and speciality; ``top`` keeps the specialities with most leads in the window."""
    named = _monthly_names(t, as_of, months)
    if top is not None:
        best = S.top_k(
            named.groupBy("speciality").agg(F.sum("total_leads").alias("_all")),
            top, F.desc("_all"), F.col("speciality"),
        )
        named = named.join(bounded(best.select("speciality"), top), "speciality", "left_semi")
    return named.select("month", "speciality", "total_leads").orderBy(
        "month", F.desc("total_leads"), "speciality"
    )


def _monthly_names(t: Tables, as_of, months: int) -> DataFrame:
    cells = lead_cells(_since(t, as_of, months), "month", "speciality_id")
    named = cells.join(
        t.specialities.select(F.col("id").alias("speciality_id"), "name"), "speciality_id"
    )
    return (
        named.groupBy("month", S.ci_key("name").alias("_name"))
        .agg(F.min("name").alias("speciality"), F.sum("leads").alias("total_leads"))
        .drop("_name")
    )


def channel_trend(t: Tables, as_of, months: int = 6) -> DataFrame:
    return (
        lead_cells(_since(t, as_of, months), "month", "lead_source")
        .select("month", F.col("lead_source").alias("channel"), F.col("leads").alias("total_leads"))
        .orderBy("month", "channel")
    )


def _since(t: Tables, as_of, months: int) -> Tables:
    """Leads enquired in the last ``months`` months, with their month."""
    if "lead_cube" in t:
        cube = t["lead_cube"]
        return t.replace(lead_cube=cube.where(F.col("months_back") <= months))
    recent = t.leads.where(F.col("enquiry_date") >= S.months_before(as_of, months))
    return t.replace(leads=recent.withColumn("month", S.month_key("enquiry_date")))


# --- appointments ----------------------------------------------------------------------


def no_show_rate(t: Tables) -> DataFrame:
    status = F.col("visit_status")
    n = F.col("n")
    sums = _visits(t).agg(
        F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("total_appointments"),
        S.count_where(status == "no_show", n).alias("no_shows"),
        S.count_where(status == "visited", n).alias("visited"),
    )
    return sums.withColumn("no_show_rate", S.pct1(F.col("no_shows"), F.col("total_appointments")))


# --- revenue ---------------------------------------------------------------------------


def bill_cells(t: Tables, *keys: str) -> DataFrame:
    """Bills as additive cells (from ``t.bill_cube`` when a bundle has prepared one)."""
    if "bill_cube" in t:
        cells = t["bill_cube"]
    else:
        money = [F.col(c).cast("decimal(28,2)").alias(c) for c in (
            "total_value", "consultation_value", "procedure_value", "package_value")]
        cells = t.revenue.select(
            S.month_key("billed_date").alias("month"), "payment_status", *money,
            F.lit(1).cast("bigint").alias("bills"),
        )
    none = F.lit(0).cast(S.EXACT_SUM)

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c).cast(S.EXACT_SUM), none)

    return cells.groupBy(*keys).agg(
        total("total_value").alias("revenue"),
        total("consultation_value").alias("consultation"),
        total("procedure_value").alias("proc_value"),
        total("package_value").alias("package"),
        F.coalesce(F.sum("bills"), F.lit(0)).cast("bigint").alias("bills"),
    )


def revenue_total(t: Tables) -> DataFrame:
    return bill_cells(t).select(F.col("revenue").alias("total_revenue"), F.col("bills").alias("revenue_count"))


def revenue_breakdown(t: Tables) -> DataFrame:
    mean = F.coalesce(S.mean_money(F.col("revenue"), F.col("bills")), F.lit(0).cast(S.EXACT_AVG))
    return bill_cells(t).select(
        F.col("revenue").alias("total_revenue"),
        F.col("consultation").alias("total_consultation"),
        F.col("proc_value").alias("total_procedure"),
        F.col("package").alias("total_package"),
        F.col("bills").alias("revenue_count"),
        mean.alias("avg_revenue"),
    )


def revenue_by_month(t: Tables, n: int | None = 12, which: str = "first") -> DataFrame:
    """Revenue per billed month, ascending: the first ``n`` months, or the last ones."""
    months = bill_cells(t, "month").select(
        "month", "revenue", "consultation", "proc_value", F.col("bills").alias("count")
    )
    if which == "last" and n is not None:
        return S.top_k(months, n, F.desc("month")).orderBy("month")
    return S.top_k(months, n, F.col("month"))


def revenue_by_payment_status(t: Tables) -> DataFrame:
    return bill_cells(t, "payment_status").select(
        "payment_status", F.col("bills").alias("count"), "revenue"
    )


def _mean_value() -> Column:
    return S.mean_money(F.col("revenue"), F.col("bills"), 0).cast("bigint").alias("avg_value")


def revenue_by_channel(t: Tables) -> DataFrame:
    return (
        revenue_cells(t, "lead_source")
        .select(F.col("lead_source").alias("channel"), "revenue", F.col("bills").alias("count"), _mean_value())
        .orderBy(F.desc("revenue"), "channel")
    )


def revenue_by_speciality(t: Tables) -> DataFrame:
    named = name_by(
        revenue_cells(t, "speciality_id"),
        {"speciality_id": (t.specialities, "speciality")}, ["revenue", "bills"],
    )
    return named.select("speciality", "revenue", F.col("bills").alias("count"), _mean_value()).orderBy(
        F.desc("revenue"), "speciality"
    )


def revenue_by_facility(t: Tables) -> DataFrame:
    named = name_by(
        revenue_cells(t, "facility_id"), {"facility_id": (t.facilities, "facility")}, ["revenue", "bills"]
    )
    return named.select("facility", "revenue", F.col("bills").alias("count")).orderBy(
        F.desc("revenue"), "facility"
    )


def revenue_by_speciality_all(t: Tables) -> DataFrame:
    """Revenue of each speciality that has leads, 0 where nothing was billed."""
    cells = (
        lead_cells(t, "speciality_id")
        .select("speciality_id")
        .join(revenue_cells(t, "speciality_id"), "speciality_id", "left")
        .select(
            "speciality_id",
            F.coalesce("revenue", F.lit(0).cast(S.EXACT_SUM)).alias("revenue"),
            F.coalesce("bills", F.lit(0).cast("bigint")).alias("bills"),
        )
    )
    named = name_by(cells, {"speciality_id": (t.specialities, "speciality")}, ["revenue", "bills"])
    return named.select("speciality", "revenue", F.col("bills").alias("count")).orderBy(
        F.desc("revenue"), "speciality"
    )


def high_value_patients(t: Tables, n: int = 20) -> DataFrame:
    """Patients by revenue. The first ``n`` ids are found on the bills alone and only
    those meet the patients (every bill has its patient)."""
    if "patient_bills" in t:
        sums = t["patient_bills"].select(
            F.col("patient_id").alias("id"), F.col("total_value").alias("total_revenue"), F.col("bills").alias("visit_count"), "last_visit")
    else:
        sums = t.revenue.groupBy(F.col("patient_id").alias("id")).agg(
            S.exact_sum("total_value").alias("total_revenue"),
            F.count(F.lit(1)).alias("visit_count"),
            F.max("billed_date").alias("last_visit"),
        )
    best = bounded(S.top_k(sums, n, F.desc("total_revenue"), F.col("id")), n)
    return (
        best.join(t.patients.select("id", "full_name", "primary_phone", "city"), "id")
        .orderBy(F.desc("total_revenue"), "id")
        .select("full_name", "primary_phone", "city", "total_revenue", "visit_count", "last_visit")
    )


# --- documents -------------------------------------------------------------------------


def exec_summary(t: Tables) -> DataFrame:
    """Executive summary as JSON lines: totals, revenue, one line per source and facility.

    One line per entry instead of one text holding all of them, so that the
    number of facilities is not limited by what one task can hold.
    """
    parts = {
        "stats": dashboard_stats(t),
        "revenue": revenue_total(t).select(F.col("total_revenue").alias("total")),
        "bySource": leads_by_source(t),
        "byFacility": facility_leads(t),
    }
    return labelled_documents(parts)


def labelled_documents(parts: dict[str, DataFrame]) -> DataFrame:
    """Frames of different shapes as one frame of (section, value) JSON lines."""
    out = None
    for name, df in parts.items():
        lines = to_documents(df).select(F.lit(name).alias("section"), "value")
        out = lines if out is None else out.unionByName(lines)
    return out

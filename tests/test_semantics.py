"""Edge rules on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leadlake.functions import semantics as S
from leadlake.functions.numbering import running_number
from leadlake.operators import dashboards as D
from leadlake.operators import listing as L
from leadlake.operators import views as V
from leadlake.plans.bundles import dashboard, release, shared_cubes
from leadlake.sources.fixtures import CLOCK


def test_text_key_ignores_case_accents_and_trailing_spaces(spark):
    df = spark.createDataFrame([("José ",), ("jose",), ("JOSÉ",), (" jose",)], "n string")
    sizes = sorted(r["count"] for r in df.groupBy(S.ci_key("n")).count().collect())
    assert sizes == [1, 3]


def test_rates_are_exact_and_null_on_zero(spark):
    df = spark.createDataFrame([(1, 3), (1, 2000), (0, 0), (999, 1000), (1, 8)], "a bigint, b bigint")
    got = [r[0] for r in df.select(S.pct1(F.col("a"), F.col("b"))).collect()]
    assert got == [33.3, 0.1, None, 99.9, 12.5]
    money = spark.createDataFrame([("1.00", 3), ("2.00", 3), ("0.00", 0)], "v string, n bigint")
    cents = F.col("v").cast(S.EXACT_SUM)
    assert [str(r[0]) for r in money.select(S.mean_money(cents, F.col("n"))).collect()] == ["0.333333", "0.666667", "None"]


def test_empty_inputs(spark, t):
    none = t.replace(leads=t.leads.limit(0), appointments=t.appointments.limit(0), revenue=t.revenue.limit(0))
    stats = V.dashboard_stats(none).first()
    assert stats["total_leads"] == 0 and stats["total_customers"] is None
    assert stats["conversion_rate"] is None and stats["avg_ai_score"] is None
    visits = D.no_show_rate(none).first()
    assert visits["total_appointments"] == 0 and visits["no_shows"] is None and visits["no_show_rate"] is None
    funnel = D.funnel(none).first()
    assert (funnel["total_leads"], funnel["contacted"], funnel["visited"]) == (0, None, 0)
    assert D.revenue_total(none).first()["total_revenue"] == 0
    assert D.revenue_breakdown(none).first()["avg_revenue"] == 0
    assert L.revenue_list_summary(none).first()["avg"] == 0


def test_last_day_of_a_range(spark):
    df = spark.createDataFrame([(dt.datetime(2001, 5, 31, 12),)], "ts timestamp_ntz")
    assert df.where(S.day_range("ts", "2001-05-01", "2001-05-31", whole_last_day=True)).count() == 1
    assert df.where(S.day_range("ts", "2001-05-01", "2001-05-31", whole_last_day=False)).count() == 0


def test_month_window_clamps_the_day(spark):
    row = spark.range(1).select(S.months_before("2001-03-31 10:00:00", 1).alias("m")).first()
    assert row["m"] == dt.datetime(2001, 2, 28, 10)


def test_numbers_are_padded_not_cut(spark):
    df = spark.createDataFrame([(7,), (99999,), (123456,)], "n bigint")
    assert [r[0] for r in df.select(S.pad_number("n")).collect()] == ["PAT-00007", "PAT-99999", "PAT-123456"]


def test_leading_number(spark):
    df = spark.createDataFrame([("12.5abc",), ("abc",), (None,), (" -3",), ("1e3",), (".5",), ("7.",)], "v string")
    got = [float(r[0]) for r in df.select(S.leading_number("v")).collect()]
    assert got == [12.5, 0, 0, -3, 1000, 0.5, 7]


def test_search_literal_and_wildcard(spark):
    df = spark.createDataFrame([("Ánna 100%", None), ("anna", "x"), ("Bob", "a_b"), (None, None)], "n string, e string")
    cols = ["n", "e"]
    assert df.where(S.search_any(cols, "ANNA")).count() == 2
    assert df.where(S.search_any(cols, "0%")).count() == 1
    assert df.where(S.search_any(cols, "a%a", literal=False)).count() == 1
    assert df.where(S.search_any(cols, "_")).count() == 1


def test_running_number_matches_row_number_for_any_slices(spark):
    df = spark.range(0, 500).select((F.col("id") * 7 % 501).alias("s"), (F.col("id") % 3).alias("k"))
    for size in (1, 10, 10_000, None):
        rows = running_number(df, "s", ["k"], rows=size).collect()
        for k in range(3):
            mine = sorted((r["s"], r["n"]) for r in rows if r["k"] == k)
            assert [n for _, n in mine] == list(range(1, len(mine) + 1))
        whole = sorted((r["s"], r["n"]) for r in running_number(df, "s", rows=size).collect())
        assert [n for _, n in whole] == list(range(1, 501))


def test_ties_under_a_limit_are_broken_by_key(spark, t):
    first = D.top_campaigns(t, 3).collect()
    every = D.top_campaigns(t, None).collect()
    assert first == every[:3]
    assert every == sorted(every, key=lambda r: (-r["total_leads"], r["campaign_name"]))


def test_campaign_spellings_are_one_campaign(spark, t):
    base = t.leads.limit(4).drop("campaign_name")
    names = spark.createDataFrame([("Été",), ("ete ",), ("ETE",), (" ",)], "campaign_name string")
    rows = [r["campaign_name"] for r in names.collect()]
    lead_rows = base.collect()
    from leadlake.sources.fixtures import spark_schema

    cols = spark_schema("leads").fieldNames()
    data = [tuple(rows[i] if c == "campaign_name" else r[c] for c in cols) for i, r in enumerate(lead_rows)]
    leads = spark.createDataFrame(data, spark_schema("leads"))
    got = D.top_campaigns(t.replace(leads=leads)).collect()
    assert [r["total_leads"] for r in got] == [3]


def test_bundles_equal_the_single_frames(t):
    singles = {
        name: {k: sorted(map(str, df.collect())) for k, df in dashboard(t, name, CLOCK).items()}
        for name in ("summary", "marketing", "cxo", "finance")
    }
    for name, frames in singles.items():
        with shared_cubes(t, name, CLOCK) as ready:
            made = dashboard(ready, name, CLOCK)
            assert {k: sorted(map(str, df.collect())) for k, df in made.items()} == frames, name
        assert not any(ready[c].is_cached for c in ("lead_cube", "revenue_cube", "bill_cube") if c in ready)


def test_release_drops_cached_cubes(spark, t):
    from leadlake.plans.bundles import prepare

    ready = prepare(t, "cxo", CLOCK)
    assert ready["lead_cube"].is_cached
    release(ready)
    assert not ready["lead_cube"].is_cached


def test_dated_dashboard(t):
    cut = D.within(t, "1998-01-01", "1998-12-31")
    total = D.channel_conversion(cut).agg(F.sum("total_leads")).first()[0]
    assert total == t.leads.where("year(enquiry_date) = 1998").count()
    assert D.within(t) is t


def test_pages_join_up_to_the_sorted_list(t):
    every = [r["id"] for r in L.sort_leads(L.list_leads(t), "stage", "DESC").collect()]
    pages = []
    for n in range(1, 5):
        pages += [r["id"] for r in L.lead_page(t, n, 500, "stage", "DESC").collect()]
    assert pages == every


def test_page_size_is_capped(t):
    assert L.lead_page(t, 1, 5000).count() == 500
    info = L.page_info(t.leads, 1, 5000, cap=L.LEAD_PAGE_CAP).first()
    assert (info["limit"], info["pages"]) == (500, 3)
    assert L.lead_page(t, 1, 5000, cap=None).count() == t.leads.count()
    assert L.page_info(t.appointments, 1, 900).first()["limit"] == 900


def test_appointment_and_revenue_pages_are_cut_from_the_sorted_lists(t):
    every = L.list_appointments(t, status="no_show").orderBy(F.desc("appointment_date"), "id").collect()
    assert L.appointment_page(t, 2, 70, status="No_Show").collect() == every[70:140]
    every = L.list_revenue(t, facility_id=3, date_from="1997-01-01").orderBy(F.desc("billed_date"), "id").collect()
    assert L.revenue_page(t, 2, 20, facility_id=3, date_from="1997-01-01").collect() == every[20:40]


def test_unknown_sort_key_sorts_by_date(t):
    assert L.lead_page(t, 1, 20, "nonsense").collect() == L.lead_page(t, 1, 20, "date").collect()


def test_row_access(t):
    assert L.visible_to(t.leads, 4, "admin").count() == t.leads.count()
    mine = L.lead_page(t, 1, 500, user=(4, "agent"))
    assert {r["agent_id"] for r in mine.collect()} == {4}
    pairs = L.visible_leads(t).where("user_id = 4").count()
    assert pairs == L.visible_to(t.leads, 4, "agent").count()


def test_funnel_is_the_sum_of_its_parts(t):
    f, s = D.funnel(t).first(), V.dashboard_stats(t).first()
    assert f["contacted"] == s["total_leads"] - s["total_untouched"]
    assert f["visited"] == D.no_show_rate(t).first()["visited"]


def test_last_months_option(t):
    every = [r["month"] for r in D.revenue_by_month(t, None).collect()]
    assert [r["month"] for r in D.revenue_by_month(t, 12).collect()] == every[:12]
    assert [r["month"] for r in D.revenue_by_month(t, 12, "last").collect()] == every[-12:]


def test_top_specialities_of_a_trend(t):
    assert D.speciality_trend(t, CLOCK, 6, top=2).select("speciality").distinct().count() == 2


@pytest.mark.parametrize("slice_rows", [None, 40])
def test_parts_in_order_are_newest_first(t, monkeypatch, slice_rows):
    """Whether split parents' children are ranked in one slice of time or in many."""
    from leadlake.functions import numbering
    from leadlake.operators.profiles import lead_360, patient_360

    if slice_rows:
        monkeypatch.setattr(numbering, "SMALL_BYTES", 0)
        monkeypatch.setattr(numbering, "SLICE_ROWS", slice_rows)

    for small, whole, key, name, when in (
        (lead_360(t, part_rows=2), lead_360(t), "lead_id", "appointments", "appointment_date"),
        (patient_360(t, part_rows=2), patient_360(t), "patient_id", "leads", "created_at"),
    ):
        parts = {}
        for r in small.select(key, "part", "parts", name).collect():
            assert len(r[name]) <= 2 and r["part"] < r["parts"]
            parts.setdefault(r[key], {})[r["part"]] = r[name]
        for r in whole.select(key, name).collect():
            joined = [x for _, rows in sorted(parts[r[key]].items()) for x in rows]
            assert joined == r[name] == sorted(r[name], key=lambda x: (x[when], x["id"]), reverse=True)


def test_many_children_in_one_day_are_spread(spark):
    from leadlake.operators.profiles import _with_part

    at = F.expr("timestamp_ntz '2001-01-01 00:00:00'") + F.expr("make_dt_interval(0, 0, 0, id)")
    rows = spark.range(5000).select("id", F.lit(1).alias("k"), F.when(F.col("id") % 50 > 0, at).alias("at"))
    split = spark.createDataFrame([(1, 50)], "k int, parts int")
    for newest in (True, False):
        got = _with_part(rows, split, "k", "at", 100, newest, slice_rows=400)
        order = sorted(got.collect(), key=lambda r: (r["at"] is not None, r["at"], r["id"]) if r["at"] else (False, r["at"] is None, r["id"]), reverse=newest)
        assert [r["part"] for r in order] == [k // 100 for k in range(5000)]

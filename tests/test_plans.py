"""The plans we want (test_oracle.py also checks each registered query for Python and cross joins)."""

import re

import pytest

from leadlake.operators import dashboards as D
from leadlake.operators import listing as L
from leadlake.operators import stage_engine as G
from leadlake.plans.inspect import plan_text


@pytest.mark.parametrize("fn", [D.top_campaigns, D.top_doctors, D.high_value_patients, D.recent_leads, L.revenue_page])
def test_top_k_is_taken_per_task(t, fn):
    assert "TakeOrderedAndProject" in plan_text(fn(t))


def test_pages_are_cut_before_names_are_joined(spark, t, tmp_path):
    from leadlake.sources.tables import commit_snapshot

    names = ["patients", "leads", "facilities", "specialities", "doctors", "appointments", "revenue"]
    lake = commit_snapshot(spark, str(tmp_path / "lake"), 1, t, names)
    for fn in (L.appointment_page, L.revenue_page):
        cut = plan_text(fn(lake)).split("TakeOrderedAndProject")
        below = cut[-1].splitlines()
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        own = [line for line in below[1:] if depth(line) > depth(cut[-2].splitlines()[-1])]
        assert len(cut) == 2 and not any("Join" in line for line in own[:3]), below[:6]


def test_rank_limits_are_pushed_before_the_shuffle(t):
    assert "WindowGroupLimit" in plan_text(L.audit_trail(t))


def test_date_filters_reach_the_scan(spark, t, tmp_path):
    from leadlake.sources.tables import commit_snapshot

    lake = commit_snapshot(spark, str(tmp_path / "lake"), 1, t, ["leads"])
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    text = plan_text(L.filter_leads(lake.leads, stage="customer", date_from="1997-01-01", date_to="1997-02-01").select("id"))
    assert "GreaterThanOrEqual(enquiry_date" in text and "EqualTo(lead_stage,customer)" in text
    assert "medical_concern" not in text


def test_dashboards_shuffle_no_lead_rows(spark, t, tmp_path):
    """Leads are counted before any exchange, whatever the dimension's size."""
    from leadlake.sources.tables import commit_snapshot

    lake = commit_snapshot(spark, str(tmp_path / "lake"), 1, t)
    text = plan_text(D.speciality_conversion(lake))
    assert text.index("partial_sum") >= 0
    first_exchange = text.rindex("Exchange hashpartitioning(speciality_id")
    assert "partial_sum" in text[first_exchange:], text


def test_stage_engine_shuffles_by_lead_and_slice(t):
    text = plan_text(G.apply_interactions(t, rows=50))
    assert re.search(r"hashpartitioning\(lead_id#\d+L?, _slice#\d+", text)


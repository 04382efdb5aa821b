"""Frames from shared cubes are the frames from the tables, and read each fact once."""

import pytest

from leadlake.plans.bundles import BY_LEAD, BY_MONTH, BY_PATIENT, bill_sets, dashboard, shared_cubes
from leadlake.plans.inspect import plan_text
from leadlake.sources.fixtures import CLOCK
from leadlake.sources.tables import commit_snapshot


@pytest.fixture(scope="module")
def lake(spark, t, tmp_path_factory):
    return commit_snapshot(spark, str(tmp_path_factory.mktemp("lake") / "lake"), 1, t)


@pytest.mark.parametrize("name", ["summary", "marketing", "cxo", "finance"])
def test_shared_frames_are_the_same(lake, name):
    with shared_cubes(lake, name, CLOCK) as ready:
        for key, frame in dashboard(ready, name, CLOCK).items():
            want = dashboard(lake, name, CLOCK)[key]
            assert frame.columns == want.columns
            assert sorted(map(str, frame.collect())) == sorted(map(str, want.collect())), key


@pytest.mark.parametrize("name, facts", [("cxo", ("revenue", "appointments")), ("finance", ("revenue",))])
def test_facts_are_read_once(lake, name, facts):
    with shared_cubes(lake, name, CLOCK) as ready:
        frames = dashboard(ready, name, CLOCK)
        for fact in facts:
            mark = {"revenue": "consultation_value", "appointments": "visit_status"}[fact]
            for key, frame in frames.items():
                text = plan_text(frame)
                # the scan of the fact stands below a cached cube, if anywhere
                for part in text.split("InMemoryRelation")[:1]:
                    assert not any("FileScan" in line and mark in line for line in part.splitlines()), (key, fact)
    sets = plan_text(bill_sets(lake, BY_LEAD, BY_MONTH, BY_PATIENT))
    assert sets.count("FileScan") == 1 and "Expand" in sets

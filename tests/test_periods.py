"""The cube of periods and areas: one aggregate, one reading of the tables."""

import datetime as dt

import pytest

from phaseflux.operators import report
from phaseflux.plans import catalog, reports  # noqa: F401  the second adds its queries to the catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["a13_period_cube", "a35_movers", "a35_weighted_loa", "o29_period_areas", "g4_period_loa"])
def test_tables_are_read_once(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 5, name


def test_grains(spark):
    day = dt.date
    rows = [("oncology", "Phase 2", "Approved", day(1996, 1, 1)), ("oncology", "Phase 1", "Failed Phase 1", day(1996, 5, 1)), ("oncology", "Phase 3", None, day(1999, 1, 1)), ("", "Phase 1", "Failed Phase 1", day(1999, 1, 1)), (None, "Phase 1", "Ongoing", day(1996, 1, 1)), ("zzz", "Phase 1", "Commercialized", day(2001, 12, 31)), ("zzz", "Phase 1", "Approved", None), ("zzz", "Phase 1", "Approved", day(1990, 1, 1))]
    frame = spark.createDataFrame(rows, "disease_area string, highest_phase string, outcome string, earliest_start date")
    got = {(r.grain, r.period, r.area): (r.candidate_count, r.c0, r.c4, r.loa, r.n) for r in report.period_cube(frame, catalog.PERIODS).collect()}
    one, two = "1995–1997", "1998–2001"
    assert got["cell", one, "Oncology"] == (2, 2, 0, 0.0, 2 + 1 + 1 + 1) and got["cell", two, "Oncology"] == (1, 0, 0, 0.0, 0)
    assert got["cell", two, "Others"] == (1, 1, 1, 1.0, 4)
    assert got["period", one, None][0] == 3 and got["period", two, None][:2] == (3, 2) and got["area", None, "Oncology"][0] == 3 and got["all", None, None][0] == 6
    assert len(got) == 3 + 2 + 2 + 1
    each = report.period_area_loa(frame, catalog.PERIODS)
    assert {(r.area, r.in_both) for r in report.in_periods(each, catalog.PERIODS).collect()} == {("Oncology", True), ("Others", False)}
    assert report.period_cube(frame.where("false"), catalog.PERIODS).where("grain != 'all'").count() == 0

"""Registered queries against their SQL on the smallest tables. FAIRLEAD_ALL=1 runs every query."""

import os

import pytest

from fairlead.workload import all_queries
from fairlead.workload.check import compare, connect

SF_DIR = os.environ.get("FAIRLEAD_SF", "/root/testdata/sf0.001")
QUERIES, ORACLES = all_queries()
QUICK = ["sel2_primary_gps", "jn1_merge_nav", "seg6_fold_negligible_legs", "seg8_stays", "seg9_trip_endpoints", "ag4_fuel_litres", "per3_overall_and_year", "tk4_periodic_log", "dq3_time_regressions", "dec5_engine_dynamic", "qm1_layout", "st5_late_time"]
NAMES = list(QUERIES) if os.environ.get("FAIRLEAD_ALL") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not there")


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    verdict, _, _ = compare(spark, connect(SF_DIR), name, SF_DIR, QUERIES, ORACLES)
    assert verdict in ("ok", "rows-only")


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)

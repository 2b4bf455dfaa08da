"""Registered queries against their SQL.  ORDINALIS_ALL=1 runs every one of them; the default is a quick selection."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = ["flagship", "confusion_matrix", "evaluate_on_splits", "lift_curve", "calibration_report", "bootstrap_ci", "fairness_matrix",
         "merge_new_columns", "leak_audit", "rank_min_desc", "response_biased_split", "derive_all", "build_prompts",
         "top_words_by_class", "batch_kpis", "alert_table", "stream_kpis", "linear_local_contrib",
         "isotonic_recalibrate", "recalibration_report", "lift_intervals", "stream_late_rows", "stream_sessions"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ORDINALIS_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    if not Path(SF).exists():
        pytest.skip("no test tables")
    import check
    return check.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    import check
    assert check.compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == "ok"


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 172


def test_entry(spark):
    if not Path(SF).exists():
        pytest.skip("no test tables")
    out = entry.entry(spark)
    assert {"model", "segment", "group", "qwk", "di"} <= set(out.columns) and out.count() > 0

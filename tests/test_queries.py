"""Registered queries against their SQL on the smallest data folder, and the entry contract."""
import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of
from vitalgrid.plans.registry import all_queries, all_sql

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "icustay_hourly", "icustay_detail", "weight_durations", "bg", "gcs", "vitalsign", "oxygen_delivery", "urine_output_rate", "charlson", "antibiotic",
    "vasoactive_agent", "rrt", "ventilation", "first_day_lab", "kdigo_stages", "sofa", "sapsii", "apsiii", "oasis", "sepsis3", "filter_aggregate_median",
    "filter_hour_window_sum", "cohort_expression", "cohort_summary", "code_filter_all", "d_prescriptions", "demographics", "timeline_items", "item_series",
    "trajectory", "top_categories", "table_one", "rank_test_statistic", "chi_square_statistic", "window_running_sum", "join_first_of_two_windows")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert "sofa_24hours" in df.columns and df.limit(1).count() == 1


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(entry.oracle_sql()[name])
    assert got == rows_of([d[0] for d in res.description], res.fetchall())


def test_group_tests_adjusts_p_values(spark):
    rows = entry.queries()["group_tests"](spark, FOLDER).collect()
    tested = sorted((r.p_value, r.q_value) for r in rows if r.p_value is not None)
    assert tested and all(p <= q <= 1 for p, q in tested) and [q for _, q in tested] == sorted(q for _, q in tested)

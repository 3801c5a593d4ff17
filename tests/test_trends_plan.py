"""Selections of cohort trends are shuffled, however small their file: each becomes a row a level."""

from datetime import date, datetime

from lotlens.operators import trends

KEYS = "make string, model string, fuel_type string, transmission string, model_year int, mileage_bucket int"


def test_no_selection_is_broadcast(spark):
    asked = spark.createDataFrame([(1, "M", "x", None, None, None, None)], f"request_id long, {KEYS}")
    cohorts = spark.createDataFrame([(date(2024, 1, 30), "model", "M", "x", None, None, None, None, 20, 5.0)], f"day date, granularity string, {KEYS}, active_count long, median_price double")
    out = trends.trends(asked, cohorts, datetime(2024, 1, 31), (3,))
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().sparkPlan().toString()
    assert [(r.request_id, r.granularity, r.median_price, r.used_fallback) for r in out.collect()] == [(1, "model", 5.0, False)]

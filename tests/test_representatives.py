"""The ad that stands for a vehicle: ties and nulls, and that listings are read and dealt out once for it."""

from datetime import datetime

from pyspark.sql import functions as F

from lotlens.operators import upkeep
from lotlens.plans import queries as plans
from lotlens.sources import tables

A, B = datetime(2000, 1, 1), datetime(2000, 1, 2)


def test_ties_and_nulls(spark):
    rows = [
        ("a", 1, "active", A, B), ("b", 1, "active", A, B), ("c", 1, "active", None, B), ("d", 1, "removed", B, B), ("d", 1, "removed", B, B),
        ("e", 2, "active", None, None), ("f", 2, "active", None, A), ("g", 3, "removed", A, A), ("h", None, "active", A, A), ("i", 4, "active", B, A), ("i", 4, "active", B, A), ("j", 4, "active", B, None),
    ]
    ads = spark.createDataFrame(rows, "listing_id string, vehicle_id long, status string, first_seen_at timestamp, last_seen_at timestamp")
    got = sorted(tuple(r) for r in upkeep.representatives(ads, F.lit(True)).collect())
    assert got == [("a", 1, True), ("b", 1, False), ("c", 1, False), ("d", 1, False), ("d", 1, False), ("e", 2, False), ("f", 2, True), ("i", 4, True), ("i", 4, True), ("j", 4, False)]


def test_listings_are_read_once(spark):
    for name in ("g10_representatives", "p12_shown"):
        plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("l_extendedprice") and plan.count("/lineitem.parquet") == 1


def test_sellers_beyond_the_broadcast(spark, monkeypatch):
    ads = lambda: sorted(map(str, tables.listings(spark, "/root/testdata/sf0.001").collect()))
    few = ads()
    monkeypatch.setattr(tables, "SELLERS", 0)
    assert len(few) > 1000 and ads() == few

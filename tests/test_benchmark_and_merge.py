import hashlib
import math
import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lotlens.operators import benchmark, costs, ingest


def test_split_is_by_digest(spark):
    got = {r.k: (r.b, r.p) for r in spark.range(300).select(F.col("id").alias("k"), benchmark.bucket(F.col("id")).alias("b"), benchmark.part(F.col("id")).alias("p")).collect()}
    for k, (b, p) in got.items():
        assert b == int(hashlib.sha256(str(k).encode()).hexdigest()[:8], 16) % 100
        assert p == ("train" if b < 60 else "tuning" if b < 75 else "calibration" if b < 85 else "test")


def test_ridge_and_interval(spark):
    """Prices fall a tenth a year from a level of the make, with a spread of a twentieth."""
    k = F.col("id")
    cars = spark.range(3000).select(
        k.cast("string").alias("listing_id"), k.alias("vehicle_id"), F.concat(F.lit("m"), (k % 5).cast("string")).alias("make"), (k % 3).cast("string").alias("model"), F.lit("suv").alias("body_style"), F.lit("petrol").alias("fuel_type"),
        F.lit("manual").alias("transmission"), F.lit("dealer").alias("seller_type"), (F.lit(100) + k % 7 * 10).alias("horsepower"), (F.lit(1990) + k % 12).cast("int").alias("model_year"), (k % 40 * 5000).alias("mileage_km"),
    )
    price = 100_000 * F.exp(F.lit(-0.1) * (2002 - F.col("model_year")) + F.substring("make", 2, 1).cast("int") * 0.2 + 0.05 * F.randn(3))
    rows = benchmark.features(cars.withColumn("price", price.cast("long")), 2002).withColumn("part", benchmark.part(F.col("vehicle_id"))).cache()
    model = benchmark.ridge(rows.filter("part = 'train'"), 0.001)
    radius = benchmark.log_radius(benchmark.predicted(model, rows.filter("part = 'calibration'")))
    report = benchmark.errors(benchmark.predicted(model, rows.filter("part = 'test'")), radius).first()
    plain = rows.filter("part = 'test'").withColumn("predicted", F.lit(rows.filter("part = 'train'").agg(F.percentile("price", 0.5)).first()[0]))
    assert report.valued == report.targets and report.mean_absolute_log < 0.06 < benchmark.errors(plain).first().mean_absolute_log
    assert 0.85 <= report.interval_coverage <= 0.95


def test_strict_median_and_errors(spark):
    car = lambda i, v, price, km=1000: (i, v, "m", "x", "suv", "petrol", "manual", 100, 2000, km, price)
    schema = "listing_id string, vehicle_id int, make string, model string, body_style string, fuel_type string, transmission string, horsepower int, model_year int, mileage_km long, price long"
    pool = spark.createDataFrame([car("a", 1, 100), car("b", 2, 110), car("c", 3, 130), car("d", 1, 999)], schema)
    got = {r.listing_id: r.predicted for r in benchmark.strict_median(pool.filter("listing_id in ('a', 'b')"), pool).collect()}
    assert got == {"b": 130.0}
    rows = spark.createDataFrame([(100, 110.0), (100, 90.0), (100, None)], "price long, predicted double")
    e = benchmark.errors(rows, 0.1).first()
    assert (e.targets, e.valued, e.mae) == (3, 2, 10.0) and e.interval_coverage == 0.5 and e.coverage == pytest.approx(2 / 3)
    assert benchmark.log_radius(rows) is None
    many = spark.createDataFrame([(100, 100.0 * math.exp(k / 100)) for k in range(1, 20)], "price long, predicted double")
    assert benchmark.log_radius(many) == pytest.approx(0.18)


def test_insurance_risk(spark):
    rows = [("Tesla", "electric", None, None, None, 1.6 * 1.2), ("kia ", "petrol", "18-24", 1, "Malmö", 0.85 * 1.35 * 1.25 * 1.15), ("Odd", "plug_in_hybrid", "?", 20, "Kiruna", 1.5 * 0.92)]
    got = spark.createDataFrame(rows, "m string, f string, a string, l int, r string, want double").select(costs.insurance_risk(*[F.col(c) for c in "mfalr"]).alias("x"), "want").collect()
    assert all(r.x == pytest.approx(r.want) for r in got)


def test_upsert_and_evidence(spark):
    t = datetime(2026, 1, 1)
    late = t + timedelta(days=1)
    old = [(1, 10, None, t, t, "removed", t), (2, 20, t, t, t, "active", t), (3, 30, None, t, t, "active", None)]
    current = spark.createDataFrame(old, "listing_id long, price long, published_at timestamp, listed_at timestamp, first_seen_at timestamp, status string, confirmed_at timestamp")
    new = spark.createDataFrame([(1, 9, None), (2, 20, late), (4, 40, None)], "listing_id long, price long, published_at timestamp")
    got = {r.listing_id: (r.price, r.listed_at, r.first_seen_at, r.status, r.confirmed_at) for r in ingest.upsert(current, new, F.lit(late)).collect()}
    assert got == {1: (9, t, t, "active", None), 2: (20, late, t, "active", None), 3: (30, t, t, "active", None), 4: (40, late, late, "active", None)}

    ads = [(1, "active", 100, 70, t, None), (2, "active", 100, 70, late, None), (3, "reserved", 100, 70, t, None), (4, "removed", 100, 70, t, None), (5, "active", 100, 70, t, late)]
    listings = spark.createDataFrame(ads, "listing_id long, status string, price long, deal_score int, synced_at timestamp, checked_at timestamp")
    noon = t + timedelta(hours=12)
    checks = [(1, noon, "active", 90), (1, t - timedelta(days=1), "missing", None), (2, noon, "missing", None), (3, noon, "active", 100), (4, noon, "active", 100), (5, noon, "missing", None)]
    out = {r.listing_id: (r.status, r.price, r.deal_score, r.checked_at) for r in ingest.host_evidence(listings, spark.createDataFrame(checks, "listing_id long, at timestamp, availability string, seen_price long")).collect()}
    assert out == {1: ("active", 90, None, noon), 2: ("active", 100, 70, None), 3: ("active", 100, 70, noon), 4: ("removed", 100, 70, None), 5: ("active", 100, 70, late)}


def test_strict_medians_without_pairs(spark):
    """The nearest by year, mileage and id of another vehicle, against plain search; no join or window of pairs in the plan."""
    rng = random.Random(5)
    keys = ("M", "a", "suv", "petrol", "manual", 100)
    rows = [(f"l{i:04d}", rng.randrange(60), *keys[:2], rng.choice(["suv", "estate"]), *keys[3:], rng.choice([2010, 2011, 2012, None]), rng.randrange(0, 40_000, 8_000), rng.randrange(5_000, 90_000)) for i in range(400)]
    pool = spark.createDataFrame(rows, "listing_id string, vehicle_id long, make string, model string, body_style string, fuel_type string, transmission string, horsepower int, model_year int, mileage_km long, price long")
    targets = pool.filter("vehicle_id % 3 = 0")
    out = benchmark.strict_median(targets, pool)
    want = {}
    for t in targets.collect():
        far = lambda r: -1 if None in (r[8], t.model_year) else abs(r[8] - t.model_year) * 60_000 + abs(r[9] - t.mileage_km)  # noqa: B023, E731
        near = sorted((far(r), r[0], r[10]) for r in rows if r[1] != t.vehicle_id and r[4] == t.body_style)[:40]
        want[t.listing_id] = statistics.median(x[2] for x in near)
    assert {r.listing_id: r.predicted for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_draws_are_not_shuffled(spark, monkeypatch):
    """Sums of draws by parts of the differences are those of plain draws; what is shuffled is the differences."""
    monkeypatch.setattr(benchmark, "PLACES", 300)
    rng = random.Random(6)
    rows = [(k, 10.0, rng.uniform(5, 20), rng.uniform(5, 20)) for k in range(1000)]
    df = spark.createDataFrame(rows, "vehicle_id long, price double, a double, b double")
    deltas = [abs(math.log(b / p)) - abs(math.log(a / p)) for _, p, a, b in rows]
    x, means = benchmark.SEED, []
    for _ in range(benchmark.REPLICATES):
        total = 0.0
        for _ in rows:
            x = (benchmark.LCG_A * x + benchmark.LCG_C) % 2**32
            total += deltas[int(x / 2**32 * len(rows))]
        means.append(total / len(rows))
    out = benchmark.paired_bootstrap(*[df.select("vehicle_id", "price", F.col(c).alias("predicted")) for c in "ab"])
    got = out.first()
    assert abs(got.low - sorted(means)[benchmark.LOWER]) < 1e-12 and abs(got.high - sorted(means)[benchmark.UPPER]) < 1e-12 and got.paired == 1000
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()

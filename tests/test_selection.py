"""Percentiles by ranges, places by ranges, and the seeded bootstrap, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lotlens.functions import selection as s
from lotlens.operators import benchmark


def plain(values, p):
    v, at = sorted(values), p * (len(values) - 1)
    lo, hi = math.floor(at), math.ceil(at)
    return v[lo] if lo == hi else (hi - at) * v[lo] + (at - lo) * v[hi]


@pytest.mark.parametrize("limit", [5, 50, 100_000])
def test_percentiles(spark, monkeypatch, limit):
    monkeypatch.setattr(s, "RANGES", 7)
    rng = random.Random(limit)
    groups = {"many": [rng.gauss(0, 1) for _ in range(400)], "same": [2.5] * 90, "few": [1.0, 2.0], "one": [7.0], "ties": [float(rng.randint(0, 3)) for _ in range(200)], "wide": [10.0 ** rng.randint(-8, 12) * rng.choice([1, -1]) for _ in range(150)], None: [0.5, 1.5, 9.0]}
    rows = [(k, x) for k, v in groups.items() for x in v] + [("few", None), ("empty", None)]
    rng.shuffle(rows)
    fractions = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: (r.n, r.p0, r.p10, r.p50, r.p99, r.p100) for r in s.percentiles(df, ["k"], "x", fractions, limit).collect()}
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        assert got[k][0] == len(v) and got[k][1:] == pytest.approx([plain(v, p) for p in fractions.values()], rel=1e-12)
    every = [x for v in groups.values() for x in v]
    assert s.percentiles(df, [], "x", {"m": 0.5}, limit).first().m == pytest.approx(plain(every, 0.5), rel=1e-12)
    assert s.percentiles(df.filter("false"), [], "x", {"m": 0.5}, limit).count() == 0


def test_numbered(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = {r.x: r.place for r in s.numbered(rows, "x", tasks=7).collect()}
    assert got == {k: k for k in range(1000)}


def test_bootstrap_against_plain_draws(spark):
    rng = random.Random(2)
    cars = [(k, 100.0 + k, rng.choice([None, 90.0 + k, 120.0 + k]), rng.choice([None, 0.0, 80.0 + k, 101.0 + k])) for k in range(150)]
    df = spark.createDataFrame(cars, "vehicle_id long, price double, a double, b double")
    deltas = [abs(math.log(b / p)) - abs(math.log(a / p)) for _, p, a, b in cars if a and b]
    seed, means = 37, []
    for _ in range(500):
        total = 0.0
        for _ in deltas:
            seed = (seed * 1664525 + 1013904223) % 2**32
            total += deltas[math.floor(seed / 4294967296 * len(deltas))]
        means.append(total / len(deltas))
    means.sort()
    side = lambda c: df.select("vehicle_id", "price", F.col(c).alias("predicted"))
    got = benchmark.paired_bootstrap(side("a"), side("b")).first()
    assert got.paired == len(deltas) and (got.difference, got.low, got.high) == pytest.approx((sum(deltas) / len(deltas), means[12], means[487]), abs=1e-12)
    assert benchmark.paired_bootstrap(side("a").filter("false"), side("b")).first().paired == 0


def test_hybrid_carries_prices_by_the_model(spark):
    car = lambda i, v, year, km, price: (i, v, "m", "x", "suv", "petrol", "manual", 100, year, km, price)
    schema = "listing_id string, vehicle_id int, make string, model string, body_style string, fuel_type string, transmission string, horsepower int, model_year int, mileage_km long, price long"
    pool = spark.createDataFrame([car("t", 0, 2010, 50_000, 1), car("a", 1, 2008, 40_000, 100), car("b", 2, 2010, 60_000, 200), car("c", 3, 2012, 50_000, 400), car("old", 4, 1990, 50_000, 1)], schema)
    modelled = spark.createDataFrame([("t", 150.0), ("a", 100.0), ("b", 150.0), ("c", 300.0), ("old", 10.0)], "listing_id string, modelled double")
    got = {r.listing_id: r.predicted for r in benchmark.hybrid(pool.filter("listing_id in ('t', 'old')"), pool.filter("listing_id <> 'old'"), modelled).collect()}
    assert got == {"t": 200.0}

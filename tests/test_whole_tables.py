"""Queries over whole tables, against plain Python over the smallest ones."""

from test_valuation import plain_value

from lotlens.operators import valuation as v
from lotlens.plans import queries as q
from lotlens.plans.queries_valuation import v4_valuation

SF = "/root/testdata/sf0.001"


def test_every_listing_is_valued(spark):
    """All pairs of a cohort in plain Python, and those of the make where a listing has fewer than three."""
    pool = [x.asDict() for x in q._pool(spark, SF).collect()]
    pairs = v.comparables(q._pool(spark, SF), q._pool(spark, SF)).collect()
    weights = {(x.t_listing_id, x.listing_id): x.weight for x in pairs}
    assert all(w > 0 for w in weights.values())
    other = lambda a, b: a["listing_id"] != b["listing_id"] and a["vehicle_id"] != b["vehicle_id"]
    same = lambda a, b: all(a[n] == b[n] for n in ("make", "model", "fuel_type")) and other(a, b)
    first = {}
    for c in sorted(pool, key=lambda c: (c["age_days"], c["listing_id"])):
        first.setdefault(c["vehicle_id"], c)
    want, fallbacks = {}, 0
    for t in pool:
        near = [c for c in pool if same(t, c)]
        row = lambda c, w: (c["listing_id"], c["price"], 2002.0 - c["model_year"], c["mileage_km"], w)
        if len(near) >= 3:
            rows = [row(c, weights[t["listing_id"], c["listing_id"]]) for c in near if (t["listing_id"], c["listing_id"]) in weights]
        else:
            fallbacks += 1
            rows = [row(c, 0.2 * 0.5 ** (c["age_days"] / 45)) for c in first.values() if c["make"] == t["make"] and other(t, c) and abs(c["model_year"] - t["model_year"]) <= 5 and 0.6 * t["price"] <= c["price"] <= 1.4 * t["price"]]
        if x := plain_value(2002 - t["model_year"], t["mileage_km"], rows):
            want[t["listing_id"]] = x
    got = {x.listing_id: (x.market_value, x.range_low, x.range_high, x.comparable_count, x.method) for x in v4_valuation(spark, SF).collect()}
    assert got == want and len(got) > 60 and fallbacks > 60


def test_every_order_has_its_vehicle(spark):
    orders = [(x.o_orderkey, x.o_custkey) for x in q.table(spark, SF, "orders").collect()]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for k, c in orders:
        for token in (("v", c), ("p", k % 4000)):
            root[find(token)] = find(k)
    least = {}
    for k, _ in orders:
        least[find(k)] = min(k, least.get(find(k), k))
    assert {x.listing_id: x.vehicle_key for x in q.g1_vehicle_keys(spark, SF).collect()} == {k: least[find(k)] for k, _ in orders}

"""The independent market of an ad against plain Python."""

import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from test_valuation import middle, plain_value

from lotlens.operators import cohort

SCHEMA = "listing_id string, vehicle_id long, make string, model string, fuel_type string, generation string, transmission string, body_style string, model_year int, mileage_km long, seller_type string, price long, seen_at timestamp"
NOW = datetime(2026, 9, 2)


def ads(seed=4):
    rng = random.Random(seed)
    rows = []
    for k in range(420):
        model = "hot" if k < 330 else f"m{k % 25}"
        rows.append((f"a{k:04d}", k, "M" if k % 7 else "N", model, rng.choice(["petrol", "petrol", "diesel"]), rng.choice(["I", "II", None]), rng.choice(["automatic", "manual"]), rng.choice(["suv", "estate", "other"]), rng.randint(1995, 2025), rng.randrange(0, 250_000, 500), rng.choice(["dealer", "private"]), rng.randint(20_000, 300_000), NOW - timedelta(hours=rng.randint(0, 3000))))
    return rows


def similarity(t, c, age):
    alike = lambda a, b, w, other=0.0, unknown=0.75: w * (unknown if a is None or b is None else 1.0 if a == b else other)
    body = 0.6 if "other" in (t[7], c[7]) else 1.0 if t[7] == c[7] else 0.1
    s = alike(t[5], c[5], 14) + 6 * 0.75 + 14 * 0.75 + alike(t[6], c[6], 6) + 7 * 0.65 + 8 + 6 * body + 12 * max(0, 1 - abs(t[8] - c[8]) / 6) + 18 * max(0, 1 - abs(t[9] - c[9]) / 60_000)
    return math.floor(round(s + 4 * (1.0 if t[10] == c[10] else 0.6) + 5 * 0.5 ** (age / 45), 9) + 0.5)


def plain(t, pool, newest):
    since = lambda c: max(0.0, (t[12] - c[12]).total_seconds() / 86_400)
    last = lambda rows: sorted(rows, key=lambda c: (-c[12].timestamp(), c[0]))[:newest]
    same = [c for c in last([c for c in pool if c[2:4] == t[2:4] and abs(c[8] - t[8]) <= 8]) if c[1] != t[1] and c[4] == t[4]]
    told = [(c, s, 0 if s >= 82 else 1 if s >= 65 else 2 if s >= 45 else 3) for c in same for s in [similarity(t, c, since(c))]]
    rows, label = [], "insufficient"
    for k, name in enumerate(("exact", "wide_model_fuel", "model_fuel", "model_fuel")):
        some = [x for x in told if x[2] <= k]
        if len(some) >= 8 or len(some) == len(told) or k == 3:
            if len(some) >= 3:
                label, rows = name, [(c[0], c[11], 2026.0 - c[8], c[9], (1.0, 0.65, 0.35, 0.15)[tier] * 0.5 ** (since(c) / 45)) for c, _, tier in some]
            break
    if not rows:
        wide = [c for c in last([c for c in pool if c[2] == t[2] and abs(c[8] - t[8]) <= 5 and 0.6 * t[11] <= c[11] <= 1.4 * t[11]]) if c[1] != t[1]]
        if len(wide) >= 3:
            label, rows = "make_fallback", [(c[0], c[11], 2026.0 - c[8], c[9], 0.2 * 0.5 ** (since(c) / 45)) for c in wide]
    value = plain_value(2026 - t[8], t[9], rows) if rows else None
    if not value:
        return (label, len(rows), None, 0, None)
    near = sorted(rows, key=lambda c: (-c[4], abs(c[2] - (2026 - t[8])) * 60_000 + abs(c[3] - t[9]), c[0]))[:40]
    mid = middle([c[1] for c in near])
    used = near if len(near) < 4 else [c for c in near if 0.4 * mid <= c[1] <= 2.5 * mid]
    return (label, len(rows), value[0], value[3], math.floor(100.0 * sum(c[1] <= t[11] for c in used) / len(used) + 0.5))


def test_against_plain_python(spark):
    rows = ads()
    pool = spark.createDataFrame(rows, SCHEMA)
    for newest in (1_200, 40):
        got = {r.listing_id: (r.tier, r.eligible, r.market_value, r.comparable_count, r.price_percentile) for r in cohort.independent(pool.filter(F.col("vehicle_id") % 3 == 0), pool, 2026, newest).collect()}
        want = {t[0]: plain(t, rows, newest) for t in rows if t[1] % 3 == 0}
        assert got == want
        assert {x[0] for x in want.values()} >= {"wide_model_fuel", "make_fallback"}

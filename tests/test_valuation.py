import math
import random

import pytest
from pyspark.sql import functions as F

from lotlens.functions import rules as r
from lotlens.operators import valuation as v
from lotlens.plans import queries as q


def weighted(rows, p):
    s = sorted((x for x in rows if x[1] > 0), key=lambda x: x[0])
    target, upto = p * sum(w for _, w in s), 0.0
    for k, (x, w) in enumerate(s):
        before = upto
        upto += w
        if upto >= target:
            return x if k == 0 else s[k - 1][0] + (target - before) / (upto - before) * (x - s[k - 1][0])
    return s[-1][0]


def middle(x):
    x = sorted(x)
    return (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2


def plain_value(age, km, rows):
    """(value, low, high, n, method) of one target from rows (id, price, age, km, weight)."""
    near = sorted(rows, key=lambda c: (-c[4], abs(c[2] - age) * 60_000 + abs(c[3] - km), c[0]))[:40]
    if len(near) < 3:
        return None
    mid = middle([c[1] for c in near])
    near = near if len(near) < 4 else [c for c in near if 0.4 * mid <= c[1] <= 2.5 * mid]
    if len(near) < 3:
        return None
    plain, w = middle([c[1] for c in near]), [c[4] for c in near]
    mean = lambda k: sum(x * c[k] for x, c in zip(w, near, strict=True)) / sum(w)
    ma, mk, mp = mean(2), mean(3), mean(1)
    s = lambda f: sum(x * f(c) for x, c in zip(w, near, strict=True))
    aa, kk, ak = s(lambda c: (c[2] - ma) ** 2), s(lambda c: (c[3] - mk) ** 2), s(lambda c: (c[2] - ma) * (c[3] - mk))
    ap, kp = s(lambda c: (c[2] - ma) * (c[1] - mp)), s(lambda c: (c[3] - mk) * (c[1] - mp))
    slopes = None
    if len(near) >= 8 and kk >= 1e-3:
        if max(c[2] for c in near) - min(c[2] for c in near) < 2:
            slopes = (0.0, kp / kk)
        elif abs(aa * kk - ak * ak) >= 1e-3:
            det = aa * kk - ak * ak
            slopes = ((kk * ap - ak * kp) / det, (aa * kp - ak * ap) / det)
    adjusted = slopes is not None and slopes[0] <= 0 and slopes[1] < 0
    shift = lambda c: min(max(c[1] + slopes[0] * (age - c[2]) + slopes[1] * (km - c[3]), 0.5 * c[1]), 1.6 * c[1]) if adjusted else c[1]
    values = [(shift(c), c[4]) for c in near]
    bound = lambda x: min(max(x, 0.5 * plain), 1.6 * plain) if adjusted else x
    ends = [max(1000, math.floor(bound(weighted(values, p)) / 1000 + 0.5) * 1000) for p in (0.5, 0.25, 0.75)]
    return (*ends, len(near), "adjusted" if adjusted else "raw_median")


def test_value_against_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    pairs = v.comparables(q._pool(spark, sf).orderBy(F.md5("listing_id"), "listing_id").limit(60), q._pool(spark, sf)).cache()
    rows = {}
    for x in pairs.collect():
        rows.setdefault((x.t_listing_id, 2002 - x.t_model_year, x.t_mileage_km), []).append((x.listing_id, x.price, 2002.0 - x.model_year, x.mileage_km, x.weight))
    want = {k[0]: plain_value(k[1], k[2], c) for k, c in rows.items()}
    got = {x.listing_id: (x.market_value, x.range_low, x.range_high, x.comparable_count, x.method) for x in v.value(pairs, 2002).collect()}
    assert got == {k: x for k, x in want.items() if x}


def test_recovers_a_known_surface(spark):
    """Prices that fall 20,000 a year and half a unit a kilometre from 400,000."""
    rng = random.Random(5)
    pool = []
    for k in range(36):
        age, km = rng.randint(1, 8), rng.randint(10_000, 120_000)
        pool.append((f"c{k}", k, "t", 4, 60_000, 2002 - age, km, int(400_000 - 20_000 * age - 0.5 * km), 1.0))
    pairs = spark.createDataFrame(pool, "listing_id string, vehicle_id long, t_listing_id string, t_age4 int, t_mileage_km long, model_year int, mileage_km long, price long, weight double").withColumn("t_model_year", F.lit(1998))
    got = v.value(pairs, 2002).first()
    assert got.method == "adjusted" and abs(got.market_value - 290_000) <= 3_000


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_curves_and_codes(spark):
    score = lambda x: one(spark, r.score(r.interpolate(F.lit(x), v.PRICE_CURVE)))[0]
    assert [score(x) for x in (-1.0, -0.3, 0.0, 0.025, 0.5, 2.0)] == [10, 10, 50, 54, 91, 91]
    code = lambda price, market, n=30, worded=False, monthly=None: one(spark, v.asking_price_code(F.lit(price), F.lit(2022), 2026, F.lit(market).cast("double"), F.lit(n), F.lit(worded), F.lit(monthly).cast("int")))[0]
    assert code(285_000, 300_000) == 0 and code(1, 300_000) == 1 and code(3_000_001, 300_000) == 2 and code(100_000, 300_000) == 3
    assert code(1_000_000, 300_000) == 4 and code(40_000, None, monthly=4_000) == 5 and code(150_000, 300_000, worded=True) == 6 and code(150_000, 300_000, n=7) == 7
    conf = lambda strong, spread, how="adjusted", wide=False: one(spark, v.confidence(F.lit(strong), F.lit(spread), F.lit(how), F.lit(wide)))[0]
    assert conf(18, 0.08) >= 85 and conf(18, 0.08, wide=True) < 60 and conf(1, 0.0) < 30 and conf(5, 0.1, "insufficient") == 0
    deal = lambda delta, n, usable=True: one(spark, v.deal_score(F.lit(delta), F.lit(n), F.lit(usable)))[0]
    assert deal(0.0, 40) == 50 and deal(0.3, 40) > deal(0.3, 4) > 50 and deal(0.3, 40, False) is None


def test_similarity_rejects_nothing_it_knows_to_be_alike(spark):
    base = dict(generation="G01", facelift=False, drivetrain="awd", transmission="automatic", trim="xLine", performance=None, body_style="suv", model_year=2021, mileage_km=85_140, seller_type="private", age_days=0.0)
    schema = "generation string, facelift boolean, drivetrain string, transmission string, trim string, performance string, body_style string, model_year int, mileage_km long, seller_type string, age_days double"
    target = spark.createDataFrame([tuple(base.values())], schema)
    target = target.select(*[F.col(c).alias(f"t_{c}") for c in target.columns])

    def similarity(**other):
        return spark.createDataFrame([tuple({**base, **other}.values())], schema).join(F.broadcast(target)).select(v.similarity()).first()[0]

    assert similarity() == 100
    assert similarity(generation="G02") == 86 and similarity(trim=None) == 98 and similarity(model_year=2015) == 88
    assert similarity(performance="M") == 93 and similarity(mileage_km=145_140) == 82


def test_mileage_bands_and_floors(spark):
    band = lambda km: one(spark, r.mileage_band(F.lit(km)))[0]
    assert [band(x) for x in (0, 24_999, 25_000, 99_999, 149_999, 150_000)] == [0, 0, 1, 3, 4, 5]
    floor = lambda year: one(spark, r.price_floor(F.lit(year), 2026))[0]
    assert [floor(x) for x in (2026, 2015, 1996)] == [25_000, 3_000, 3_000]
    assert one(spark, r.haversine_km(F.lit(59.33), F.lit(18.07), F.lit(57.71), F.lit(11.97)))[0] == pytest.approx(397, abs=5)

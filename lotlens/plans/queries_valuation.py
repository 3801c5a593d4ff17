"""Registered queries of valuations and what is made of them, with the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotlens.functions.lineage import settle
from lotlens.operators import benchmark, cohort, insights, nearest, valuation
from lotlens.plans.queries import _CURVE, _KM, _PAIRS, ACTIVE_SQL, AS_OF, _pool, query, rounded
from lotlens.sources.tables import LISTING_SQL, listings

_NEAR = f"""{_PAIRS}, near AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY weight DESC, close, listing_id) AS k FROM kept QUALIFY k <= 40)"""

_COMPARED = f"""{_NEAR}, rep AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY age_days, listing_id) = 1), rich AS (SELECT target_id FROM n WHERE n_all >= 3),
seg AS (SELECT t.listing_id AS target_id, t.model_year AS t_year, t.mileage_km AS t_km, c.listing_id, c.price, c.model_year, c.mileage_km, 'D' AS tier, 0.2::DOUBLE * power(0.5, c.age_days / 45.0) AS weight, abs(c.model_year - t.model_year) * 60000.0 + abs(c.mileage_km - t.mileage_km) AS close
  FROM t JOIN rep c ON c.make = t.make AND c.listing_id <> t.listing_id AND c.vehicle_id <> t.vehicle_id AND abs(c.model_year - t.model_year) <= 5 AND c.price BETWEEN t.price * 0.6::DOUBLE AND t.price * 1.4::DOUBLE WHERE t.listing_id NOT IN (SELECT target_id FROM rich)
  QUALIFY row_number() OVER (PARTITION BY t.listing_id ORDER BY weight DESC, close, c.listing_id) <= 40),
compared AS (SELECT target_id, t_year, t_km, listing_id, price, model_year, mileage_km, tier, weight, FALSE AS fallback FROM near JOIN rich USING (target_id) UNION ALL SELECT target_id, t_year, t_km, listing_id, price, model_year, mileage_km, tier, weight, TRUE FROM seg)"""

#: V4 in SQL: cut by the median, fit, shift, weighted percentiles.
VALUED_SQL = f"""{_COMPARED}, sized AS (SELECT *, count(*) OVER w AS size, quantile_cont(price, 0.5) OVER w AS mid FROM compared WINDOW w AS (PARTITION BY target_id)),
used AS (SELECT target_id, t_year, t_km, listing_id, CAST(price AS DOUBLE) AS price, CAST(2002 - model_year AS DOUBLE) AS age, CAST(mileage_km AS DOUBLE) AS km, tier, weight, fallback FROM sized WHERE size >= 3 AND (size < 4 OR price BETWEEN 0.4::DOUBLE * mid AND 2.5::DOUBLE * mid)),
m AS (SELECT target_id, count(*) AS cnt, quantile_cont(price, 0.5) AS plain, sum(weight * age) / sum(weight) AS ma, sum(weight * km) / sum(weight) AS mk, sum(weight * price) / sum(weight) AS mp, max(age) - min(age) AS spread, sum(weight) AS total, power(sum(weight), 2) / sum(weight * weight) AS effective,
  count(*) FILTER (tier = 'A') AS used_a, count(*) FILTER (tier = 'B') AS used_b, count(*) FILTER (tier = 'C') AS used_c, count(*) FILTER (tier = 'D') AS used_d, any_value(fallback) AS fallback FROM used GROUP BY 1 HAVING count(*) >= 3),
x AS (SELECT target_id, sum(weight * (age - ma) * (age - ma)) AS aa, sum(weight * (km - mk) * (km - mk)) AS kk, sum(weight * (age - ma) * (km - mk)) AS ak, sum(weight * (age - ma) * (price - mp)) AS ap, sum(weight * (km - mk) * (price - mp)) AS kp FROM used JOIN m USING (target_id) GROUP BY 1),
f AS (SELECT *, CASE WHEN cnt < 8 OR kk < 0.001 THEN NULL WHEN spread < 2 THEN 0.0 WHEN abs(aa * kk - ak * ak) >= 0.001 THEN (kk * ap - ak * kp) / (aa * kk - ak * ak) END AS b_age,
  CASE WHEN cnt < 8 OR kk < 0.001 THEN NULL WHEN spread < 2 THEN kp / kk WHEN abs(aa * kk - ak * ak) >= 0.001 THEN (aa * kp - ak * ap) / (aa * kk - ak * ak) END AS b_km FROM m JOIN x USING (target_id)),
s AS (SELECT u.target_id, u.listing_id, u.weight, coalesce(b_age <= 0 AND b_km < 0, FALSE) AS adjusted, total, CASE WHEN coalesce(b_age <= 0 AND b_km < 0, FALSE)
  THEN least(greatest(price + b_age * ((2002 - t_year) - age) + b_km * (t_km - km), 0.5::DOUBLE * price), 1.6::DOUBLE * price) ELSE price END AS v FROM used u JOIN f USING (target_id) WHERE u.weight > 0),
o AS (SELECT *, sum(weight) OVER w AS upto, lag(v) OVER w AS before FROM s WINDOW w AS (PARTITION BY target_id ORDER BY v, listing_id ROWS UNBOUNDED PRECEDING)),
c AS (SELECT target_id, {", ".join(f"coalesce(arg_min(CASE WHEN before IS NULL THEN v ELSE before + ({q}::DOUBLE * total - (upto - weight)) / weight * (v - before) END, upto) FILTER (upto >= {q}::DOUBLE * total), max(v)) AS {n}" for n, q in (("p50", 0.5), ("p25", 0.25), ("p75", 0.75)))} FROM o GROUP BY 1),
bounded AS (SELECT *, coalesce(b_age <= 0 AND b_km < 0, FALSE) AS adjusted FROM f JOIN c USING (target_id)),
valued AS (SELECT target_id AS listing_id, (p75 - p25) / nullif(p50, 0) AS dispersion, {", ".join(f"greatest(1000.0, floor((CASE WHEN adjusted THEN least(greatest({p}, 0.5::DOUBLE * plain), 1.6::DOUBLE * plain) ELSE {p} END) / 1000 + 0.5) * 1000.0) AS {n}" for n, p in (("market_value", "p50"), ("range_low", "p25"), ("range_high", "p75")))},
  cnt AS comparable_count, CASE WHEN adjusted THEN 'adjusted' ELSE 'raw_median' END AS method, effective, fallback, used_a, used_b, used_c, used_d, CASE WHEN adjusted THEN CAST(floor(0.5 - b_age) AS BIGINT) END AS per_model_year, CASE WHEN adjusted THEN CAST(floor(b_km * 1000 + 0.5) AS BIGINT) END AS per_thousand_km FROM bounded)"""


def valuations(spark, sf):
    pool = _pool(spark, sf)
    return nearest.valuations(pool, pool, AS_OF.year)


@query(f"""WITH {_NEAR} SELECT target_id, listing_id, tier, k AS rank FROM near""")
def v1_nearest_comparables(spark, sf):
    """The forty that a valuation looks at, for every listing of the pool."""
    pool = settle(nearest.narrow(_pool(spark, sf)))
    return nearest.ranked(pool, pool)


@query(f"""WITH {_COMPARED} SELECT target_id, listing_id, tier, round(weight, 9) AS weight FROM compared WHERE fallback""")
def v3_make_fallback(spark, sf):
    """Listings with fewer than three of their model, by cars of their make."""
    pool = _pool(spark, sf)
    near = nearest.fallbacks(pool, pool)
    if near is None:
        return spark.createDataFrame([], "target_id string, listing_id string, tier string, weight double")
    found = near.select(F.col("t_listing_id").alias("target_id"), F.explode("near").alias("c"))
    return found.select("target_id", F.col("c.listing_id").alias("listing_id"), F.col("c.tier").alias("tier"), F.round("c.weight", 9).alias("weight"))


@query(f"""WITH {VALUED_SQL} SELECT listing_id, market_value, range_low, range_high, comparable_count, method, round(effective, 6) AS effective_sample, fallback, per_model_year, per_thousand_km FROM valued""")
def v4_valuation(spark, sf):
    """Every listing of the pool; held against a plain Python version in the tests, too."""
    out = valuations(spark, sf)
    return out.select("listing_id", "market_value", "range_low", "range_high", "comparable_count", "method", F.round("effective_sample", 6).alias("effective_sample"), "fallback", "per_model_year", "per_thousand_km")


_FLOATS = lambda points: [(float(a), b) for a, b in points]
_OWNERS = "nullif((horsepower // 5) % 9, 0)"
_TOLD = "CASE (mileage_km // 8000) % 4 WHEN 1 THEN 'complete' WHEN 2 THEN 'partial' WHEN 3 THEN 'missing' END"
_OWNER_AGE = "(1 + greatest(2002.0 - model_year, 0.0) / 4)"
_OWNER_SQL = f"""CASE WHEN owners IS NULL THEN 46 ELSE CAST(floor(0.55 * ({_CURVE(f"(owners / {_OWNER_AGE})", _FLOATS(valuation.RELATIVE_OWNERS))}) + 0.45 * ({_CURVE("owners", _FLOATS(valuation.ABSOLUTE_OWNERS))}) + 0.5) AS BIGINT) END"""


def _owners():
    return F.nullif(F.floor(F.col("horsepower") / 5) % 9, F.lit(0))


@query(f"""WITH {LISTING_SQL}, o AS (SELECT listing_id, model_year, {_OWNERS} AS owners FROM listing) SELECT listing_id, {_OWNER_SQL} AS owner_score FROM o""")
def v8_owner_score(spark, sf):
    age = (F.lit(AS_OF.year) - F.col("model_year")).cast("double")
    return listings(spark, sf).select("listing_id", valuation.owner_score(_owners(), age).alias("owner_score"))


def _ads(spark, sf):
    """What an analysis reads of an ad, told by its numbers."""
    hp, kind = F.col("horsepower"), F.floor(F.col("mileage_km") / 8000) % 4
    service = F.when(kind == 1, "complete").when(kind == 2, "partial").when(kind == 3, "missing")
    return _pool(spark, sf).select(
        "listing_id", "make", "model", "price", "model_year", "mileage_km", "fuel_type", (hp % 13 != 0).alias("eligible"), F.lit(None).cast("double").alias("monthly_cost"), (F.col("price") % 97 == 0).alias("suspicious"),
        _owners().alias("owners"), service.alias("service"), F.when(F.floor(F.col("mileage_km") / 8000) % 17 == 0, "suspicious").otherwise("plausible").alias("mileage_status"), (F.lit(50) + F.floor(hp / 5) % 20).cast("int").alias("equipment_score"),
        F.lit(60).alias("transparency"), F.when(F.col("seller_type") == "dealer", 70).otherwise(40).alias("protection"), F.when(service == "complete", 3).when(service == "missing", -4).otherwise(0).alias("service_modifier"),
        F.when(hp % 19 != 0, F.when(hp % 7 == 0, -5).otherwise(0)).alias("defect_modifier"),
    )


def _analysed(spark, sf):
    return insights.analysed(_ads(spark, sf), valuations(spark, sf), AS_OF.year)


_FLOOR = "greatest(3000, 25000 - 2000 * (2002 - model_year))"
_SCORE = lambda x: f"greatest(10, least(95, floor({x} + 0.5)))"
ANALYSED_SQL = f"""{VALUED_SQL}, ads AS (SELECT listing_id, make, model, price, model_year, mileage_km, fuel_type, horsepower % 13 <> 0 AS eligible, price % 97 = 0 AS suspicious, {_OWNERS} AS owners, {_TOLD} AS service,
  CASE WHEN (mileage_km // 8000) % 17 = 0 THEN 'suspicious' ELSE 'plausible' END AS mileage_status, 50 + (horsepower // 5) % 20 AS equipment_score, 60 AS transparency, CASE WHEN seller_type = 'dealer' THEN 70 ELSE 40 END AS protection,
  CASE (mileage_km // 8000) % 4 WHEN 1 THEN 3 WHEN 3 THEN -4 ELSE 0 END AS service_modifier, CASE WHEN horsepower % 19 <> 0 THEN CASE WHEN horsepower % 7 = 0 THEN -5 ELSE 0 END END AS defect_modifier FROM pool),
a1 AS (SELECT *, greatest(0, 2002 - model_year) AS age, coalesce(used_a + used_b, 0) AS strong, price / market_value AS share FROM ads LEFT JOIN valued USING (listing_id)),
a2 AS (SELECT *, CASE WHEN market_value IS NOT NULL THEN floor((0.4::DOUBLE * CASE WHEN strong <= 0 THEN 0.0 ELSE least(1.0, log2(strong + 1) / log2(21.0)) END + 0.35::DOUBLE * CASE WHEN dispersion IS NULL OR dispersion < 0 THEN 0.5 ELSE greatest(0.0, 1 - dispersion / 0.5) END
   + 0.25::DOUBLE * CASE method WHEN 'adjusted' THEN 1.0 WHEN 'raw_median' THEN 0.55 ELSE 0.0 END) * CASE WHEN fallback THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN strong >= 3 THEN 1.0 ELSE power(greatest(strong, 0) / 3.0, 1.5) END * 100 + 0.5) END AS vc,
  CASE WHEN price < {_FLOOR} THEN 1 WHEN price > 3000000 THEN 2 WHEN market_value > 0 AND share < 0.35 THEN 3 WHEN market_value > 0 AND price > market_value * 3 THEN 4 WHEN market_value > 0 AND share < 0.6 AND suspicious THEN 6
   WHEN market_value > 0 AND share < 0.6 AND coalesce(comparable_count, 0) < 8 THEN 7 ELSE 0 END AS reason FROM a1),
a3 AS (SELECT *, coalesce(eligible AND NOT fallback AND market_value IS NOT NULL AND reason = 0, FALSE) AS rated FROM a2), a4 AS (SELECT *, CASE WHEN rated THEN (market_value - price) / market_value ELSE 0.0 END AS delta, coalesce(comparable_count, 0) AS n FROM a3),
a5 AS (SELECT *, floor({_CURVE("CAST(age AS DOUBLE)", _FLOATS(valuation.AGE_CURVE))} + 0.5) AS age_score, CASE WHEN mileage_status = 'plausible' THEN floor(0.65 * ({_CURVE(_KM, _FLOATS(valuation.RELATIVE_MILEAGE))}) + 0.35 * ({_CURVE("mileage_km", _FLOATS(valuation.ABSOLUTE_MILEAGE))}) + 0.5) ELSE 50 END AS mileage_score,
  {_OWNER_SQL} AS owner_score, 50 + ({_SCORE("(" + _CURVE("delta", valuation.PRICE_CURVE) + ")")} - 50) * (n / (n + 6.0)) AS pv,
  {_CURVE("CAST(age AS DOUBLE)", _FLOATS(valuation.CONDITION_AGE))} AS ca, {_CURVE("mileage_km", _FLOATS(valuation.CONDITION_MILEAGE))} AS ck, CASE WHEN owners IS NULL THEN 45.0 ELSE {_CURVE("owners", _FLOATS(valuation.CONDITION_OWNERS))} END AS co,
  CASE service WHEN 'complete' THEN 100.0 WHEN 'partial' THEN 62.0 WHEN 'missing' THEN 25.0 ELSE 40.0 END AS cs FROM a4),
a6 AS (SELECT *, CASE WHEN rated AND mileage_status <> 'suspicious' AND vc >= 50 AND defect_modifier IS NOT NULL THEN CAST({_SCORE("50 + 0.5 * (pv - 50) + 0.12 * (mileage_score - 50) + 0.12 * (age_score - 50) + 0.12 * (owner_score - 50) + 0.08 * (equipment_score - 50) + 0.03 * (transparency - 50) + 0.03 * (protection - 50) + service_modifier + defect_modifier")} AS BIGINT) END AS deal_score,
  CASE WHEN NOT rated THEN 'unrated' WHEN coalesce(vc, 0) >= 70 THEN 'high' WHEN coalesce(vc, 0) >= 50 THEN 'medium' ELSE 'low' END AS confidence, CAST(floor((34000 + price * 0.065) * CASE WHEN fuel_type = 'electric' THEN 0.8 ELSE 1.0 END + 0.5) AS BIGINT) AS annual_cost,
  CASE WHEN age <= 1 THEN 0.18 WHEN age <= 3 THEN 0.14 WHEN age <= 6 THEN 0.1 WHEN age <= 10 THEN 0.06 WHEN age <= 15 THEN 0.03 ELSE 0.015 END AS lost_rate FROM a5),
a7 AS (SELECT *, CAST(floor(least(price * lost_rate, annual_cost * 0.6) + 0.5) AS BIGINT) AS depreciation FROM a6),
analysed AS (SELECT *, {", ".join(f"CAST(floor((annual_cost - depreciation) * ({x}::DOUBLE / {sum(insights.SHARES.values())!r}::DOUBLE) + 0.5) AS BIGINT) AS {n}" for n, x in insights.SHARES.items() if n != "insurance")} FROM a7)"""


@query(f"""WITH {ANALYSED_SQL} SELECT listing_id, CASE WHEN rated THEN market_value ELSE CAST(price AS DOUBLE) END AS market_value, CASE WHEN rated THEN range_low ELSE greatest(1000.0, floor(price * 0.9::DOUBLE / 1000 + 0.5) * 1000.0) END AS range_low,
 CASE WHEN rated THEN range_high ELSE greatest(1000.0, floor(price * 1.1::DOUBLE / 1000 + 0.5) * 1000.0) END AS range_high, CASE WHEN rated AND deal_score IS NOT NULL THEN CAST(floor(delta * 10000 + 0.5) AS BIGINT) END AS discount_bps, CASE WHEN rated THEN n ELSE 0 END AS comparable_count,
 confidence, CAST(CASE WHEN deal_score IS NULL OR NOT rated THEN 0 WHEN confidence = 'high' THEN 3 WHEN confidence = 'medium' THEN 2 ELSE 1 END AS BIGINT) AS confidence_rank, CASE WHEN rated THEN CAST(vc AS BIGINT) END AS valuation_confidence, deal_score,
 CAST(greatest(10, least(95, floor(0.34 * ca + 0.3 * ck + 0.2 * cs + 0.16 * co - CASE WHEN owners IS NULL AND service IS NULL THEN 4 ELSE 0 END + 0.5))) AS BIGINT) AS buy_confidence, annual_cost, reason AS price_reason FROM analysed""")
def v11_analysis(spark, sf):
    out = _analysed(spark, sf)
    return out.select("listing_id", "market_value", "range_low", "range_high", "discount_bps", "comparable_count", "confidence", "confidence_rank", "valuation_confidence", "deal_score", "buy_confidence", "annual_cost", "price_reason")


@query(f"""WITH {ANALYSED_SQL} SELECT listing_id, depreciation, annual_cost - depreciation - energy - maintenance - tax AS insurance, energy, maintenance, tax FROM analysed""")
def v13_cost_items(spark, sf):
    ads = _ads(spark, sf)
    cost = insights.annual_cost(F.col("price"), F.col("fuel_type"))
    age = F.greatest(F.lit(0), F.lit(AS_OF.year) - F.col("model_year"))
    items = ads.withColumn("cost", cost).select("listing_id", insights.ownership_items(F.col("cost"), F.col("price"), age).alias("i")).select("listing_id", "i.*")
    return items.select("listing_id", "depreciation", "insurance", "energy", "maintenance", "tax")


_IMPACT = lambda x: f"CASE WHEN {x} >= 75 THEN 'positive' WHEN {x} <= 45 THEN 'negative' ELSE 'neutral' END"
_FACTOR = lambda key, x: f"concat_ws(':', '{key}', {_IMPACT(x)}, CAST({x} AS BIGINT))"
_MODIFIER = lambda key, x: f"concat_ws(':', '{key}', CASE WHEN {x} IS NULL OR {x} < 0 THEN 'negative' WHEN {x} > 0 THEN 'positive' ELSE 'neutral' END, CASE WHEN {x} IS NULL THEN 10 ELSE greatest(10, least(95, 50 + {x} * 5)) END)"


@query(f"""WITH {ANALYSED_SQL} SELECT listing_id, concat_ws(';', concat_ws(':', 'price_vs_market', CASE WHEN NOT rated THEN 'neutral' WHEN delta > 0.03 THEN 'positive' WHEN delta < -0.03 THEN 'negative' ELSE 'neutral' END, CAST(floor(pv + 0.5) AS BIGINT)),
 {_FACTOR("mileage", "mileage_score")}, {_FACTOR("vehicle_age", "age_score")}, {_FACTOR("ownership_history", "owner_score")}, {_FACTOR("equipment", "equipment_score")}, {_FACTOR("listing_transparency", "transparency")}, {_FACTOR("seller_protection", "protection")},
 {_MODIFIER("service_history_modifier", "service_modifier")}, {_MODIFIER("known_defects_modifier", "defect_modifier")}) AS deal_factors,
 concat_ws(';', {_FACTOR("condition", "floor((ca + ck + cs) / 3 + 0.5)")}, {_FACTOR("ownership_history", "floor(co + 0.5)")}) AS buy_factors,
 CASE WHEN rated THEN CAST(floor(abs(delta) * 100 + 0.5) AS BIGINT) END AS price_percent FROM analysed""")
def v10_score_factors(spark, sf):
    told = lambda c: F.array_join(F.transform(c, lambda f: F.concat_ws(":", f["key"], f["impact"], f["score"].cast("string"))), ";").alias(c)
    return _analysed(spark, sf).select("listing_id", told("deal_factors"), told("buy_factors"), F.get("deal_factors", F.lit(0))["params"]["percent"].cast("long").alias("price_percent"))


_RULES = lambda: [
    ("below >= 2.5", "price-below-market", "66 + below * 2.6", "abs(below)"), ("below <= -2.5", "price-above-market", "70 + abs(below) * 2.6", "abs(below)"), ("below < 2.5 AND below > -2.5", "price-near-market", "52", None),
    ("previous > price", "recent-price-reduction", "58 + cut * 4", "cut"), ("size >= 3 AND mkm > 0 AND kma >= 15", "lower-annual-mileage", "57 + kma * 0.9", "kma"), ("size >= 3 AND mkm > 0 AND kma <= -15", "higher-annual-mileage", "57 - kma * 0.9", "-kma"),
    ("size >= 3 AND mc > 0 AND ca2 >= 8", "lower-ownership-cost", "62 + ca2 * 1.25", "ca2"), ("size >= 3 AND mc > 0 AND ca2 <= -8", "higher-ownership-cost", "62 - ca2 * 1.25", "-ca2"), ("service = 'complete'", "complete-service-history", "72", None),
    ("service = 'partial'", "partial-service-history", "78", None), ("service = 'missing'", "missing-service-history", "92", None), ("owners = 1", "single-owner", "68", None), ("owners >= 3", "multiple-owners", "66 + owners * 2", "owners"),
    ("protection = 70", "warranty-included", "64", None), ("confidence = 'high' AND shown_count >= 15", "strong-market-evidence", "56", "shown_count"),
]


def _rule_sql(i, when, name, relevance, number):
    text = f"'{insights.SAID[name]}'" if number is None else f"replace('{insights.SAID[name]}', '{{}}', CAST(CAST(floor({number} + 0.5) AS BIGINT) AS VARCHAR))"
    return f"CASE WHEN {when} THEN {{'r': -greatest(0, least(100, CAST(floor({relevance} + 0.5) AS BIGINT))), 'i': {i}, 't': {text}}} END"


@query(f"""WITH {ANALYSED_SQL}, own AS (SELECT *, CASE WHEN rated THEN market_value ELSE CAST(price AS DOUBLE) END AS market, CASE WHEN rated THEN n ELSE 0 END AS shown_count, CASE WHEN owners % 2 = 0 THEN price * 1.125::DOUBLE END AS previous, mileage_km / greatest(1, 2002 - model_year) AS a_year FROM analysed),
bm AS (SELECT make, model, count(*) AS size, quantile_cont(a_year, 0.5) AS mkm, quantile_cont(CAST(annual_cost AS DOUBLE), 0.5) AS mc FROM own GROUP BY 1, 2),
facts AS (SELECT *, (market - price) / market * 100 AS below, (previous - price) / previous * 100 AS cut, (mkm - a_year) / mkm * 100 AS kma, (mc - annual_cost) / mc * 100 AS ca2 FROM own JOIN bm USING (make, model))
SELECT listing_id, array_to_string(list_transform(list_sort(list_filter([{", ".join(_rule_sql(i, *r) for i, r in enumerate(_RULES()))}], lambda e: e IS NOT NULL)), lambda e: concat(-e.r, ' ', e.t)), '; ') AS insights FROM facts""")
def v16_insights(spark, sf):
    """What is said of each listing of the pool against its model, the most relevant first."""
    found = _analysed(spark, sf).select("listing_id", "market_value", "comparable_count", "confidence", "annual_cost")
    rows = _ads(spark, sf).join(found, "listing_id").withColumn("previous_price", F.when(F.col("owners") % 2 == 0, F.col("price") * 1.125)).withColumn("warranty", F.col("protection") == 70).withColumn("warranty_text", F.lit(None).cast("string"))
    rows = settle(rows)
    rows = rows.join(insights.benchmarks(rows, AS_OF.year), ["make", "model"])
    told = F.transform(insights.insights(rows, AS_OF.year), lambda i: F.concat_ws(" ", i["relevance"].cast("string"), i["message"]))
    return rows.select("listing_id", F.array_join(told, "; ").alias("insights"))


#: Two estimators of the same cars: the valuation and the strict median, one ad a vehicle, of the test part.
_BENCH = f"""{VALUED_SQL}, one AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY last_seen_at DESC, listing_id) = 1 AND CAST(('0x' || substr(sha256(CAST(vehicle_id AS VARCHAR)), 1, 8)) AS BIGINT) % 100 >= 60),
sp AS (SELECT t.listing_id, c.price FROM one t JOIN pool c ON c.make = t.make AND c.model = t.model AND c.body_style = t.body_style AND c.fuel_type = t.fuel_type AND c.transmission = t.transmission AND c.horsepower = t.horsepower AND c.vehicle_id <> t.vehicle_id
  QUALIFY row_number() OVER (PARTITION BY t.listing_id ORDER BY abs(c.model_year - t.model_year) * 60000 + abs(c.mileage_km - t.mileage_km), c.listing_id) <= 40),
sm AS (SELECT listing_id, quantile_cont(price, 0.5) AS strict FROM sp GROUP BY 1 HAVING count(*) >= 3)"""


def _estimates(spark, sf):
    pool = _pool(spark, sf)
    one = cohort.one_a_vehicle(pool.withColumn("seen_at", F.col("last_seen_at"))).filter(benchmark.bucket(F.col("vehicle_id")) >= 60)
    one = settle(one.select("listing_id", "vehicle_id", "price", "make", "model", "body_style", "fuel_type", "transmission", "horsepower", "model_year", "mileage_km"))
    value = valuations(spark, sf).select("listing_id", F.col("market_value").alias("predicted"))
    strict = benchmark.strict_median(one, pool)
    a = one.select("listing_id", "vehicle_id", "price").join(value, "listing_id", "left")
    b = one.select("listing_id", "vehicle_id", "price").join(strict, "listing_id", "left")
    return a, b


@query(f"""WITH {_BENCH}, zp AS (SELECT CAST(price AS DOUBLE) AS price, market_value AS predicted FROM one LEFT JOIN valued USING (listing_id)), ze AS (SELECT *, abs(ln(predicted / price)) AS l FROM zp)
SELECT count(*) AS targets, count(predicted) AS valued, round(count(predicted) / count(*), 9) AS coverage, round(avg(abs(predicted - price)), 4) AS mae, round(quantile_cont(abs(predicted / price - 1), 0.5), 9) AS median_absolute_percentage, round(avg(l), 9) AS mean_absolute_log, round(quantile_cont(ln(predicted / price), 0.5), 9) AS median_signed_log,
 round(quantile_disc(l, 0.95), 9) AS p95_absolute_log, round(quantile_cont(predicted * (exp(0.3::DOUBLE) - exp(-0.3::DOUBLE)), 0.5), 4) AS median_interval_width, round(avg(CASE WHEN l <= 0.3 THEN 1.0 ELSE 0.0 END) FILTER (l IS NOT NULL), 9) AS interval_coverage FROM ze""")
def v20_errors(spark, sf):
    a, _ = _estimates(spark, sf)
    out = benchmark.errors(a, 0.3)
    return rounded(rounded(out, "mae", "median_interval_width", digits=4), "coverage", "median_absolute_percentage", "mean_absolute_log", "median_signed_log", "p95_absolute_log", "interval_coverage", digits=9)


def _draws_sql(doublings: int = 24) -> str:
    """The generator's numbers by doubling: what is known of it, and the same so many steps on, as far as the draws go."""
    sql, a, c = "g0 AS (SELECT CAST(0 AS BIGINT) AS k, CAST(37 AS HUGEINT) AS x)", benchmark.LCG_A, benchmark.LCG_C
    for j in range(doublings):
        sql += f", g{j + 1} AS MATERIALIZED (SELECT * FROM g{j} UNION ALL SELECT k + {2**j}, (x * {a} + {c}) % 4294967296 FROM g{j} WHERE k + {2**j} <= (SELECT 500 * count(*) FROM zd))"
        a, c = a * a % 2**32, (a * c + c) % 2**32
    return sql


@query(f"""WITH {_BENCH}, zd0 AS (SELECT vehicle_id, abs(ln(strict / price)) - abs(ln(market_value / price)) AS delta FROM one JOIN valued USING (listing_id) JOIN sm USING (listing_id)), zd AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vehicle_id) - 1 AS i, delta FROM zd0),
{_draws_sql()}, zn AS (SELECT count(*) AS n FROM zd), drawn AS (SELECT (k - 1) // n AS r, CAST(floor(CAST(x AS DOUBLE) / 4294967296.0 * n) AS BIGINT) AS i FROM g24, zn WHERE k >= 1 AND k <= 500 * n),
zm AS (SELECT r, sum(delta) / any_value(n) AS mean FROM drawn JOIN zd USING (i), zn GROUP BY r), zs AS (SELECT list_sort(list(mean)) AS m FROM zm)
SELECT count(*) AS paired, round(avg(delta), 9) AS difference, round(any_value(zs.m[13]), 9) AS low, round(any_value(zs.m[488]), 9) AS high FROM zd, zs""")
def v20_paired_bootstrap(spark, sf):
    return rounded(benchmark.paired_bootstrap(*_estimates(spark, sf)), "difference", "low", "high", digits=9)

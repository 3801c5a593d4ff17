"""Registered queries over the stand-in tables, and the SQL that checks each by another engine."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from lotlens.functions import rules as r
from lotlens.operators import catalogue, costs, history, ingest, market, reports, text, valuation
from lotlens.sources.tables import LISTING_SQL, OBSERVATION_SQL, equipment, listings, observations, table

AS_OF = datetime(2002, 1, 1)
FRESH_DAYS = 2192
EVENTS_AS_OF = datetime(2024, 2, 1)
DAY, DAY_END = datetime(2024, 1, 15), datetime(2024, 1, 16)
MARKET = market.Market(AS_OF, FRESH_DAYS)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ACTIVE_SQL = f"""{LISTING_SQL}, active AS (SELECT * FROM listing WHERE status = 'active' AND last_seen_at >= TIMESTAMP '1996-01-01'
  AND price <= 3000000 AND price >= greatest(3000, 25000 - 2000 * (2002 - model_year)) AND mileage_km BETWEEN 0 AND 1000000)"""
CELL_SQL = "CASE WHEN mileage_km >= 400000 THEN 21 ELSE CAST(floor(mileage_km / 20000.0) AS INT) + 1 END"
SCORED_SQL = f"""{ACTIVE_SQL}, priced AS (SELECT *, {CELL_SQL} AS mileage_cell, ln(price) AS log_price FROM active),
cells AS (SELECT make, model, model_year, mileage_cell, quantile_cont(log_price, 0.5) AS cell_median, count(*) AS cell_size FROM priced GROUP BY ALL),
scored AS (SELECT *, log_price - cell_median AS residual FROM priced JOIN cells USING (make, model, model_year, mileage_cell)),
usable AS (SELECT * FROM scored WHERE cell_size >= 4 AND abs(residual) <= ln(2.5))"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def live(spark, sf):
    return market.active(listings(spark, sf), MARKET)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


@query(f"""WITH {ACTIVE_SQL} SELECT count(*) AS listing_count, round(quantile_cont(price, 0.5), 4) AS median_price, round(quantile_cont(price, 0.25), 4) AS price_p25,
  round(quantile_cont(price, 0.75), 4) AS price_p75, round(quantile_cont(mileage_km, 0.5), 4) AS median_mileage_km, round(quantile_cont(model_year, 0.5), 4) AS median_model_year,
  round(greatest(quantile_cont(model_year, 0.02), min(model_year)), 4) AS year_floor, round(least(quantile_cont(model_year, 0.98), max(model_year)), 4) AS year_ceiling FROM active""")
def q1_market_snapshot(spark, sf):
    out = market.snapshot(live(spark, sf))
    return rounded(out, *out.columns[1:], digits=4)


@query(f"""WITH {ACTIVE_SQL}, b AS (SELECT count(*) AS matching_count, quantile_cont(price, 0.01) AS price_minimum,
  least(quantile_cont(price, 0.99), quantile_cont(price, 0.75) + 1.5 * (quantile_cont(price, 0.75) - quantile_cont(price, 0.25))) AS price_maximum,
  least(quantile_cont(mileage_km, 0.99), quantile_cont(mileage_km, 0.75) + 1.5 * (quantile_cont(mileage_km, 0.75) - quantile_cont(mileage_km, 0.25))) AS mileage_maximum FROM active)
SELECT listing_id, price, mileage_km, model_year, make, model, variant, seller_type, municipality, matching_count, round(price_minimum, 4) AS price_minimum,
  round(price_maximum, 4) AS price_maximum, round(mileage_maximum, 4) AS mileage_maximum FROM active, b
WHERE price BETWEEN price_minimum AND price_maximum AND mileage_km <= mileage_maximum ORDER BY md5(listing_id), listing_id LIMIT 1200""")
def q2_price_mileage_scatter(spark, sf):
    return rounded(market.scatter(live(spark, sf)), "price_minimum", "price_maximum", "mileage_maximum", digits=4)


@query(f"""WITH {ACTIVE_SQL}, e AS (SELECT CAST(floor(greatest(quantile_cont(model_year, 0.02), min(model_year))) AS INT) AS lo, CAST(ceil(least(quantile_cont(model_year, 0.98), max(model_year))) AS INT) AS hi FROM active),
w AS (SELECT lo, hi, greatest(1, CAST(ceil((hi - lo + 1) / 8.0) AS INT)) AS width FROM e),
c AS (SELECT 'y' || CAST((hi - model_year) // width AS VARCHAR) AS year_key, CASE WHEN mileage_km < 50000 THEN 'b1' WHEN mileage_km < 80000 THEN 'b2' WHEN mileage_km < 120000 THEN 'b3' WHEN mileage_km < 160000 THEN 'b4' ELSE 'b5' END AS band_key, price
  FROM active, w WHERE model_year BETWEEN lo AND hi AND (hi - model_year) // width < 8)
SELECT year_key, band_key, round(quantile_cont(price, 0.5), 4) AS median_price, count(*) AS listing_count FROM c GROUP BY ALL""")
def q3_value_map(spark, sf):
    return rounded(market.value_map(live(spark, sf)), "median_price", digits=4)


@query(f"""WITH {SCORED_SQL} SELECT listing_id, cell_size, round(residual, 6) AS residual FROM scored""")
def q4_residuals(spark, sf):
    return rounded(market.residuals(live(spark, sf)).select("listing_id", "cell_size", "residual"), "residual")


@query(f"""WITH {SCORED_SQL}, v AS (SELECT variant, count(*) AS listing_count, quantile_cont(price, 0.5) AS median_price, quantile_cont(model_year, 0.5) AS median_model_year, quantile_cont(residual, 0.5) AS m
  FROM usable WHERE length(trim(variant)) > 0 GROUP BY variant HAVING count(*) >= 12 ORDER BY m, variant LIMIT 40)
SELECT variant, listing_count, round(median_price, 4) AS median_price, round(median_model_year, 4) AS median_model_year, round((exp(m) - 1) * 100, 6) AS value_percent FROM v""")
def q5_variant_value(spark, sf):
    out = market.variant_value(live(spark, sf))
    return rounded(rounded(out, "median_price", "median_model_year", digits=4), "value_percent")


@query(f"""WITH {ACTIVE_SQL}, y AS (SELECT model_year, count(*) AS listing_count, quantile_cont(price, 0.5) AS median_price FROM active GROUP BY 1 HAVING count(*) >= 12),
s AS (SELECT *, row_number() OVER (ORDER BY model_year DESC) AS place, 100.0 * median_price / first_value(median_price) OVER (ORDER BY model_year DESC) AS retained FROM y),
t AS (SELECT *, lead(retained) OVER (ORDER BY model_year) - retained AS step FROM s WHERE place <= 8 AND listing_count >= 20),
b AS (SELECT (SELECT model_year FROM t WHERE step > 0 ORDER BY step DESC, model_year LIMIT 1) AS best)
SELECT model_year, listing_count, round(median_price, 4) AS median_price, round(retained, 6) AS retained_percent, coalesce(model_year = best, FALSE) AS sweet_spot FROM s, b""")
def q6_depreciation(spark, sf):
    return rounded(rounded(market.depreciation(live(spark, sf)), "median_price", digits=4), "retained_percent")


@query(f"""WITH {SCORED_SQL}, sample AS (SELECT listing_id, vehicle_id, residual FROM usable ORDER BY md5(listing_id), listing_id LIMIT 25000),
labels AS (SELECT DISTINCT p_partkey AS vehicle_id, unnest(string_split(p_name, ' ')) AS label FROM part),
j AS (SELECT listing_id, residual, label FROM sample JOIN labels USING (vehicle_id)), t AS (SELECT count(*) AS n, quantile_cont(residual, 0.5) AS m FROM (SELECT DISTINCT listing_id, residual FROM j)),
g AS (SELECT label, count(*) AS listing_count, quantile_cont(residual, 0.5) AS median FROM j GROUP BY label)
SELECT label, listing_count, round((exp(median - m) - 1) * 100, 6) AS premium_percent FROM g, t WHERE listing_count >= 12 AND listing_count >= 0.05 * n AND listing_count <= 0.85 * n ORDER BY abs(median - m) DESC, label LIMIT 10""")
def q7_equipment_value(spark, sf):
    return rounded(market.equipment_value(live(spark, sf), equipment(spark, sf)), "premium_percent")


@query(f"""WITH {SCORED_SQL}, b AS (SELECT quantile_cont(residual, 0.5) AS m FROM usable WHERE length(trim(municipality)) > 0),
p AS (SELECT municipality, count(*) AS listing_count, quantile_cont(price, 0.5) AS median_price, quantile_cont(residual, 0.5) AS r FROM usable WHERE length(trim(municipality)) > 0 GROUP BY 1 HAVING count(*) >= 12),
k AS (SELECT *, row_number() OVER (ORDER BY r, municipality) AS c, row_number() OVER (ORDER BY r DESC, municipality DESC) AS d FROM p)
SELECT municipality, listing_count, round(median_price, 4) AS median_price, round((exp(r - m) - 1) * 100, 6) AS difference_percent FROM k, b WHERE c <= 5 OR d <= 5""")
def q8_regional_prices(spark, sf):
    return rounded(rounded(market.regional_prices(live(spark, sf)), "median_price", digits=4), "difference_percent")


_T = {"age": "CAST(2002 - model_year AS DOUBLE)", "mileage": "mileage_km / 10000.0", "manual": "(transmission = 'manual')::INT::DOUBLE", "private": "(seller_type = 'private')::INT::DOUBLE", **{f: f"(fuel_type = '{f}')::INT::DOUBLE" for f in market.TERMS[4:]}}


@query(f"""WITH {ACTIVE_SQL}, priced AS (SELECT *, {CELL_SQL} AS mileage_cell, ln(price) AS y FROM active),
cells AS (SELECT make, model, model_year, mileage_cell, quantile_cont(y, 0.5) AS cm FROM priced GROUP BY ALL HAVING count(*) >= 4),
kept AS (SELECT make, model, y, {", ".join(f"{e} AS {n}" for n, e in _T.items())} FROM priced LEFT JOIN cells USING (make, model, model_year, mileage_cell) WHERE cm IS NULL OR abs(y - cm) <= ln(2.5)),
c AS (SELECT make, model, count(*) OVER w AS size, {", ".join(f"{n} - avg({n}) OVER w AS c_{n}" for n in ["y", *_T])} FROM kept WINDOW w AS (PARTITION BY make, model))
SELECT count(*) AS n, count(DISTINCT (make, model)) AS groups, round(sum(c_y * c_y), 3) AS yy, {", ".join(f"round(sum(c_{t} * c_y), 3) AS xy_{t}" for t in _T)},
{", ".join(f"round(sum(c_{a} * c_{b}), 3) AS xx_{a}_{b}" for i, a in enumerate(_T) for b in list(_T)[i:])} FROM c WHERE size >= 3""")
def q9_cross_products(spark, sf):
    out = market.cross_products(live(spark, sf), AS_OF.year)
    return out.select("n", "groups", *[(F.round(c, 3) + 0.0).alias(c) for c in out.columns[2:]])


_HELD = f"""{OBSERVATION_SQL}, held AS (SELECT *, observed_at AS valid_from, coalesce(lead(observed_at) OVER w, TIMESTAMP '2024-02-01') AS valid_to, lag(price) OVER w AS previous_price
  FROM observation WINDOW w AS (PARTITION BY listing_id ORDER BY observed_at, event_id))"""


@query(f"""WITH {_HELD}, spread AS (SELECT *, unnest(generate_series(date_trunc('day', valid_from)::TIMESTAMP, date_trunc('day', valid_to - INTERVAL 1 MICROSECOND)::TIMESTAMP, INTERVAL 1 DAY)) AS period
  FROM held WHERE kind <> 'disappeared' AND valid_to > valid_from),
lastly AS (SELECT * FROM spread QUALIFY row_number() OVER (PARTITION BY period, listing_id ORDER BY valid_from DESC, event_id DESC) = 1),
keyed AS (SELECT *, {CELL_SQL} AS mileage_cell, ln(price) AS lp FROM lastly), cells AS (SELECT make, model, fuel_type, mileage_cell, quantile_cont(lp, 0.5) AS m FROM keyed GROUP BY ALL HAVING count(*) >= 4),
monthly AS (SELECT period, count(*) AS observation_count, count(DISTINCT listing_id) AS listing_count, quantile_cont(price, 0.5) AS median_price, avg(CASE WHEN abs(lp - m) <= ln(2.5) THEN lp - m END) AS mr,
  quantile_cont(greatest(epoch_us(period + INTERVAL 1 DAY) - epoch_us(valid_from), 0) / 86400000000.0, 0.5) AS age FROM keyed LEFT JOIN cells USING (make, model, fuel_type, mileage_cell) GROUP BY period),
cuts AS (SELECT date_trunc('day', valid_from)::TIMESTAMP AS period, count(DISTINCT listing_id) AS reductions FROM held WHERE kind = 'price_change' AND price < previous_price GROUP BY 1)
SELECT CAST(period AS DATE) AS day, observation_count, listing_count, round(median_price, 4) AS median_price, round(mr, 6) AS mean_log_residual, round(age, 6) AS median_age_days, coalesce(reductions, 0) AS reductions FROM monthly LEFT JOIN cuts USING (period)""")
def q10_seasonality(spark, sf):
    out = history.seasonality(observations(spark, sf), EVENTS_AS_OF).withColumn("day", F.col("period").cast("date")).drop("period")
    return rounded(rounded(out, "median_price", digits=4), "mean_log_residual", "median_age_days")


_BAND = "CASE WHEN mileage_km < 25000 THEN 0 WHEN mileage_km < 50000 THEN 1 WHEN mileage_km < 75000 THEN 2 WHEN mileage_km < 100000 THEN 3 WHEN mileage_km < 150000 THEN 4 ELSE 5 END"
_SETS = "GROUPING SETS ((make, model), (make, model, fuel_type), (make, model, fuel_type, transmission), (make, model, fuel_type, transmission, mileage_bucket))"
_LEVEL = "CASE WHEN grouping(mileage_bucket) = 0 THEN 'mileage' WHEN grouping(transmission) = 0 THEN 'transmission' WHEN grouping(fuel_type) = 0 THEN 'fuel' ELSE 'model' END AS granularity"


@query(f"""WITH {OBSERVATION_SQL}, prior AS (SELECT * FROM observation WHERE observed_at < TIMESTAMP '2024-01-16'),
spell AS (SELECT listing_id, max(observed_at) FILTER (kind IN ('first_seen', 'relisted')) AS since FROM prior GROUP BY 1),
state AS (SELECT *, {_BAND} AS mileage_bucket, greatest(0, epoch_us(TIMESTAMP '2024-01-16') - epoch_us(coalesce(since, observed_at))) / 86400000000.0 AS days
  FROM (SELECT * FROM prior QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY observed_at DESC, event_id DESC) = 1) LEFT JOIN spell USING (listing_id) WHERE kind <> 'disappeared'),
a AS (SELECT {_LEVEL}, make, model, fuel_type, transmission, mileage_bucket, count(*) AS active_count, CAST(round_even(quantile_cont(price, 0.5), 0) AS BIGINT) AS median_price, CAST(round(avg(price)) AS BIGINT) AS average_price,
  min(price) AS minimum_price, max(price) AS maximum_price, CAST(round_even(quantile_cont(price, 0.1), 0) AS BIGINT) AS price_p10, CAST(round_even(quantile_cont(price, 0.9), 0) AS BIGINT) AS price_p90, quantile_cont(days, 0.5) AS median_days
  FROM state GROUP BY {_SETS} HAVING count(*) >= 2),
today AS (SELECT * FROM (SELECT *, {_BAND} AS mileage_bucket, lag(price) OVER (PARTITION BY listing_id ORDER BY observed_at, event_id) AS previous_price FROM observation) WHERE observed_at >= TIMESTAMP '2024-01-15' AND observed_at < TIMESTAMP '2024-01-16'),
e AS (SELECT {_LEVEL}, make, model, fuel_type, transmission, mileage_bucket, count(*) FILTER (kind = 'first_seen') AS new_count, count(*) FILTER (kind = 'disappeared') AS removed_count,
  count(*) FILTER (kind = 'price_change' AND price < previous_price) AS reduction_count, count(DISTINCT listing_id) FILTER (kind = 'price_change' AND price < previous_price) AS reduced,
  CAST(round_even(quantile_cont(previous_price - price, 0.5) FILTER (kind = 'price_change' AND price < previous_price), 0) AS BIGINT) AS median_reduction FROM today GROUP BY {_SETS})
SELECT a.* EXCLUDE (median_days), round(median_days, 6) AS median_days, coalesce(new_count, 0) AS new_count, coalesce(removed_count, 0) AS removed_count, coalesce(reduction_count, 0) AS reduction_count, median_reduction,
  round(coalesce(reduced / nullif(active_count, 0), 0), 6) AS reduction_share
FROM a LEFT JOIN e ON a.granularity = e.granularity AND a.make = e.make AND a.model = e.model AND a.fuel_type IS NOT DISTINCT FROM e.fuel_type AND a.transmission IS NOT DISTINCT FROM e.transmission AND a.mileage_bucket IS NOT DISTINCT FROM e.mileage_bucket""")
def q12_daily_snapshot(spark, sf):
    return rounded(history.daily_snapshot(observations(spark, sf), DAY, DAY_END, 2), "median_days", "reduction_share")


@query(f"""WITH {LISTING_SQL} SELECT CASE WHEN grouping(model) = 0 THEN 'model' WHEN grouping(make) = 0 THEN 'make' ELSE 'year' END AS facet, make, model, model_year, count(*) AS n, min(price) AS min_price, max(price) AS max_price
FROM listing WHERE status = 'active' GROUP BY GROUPING SETS ((make), (make, model), (model_year))""")
def q14_facets(spark, sf):
    return catalogue.facets(listings(spark, sf).filter("status = 'active'"))


@query(f"""WITH {LISTING_SQL} SELECT listing_id, make, model, variant, price, model_year, provider FROM listing WHERE status = 'active' AND contains(lower(make || ' ' || model || ' ' || variant), 'economy')
AND fuel_type IN ('petrol', 'diesel') AND body_style NOT IN ('other') AND price BETWEEN 10000 AND 60000 AND model_year <= 2000 ORDER BY price DESC, listing_id LIMIT 35 OFFSET 35""")
def q15_catalogue_page(spark, sf):
    s = catalogue.Search(text="economy", fuel_types=("petrol", "diesel"), excluded_bodies=("other",), min_price=10_000, max_price=60_000, min_year=2001, max_year=2000)
    found = catalogue.matching(listings(spark, sf).filter("status = 'active'"), s)
    return catalogue.page(found, "price_desc", 2, 35).select("listing_id", "make", "model", "variant", "price", "model_year", "provider")


_SIMILAR = """x.vehicle_id <> t.vehicle_id AND x.body_style = t.body_style AND x.fuel_type = t.fuel_type AND x.transmission = t.transmission AND abs(x.price / t.price - 1) <= 0.2 AND abs(x.model_year - t.model_year) <= 5"""


@query(f"""WITH {LISTING_SQL}, t AS (SELECT * FROM listing WHERE status = 'active' AND body_style <> 'other' AND vehicle_id % 20 = 0),
p AS (SELECT t.listing_id AS target_id, x.listing_id, x.vehicle_id, x.provider, round(3 * abs(ln(x.price / t.price)) + abs(x.model_year - t.model_year) / 6 + abs(x.mileage_km - t.mileage_km) / 100000
  + CASE WHEN x.make = t.make AND x.model = t.model THEN 0 ELSE 0.5 END + abs(ln(x.horsepower / t.horsepower)), 9) AS distance FROM t JOIN (SELECT * FROM listing WHERE status = 'active' AND price > 0) x ON {_SIMILAR}),
c AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY target_id, vehicle_id ORDER BY distance, listing_id) = 1), s AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY target_id, provider ORDER BY distance, listing_id) <= 6)
SELECT target_id, listing_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY target_id ORDER BY distance, listing_id) AS rank FROM s QUALIFY rank <= 12""")
def q17_similar_vehicles(spark, sf):
    """A search: its queries are the active listings whose vehicle has an id divisible by 20, against all of them."""
    ads = listings(spark, sf).filter("status = 'active'")
    found = catalogue.similar(ads.filter("vehicle_id % 20 = 0"), ads)
    return found.withColumn("distance", F.round(F.col("distance") * 1e6) / 1e6)  # rounded in binary, as the SQL does


@query(f"""WITH {LISTING_SQL}, car AS (SELECT provider, vehicle_id, count(*) AS ads, min(first_seen_at) AS f, max(last_seen_at) AS l, bool_or(length(trim(variant)) > 0) AS d FROM listing WHERE status = 'active' GROUP BY 1, 2),
s AS (SELECT vehicle_id, count(*) AS sources, min(f) FILTER (provider = 's0') AS main_at FROM car GROUP BY 1)
SELECT provider, CAST(sum(ads) AS BIGINT) AS active_listings, count(*) AS active_vehicles, count(*) FILTER (sources = 1) AS unique_vehicles, round(100.0 * count(*) FILTER (sources = 1) / count(*), 1) AS unique_rate,
 count(main_at) AS overlap_vehicles, CASE WHEN provider <> 's0' THEN round(100.0 * count(main_at) / count(*), 1) END AS overlap_rate, CASE WHEN provider <> 's0' THEN round(avg((epoch_us(main_at) - epoch_us(f)) / 3600000000.0)) END AS lead_hours,
 round(100.0 * count(*) FILTER (d) / count(*), 1) AS description_coverage, count(*) FILTER (l < TIMESTAMP '2001-06-01' - INTERVAL 48 HOUR) AS stale_vehicles, round(100.0 * count(*) FILTER (l < TIMESTAMP '2001-06-01' - INTERVAL 48 HOUR) / count(*), 1) AS stale_rate
FROM car JOIN s USING (vehicle_id) GROUP BY provider""")
def q18_source_value(spark, sf):
    return reports.source_value(listings(spark, sf), "s0", datetime(2001, 6, 1))


@query(f"""WITH {LISTING_SQL}, car AS (SELECT DISTINCT provider, vehicle_id FROM listing WHERE status = 'active'), n AS (SELECT provider, count(*) AS size FROM car GROUP BY 1)
SELECT x.provider AS a, y.provider AS b, count(*) AS shared, round(100.0 * count(*) / least(any_value(n1.size), any_value(n2.size)), 1) AS overlap FROM car x JOIN car y ON x.vehicle_id = y.vehicle_id AND y.provider > x.provider
JOIN n n1 ON n1.provider = x.provider JOIN n n2 ON n2.provider = y.provider GROUP BY 1, 2""")
def q19_source_pairs(spark, sf):
    return reports.source_pairs(listings(spark, sf))


_WINDOW = "first_seen_at >= TIMESTAMP '2000-01-01' AND first_seen_at < TIMESTAMP '2000-03-01'"
_PLAUSIBLE = "price BETWEEN greatest(3000, 25000 - 2000 * (2002 - model_year)) AND 3000000"


def _window(spark, sf):
    return listings(spark, sf).filter(reports.within("first_seen_at", datetime(2000, 1, 1), datetime(2000, 3, 1)))


@query(f"""WITH {LISTING_SQL} SELECT count(DISTINCT listing_id) AS n, round(avg(price) FILTER ({_PLAUSIBLE}), 4) AS average_price, min(price) FILTER ({_PLAUSIBLE}) AS minimum_price, max(price) FILTER ({_PLAUSIBLE}) AS maximum_price FROM listing WHERE {_WINDOW}""")
def q20_r2_price_summary(spark, sf):
    return rounded(reports.price_summary(_window(spark, sf), AS_OF.year), "average_price", digits=4)


@query(f"""WITH {LISTING_SQL} SELECT concat(make, ' ', model) AS name, count(DISTINCT listing_id) AS n, round(avg(price) FILTER ({_PLAUSIBLE}), 4) AS average_price FROM listing WHERE {_WINDOW} GROUP BY 1 ORDER BY n DESC, name LIMIT 8""")
def q20_r9_top_models(spark, sf):
    return rounded(reports.top_groups(_window(spark, sf), F.concat_ws(" ", "make", "model"), AS_OF.year, 8), "average_price", digits=4)


@query(f"""WITH {LISTING_SQL} SELECT coalesce(nullif(trim(seller_name), ''), 'Unknown seller') AS name, count(DISTINCT listing_id) AS n, round(avg(price) FILTER ({_PLAUSIBLE}), 4) AS average_price FROM listing WHERE {_WINDOW} GROUP BY 1 ORDER BY n DESC, name LIMIT 8""")
def q20_r10_top_sellers(spark, sf):
    return rounded(reports.top_groups(_window(spark, sf), reports.or_unknown("seller_name", "Unknown seller"), AS_OF.year, 8), "average_price", digits=4)


@query(f"""WITH {LISTING_SQL} SELECT provider AS name, count(*) AS n, round(avg(price), 4) AS average_price FROM listing WHERE status = 'active' GROUP BY 1""")
def q20_r12_active_by_provider(spark, sf):
    return rounded(listings(spark, sf).filter("status = 'active'").groupBy(F.col("provider").alias("name")).agg(F.count("*").alias("n"), F.avg("price").alias("average_price")), "average_price", digits=4)


@query(f"""WITH {OBSERVATION_SQL} SELECT listing_id, event_id, observed_at, price FROM observation WHERE kind = 'disappeared' QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY observed_at DESC, event_id DESC) = 1 ORDER BY listing_id LIMIT 500""")
def q20_r8_last_disappearance(spark, sf):
    return reports.last_disappearance(observations(spark, sf).filter("kind = 'disappeared'")).select("listing_id", "event_id", "observed_at", "price")


_CHANGES = f"""{_HELD}, changes AS (SELECT * FROM held WHERE kind = 'price_change')"""


def _changes(spark, sf):
    return history.intervals(observations(spark, sf), EVENTS_AS_OF).filter("kind = 'price_change'")


@query(f"""WITH {_CHANGES} SELECT count(*) AS n, count(*) FILTER (price < previous_price) AS reductions, count(*) FILTER (price > previous_price) AS increases, round(avg(price - previous_price), 4) AS average_change FROM changes""")
def q20_r13_price_changes(spark, sf):
    return rounded(reports.price_changes(_changes(spark, sf)), "average_change", digits=4)


@query(f"""WITH {_CHANGES}, d AS (SELECT CASE WHEN price - previous_price < -110000 THEN 0 WHEN price - previous_price >= 110000 THEN 12 ELSE CAST(floor((price - previous_price + 110000) / 20000.0) AS INT) + 1 END AS bucket FROM changes WHERE previous_price IS NOT NULL)
SELECT CAST(b.range AS BIGINT) AS bucket, count(d.bucket) AS n FROM range(13) b LEFT JOIN d ON d.bucket = b.range GROUP BY 1""")
def q20_r22_delta_histogram(spark, sf):
    return reports.delta_histogram(_changes(spark, sf))


@query(f"""WITH {OBSERVATION_SQL}, s AS (SELECT CAST(DATE '2024-02-01' - CAST(range AS INT) AS DATE) AS day FROM range(21)), c AS (SELECT CAST(observed_at AS DATE) AS day, count(DISTINCT listing_id) AS n FROM observation WHERE kind = 'disappeared' GROUP BY 1)
SELECT day, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (day)""")
def q20_r19_dense_days(spark, sf):
    return reports.dense_days(observations(spark, sf).filter("kind = 'disappeared'"), "observed_at", EVENTS_AS_OF, 21, "listing_id")


@query(f"""WITH {LISTING_SQL} SELECT vehicle_id, listing_id, last_seen_at FROM listing QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY last_seen_at DESC, listing_id) = 1""")
def w3_representatives(spark, sf):
    return catalogue.representatives(listings(spark, sf), F.desc("last_seen_at"), F.asc("listing_id")).select("vehicle_id", "listing_id", "last_seen_at")


_AGE = "date_diff('day', CAST(last_seen_at AS DATE), DATE '2002-01-01')"


def _pool(spark, sf):
    return live(spark, sf).filter("body_style <> 'other'").withColumn("age_days", F.datediff(F.lit(AS_OF).cast("date"), F.col("last_seen_at").cast("date")).cast("double"))


_DECAY = lambda d, s: f"greatest(0.0, 1 - abs({d}) / {s})"
_PAIRS = f"""{ACTIVE_SQL}, pool AS (SELECT *, CAST({_AGE} AS DOUBLE) AS age_days FROM active WHERE body_style <> 'other'), t AS (SELECT * FROM pool),
p AS (SELECT t.listing_id AS target_id, t.model_year AS t_year, t.mileage_km AS t_km, c.*, floor(14 * 0.75 + 6 * 0.75 + 14 * 0.75 + 6 * CASE WHEN c.transmission = t.transmission THEN 1.0 ELSE 0.0 END + 7 * 0.65 + 8 * 1.0
  + 6 * CASE WHEN c.body_style = t.body_style THEN 1.0 ELSE 0.1 END + 12 * {_DECAY("t.model_year - c.model_year", "6.0")} + 18 * {_DECAY("t.mileage_km - c.mileage_km", "60000.0")}
  + 4 * CASE WHEN c.seller_type = t.seller_type THEN 1.0 ELSE 0.6 END + 5 * power(0.5, c.age_days / 45.0) + 0.5) AS similarity
  FROM t JOIN pool c ON c.make = t.make AND c.model = t.model AND c.fuel_type = t.fuel_type AND c.listing_id <> t.listing_id AND c.vehicle_id <> t.vehicle_id),
q AS (SELECT *, CASE WHEN similarity >= 82 THEN 'A' WHEN similarity >= 65 THEN 'B' WHEN similarity >= 45 THEN 'C' ELSE 'D' END AS tier FROM p),
n AS (SELECT target_id, count(*) FILTER (tier = 'A') AS a, count(*) FILTER (tier = 'B') AS b, count(*) FILTER (tier = 'C') AS c, count(*) AS n_all FROM q GROUP BY 1),
kept AS (SELECT q.*, n_all, CASE tier WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.65 WHEN 'C' THEN 0.35 ELSE 0.15 END * power(0.5, age_days / 45.0) AS weight, abs(model_year - t_year) * 60000.0 + abs(mileage_km - t_km) AS close FROM q JOIN n USING (target_id)
  WHERE CASE tier WHEN 'A' THEN 0 WHEN 'B' THEN n.a WHEN 'C' THEN n.a + n.b ELSE n.a + n.b + n.c END < 8)"""


@query(f"""WITH {_PAIRS} SELECT target_id, listing_id, CAST(similarity AS BIGINT) AS similarity, tier, round(weight, 9) AS weight FROM kept""")
def v1_all_comparables(spark, sf):
    """Every scored pair that takes part, for every listing of the pool."""
    pool = _pool(spark, sf)
    out = valuation.comparables(pool, pool)
    return out.select(F.col("t_listing_id").alias("target_id"), "listing_id", "similarity", "tier", F.round("weight", 9).alias("weight"))


_CURVE = lambda x, points: f"CASE WHEN {x} <= {points[0][0]} THEN {points[0][1]}.0 " + " ".join(f"WHEN {x} <= {b} THEN {ya}.0 + ({yb}.0 - {ya}.0) * (({x} - {a}) / ({b} - {a}))" for (a, ya), (b, yb) in zip(points, points[1:], strict=False)) + f" ELSE {points[-1][1]}.0 END"
_KM = "mileage_km / (12000.0 * greatest(2002.0 - model_year, 1.0))"


@query(f"""WITH {LISTING_SQL}, s AS (SELECT listing_id, floor({_CURVE("(2002.0 - model_year)", [(float(a), b) for a, b in valuation.AGE_CURVE])} + 0.5) AS age_score,
 floor(0.65 * ({_CURVE(_KM, [(float(a), b) for a, b in valuation.RELATIVE_MILEAGE])}) + 0.35 * ({_CURVE("mileage_km", [(float(a), b) for a, b in valuation.ABSOLUTE_MILEAGE])}) + 0.5) AS mileage_score FROM listing)
SELECT listing_id, CAST(age_score AS BIGINT) AS age_score, CAST(mileage_score AS BIGINT) AS mileage_score FROM s""")
def v8_vehicle_scores(spark, sf):
    age = (F.lit(AS_OF.year) - F.col("model_year")).cast("double")
    return listings(spark, sf).select("listing_id", valuation.age_score(age).alias("age_score"), valuation.mileage_score(F.col("mileage_km"), age).alias("mileage_score"))


_REASONS = """list_filter([CASE WHEN price <= 0 THEN 'PRICE_NOT_POSITIVE' END, CASE WHEN price > 0 AND price < greatest(3000, 25000 - 2000 * (2002 - model_year)) THEN 'PRICE_BELOW_MODEL_YEAR_FLOOR' END,
 CASE WHEN mileage_km BETWEEN 0 AND 1000000 AND mileage_km <> 0 AND ((2002 - model_year >= 5 AND mileage_km < 1000) OR (2002 - model_year <= 1 AND mileage_km > 100000) OR (2002 - model_year <= 3 AND mileage_km > 200000)) THEN 'MILEAGE_IMPLAUSIBLE_FOR_AGE' END,
 CASE WHEN body_style = 'other' THEN 'BODY_STYLE_UNKNOWN' END], lambda x: x IS NOT NULL)"""


@query(f"""WITH {LISTING_SQL}, q AS (SELECT listing_id, {_REASONS} AS r FROM listing) SELECT listing_id, array_to_string(r, ',') AS reasons,
 CASE WHEN list_has_any(r, ['PRICE_NOT_POSITIVE', 'PRICE_BELOW_MODEL_YEAR_FLOOR', 'MILEAGE_IMPLAUSIBLE_FOR_AGE']) THEN 'rejected' WHEN len(r) > 0 THEN 'warning' ELSE 'valid' END AS status FROM q""")
def g17_quality_gate(spark, sf):
    reasons = ingest.quality_reasons(AS_OF.year, F.col("variant"))
    return listings(spark, sf).select("listing_id", F.array_join(reasons, ",").alias("reasons"), ingest.quality_status(reasons).alias("status"))


def _orders(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("listing_id"), F.when(F.col("o_orderstatus") == "P", "removed").otherwise("active").alias("status"), F.floor("o_totalprice").cast("long").alias("price"),
                    (F.col("o_custkey") * 10).alias("mileage_km"), F.col("o_orderpriority").alias("seller_type"), F.lit(None).cast("string").alias("seller_name"), F.col("o_orderdate").alias("seen_at"))


def _readings(spark, sf):
    """A later reading of most listings: some prices moved, some mileages too, some ads new."""
    k = F.col("listing_id")
    moved = _orders(spark, sf).filter(k % 11 != 0).withColumn("price", F.when(k % 5 == 0, F.col("price") - 1000).otherwise(F.col("price"))).withColumn("mileage_km", F.when(k % 7 == 0, F.col("mileage_km") + 1).otherwise(F.col("mileage_km")))
    return moved.withColumn("status", F.lit("active")).withColumn("listing_id", F.when(k % 13 == 0, -k - 1).otherwise(k)).withColumn("seen_at", F.col("seen_at") + F.expr("interval 1 day"))


_READ = """o AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'P' THEN 'removed' ELSE 'active' END AS status, CAST(floor(o_totalprice) AS BIGINT) AS price, o_custkey * 10 AS km FROM orders),
n AS (SELECT CASE WHEN k % 13 = 0 THEN -k - 1 ELSE k END AS k, CASE WHEN k % 5 = 0 THEN price - 1000 ELSE price END AS price, CASE WHEN k % 7 = 0 THEN km + 1 ELSE km END AS km FROM o WHERE k % 11 <> 0),
j AS (SELECT n.k AS listing_id, n.price, n.km, o.k IS NULL AS new, o.status AS s, o.price AS p, o.km AS m FROM n LEFT JOIN o ON o.k = n.k)"""


@query(f"""WITH {_READ} SELECT listing_id, kind FROM (SELECT listing_id, unnest(list_filter(CASE WHEN new THEN ['first_seen'] ELSE [CASE WHEN s <> 'active' THEN 'relisted' END, CASE WHEN price <> p THEN 'price_change' END, CASE WHEN km <> m THEN 'mileage_change' END] END, lambda x: x IS NOT NULL)) AS kind FROM j)""")
def g5_event_derivation(spark, sf):
    return ingest.events(_orders(spark, sf), _readings(spark, sf))


@query(f"""WITH {_READ} SELECT listing_id, CASE WHEN new THEN 'created' WHEN price <> p OR km <> m THEN 'updated' ELSE 'unchanged' END AS outcome FROM j""")
def g4_outcomes(spark, sf):
    return ingest.outcomes(_orders(spark, sf), _readings(spark, sf), "listing_id", "price", "mileage_km")


@query(f"""WITH {_READ}, a AS (SELECT o.k AS listing_id, n.k IS NOT NULL AS seen, 1 AS strikes, o.status FROM o LEFT JOIN n ON n.k = o.k)
SELECT listing_id, CASE WHEN seen THEN 0 ELSE 2 END AS strikes, CASE WHEN status = 'active' AND NOT seen THEN 'removed' ELSE status END AS status FROM a""")
def g11_two_strikes(spark, sf):
    current = _orders(spark, sf).withColumn("strikes", F.lit(1))
    return ingest.missed(current, _readings(spark, sf)).select("listing_id", "strikes", "status")


def _tokens(orders):
    return orders.select(F.col("o_orderkey").alias("listing_id"), F.explode(F.array(F.concat(F.lit("v"), F.col("o_custkey").cast("string")), F.concat(F.lit("p"), (F.col("o_orderkey") % 4000).cast("string")))).alias("token"))


@query()
def g1_vehicle_keys(spark, sf):
    """The vehicle of every order's listing: held against plain search over whole tables in the tests."""
    return ingest.identities(_tokens(table(spark, sf, "orders")))


@query("""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, CAST(len(regexp_extract_all(html, '(?i)<a\\s[^>]*href=["'']([^"'']*)["'']', 1)) AS BIGINT) AS links FROM pages""")
def s5_page_parse(spark, sf):
    pages = table(spark, sf, "pages")
    n = text.html_links(pages).groupBy("page_id").agg(F.count("*").alias("links"))
    return pages.select("page_id", text.html_title(F.col("html")).alias("title")).join(n, "page_id", "left").withColumn("links", F.coalesce("links", F.lit(0)))


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\\b(idag|garanti|moron|idiot)\\b') THEN 1 ELSE 0 END AS hit FROM documents""")
def x_text_pattern(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.when(F.lower("text").rlike(r"\b(idag|garanti|moron|idiot)\b"), 1).otherwise(0).alias("hit"))


@query("""SELECT p_partkey AS vehicle_id, label FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS label FROM part)""")
def j_equipment_labels(spark, sf):
    return equipment(spark, sf)


@query(f"""WITH {LISTING_SQL} SELECT count(*) AS n, count(DISTINCT make) AS makes, count(DISTINCT (make, model)) AS models, min(price) AS min_price, max(price) AS max_price, max(last_seen_at) AS last_seen_at FROM listing""")
def q14_summary(spark, sf):
    return catalogue.summary(listings(spark, sf))


_AGE_Y = "greatest(0, 2002 - model_year)"
_RET = lambda a: f"CASE WHEN {a} <= 0 THEN 1.0 WHEN {a} <= 1 THEN 1 - (1 - first) * {a} ELSE first * power(later, {a} - 1) END"
_UNIT = "CASE fuel_type WHEN 'petrol' THEN 18.5 WHEN 'diesel' THEN 19.5 WHEN 'electric' THEN 2.5 ELSE 18.5 END"


@query(f"""WITH {LISTING_SQL}, b AS (SELECT *, {_AGE_Y} AS age, CAST(greatest(price, greatest(3000, 25000 - 2000 * (2002 - model_year))) AS DOUBLE) AS basis, CASE WHEN fuel_type = 'electric' THEN 0.75 ELSE 0.8 END AS first,
  CASE WHEN fuel_type = 'electric' THEN 0.88 ELSE 0.87 END AS later, CASE WHEN fuel_type = 'electric' THEN 18.0 ELSE 6.5 END AS use FROM listing),
c AS (SELECT *, 6.5 * CASE WHEN fuel_type = 'diesel' THEN 26.4 ELSE 23.2 END AS co2 FROM b)
SELECT listing_id, CAST(floor(basis * (1 - ({_RET("(age + 1)")}) / ({_RET("age")})) + 0.5) AS BIGINT) AS depreciation, CAST(floor(150 * use * {_UNIT} + 0.5) AS BIGINT) AS energy,
 CAST(floor(5500 + greatest(0, horsepower - 150) * 15 + least(basis, 300000.0) * 0.01 + 0.5) AS BIGINT) AS insurance, CAST(floor(4000 + least(age, 15) * 350 + 900 + 0.5) AS BIGINT) AS maintenance,
 CAST(floor(CASE WHEN fuel_type = 'electric' THEN 360.0 WHEN fuel_type = 'diesel' THEN (360 + greatest(0.0, co2 - 111) * 22) * 2.37 ELSE 360 + greatest(0.0, co2 - 111) * 22 END + 0.5) AS BIGINT) AS tax,
 price < greatest(3000, 25000 - 2000 * (2002 - model_year)) AS implausible_price FROM c""")
def v12_ownership_cost(spark, sf):
    c = costs.ownership(F.col("price"), F.col("model_year"), F.col("fuel_type"), F.lit(None).cast("double"), F.col("horsepower"), AS_OF.year)
    return listings(spark, sf).select("listing_id", c.alias("c")).select("listing_id", "c.*")


@query(f"""WITH {SCORED_SQL}, m AS (SELECT CAST(month(last_seen_at) AS INT) AS month, count(*) AS n, avg(residual) AS r, count(*) FILTER (residual < -0.2) AS cuts, quantile_cont(CAST({_AGE} AS DOUBLE), 0.5) AS age FROM usable GROUP BY 1),
f AS (SELECT *, n >= 25 AND (sum(CAST(n >= 25 AS INT)) OVER ()) >= 2 AS fit, cuts / n AS rate FROM m),
a AS (SELECT avg(r) FILTER (fit) AS mr, avg(n) FILTER (fit) AS mn, avg(rate) FILTER (fit) AS mc, avg(age) FILTER (fit) AS ma FROM f),
s AS (SELECT month, fit, (exp(r - mr) - 1) * 100 AS rel, n / mn * 100 AS inv, greatest(0, least(100, 50 + greatest(-25, least(25, -(exp(r - mr) - 1) * 100 * 3)) + greatest(-12, least(12, (n / mn * 100 - 100) * 0.25)) + greatest(-12, least(12, (rate - mc) * 100 * 1.5)) + greatest(-8, least(8, (age - ma) * 0.4)))) AS t FROM f, a)
SELECT month, CASE WHEN fit THEN round(rel, 6) END AS relative_price, round(inv, 6) AS inventory_index, CASE WHEN fit THEN CAST(floor(t + 0.5) AS BIGINT) END AS score,
 CASE WHEN NOT fit THEN NULL WHEN floor(t + 0.5) >= 68 THEN 'great' WHEN floor(t + 0.5) >= 57 THEN 'good' WHEN floor(t + 0.5) >= 43 THEN 'normal' ELSE 'expensive' END AS verdict FROM s""")
def q11_buyer_scores(spark, sf):
    usable = market.comparable(market.residuals(live(spark, sf)))
    age = F.datediff(F.lit(AS_OF).cast("date"), F.col("last_seen_at").cast("date")).cast("double")
    months = usable.groupBy(F.month("last_seen_at").alias("month")).agg(
        F.count("*").alias("listing_count"), F.avg("residual").alias("mean_log_residual"), F.count_if(F.col("residual") < -0.2).alias("reductions"), r.median(age).alias("median_age_days")
    )
    return rounded(costs.buyer_scores(months), "relative_price", "inventory_index")


@query(f"""WITH {OBSERVATION_SQL}, s AS (SELECT make, CAST(observed_at AS DATE) AS day, quantile_cont(price, 0.5) AS median_price FROM observation GROUP BY 1, 2)
SELECT make, max(day) AS day, round(max_by(median_price, day), 4) AS median_price FROM s WHERE day <= DATE '2024-01-16' - 7 GROUP BY make""")
def q13_trend_reference(spark, sf):
    daily = observations(spark, sf).groupBy("make", F.col("observed_at").cast("date").alias("day")).agg(r.median("price").alias("median_price"))
    return rounded(history.trend_point(daily, ["make"], DAY_END, 7), "median_price", digits=4)


@query(f"""WITH {ACTIVE_SQL}, o AS (SELECT make, price AS v, mileage_km AS w, sum(mileage_km) OVER k AS upto, lag(price) OVER k AS before, sum(mileage_km) OVER (PARTITION BY make) AS total FROM active WHERE mileage_km > 0 WINDOW k AS (PARTITION BY make ORDER BY price, listing_id ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, row_number() OVER (PARTITION BY make ORDER BY upto) AS n FROM o WHERE upto >= 0.5 * total)
SELECT make, round(CASE WHEN before IS NULL THEN v ELSE before + (0.5 * total - (upto - w)) / w * (v - before) END, 4) AS p50 FROM c WHERE n = 1""")
def a14_weighted_median(spark, sf):
    return rounded(valuation.weighted_percentile(live(spark, sf), "make", "price", "mileage_km", {"p50": 0.5}, "listing_id"), "p50", digits=4)


@query(f"""WITH {OBSERVATION_SQL}, k AS (SELECT listing_id, event_id, observed_at, price FROM observation WHERE kind IN ('first_seen', 'price_change'))
SELECT listing_id, string_agg(CAST(price AS VARCHAR), ',' ORDER BY observed_at, event_id) AS prices, count(*) AS points FROM k GROUP BY 1""")
def w9_price_history(spark, sf):
    k = observations(spark, sf).filter(F.col("kind").isin("first_seen", "price_change"))
    told = F.array_sort(F.collect_list(F.struct("observed_at", "event_id", "price")))
    return k.groupBy("listing_id").agg(told.alias("h")).select("listing_id", F.array_join(F.transform("h", lambda x: x["price"].cast("string")), ",").alias("prices"), F.size("h").cast("long").alias("points"))


@query(f"""WITH {LISTING_SQL}, v AS (SELECT listing_id, CASE WHEN provider = 's0' THEN NULL ELSE last_seen_at END AS checked_at FROM listing WHERE status = 'active') SELECT listing_id, checked_at FROM v ORDER BY checked_at ASC NULLS FIRST, listing_id LIMIT 200""")
def t7_rotation_queue(spark, sf):
    checked = F.when(F.col("provider") != "s0", F.col("last_seen_at"))
    return listings(spark, sf).filter("status = 'active'").select("listing_id", checked.alias("checked_at")).orderBy(F.col("checked_at").asc_nulls_first(), "listing_id").limit(200)


@query(f"""WITH {ACTIVE_SQL} SELECT make, round(quantile_cont(price, 0.2), 4) AS q20, round(quantile_cont(price, 0.4), 4) AS q40, round(quantile_cont(price, 0.6), 4) AS q60, round(quantile_cont(price, 0.8), 4) AS q80 FROM active GROUP BY 1""")
def a20_colour_thresholds(spark, sf):
    q = live(spark, sf).groupBy("make").agg(F.percentile("price", F.array(*[F.lit(x) for x in (0.2, 0.4, 0.6, 0.8)])).alias("q"))
    return q.select("make", *[F.round(F.col("q")[k], 4).alias(f"q{20 * (k + 1)}") for k in range(4)])


@query(f"""WITH {LISTING_SQL}, v AS (SELECT * FROM listing WHERE status = 'active' AND price BETWEEN 20000 AND 40000),
u AS ((SELECT * FROM v ORDER BY price, listing_id LIMIT 75) UNION (SELECT * FROM v ORDER BY first_seen_at DESC, listing_id LIMIT 75) UNION (SELECT * FROM v ORDER BY mileage_km, listing_id LIMIT 75) UNION (SELECT * FROM v ORDER BY model_year DESC, listing_id LIMIT 75)),
o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY price, listing_id) = 1),
s AS (SELECT *, min(price) OVER () AS pa, max(price) OVER () AS pb, min(mileage_km) OVER () AS ka, max(mileage_km) OVER () AS kb FROM o),
z AS (SELECT listing_id, round(0.6 * CASE WHEN pa = pb THEN 0.5 ELSE (pb - price) / (pb - pa) END + 0.4 * CASE WHEN ka = kb THEN 0.5 ELSE (kb - mileage_km) / (kb - ka) END, 6) AS score FROM s) SELECT listing_id, score FROM z ORDER BY score DESC, listing_id LIMIT 20""")
def l3_search_inventory(spark, sf):
    band = listings(spark, sf).filter("status = 'active'").filter(F.col("price").between(20_000, 40_000))
    views = [F.col("price").asc(), F.col("first_seen_at").desc(), F.col("mileage_km").asc(), F.col("model_year").desc()]
    return catalogue.shortlist(band, views, 75, 20)


@query("""SELECT o_orderkey AS listing_id, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS has_children FROM orders""")
def j12_all_presence(spark, sf):
    """Whether an order has rows of its own."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("listing_id"))
    kids = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("listing_id")).distinct().withColumn("k", F.lit(True))
    return o.join(kids, "listing_id", "left").select("listing_id", F.col("k").isNotNull().alias("has_children"))


@query("""SELECT o_orderkey AS listing_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def j13_unmatched(spark, sf):
    kids = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("listing_id"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("listing_id")).join(kids, "listing_id", "left_anti")


@query("""WITH n AS (SELECT n_nationkey AS k, 55 + n_nationkey * 0.5 AS lat, 11 + n_nationkey * 0.3 AS lng FROM nation), d AS (SELECT k, power(sin(radians(59.33 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(59.33)) * power(sin(radians(18.07 - lng) / 2), 2) AS a FROM n)
SELECT CAST(k AS BIGINT) AS place, round(6371.0 * 2 * atan2(sqrt(a), sqrt(1 - a)), 6) AS km FROM d""")
def p11_distances(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("place"), (55 + F.col("n_nationkey") * 0.5).alias("lat"), (11 + F.col("n_nationkey") * 0.3).alias("lng"))
    return n.select("place", F.round(r.haversine_km(F.col("lat"), F.col("lng"), F.lit(59.33), F.lit(18.07)), 6).alias("km"))


@query(f"""WITH {LISTING_SQL} SELECT count(*) FILTER (status = 'active') AS pending, count(*) FILTER (status = 'active' AND seller_type = 'private') AS visible, min(first_seen_at) FILTER (status = 'active') AS oldest FROM listing""")
def q22_backlog(spark, sf):
    on = F.col("status") == "active"
    return listings(spark, sf).agg(F.count_if(on).alias("pending"), F.count_if(on & (F.col("seller_type") == "private")).alias("visible"), F.min(F.when(on, F.col("first_seen_at"))).alias("oldest"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, length(props) AS payload_length FROM events""")
def s3_json_payload(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.length("props").cast("long").alias("payload_length"))


@query(f"""WITH {ACTIVE_SQL} SELECT listing_id, price FROM active ORDER BY md5(listing_id), listing_id LIMIT 1200""")
def t1_stable_sample(spark, sf):
    return live(spark, sf).select("listing_id", "price").orderBy(F.md5("listing_id"), "listing_id").limit(1200)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q6_depreciation(spark, sf_dir)




from lotlens.plans import queries_market, queries_stored, queries_upkeep, queries_valuation  # noqa: E402, F401  register more queries

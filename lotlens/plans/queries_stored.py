"""Registered queries of the assistant's searches and of stored analyses, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lotlens.operators import assistant, stored
from lotlens.plans.queries import ACTIVE_SQL, AS_OF, live, query
from lotlens.sources.tables import LISTING_SQL, listings

_TRUSTED = {"query": "brand", "makes": ["Brand#13", "Brand#21", "Brand#32"], "max_price": 60_000, "license_plate": "ABC"}
_ASKED = {"max_price": 45_000, "fuel_types": ["petrol", "electric"], "min_horsepower": 100, "max_horsepower": 300, "max_mileage_mil": 30_000, "no_commercial": True, "posted_within": "month"}


@query(f"""WITH {LISTING_SQL} SELECT listing_id, make, fuel_type, price, horsepower FROM listing WHERE status = 'active' AND contains(lower(concat_ws(' ', make, model, variant)), 'brand')
 AND make IN ('Brand#13', 'Brand#21', 'Brand#32') AND price <= 45000 AND fuel_type IN ('petrol', 'electric') AND horsepower BETWEEN 100 AND 300 AND mileage_km <= 300000 AND body_style NOT IN ('van', 'pickup')
 AND first_seen_at >= TIMESTAMP '1998-01-01' - INTERVAL 30 DAY""")
def p17_assistant_search(spark, sf):
    search = assistant.merged(assistant.requested(_TRUSTED), assistant.requested(_ASKED))
    return assistant.matching(listings(spark, sf), search, datetime(1998, 1, 1)).select("listing_id", "make", "fuel_type", "price", "horsepower")


_STORED_SQL = f"""{LISTING_SQL}, cohort AS (SELECT make, model, fuel_type, count(*) AS n, CAST(floor(sum(price) / count(*)) AS BIGINT) AS mean FROM listing GROUP BY ALL),
stored AS (SELECT listing.*, CASE WHEN horsepower % 3 <> 0 THEN n END AS comparable_count, CASE WHEN horsepower % 3 <> 0 THEN mean END AS market_value, CASE WHEN horsepower % 7 <> 0 THEN 20 + mileage_km // 8000 END AS deal_score,
  CASE WHEN horsepower % 4 <> 0 THEN 30 + mileage_km // 8000 END AS confidence_score, CASE WHEN horsepower % 2 = 0 THEN 40 + mileage_km // 8000 END AS buy_score FROM listing JOIN cohort USING (make, model, fuel_type))"""


def _stored(spark, sf):
    """Ads with a stand-in of their stored analysis: the mean of the cohort, scores told by the mileage, some absent."""
    ads = listings(spark, sf)
    keys = ["make", "model", "fuel_type"]
    cohort = ads.groupBy(*keys).agg(F.count("*").alias("n"), F.floor(F.sum("price") / F.count("*")).cast("long").alias("mean"))
    if_ = lambda k, x: F.when(F.col("horsepower") % k != 0, x)
    step = F.floor(F.col("mileage_km") / 8000)
    return ads.join(cohort, keys).withColumns({
        "comparable_count": if_(3, F.col("n")), "market_value": if_(3, F.col("mean")), "deal_score": if_(7, 20 + step), "confidence_score": if_(4, 30 + step),
        "buy_score": F.when(F.col("horsepower") % 2 == 0, 40 + step), "range_low": F.lit(None).cast("double"), "range_high": F.lit(None).cast("double"),
    })


@query(f"""WITH {_STORED_SQL} SELECT listing_id, CAST(coalesce(market_value, price) AS DOUBLE) AS market_value, greatest(1000.0, floor(price * 0.9::DOUBLE / 1000 + 0.5) * 1000.0)::DOUBLE AS range_low, greatest(1000.0, floor(price * 1.1::DOUBLE / 1000 + 0.5) * 1000.0)::DOUBLE AS range_high,
 CAST(coalesce(comparable_count, 0) AS BIGINT) AS comparable_count, CASE WHEN confidence_score < 50 THEN NULL ELSE CAST(deal_score AS BIGINT) END AS deal_score,
 CASE WHEN deal_score IS NULL THEN 'not_assessed' WHEN coalesce(comparable_count, 0) >= 3 THEN 'assessed' ELSE 'too_few' END AS deal_verdict, CAST(coalesce(buy_score, 50) AS BIGINT) AS buy_score FROM stored""")
def p20_shown_analysis(spark, sf):
    return stored.shown(_stored(spark, sf)).select("listing_id", "shown.*")


@query(f"""WITH {_STORED_SQL}, told AS (SELECT *, price < greatest(3000, 25000 - 2000 * ({AS_OF.year} - model_year)) OR coalesce(comparable_count >= 3 AND price < market_value * 0.35::DOUBLE, FALSE) AS reset FROM stored)
SELECT listing_id, CAST(CASE WHEN reset THEN 50 ELSE deal_score END AS BIGINT) AS deal_score, CASE WHEN reset THEN 'low' ELSE 'high' END AS confidence,
 CASE WHEN comparable_count >= 3 AND deal_score IS NOT NULL AND market_value > 0 THEN CAST(round((market_value - price) / market_value::DOUBLE * 10000) AS BIGINT) END AS discount_bps FROM told""")
def g20_repaired_scores(spark, sf):
    out = stored.repaired(_stored(spark, sf).withColumn("confidence", F.lit("high")), AS_OF.year)
    return out.select("listing_id", F.col("deal_score").cast("long").alias("deal_score"), "confidence", "discount_bps")


@query(f"""WITH {ACTIVE_SQL} SELECT vehicle_id, listing_id, make, model, price FROM active WHERE (make, model) IN (SELECT make, model FROM listing WHERE status <> 'active' AND price > 90000)
 QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY last_seen_at DESC, listing_id) = 1""")
def j11_target_cohorts(spark, sf):
    """The pool of the cohorts in which a dear car was sold."""
    targets = listings(spark, sf).filter("status <> 'active' and price > 90000")
    return stored.of_cohorts(live(spark, sf), targets).select("vehicle_id", "listing_id", "make", "model", "price")

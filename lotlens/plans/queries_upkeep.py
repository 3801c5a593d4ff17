"""Registered queries of the report's remaining parts, condition scores, searches and upkeep, with the SQL that checks each."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lotlens.functions import rules as r
from lotlens.operators import ingest, reports, upkeep, valuation
from lotlens.plans.queries import _PLAUSIBLE, _WINDOW, ACTIVE_SQL, AS_OF, DAY_END, _window, live, query, rounded
from lotlens.sources import parsers
from lotlens.sources.tables import CHECKED_SQL, LISTING_SQL, OBSERVATION_SQL, RUN_SQL, checked, listings, observations, runs, table

FROM, TO = datetime(2000, 1, 1), datetime(2000, 3, 1)
_GONE = f"""{OBSERVATION_SQL}, gone AS (SELECT *, 1990 + listing_id % 12 AS model_year FROM observation WHERE kind = 'disappeared')"""
_NEAR = "observed_at >= TIMESTAMP '2024-01-09' AND observed_at < TIMESTAMP '2024-01-16'"


def _gone(spark, sf):
    return observations(spark, sf).filter("kind = 'disappeared'").withColumn("model_year", F.lit(1990) + F.col("listing_id") % 12)


def _piecewise(x: str, points) -> str:
    out = f"CASE WHEN {x} <= {points[0][0]} THEN {points[0][1]}.0"
    for (a, ya), (b, yb) in zip(points, points[1:], strict=False):
        out += f" WHEN {x} <= {b} THEN {ya} + ({yb} - {ya}) * (({x} - {a}) / ({b}.0 - {a}))"
    return out + f" ELSE {points[-1][1]}.0 END"


@query(f"WITH {LISTING_SQL} SELECT count(*) AS n FROM listing WHERE status = 'active'")
def q20_r1_active(spark, sf):
    return reports.active_count(listings(spark, sf))


@query(f"WITH {LISTING_SQL} SELECT round(count(*) / 7.0, 6) AS average FROM listing WHERE first_seen_at >= TIMESTAMP '2000-02-23' AND first_seen_at < TIMESTAMP '2000-03-01'")
def q20_r4_new_per_day(spark, sf):
    return rounded(reports.per_day(listings(spark, sf), "first_seen_at", TO), "average")


@query(f"WITH {_GONE} SELECT round(count(DISTINCT listing_id) / 7.0, 6) AS average FROM gone WHERE {_NEAR}")
def q20_r5_gone_per_day(spark, sf):
    return rounded(reports.per_day(_gone(spark, sf), "observed_at", DAY_END, distinct="listing_id"), "average")


@query(f"WITH {_GONE} SELECT event_id, listing_id, price FROM gone WHERE {_PLAUSIBLE} ORDER BY price, event_id LIMIT 1")
def q20_r6_cheapest_gone(spark, sf):
    return reports.extreme(_gone(spark, sf), AS_OF.year).select("event_id", "listing_id", "price")


@query(f"WITH {_GONE} SELECT event_id, listing_id, price FROM gone WHERE {_PLAUSIBLE} ORDER BY price DESC, event_id LIMIT 1")
def q20_r7_dearest_gone(spark, sf):
    return reports.extreme(_gone(spark, sf), AS_OF.year, dearest=True).select("event_id", "listing_id", "price")


@query(f"WITH {LISTING_SQL} SELECT provider AS name, count(*) AS n, round(avg(price), 4) AS average_price FROM listing WHERE {_WINDOW} GROUP BY 1")
def q20_r11_new_by_provider(spark, sf):
    return rounded(reports.by_provider(_window(spark, sf)), "average_price", digits=4)


@query(f"""WITH {RUN_SQL} SELECT provider, count(*) AS runs, CAST(sum(created_count) AS BIGINT) AS created_count, CAST(sum(updated_count) AS BIGINT) AS updated_count, CAST(sum(removed_count) AS BIGINT) AS removed_count,
  CAST(sum(failed_count) AS BIGINT) AS failed_count, count(*) FILTER (status = 'failed') AS failed_runs FROM run WHERE started_at >= TIMESTAMP '2000-01-01' AND started_at < TIMESTAMP '2000-03-01' AND provider <> 's4' GROUP BY 1""")
def q20_r14_import_health(spark, sf):
    return reports.import_health(runs(spark, sf), FROM, TO, "s4")


@query(f"""WITH {CHECKED_SQL} SELECT count(*) AS active_total, count(*) FILTER (checked_at IS NULL) AS never_checked, count(*) FILTER (check_status = 'active') AS last_active, count(*) FILTER (check_status = 'missing') AS last_missing,
  count(*) FILTER (check_status = 'inconclusive') AS last_inconclusive, min(checked_at) AS oldest_check, max(checked_at) AS newest_check FROM checked WHERE provider = 's1' AND status = 'active'""")
def q20_r15_verification(spark, sf):
    return reports.verification_coverage(checked(listings(spark, sf)), "s1")


@query(f"""WITH {CHECKED_SQL}, d AS (SELECT DISTINCT listing_id FROM checked WHERE {_WINDOW}) SELECT count(*) FILTER (check_status LIKE 'missing%') AS direct_check, count(*) FILTER (check_status LIKE 'missing:deactivated%') AS deactivated_sold,
  count(*) FILTER (check_status IS NULL OR check_status NOT LIKE 'missing%') AS reconciliation FROM d JOIN checked USING (listing_id)""")
def q20_r16_methods(spark, sf):
    return reports.disappearance_methods(_window(spark, sf), checked(listings(spark, sf)))


@query(f"WITH {RUN_SQL} SELECT max(cleanup_at) AS last_cleanup_at FROM run WHERE mode = 'reconciliation'")
def q20_r17_last_cleanup(spark, sf):
    return reports.last_cleanup(runs(spark, sf))


@query(f"WITH {LISTING_SQL} SELECT min(first_seen_at) AS first_seen_at FROM listing WHERE provider = 's1' AND status = 'active'")
def q20_r18_dataset_age(spark, sf):
    return reports.dataset_age(listings(spark, sf), "s1")


@query(f"WITH {LISTING_SQL} SELECT count(*) AS total, count(*) FILTER (provider = 's1') AS one FROM listing WHERE status = 'removed'")
def q20_r21_removed_to_date(spark, sf):
    return reports.removed_to_date(listings(spark, sf), "s1")


@query(f"""WITH {LISTING_SQL}, i AS (SELECT listing_id, greatest(0, 2002 - model_year) AS age, mileage_km AS km, nullif((horsepower // 5) % 9, 0) AS owners, CAST(CASE (mileage_km // 8000) % 4 WHEN 0 THEN 40 WHEN 1 THEN 100 WHEN 2 THEN 62 ELSE 25 END AS DOUBLE) AS service,
  (mileage_km // 8000) % 4 <> 0 AS told FROM listing), s AS (SELECT *, {_piecewise('age', valuation.CONDITION_AGE)} AS sa, {_piecewise('km', valuation.CONDITION_MILEAGE)} AS sk, CASE WHEN owners IS NULL THEN 45 ELSE {_piecewise('owners', valuation.CONDITION_OWNERS)} END AS so FROM i)
SELECT listing_id, round(sa, 6) AS age_score, round(sk, 6) AS mileage_score, round(so, 6) AS owner_score, round(service, 6) AS service_score,
  CAST(greatest(10, least(95, floor(0.34 * sa + 0.3 * sk + 0.2 * service + 0.16 * so - CASE WHEN owners IS NULL AND NOT told THEN 4 ELSE 0 END + 0.5))) AS BIGINT) AS buy_confidence FROM s""")
def v9_confidence(spark, sf):
    kind = F.floor(F.col("mileage_km") / 8000) % 4
    service = F.when(kind == 1, "complete").when(kind == 2, "partial").when(kind == 3, "missing")
    owners = F.nullif(F.floor(F.col("horsepower") / 5) % 9, F.lit(0))
    c = valuation.condition_scores((AS_OF.year - F.col("model_year")).cast("double"), F.col("mileage_km"), owners, service)
    rows = listings(spark, sf).select("listing_id", c.alias("c"))
    out = rows.select("listing_id", F.col("c.age").alias("age_score"), F.col("c.mileage").alias("mileage_score"), F.col("c.owners").alias("owner_score"), F.col("c.service").alias("service_score"), valuation.buy_confidence(F.col("c")).cast("long").alias("buy_confidence"))
    return rounded(out, "age_score", "mileage_score", "owner_score", "service_score")


@query(f"""WITH {ACTIVE_SQL}, v AS (SELECT make, list_sort(list(price)) AS p FROM active GROUP BY 1)
SELECT make, array_to_string(CASE WHEN len(p) <= 40 THEN p ELSE list_transform(range(40), lambda k: p[CAST(floor(k * ((len(p) - 1) / 39.0) + 0.5) AS INT) + 1]) END, ',') AS prices FROM v""")
def a17_even_sample(spark, sf):
    prices = valuation.even_samples(live(spark, sf), "make", "price")
    return prices.select("make", F.array_join(F.col("values").cast("array<string>"), ",").alias("prices"))


@query(f"""WITH {LISTING_SQL}, b AS (SELECT listing_id, CASE WHEN horsepower % 3 = 0 THEN NULL ELSE price END AS lo, CASE WHEN horsepower % 4 = 0 THEN NULL ELSE price + 30000 END AS hi, CASE WHEN horsepower % 7 = 0 THEN price ELSE NULL END AS t FROM listing)
SELECT listing_id, CAST(CASE WHEN t > 0 THEN t WHEN lo IS NOT NULL AND hi IS NOT NULL THEN floor((lo + hi) / 2.0 + 0.5) WHEN hi IS NOT NULL THEN floor(hi * 0.88::DOUBLE + 0.5) WHEN lo IS NOT NULL THEN floor(lo * 1.25::DOUBLE + 0.5) END AS BIGINT) AS target,
  CAST(CASE WHEN t > 0 THEN floor(t * 0.8::DOUBLE + 0.5) WHEN lo IS NOT NULL AND hi IS NOT NULL THEN lo WHEN hi IS NOT NULL THEN floor(hi * 0.5::DOUBLE + 0.5) WHEN lo IS NOT NULL THEN lo END AS BIGINT) AS low,
  CAST(CASE WHEN t > 0 THEN floor(t * 1.2::DOUBLE + 0.5) WHEN hi IS NOT NULL THEN hi END AS BIGINT) AS high FROM b""")
def p16_budget_focus(spark, sf):
    hp, price = F.col("horsepower"), F.col("price")
    focus = valuation.budget_focus(F.when(hp % 3 != 0, price), F.when(hp % 4 != 0, price + 30_000), F.when(hp % 7 == 0, price))
    return listings(spark, sf).select("listing_id", focus.alias("f")).select("listing_id", "f.*")


@query(f"""WITH {LISTING_SQL} SELECT CASE WHEN first_seen_at >= TIMESTAMP '1997-12-31' THEN 'today' WHEN first_seen_at >= TIMESTAMP '1997-12-25' THEN 'week' ELSE 'month' END AS posted, count(*) AS n FROM listing WHERE first_seen_at >= TIMESTAMP '1997-12-02' GROUP BY 1""")
def p9_recent(spark, sf):
    now, at = datetime(1998, 1, 1), F.col("first_seen_at")
    posted = F.when(upkeep.recent(at, "today", now), "today").when(upkeep.recent(at, "week", now), "week").otherwise("month")
    return listings(spark, sf).filter(upkeep.recent(at, "month", now)).groupBy(posted.alias("posted")).agg(F.count("*").alias("n"))


@query(f"WITH {LISTING_SQL} SELECT listing_id FROM listing WHERE contains(lower(listing_id), '77-')")
def p13_plate(spark, sf):
    return listings(spark, sf).filter(upkeep.plate_holds(F.col("listing_id"), " 77-")).select("listing_id")


_FIRST = "row_number() OVER (PARTITION BY vehicle_id ORDER BY first_seen_at DESC, last_seen_at DESC, listing_id) = 1"


@query(f"""WITH {ACTIVE_SQL}, w AS (SELECT vehicle_id, listing_id AS winner FROM listing WHERE status = 'active' AND last_seen_at >= TIMESTAMP '1996-01-01' QUALIFY {_FIRST}) SELECT listing_id, vehicle_id, listing_id = winner AS representative FROM listing JOIN w USING (vehicle_id)""")
def g10_representatives(spark, sf):
    return upkeep.representatives(listings(spark, sf), F.col("last_seen_at") >= F.lit(datetime(1996, 1, 1)))


@query(f"""WITH {ACTIVE_SQL}, w AS (SELECT vehicle_id, listing_id AS winner FROM listing WHERE status = 'active' AND last_seen_at >= TIMESTAMP '1996-01-01' QUALIFY {_FIRST}), x AS (SELECT listing_id, provider, coalesce(listing_id = winner, false) AS rep FROM listing LEFT JOIN w USING (vehicle_id))
SELECT provider, count(*) FILTER (rep) AS shown, count(*) FILTER (provider IN ('s1', 's2')) AS narrowed FROM x GROUP BY 1""")
def p12_shown(spark, sf):
    rows = upkeep.with_winner(listings(spark, sf), F.col("last_seen_at") >= F.lit(datetime(1996, 1, 1)))
    rows = rows.withColumn("rep", F.coalesce(F.col("listing_id") == F.col("winner"), F.lit(False)))
    count = lambda sources: F.count_if(upkeep.shown(F.col("rep"), F.col("provider"), sources))
    return rows.groupBy("provider").agg(count(None).alias("shown"), count(["s1", "s2"]).alias("narrowed"))


@query(f"""WITH {LISTING_SQL} SELECT listing_id, CASE WHEN n IS NOT NULL AND m = 0 THEN h ELSE g END AS image_hash, n IS NULL OR (NOT m = 0 AND (h IS DISTINCT FROM g OR (n = 0 AND m > 0))) AS replace
FROM (SELECT listing_id, nullif(horsepower % 4, 3) AS n, make AS h, mileage_km // 8000 % 3 AS m, CASE WHEN horsepower % 2 = 0 THEN make ELSE model END AS g FROM listing)""")
def g6_gallery(spark, sf):
    hp = F.col("horsepower")
    g = upkeep.gallery(F.nullif(hp % 4, F.lit(3)), F.col("make"), F.floor(F.col("mileage_km") / 8000) % 3, F.when(hp % 2 == 0, F.col("make")).otherwise(F.col("model")))
    return listings(spark, sf).select("listing_id", g.alias("g")).select("listing_id", "g.*")


@query("""SELECT o_orderkey AS listing_id, CAST(50 AS BIGINT) AS score, o_totalprice * 0.9 AS low FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 3)""")
def g8_neutral_seed(spark, sf):
    rows = table(spark, sf, "orders").withColumn("listing_id", F.col("o_orderkey"))
    known = table(spark, sf, "lineitem").filter("l_linenumber = 3").select(F.col("l_orderkey").alias("listing_id"))
    return upkeep.missing_analyses(rows, known, {"score": F.lit(50).cast("long"), "low": F.col("o_totalprice") * 0.9})


@query(f"""WITH {LISTING_SQL}, d AS (SELECT DISTINCT vehicle_id, listing_id, last_seen_at FROM listing) SELECT listing_id, CASE WHEN row_number() OVER (PARTITION BY vehicle_id ORDER BY last_seen_at DESC, listing_id DESC) = 1 THEN vehicle_id END AS vehicle_id FROM d""")
def g9_released_identifiers(spark, sf):
    rows = listings(spark, sf).select("vehicle_id", "listing_id", "last_seen_at").distinct()
    return upkeep.released(rows, "vehicle_id", "last_seen_at").select("listing_id", "vehicle_id")


@query(f"""WITH {LISTING_SQL}, x AS (SELECT listing_id, unnest(list_filter([CASE WHEN price < 20000 THEN 'CHEAP' END, CASE WHEN mileage_km > 300000 THEN 'FAR' END, CASE WHEN model_year < 1993 THEN 'OLD' END], lambda v: v IS NOT NULL)) AS reason FROM listing) SELECT reason, count(*) AS n, reason = 'CHEAP' AS quarantined FROM x GROUP BY 1""")
def g18_reason_counts(spark, sf):
    found = F.array_compact(F.array(F.when(F.col("price") < 20_000, "CHEAP"), F.when(F.col("mileage_km") > 300_000, "FAR"), F.when(F.col("model_year") < 1993, "OLD")))
    return upkeep.reason_counts(listings(spark, sf).withColumn("reasons", found), "reasons", ["CHEAP"])


@query(f"""WITH {LISTING_SQL}, l AS (SELECT vehicle_id AS listing_id, min(first_seen_at) AS observed_at, min(price) AS price, max(mileage_km) AS mileage_km FROM listing GROUP BY 1) SELECT listing_id, 'first_seen' AS kind, observed_at, price, mileage_km, true AS reconstructed FROM l WHERE listing_id NOT IN (SELECT user_id FROM events)""")
def g19_seeded_history(spark, sf):
    cars = listings(spark, sf).groupBy(F.col("vehicle_id").alias("listing_id")).agg(F.min("first_seen_at").alias("first_seen_at"), F.min("price").alias("price"), F.max("mileage_km").alias("mileage_km"))
    return upkeep.seeded_history(cars, observations(spark, sf))


@query(f"WITH {LISTING_SQL} SELECT listing_id, make, model FROM listing WHERE status = 'active' AND (make, model) IN (SELECT make, model FROM listing WHERE {_WINDOW} AND price < 5000)")
def g21_cohort_members(spark, sf):
    return upkeep.cohort_members(listings(spark, sf), _window(spark, sf).filter("price < 5000")).select("listing_id", "make", "model")


@query("""SELECT DISTINCT user_id, user_id % 3000 AS listing_id FROM events WHERE user_id % 3000 IN (SELECT p_partkey FROM part) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = user_id AND o_orderkey = user_id % 3000)""")
def g24_favourites(spark, sf):
    wanted = table(spark, sf, "events").select("user_id", (F.col("user_id") % 3000).alias("listing_id"))
    held = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("listing_id"))
    return upkeep.imported_favourites(wanted, table(spark, sf, "part").select(F.col("p_partkey").alias("listing_id")), held)


@query(f"WITH {RUN_SQL} SELECT provider, run_id, started_at FROM run QUALIFY row_number() OVER (PARTITION BY provider ORDER BY started_at DESC, run_id DESC) = 1")
def w8_latest_runs(spark, sf):
    return upkeep.latest_runs(runs(spark, sf)).select("provider", "run_id", "started_at")


@query("SELECT l_orderkey AS run_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS seen, count(*) FILTER (l_linestatus <> 'F') AS unfinished FROM lineitem GROUP BY 1")
def a22_run_totals(spark, sf):
    points = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_quantity").cast("long").alias("seen"), (F.col("l_linestatus") == "F").alias("finished"))
    return upkeep.run_totals(points)


@query("SELECT o_orderkey AS listing_id, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS children FROM orders")
def a21_child_counts(spark, sf):
    key = lambda n, c: table(spark, sf, n).select(F.col(c).alias("listing_id"))
    return upkeep.child_counts(key("orders", "o_orderkey"), key("lineitem", "l_orderkey"), "listing_id")


_RATED = "CASE WHEN horsepower % 3 = 0 THEN NULL ELSE mileage_km // 8000 % 90 END AS score, model_year % 4 AS confidence_rank"


def _rated(spark, sf):
    score = F.when(F.col("horsepower") % 3 != 0, F.floor(F.col("mileage_km") / 8000) % 90)
    return listings(spark, sf).withColumn("score", score).withColumn("confidence_rank", F.col("model_year") % 4)


@query(f"WITH {LISTING_SQL}, x AS (SELECT listing_id, {_RATED} FROM listing) SELECT listing_id, score FROM x ORDER BY score IS NULL, confidence_rank DESC, score DESC, listing_id LIMIT 500")
def t6_by_score(spark, sf):
    return upkeep.by_score(_rated(spark, sf), 500).select("listing_id", "score")


@query(f"""WITH {CHECKED_SQL} SELECT listing_id FROM checked ORDER BY CASE WHEN seller_type = 'private' THEN first_seen_at END NULLS LAST, checked_at NULLS FIRST, listing_id LIMIT 300""")
def t8_analysis_queue(spark, sf):
    rows = checked(listings(spark, sf)).withColumn("required_at", F.when(F.col("seller_type") == "private", F.col("first_seen_at"))).withColumn("calculated_at", F.col("checked_at"))
    return upkeep.analysis_queue(rows, 300).select("listing_id")


@query(f"""WITH {LISTING_SQL}, x AS (SELECT *, {_RATED} FROM listing) SELECT listing_id FROM x WHERE status = 'active' AND price BETWEEN 49949 AND 103737 AND mileage_km <= 202000 AND transmission = 'automatic' ORDER BY confidence_rank DESC, score DESC NULLS LAST, listing_id LIMIT 50""")
def q23_score_audit(spark, sf):
    return upkeep.score_audit(_rated(spark, sf)).select("listing_id")


@query("SELECT n_nationkey // 2 AS position, p_partkey AS listing_id, p_name AS name FROM nation JOIN part ON p_partkey = 1 + (n_nationkey * 7) % 40")
def j17_in_order(spark, sf):
    ids = table(spark, sf, "nation").select((F.floor(F.col("n_nationkey") / 2)).cast("int").alias("position"), (1 + (F.col("n_nationkey") * 7) % 40).cast("long").alias("listing_id"))
    return upkeep.in_order(ids, table(spark, sf, "part").select(F.col("p_partkey").alias("listing_id"), F.col("p_name").alias("name")))


@query("SELECT o_orderkey AS listing_id, l_linenumber AS version, l_shipdate AS calculated_at FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate < TIMESTAMP '1995-06-01'")
def j5_known_before(spark, sf):
    made = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("listing_id"), F.col("l_linenumber").alias("version"), F.col("l_shipdate").alias("calculated_at"))
    return upkeep.known_before(table(spark, sf, "orders").select(F.col("o_orderkey").alias("listing_id")), made, datetime(1995, 6, 1))


@query(f"""WITH {OBSERVATION_SQL}, s AS (SELECT make, CAST(observed_at AS DATE) AS day, quantile_cont(price, 0.5) AS m FROM observation GROUP BY 1, 2),
t AS (SELECT make, max_by(m, day) AS now, max_by(m, day) FILTER (day <= DATE '2024-01-09') AS b7, max_by(m, day) FILTER (day <= DATE '2024-01-02') AS b14 FROM s WHERE day <= DATE '2024-01-16' GROUP BY 1)
SELECT make, round(now, 6) AS now, round(now / b7 - 1, 6) AS change_7, round(now / b14 - 1, 6) AS change_14 FROM t""")
def q13_trend_deltas(spark, sf):
    daily = observations(spark, sf).groupBy("make", F.col("observed_at").cast("date").alias("day")).agg(r.median("price").alias("median_price"))
    return rounded(upkeep.trend_deltas(daily, ["make"], DAY_END, [7, 14]), "now", "change_7", "change_14")


@query(f"WITH {LISTING_SQL} SELECT body_style AS given, CASE WHEN body_style IN ('estate', 'suv') THEN body_style ELSE 'other' END AS body, count(*) AS n FROM listing GROUP BY 1, 2")
def p19_coerced(spark, sf):
    return listings(spark, sf).groupBy(F.col("body_style").alias("given"), upkeep.coerced(F.col("body_style"), ["estate", "suv"], "other").alias("body")).agg(F.count("*").alias("n"))


@query(f"""WITH {LISTING_SQL}, x AS (SELECT listing_id, list_filter([CASE WHEN price <= 0 THEN 'PRICE_NOT_POSITIVE' END, CASE WHEN price > 0 AND price < greatest(3000, 25000 - 2000 * (2002 - model_year)) THEN 'PRICE_BELOW_MODEL_YEAR_FLOOR' END,
 CASE WHEN mileage_km BETWEEN 0 AND 1000000 AND mileage_km <> 0 AND ((2002 - model_year >= 5 AND mileage_km < 1000) OR (2002 - model_year <= 1 AND mileage_km > 100000) OR (2002 - model_year <= 3 AND mileage_km > 200000)) THEN 'MILEAGE_IMPLAUSIBLE_FOR_AGE' END,
 CASE WHEN horsepower % 11 = 0 THEN 'POWERTRAIN_CLASSIFICATION_CONFLICT' END, CASE WHEN body_style = 'other' THEN 'BODY_STYLE_UNKNOWN' END, CASE WHEN horsepower % 2 = 0 THEN 'DRIVETRAIN_UNKNOWN' END, CASE WHEN model_year < 1995 THEN 'GENERATION_UNKNOWN' END], lambda v: v IS NOT NULL) AS r FROM listing)
SELECT listing_id, array_to_string(r, ',') AS reasons, CASE WHEN list_has_any(r, ['PRICE_NOT_POSITIVE', 'PRICE_BELOW_MODEL_YEAR_FLOOR', 'MILEAGE_IMPLAUSIBLE_FOR_AGE', 'POWERTRAIN_CLASSIFICATION_CONFLICT']) THEN 'rejected' WHEN len(r) > 0 THEN 'warning' ELSE 'valid' END AS status FROM x""")
def g17_all_reasons(spark, sf):
    hp = F.col("horsepower")
    reasons = ingest.quality_reasons(AS_OF.year, F.col("variant"), hp % 11 == 0, F.when(hp % 2 == 0, "other").otherwise("front"), F.when(F.col("model_year") >= 1995, "II"))
    return listings(spark, sf).select("listing_id", F.array_join(reasons, ",").alias("reasons"), ingest.quality_status(reasons).alias("status"))


@query("""SELECT doc_id, TRY_CAST(regexp_extract(regexp_extract(regexp_replace(text, ',', '.'), '([0-9.]+)', 1), '^([0-9]+[.]?[0-9]*|[.][0-9]+)', 1) AS DOUBLE) AS litres FROM documents""")
def x10_fuel_consumption(spark, sf):
    return table(spark, sf, "documents").select("doc_id", parsers.fuel_consumption(F.col("text")).alias("litres"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 429 WHEN 2 THEN NULL WHEN 3 THEN 302 ELSE 200 END AS status, CASE WHEN page_id % 5 = 0 THEN concat(html, '<p>Varan har SÅLTS eller tagits bort</p>') WHEN page_id % 11 = 0 THEN concat(html, 'Sidan hittades inte') ELSE html END AS html FROM pages)
SELECT page_id, CASE WHEN status IN (404, 410) THEN 'missing' WHEN status IS NULL OR status < 200 OR status >= 300 THEN 'inconclusive' WHEN html IS NULL OR length(html) < 200 THEN 'inconclusive'
 WHEN regexp_matches(html, '(?i)annonsen är inte längre tillgänglig|varan har sålts eller tagits bort|har sålts eller tagits bort från marknaden') THEN 'missing' WHEN regexp_matches(html, '(?i)sidan (?:kunde inte hittas|hittades inte|kunde inte hämtas)|hittade inte sidan') THEN 'missing' ELSE 'active' END AS availability,
 CASE WHEN status IN (404, 410) THEN 'purged' WHEN status IS NULL OR status < 200 OR status >= 300 OR html IS NULL OR length(html) < 200 THEN NULL
 WHEN regexp_matches(html, '(?i)annonsen är inte längre tillgänglig|varan har sålts eller tagits bort|har sålts eller tagits bort från marknaden') THEN 'deactivated' WHEN regexp_matches(html, '(?i)sidan (?:kunde inte hittas|hittades inte|kunde inte hämtas)|hittade inte sidan') THEN 'purged' END AS kind FROM p""")
def x12_page_availability(spark, sf):
    k, html = F.col("page_id"), F.col("html")
    status = F.when(k % 7 == 0, 404).when(k % 7 == 1, 429).when(k % 7 == 2, None).when(k % 7 == 3, 302).otherwise(200)
    told = F.when(k % 5 == 0, F.concat(html, F.lit("<p>Varan har SÅLTS eller tagits bort</p>"))).when(k % 11 == 0, F.concat(html, F.lit("Sidan hittades inte"))).otherwise(html)
    return table(spark, sf, "pages").select("page_id", parsers.page_availability(status, told).alias("v")).select("page_id", "v.availability", "v.kind")

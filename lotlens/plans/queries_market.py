"""Registered queries of cohort trends, identities, snapshots, histories, brands and independent cohorts, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from lotlens.functions.lineage import settle, shared_dir
from lotlens.operators import brands, cohort, details, ingest, reports, trends
from lotlens.plans.queries import _BAND, _HELD, _PAIRS, _READ, ACTIVE_SQL, AS_OF, EVENTS_AS_OF, _orders, _pool, _readings, query, rounded
from lotlens.plans.queries_valuation import VALUED_SQL
from lotlens.sources import snapshots
from lotlens.sources.tables import CHECKED_SQL, LISTING_SQL, OBSERVATION_SQL, RUN_SQL, checked, listings, observations, runs, table, vehicles

_YEAR_OF = "1990 + listing_id % 12"


def _dated(spark, sf):
    return observations(spark, sf).withColumn("model_year", (F.lit(1990) + F.col("listing_id") % 12).cast("int"))


_COHORTS = f"""{_HELD}, spread AS (SELECT *, unnest(generate_series(date_trunc('day', valid_from)::TIMESTAMP, date_trunc('day', valid_to - INTERVAL 1 MICROSECOND)::TIMESTAMP, INTERVAL 1 DAY)) AS period FROM held WHERE kind <> 'disappeared' AND valid_to > valid_from),
lastly AS (SELECT *, CAST(period AS DATE) AS day, {_BAND} AS mileage_bucket, CAST({_YEAR_OF} AS INT) AS model_year FROM spread QUALIFY row_number() OVER (PARTITION BY period, listing_id ORDER BY valid_from DESC, event_id DESC) = 1),
cohorts AS (SELECT day, CASE WHEN grouping(mileage_bucket) = 0 THEN 'mileage' WHEN grouping(model_year) = 0 THEN 'model_year' WHEN grouping(transmission) = 0 THEN 'transmission' WHEN grouping(fuel_type) = 0 THEN 'fuel' ELSE 'model' END AS granularity,
  make, model, fuel_type, transmission, model_year, mileage_bucket, count(*) AS active_count, quantile_cont(price, 0.5) AS median_price FROM lastly GROUP BY GROUPING SETS ((day, make, model), (day, make, model, fuel_type), (day, make, model, fuel_type, transmission),
  (day, make, model, fuel_type, transmission, model_year), (day, make, model, fuel_type, transmission, model_year, mileage_bucket)) HAVING count(*) >= 2)"""


@query(f"WITH {_COHORTS} SELECT day, granularity, make, model, fuel_type, transmission, model_year, mileage_bucket, active_count, round(median_price, 4) AS median_price FROM cohorts")
def q13_daily_cohorts(spark, sf):
    return rounded(trends.daily_cohorts(_dated(spark, sf), EVENTS_AS_OF, 2), "median_price", digits=4)


_AGO = (3, 7, 14, 21)
_SAME = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in ("granularity", *trends.KEYS))


@query(f"""WITH {_COHORTS}, last AS (SELECT max(day) AS d FROM cohorts WHERE day <= DATE '2024-01-31'),
req AS (SELECT p_partkey AS request_id, p_brand AS make, p_type AS model, CASE p_size % 5 WHEN 0 THEN 'petrol' WHEN 1 THEN 'diesel' WHEN 2 THEN 'electric' WHEN 3 THEN 'plug_in_hybrid' ELSE 'self_charging_hybrid' END AS fuel_type,
  CASE WHEN p_partkey % 4 <> 3 THEN CASE p_size % 2 WHEN 0 THEN 'automatic' ELSE 'manual' END END AS transmission, CAST(1990 + p_partkey % 12 AS INT) AS model_year, CASE WHEN p_partkey % 3 <> 2 THEN CAST(p_partkey % 6 AS INT) END AS mileage_bucket FROM part),
cand AS (SELECT request_id, 0 AS step, 'mileage' AS granularity, make, model, fuel_type, transmission, model_year, mileage_bucket FROM req WHERE transmission IS NOT NULL AND mileage_bucket IS NOT NULL
  UNION ALL SELECT request_id, 1, 'model_year', make, model, fuel_type, transmission, model_year, NULL FROM req WHERE transmission IS NOT NULL UNION ALL SELECT request_id, 2, 'transmission', make, model, fuel_type, transmission, NULL, NULL FROM req WHERE transmission IS NOT NULL
  UNION ALL SELECT request_id, 3, 'fuel', make, model, fuel_type, NULL, NULL, NULL FROM req UNION ALL SELECT request_id, 4, 'model', make, model, NULL, NULL, NULL, NULL FROM req),
firsts AS (SELECT request_id, min(step) AS first FROM cand GROUP BY 1),
best AS (SELECT a.*, b.day, b.median_price, b.active_count FROM cand a JOIN cohorts b ON {_SAME} JOIN last ON b.day = d QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY step) = 1),
pts AS (SELECT a.request_id, b.day AS pday, b.median_price AS pprice, b.active_count AS pcount FROM best a JOIN cohorts b ON {_SAME} JOIN last ON b.day <= d AND b.day >= d - {max(_AGO)}),
agg AS (SELECT request_id, count(*) AS points, {", ".join(f"max_by(pprice, pday) FILTER (pday <= (SELECT d FROM last) - {d}) AS price_{d}, max_by(pcount, pday) FILTER (pday <= (SELECT d FROM last) - {d}) AS inventory_{d}" for d in _AGO)} FROM pts GROUP BY 1)
SELECT request_id, granularity, step > first AS used_fallback, day, round(median_price, 4) AS median_price, active_count, points, {", ".join(f"round(price_{d}, 4) AS price_{d}, round(median_price - price_{d}, 4) AS price_change_{d}, round(100.0 * (median_price - price_{d}) / nullif(price_{d}, 0), 6) AS price_percent_{d}, inventory_{d}, active_count - inventory_{d} AS inventory_change_{d}, round(100.0 * (active_count - inventory_{d}) / nullif(inventory_{d}, 0), 6) AS inventory_percent_{d}" for d in _AGO)}
FROM best JOIN firsts USING (request_id) JOIN agg USING (request_id)""")
def q13_cohort_trends(spark, sf):
    """Each car asks for its cohort's history, some without a gearbox or a mileage; the log's month allows only short references."""
    k = F.col("vehicle_id")
    asked = vehicles(spark, sf).select(k.alias("request_id"), "make", "model", "fuel_type", F.when(k % 4 != 3, F.col("transmission")).alias("transmission"), (F.lit(1990) + k % 12).cast("int").alias("model_year"), F.when(k % 3 != 2, (k % 6).cast("int")).alias("mileage_bucket"))
    out = trends.trends(asked, settle(trends.daily_cohorts(_dated(spark, sf), EVENTS_AS_OF, 2)), datetime(2024, 1, 31), _AGO)
    out = rounded(out, "median_price", *[f"price_{d}" for d in _AGO], *[f"price_change_{d}" for d in _AGO], digits=4)
    return rounded(out, *[f"{c}_percent_{d}" for d in _AGO for c in ("price", "inventory")])


def _tokens(spark, sf):
    o = table(spark, sf, "orders")
    of = lambda kind, token: F.struct(F.lit(kind).alias("kind"), token.cast("string").alias("token"))
    k = F.col("o_orderkey")
    return o.select(k.alias("listing_id"), F.explode(F.array(of("vin", F.when(k % 3 == 0, F.col("o_custkey"))), of("regno", F.when(k % 5 < 2, F.floor(k / 16))))).alias("t")).select("listing_id", "t.kind", "t.token")


def _known(spark, sf):
    c = table(spark, sf, "customer").filter("c_acctbal > 0")
    return c.select(F.lit("vin").alias("kind"), F.col("c_custkey").cast("string").alias("token"), F.concat(F.lit("v"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("vehicle_id"))


def _groups_sql(rounds: int = 64) -> str:
    """Least labels through listings and identifiers, so many rounds; each listing then takes that of its label."""
    sql = """tok AS (SELECT o_orderkey AS id, 'vin' AS kind, CAST(o_custkey AS VARCHAR) AS token FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'regno', CAST(o_orderkey // 16 AS VARCHAR) FROM orders WHERE o_orderkey % 5 < 2
  UNION ALL SELECT o_orderkey, 'listing', CAST(o_orderkey AS VARCHAR) FROM orders), l0 AS MATERIALIZED (SELECT DISTINCT id, id AS l FROM tok)"""
    for k in range(rounds):
        sql += f", t{k} AS MATERIALIZED (SELECT kind, token, min(l) AS l FROM tok JOIN l{k} USING (id) GROUP BY 1, 2), l{k + 1} AS MATERIALIZED (SELECT id, min(l) AS l FROM tok JOIN t{k} USING (kind, token) GROUP BY 1)"
    return sql + f""", old AS (SELECT DISTINCT g.l, t.kind, t.token, 'v' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS old_id FROM tok t JOIN l{rounds} g USING (id) LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON t.kind = 'vin' AND t.token = CAST(c_custkey AS VARCHAR)),
ids AS (SELECT l, min(old_id) AS kept, min({{'r': CASE kind WHEN 'vin' THEN 1 WHEN 'regno' THEN 2 ELSE 3 END, 'k': kind, 't': token}}) AS b FROM old GROUP BY 1), named AS (SELECT l, coalesce(kept, sha256('vehicle:' || b.k || ':' || b.t)) AS vehicle_id, kept IS NULL AS is_new FROM ids)"""


@query(f"WITH {_groups_sql()} SELECT id AS listing_id, vehicle_id, is_new FROM l64 JOIN named USING (l)")
def g1_vehicle_ids(spark, sf):
    return ingest.stable_identities(_tokens(spark, sf), _known(spark, sf))[0]


@query(f"WITH {_groups_sql()} SELECT DISTINCT old_id, vehicle_id FROM old JOIN named USING (l) WHERE old_id IS NOT NULL AND old_id <> vehicle_id")
def g1_merges(spark, sf):
    return ingest.stable_identities(_tokens(spark, sf), _known(spark, sf))[1]


@query(f"""WITH {OBSERVATION_SQL}, d AS (SELECT CAST(observed_at AS DATE) AS day, make, count(*) AS n, CAST(sum(price) AS BIGINT) AS total FROM observation GROUP BY 1, 2) SELECT day, make, CASE WHEN day = DATE '2024-01-15' THEN n + 1 ELSE n END AS n, total FROM d""")
def s18_replaced_day(spark, sf):
    """A table of days, one of which is written anew, twice."""
    days = observations(spark, sf).groupBy(F.col("observed_at").cast("date").alias("day"), "make").agg(F.count("*").alias("n"), F.sum("price").alias("total"))
    days = settle(days)
    path = settle(days.limit(0)).settled_at
    snapshots.replace_days(days, f"{path}/table")
    for _ in range(2):
        snapshots.replace_days(days.filter("day = date'2024-01-15'").withColumn("n", F.col("n") + 1), f"{path}/table")
    return snapshots.days(spark, f"{path}/table", "make string, n long, total long, day date")


_FOLDED = f"""{OBSERVATION_SQL}, ev AS (SELECT *, lag(price) OVER w AS previous_price, lag(mileage_km) OVER w AS previous_mileage_km FROM observation WINDOW w AS (PARTITION BY listing_id ORDER BY observed_at, event_id)),
lastly AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY observed_at DESC, event_id DESC) <= 5)"""


def _events(spark, sf):
    w = Window.partitionBy("listing_id").orderBy("observed_at", "event_id")
    return observations(spark, sf).withColumns({"observed_at": F.col("observed_at").cast("timestamp"), "previous_price": F.lag("price").over(w), "previous_mileage_km": F.lag("mileage_km").over(w), "provenance": F.when(F.col("event_id") % 50 == 0, "reconstructed").otherwise("observed")})


@query(f"""WITH {_FOLDED} SELECT p_partkey AS listing_id, coalesce(string_agg(CASE WHEN kind = 'price_change' AND previous_price IS NOT NULL THEN concat(previous_price, '>', price, CASE WHEN price < previous_price THEN 'decrease' ELSE 'increase' END) END, ';' ORDER BY observed_at, event_id), '') AS price_changes,
 coalesce(string_agg(CASE WHEN kind = 'mileage_change' AND previous_mileage_km IS NOT NULL THEN concat(previous_mileage_km, '>', mileage_km) END, ';' ORDER BY observed_at, event_id), '') AS mileage_changes, coalesce(string_agg(CASE WHEN kind IN ('disappeared', 'relisted') THEN kind END, ';' ORDER BY observed_at, event_id), '') AS lifecycle,
 count(event_id) AS events, concat_ws(';', CASE WHEN bool_or(event_id % 50 = 0) THEN 'initial_state_reconstructed' END, CASE WHEN any_value(p_size) % 5 = 0 THEN 'disappearance_is_no_sale' END) AS warnings FROM part LEFT JOIN lastly ON listing_id = p_partkey GROUP BY p_partkey""")
def l1_listing_history(spark, sf):
    ads = table(spark, sf, "part").select(F.col("p_partkey").alias("listing_id"), F.when(F.col("p_size") % 5 == 0, "removed").otherwise("active").alias("status"))
    h = details.history(ads, _events(spark, sf), 5)
    told = lambda c, f: F.array_join(F.transform(c, f), ";").alias(c)
    change = lambda e: F.concat(e["from"].cast("string"), F.lit(">"), e["to"].cast("string"))
    return h.select("listing_id", told("price_changes", lambda e: F.concat(change(e), e["direction"])), told("mileage_changes", change), told("lifecycle", lambda e: e["kind"]), F.size("events").cast("long").alias("events"), F.array_join("warnings", ";").alias("warnings"))


@query(f"""WITH {LISTING_SQL}, car AS (SELECT vehicle_id AS listing_id, min(price) AS price, max(last_seen_at) AS synchronized_at FROM listing GROUP BY 1), {OBSERVATION_SQL},
k AS (SELECT listing_id, string_agg(concat(o.price, ' ', kind), ';' ORDER BY observed_at, event_id) AS told, arg_max(o.price, (observed_at, event_id)) AS last FROM observation o WHERE kind IN ('first_seen', 'price_change') GROUP BY 1)
SELECT listing_id, CASE WHEN told IS NULL THEN concat(car.price, ' current') WHEN last <> car.price THEN concat(told, ';', car.price, ' current') ELSE told END AS points FROM car LEFT JOIN k USING (listing_id)""")
def q16_price_points(spark, sf):
    cars = listings(spark, sf).groupBy(F.col("vehicle_id").alias("listing_id")).agg(F.min("price").alias("price"), F.max("last_seen_at").cast("timestamp").alias("synchronized_at"))
    points = details.price_points(cars, observations(spark, sf).withColumn("observed_at", F.col("observed_at").cast("timestamp")))
    return points.select("listing_id", F.array_join(F.transform("points", lambda p: F.concat_ws(" ", p["price"].cast("string"), p["kind"])), ";").alias("points"))


_WORDS = """w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS typed FROM documents), n AS (SELECT typed, regexp_replace(lower(typed), '[^a-z0-9]', '', 'g') AS own FROM w)"""


def _keys_sql() -> str:
    taken, rows = set(), []
    for make, keys in brands.MAKES.items():
        for k in dict.fromkeys(["".join(c for c in make.lower() if c.isascii() and c.isalnum()), *keys]):
            if k not in taken:
                taken.add(k)
                rows.append(f"('{make}', '{k}')")
    return f"keys(make, key) AS (VALUES {', '.join(rows)})"


@query(f"""WITH {_WORDS}, {_keys_sql()}, e AS (SELECT typed, make FROM n JOIN keys ON own = key WHERE length(own) >= 2),
f AS (SELECT typed, make, min(damerau_levenshtein(own, key)) AS d FROM n, keys WHERE length(own) >= 2 AND own NOT IN (SELECT key FROM keys) AND abs(length(own) - length(key)) <= 2 AND damerau_levenshtein(own, key) <= CASE WHEN length(own) <= 5 THEN 1 ELSE 2 END GROUP BY 1, 2),
b AS (SELECT typed, make FROM (SELECT *, min(d) OVER (PARTITION BY typed) AS least FROM f) WHERE d = least QUALIFY count(*) OVER (PARTITION BY typed) = 1) SELECT * FROM e UNION ALL SELECT * FROM b""")
def p7_brand_resolution(spark, sf):
    """Every different word of the documents as a typed name."""
    words = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("typed")).distinct()
    return brands.resolved(words)


@query(f"""WITH {_keys_sql()}, o AS (SELECT DISTINCT p_brand AS option FROM part UNION SELECT make FROM keys), t AS (SELECT n_name AS typed FROM nation UNION SELECT '' UNION SELECT 'vw' UNION SELECT 'mercedesbenz' UNION SELECT 'vovlo' UNION SELECT 'BRAND#3 '),
k AS (SELECT option, regexp_replace(lower(option), '[^a-z0-9]', '', 'g') AS key FROM o UNION SELECT make, key FROM keys), n AS (SELECT typed, regexp_replace(lower(typed), '[^a-z0-9]', '', 'g') AS own FROM t),
f AS (SELECT typed, make, min(damerau_levenshtein(own, key)) AS d FROM n, keys WHERE length(own) >= 2 AND damerau_levenshtein(own, key) <= CASE WHEN own IN (SELECT key FROM keys) THEN 0 WHEN length(own) <= 5 THEN 1 ELSE 2 END GROUP BY 1, 2),
b AS (SELECT typed, make FROM (SELECT *, min(d) OVER (PARTITION BY typed) AS least FROM f) WHERE d = least QUALIFY count(*) OVER (PARTITION BY typed) = 1)
SELECT option, typed FROM k, n WHERE own = '' OR contains(key, own) OR contains(own, key) UNION SELECT make, typed FROM b""")
def p8_brand_options(spark, sf):
    options = table(spark, sf, "part").select(F.col("p_brand").alias("option")).union(brands.alias_keys(spark).select("make"))
    typed = table(spark, sf, "nation").select(F.col("n_name").alias("typed")).union(spark.createDataFrame([(x,) for x in ("", "vw", "mercedesbenz", "vovlo", "BRAND#3 ")], "typed string"))
    return brands.matching_options(options, typed)


@query(f"""WITH {_READ}, a AS (SELECT o.k AS listing_id, o.price, o.km, n.k IS NOT NULL AS seen, o.status FROM o LEFT JOIN n ON n.k = o.k) SELECT listing_id, 'disappeared' AS kind, price, km AS mileage_km FROM a WHERE status = 'active' AND NOT seen""")
def g11_disappeared(spark, sf):
    current = _orders(spark, sf).withColumn("strikes", F.lit(1))
    return ingest.disappeared(current, _readings(spark, sf), F.current_timestamp()).select("listing_id", "kind", "price", "mileage_km")


@query(f"""WITH {CHECKED_SQL}, {RUN_SQL}, v AS (SELECT provider, count(*) AS active, count(*) FILTER (checked_at IS NULL) AS never, count(*) FILTER (check_status = 'inconclusive') AS inconclusive, count(*) FILTER (check_status = 'missing') AS missing, min(first_seen_at) AS first FROM checked WHERE status = 'active' GROUP BY 1),
g AS (SELECT provider, count(*) AS gone FROM listing WHERE status = 'removed' AND first_seen_at >= TIMESTAMP '1998-07-20' GROUP BY 1), c AS (SELECT provider, max(cleanup_at) AS cleanup FROM run GROUP BY 1), f AS (SELECT list_sort(list(DISTINCT provider)) AS failed FROM run WHERE status = 'failed' AND started_at >= TIMESTAMP '1998-07-28')
SELECT provider, concat_ws(';', CASE WHEN coalesce(gone, 0) = 0 THEN 'no_disappearances' END, CASE WHEN active > 0 AND round(100.0 * (active - never) / active, 1) < 50 THEN 'low_check_coverage' END, CASE WHEN cleanup IS NULL OR TIMESTAMP '1998-08-03' - cleanup > INTERVAL 7 DAY THEN 'no_recent_cleanup' END,
 CASE WHEN first > TIMESTAMP '1998-08-03' - INTERVAL 21 DAY THEN 'young_dataset' END, CASE WHEN inconclusive > 20 AND inconclusive >= missing THEN 'inconclusive_sample' END, CASE WHEN len(failed) > 0 THEN array_to_string(list_transform(failed, lambda p: 'failed_imports:' || p), ';') END) AS warnings FROM v LEFT JOIN g USING (provider) LEFT JOIN c USING (provider), f""")
def r25_warnings(spark, sf):
    ads, r = checked(listings(spark, sf)), runs(spark, sf)
    now = F.lit(datetime(1998, 8, 3))
    sums = ads.filter("status = 'active'").groupBy("provider").agg(F.count("*").alias("active"), F.count_if(F.col("checked_at").isNull()).alias("never"), F.count_if(F.col("check_status") == "inconclusive").alias("inconclusive"), F.count_if(F.col("check_status") == "missing").alias("missing"), F.min("first_seen_at").alias("first"))
    gone = ads.filter("status = 'removed'").filter(F.col("first_seen_at") >= F.lit(datetime(1998, 7, 20))).groupBy("provider").agg(F.count("*").alias("gone"))
    failed = r.filter("status = 'failed'").filter(F.col("started_at") >= F.lit(datetime(1998, 7, 28))).agg(F.collect_set("provider").alias("failed"))
    rows = sums.join(gone, "provider", "left").join(r.groupBy("provider").agg(F.max("cleanup_at").alias("cleanup")), "provider", "left").join(F.broadcast(failed))
    w = reports.warnings_of(F.coalesce("gone", F.lit(0)), F.col("active"), F.col("never"), F.col("cleanup"), F.col("first"), F.col("inconclusive"), F.col("missing"), now, F.col("failed"))
    return rows.select("provider", F.array_join(w, ";").alias("warnings"))


@query()
def l2_independent_market(spark, sf):
    """A search: its queries are the ads whose vehicle has an id divisible by 20. Held against plain Python in the tests."""
    pool = cohort.one_a_vehicle(_pool(spark, sf).withColumn("seen_at", F.col("last_seen_at").cast("timestamp")))
    return cohort.independent(pool.filter("vehicle_id % 20 = 0"), pool, AS_OF.year)

"""Domain tables (vehicles, listings, observations, equipment) and how a star schema stands in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.functions.lineage import small_or_none

#: Sellers that are broadcast to the ads, at most; more are joined by a shuffle.
SELLERS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(number, names):
    out = F.when(number == 0, F.lit(names[0]))
    for k, name in enumerate(names[1:], 1):
        out = out.when(number == k, F.lit(name))
    return out


FUELS = ["petrol", "diesel", "electric", "plug_in_hybrid", "self_charging_hybrid"]
BODIES = ["estate", "suv", "sedan", "other"]
KINDS = {"signup": "first_seen", "purchase": "price_change", "view": "relisted", "click": "mileage_change", "error": "disappeared"}


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a physical car."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("vehicle_id"),
        F.col("p_brand").alias("make"),
        F.col("p_type").alias("model"),
        F.col("p_name").alias("variant"),
        _pick(size % 5, FUELS).alias("fuel_type"),
        F.when(size % 2 == 0, "automatic").otherwise("manual").alias("transmission"),
        _pick(size % 4, BODIES).alias("body_style"),
        (F.lit(70) + size * 5).cast("long").alias("horsepower"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a source ad, with its vehicle's columns.

    A join of supplier and nation is never estimated to be small, so sellers are counted: a broadcast comes last and moves no
    ad; more sellers are met before the ads carry their vehicle's strings. Orders and vehicles are left to AQE.
    """
    line, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    ads = line.join(order.select("o_orderkey", "o_orderstatus", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    seller = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")
    few = small_or_none(seller, SELLERS)
    cars, sold_by, of_car = vehicles(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey"), F.col("l_partkey") == F.col("vehicle_id")
    ads = ads.join(cars, of_car).join(few, sold_by) if few else ads.join(seller, sold_by).join(cars, of_car)
    return (
        ads.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), F.round(F.col("l_extendedprice") * 100).cast("long")).alias("listing_id"),
            "vehicle_id", "make", "model", "variant", "fuel_type", "transmission", "body_style", "horsepower",
            F.year("l_shipdate").alias("model_year"),
            F.floor("l_extendedprice").cast("long").alias("price"),
            (F.col("l_quantity") * 8000).cast("long").alias("mileage_km"),
            F.when(F.col("l_returnflag") == "R", "private").otherwise("dealer").alias("seller_type"),
            F.when(F.col("o_orderstatus") == "P", "removed").otherwise("active").alias("status"),
            F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("provider"),
            F.col("n_name").alias("municipality"),
            F.col("s_name").alias("seller_name"),
            F.col("o_orderdate").alias("first_seen_at"),
            F.col("l_shipdate").alias("last_seen_at"),
        )
    )


#: The same listings for the check by another engine.
LISTING_SQL = """listing AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT), CAST(round(l_extendedprice * 100) AS BIGINT)) AS listing_id,
    l_partkey AS vehicle_id, p_brand AS make, p_type AS model, p_name AS variant,
    CASE p_size % 5 WHEN 0 THEN 'petrol' WHEN 1 THEN 'diesel' WHEN 2 THEN 'electric' WHEN 3 THEN 'plug_in_hybrid' ELSE 'self_charging_hybrid' END AS fuel_type,
    CASE p_size % 2 WHEN 0 THEN 'automatic' ELSE 'manual' END AS transmission,
    CASE p_size % 4 WHEN 0 THEN 'estate' WHEN 1 THEN 'suv' WHEN 2 THEN 'sedan' ELSE 'other' END AS body_style,
    CAST(70 + p_size * 5 AS BIGINT) AS horsepower,
    CAST(year(l_shipdate) AS INT) AS model_year, CAST(floor(l_extendedprice) AS BIGINT) AS price, CAST(l_quantity * 8000 AS BIGINT) AS mileage_km,
    CASE l_returnflag WHEN 'R' THEN 'private' ELSE 'dealer' END AS seller_type,
    CASE o_orderstatus WHEN 'P' THEN 'removed' ELSE 'active' END AS status,
    's' || CAST(l_suppkey % 5 AS VARCHAR) AS provider, n_name AS municipality, s_name AS seller_name, o_orderdate AS first_seen_at, l_shipdate AS last_seen_at
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The append-only event log: (event_id, listing_id, observed_at, kind, price, mileage_km, vehicle keys)."""
    kind = F.col("event_type")
    named = F.when(kind == "signup", KINDS["signup"])
    for source in list(KINDS)[1:]:
        named = named.when(kind == source, KINDS[source])
    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("listing_id"),
        F.col("ts").alias("observed_at"),
        named.alias("kind"),
        (F.floor(F.col("value") * 1000) + 3000).cast("long").alias("price"),
        (F.get_json_object("props", "$.k").cast("long") * 2000).alias("mileage_km"),
    )
    cars = vehicles(spark, sf_dir).select(F.col("vehicle_id").alias("listing_id"), "make", "model", "fuel_type", "transmission")
    return events.join(cars, "listing_id")


OBSERVATION_SQL = """observation AS (
  SELECT event_id, user_id AS listing_id, ts AS observed_at,
    CASE event_type WHEN 'signup' THEN 'first_seen' WHEN 'purchase' THEN 'price_change' WHEN 'view' THEN 'relisted' WHEN 'click' THEN 'mileage_change' WHEN 'error' THEN 'disappeared' END AS kind,
    CAST(floor(value * 1000) + 3000 AS BIGINT) AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) * 2000 AS mileage_km,
    p_brand AS make, p_type AS model,
    CASE p_size % 5 WHEN 0 THEN 'petrol' WHEN 1 THEN 'diesel' WHEN 2 THEN 'electric' WHEN 3 THEN 'plug_in_hybrid' ELSE 'self_charging_hybrid' END AS fuel_type,
    CASE p_size % 2 WHEN 0 THEN 'automatic' ELSE 'manual' END AS transmission
  FROM events JOIN part ON p_partkey = user_id)"""


def equipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vehicle_id, label): one row for each option of a car."""
    return vehicles(spark, sf_dir).select("vehicle_id", F.explode(F.array_distinct(F.split("variant", " "))).alias("label"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import runs, an order each."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("run_id"),
        F.concat(F.lit("s"), (F.col("o_custkey") % 5).cast("string")).alias("provider"),
        F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("succeeded").alias("status"),
        F.when(F.col("o_orderpriority").startswith("1"), "reconciliation").otherwise("incremental").alias("mode"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("cleanup_at"),
        *[(k % n).alias(f"{c}_count") for c, n in (("created", 50), ("updated", 70), ("removed", 30), ("failed", 3))],
    )


RUN_SQL = """run AS (SELECT o_orderkey AS run_id, 's' || CAST(o_custkey % 5 AS VARCHAR) AS provider, o_orderdate AS started_at,
  CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN o_orderpriority LIKE '1%' THEN 'reconciliation' ELSE 'incremental' END AS mode,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS cleanup_at, o_orderkey % 50 AS created_count, o_orderkey % 70 AS updated_count, o_orderkey % 30 AS removed_count, o_orderkey % 3 AS failed_count FROM orders)"""


def checked(rows: DataFrame) -> DataFrame:
    """Ads with the outcome of their last availability check, told by their mileage."""
    kind = F.floor(F.col("mileage_km") / 8000) % 7
    status = F.when(kind.isin(1, 2, 3), "active").when(kind == 4, "missing").when(kind == 5, "missing:deactivated").when(kind == 6, "inconclusive")
    return rows.withColumn("check_status", status).withColumn("checked_at", F.when(status.isNotNull(), F.col("last_seen_at")))


CHECKED_SQL = f"""{LISTING_SQL}, checked AS (SELECT *, CASE WHEN check_status IS NOT NULL THEN last_seen_at END AS checked_at FROM (SELECT *, CASE (mileage_km // 8000) % 7 WHEN 1 THEN 'active' WHEN 2 THEN 'active' WHEN 3 THEN 'active'
  WHEN 4 THEN 'missing' WHEN 5 THEN 'missing:deactivated' WHEN 6 THEN 'inconclusive' END AS check_status FROM listing))"""

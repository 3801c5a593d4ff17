"""L1, Q16: one row an ad with its history folded in: last events, prices over time, what a reader must know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Events of an ad that its summary looks at.
LAST = 30
#: Codes of warnings.
RECONSTRUCTED, NO_SALE = "initial_state_reconstructed", "disappearance_is_no_sale"


def last_events(observations: DataFrame, n: int = LAST) -> DataFrame:
    """(listing_id, events): the last n observations of each listing, oldest first. A window limits them before they are gathered.

    observations: (listing_id, event_id, observed_at, kind, price, previous_price, mileage_km, previous_mileage_km, provenance).
    """
    latest = Window.partitionBy("listing_id").orderBy(F.desc("observed_at"), F.desc("event_id"))
    few = observations.withColumn("k", F.row_number().over(latest)).filter(F.col("k") <= n)
    event = F.struct("observed_at", "event_id", "kind", "price", "previous_price", "mileage_km", "previous_mileage_km", "provenance")
    return few.groupBy("listing_id").agg(F.sort_array(F.collect_list(event)).alias("events"))


def history(ads: DataFrame, observations: DataFrame, n: int = LAST) -> DataFrame:
    """L1: ads (listing_id, status) with price_changes, mileage_changes, lifecycle and warnings of their last n events."""
    rows = ads.join(last_events(observations, n), "listing_id", "left").withColumn("events", F.coalesce("events", F.array().cast("array<struct<observed_at:timestamp,event_id:long,kind:string,price:long,previous_price:long,mileage_km:long,previous_mileage_km:long,provenance:string>>")))
    of = lambda keep, make: F.transform(F.filter("events", keep), make)
    price = of(
        lambda e: (e["kind"] == "price_change") & e["previous_price"].isNotNull(),
        lambda e: F.struct(e["observed_at"].alias("observed_at"), e["previous_price"].alias("from"), e["price"].alias("to"), F.when(e["price"] < e["previous_price"], "decrease").otherwise("increase").alias("direction")),
    )
    mileage = of(lambda e: (e["kind"] == "mileage_change") & e["previous_mileage_km"].isNotNull(), lambda e: F.struct(e["observed_at"].alias("observed_at"), e["previous_mileage_km"].alias("from"), e["mileage_km"].alias("to")))
    life = of(lambda e: e["kind"].isin("disappeared", "relisted"), lambda e: F.struct(e["observed_at"].alias("observed_at"), e["kind"].alias("kind")))
    warned = F.array_compact(F.array(F.when(F.exists("events", lambda e: e["provenance"] == "reconstructed"), RECONSTRUCTED), F.when(F.col("status") != "active", NO_SALE)))
    return rows.select("listing_id", "status", "events", price.alias("price_changes"), mileage.alias("mileage_changes"), life.alias("lifecycle"), warned.alias("warnings"))


def price_points(ads: DataFrame, observations: DataFrame) -> DataFrame:
    """Q16: (listing_id, points): first sight and price changes in time, and the ad's own price where the last one is another.

    ads: (listing_id, price, synchronized_at).
    """
    told = observations.filter(F.col("kind").isin("first_seen", "price_change")).groupBy("listing_id").agg(F.sort_array(F.collect_list(F.struct("observed_at", "event_id", "price", "kind"))).alias("told"))
    point = lambda at, price, kind: F.struct(at.alias("observed_at"), price.alias("price"), kind.alias("kind"))
    known = F.transform(F.coalesce("told", F.array().cast("array<struct<observed_at:timestamp,event_id:long,price:long,kind:string>>")), lambda e: point(e["observed_at"], e["price"], e["kind"]))
    now = F.array(point(F.col("synchronized_at"), F.col("price"), F.lit("current")))
    stale = F.col("told").isNull() | (F.element_at("told", -1)["price"] != F.col("price"))
    return ads.join(told, "listing_id", "left").select("listing_id", F.when(stale, F.concat(known, now)).otherwise(known).alias("points"))


def detail(ads: DataFrame, observations: DataFrame, benchmarks: DataFrame, insights: Column) -> DataFrame:
    """Q16: active ads with price points, their model's benchmarks and insights. ads has the columns that insights reads."""
    live = ads.filter("status = 'active'")
    rows = live.join(benchmarks, ["make", "model"], "left").withColumn("insights", insights)
    return rows.join(price_points(live.select("listing_id", "price", "synchronized_at"), observations), "listing_id", "left")

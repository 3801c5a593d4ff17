"""Operational reports: the daily report's parts, and what each source is worth."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.functions.rules import first_by, micros, price_floor, ratio


def plausible(current_year: int) -> Column:
    return F.col("price").between(price_floor(F.col("model_year"), current_year), F.lit(3_000_000))


def within(column: str, start: datetime, end: datetime) -> Column:
    return (F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end))


def stockholm_day(spark, now: datetime, back: int = 1):
    """UTC bounds of a calendar day in Stockholm, daylight saving included."""
    day = F.date_sub(F.from_utc_timestamp(F.lit(now), "Europe/Stockholm").cast("date"), back)
    return spark.range(1).select(
        day.alias("day"),
        F.to_utc_timestamp(day.cast("timestamp"), "Europe/Stockholm").alias("start"),
        F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), "Europe/Stockholm").alias("end"),
    )


def price_summary(rows: DataFrame, current_year: int) -> DataFrame:
    """How many, and the plausible prices among them."""
    p = F.when(plausible(current_year), F.col("price"))
    return rows.agg(F.count_distinct("listing_id").alias("n"), F.avg(p).alias("average_price"), F.min(p).alias("minimum_price"), F.max(p).alias("maximum_price"))


def top_groups(rows: DataFrame, name: Column, current_year: int, top: int) -> DataFrame:
    """The commonest names with their mean plausible price."""
    p = F.when(plausible(current_year), F.col("price"))
    return rows.groupBy(name.alias("name")).agg(F.count_distinct("listing_id").alias("n"), F.avg(p).alias("average_price")).orderBy(F.desc("n"), "name").limit(top)


def or_unknown(column: str, unknown: str) -> Column:
    return F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit(unknown))


def last_disappearance(gone: DataFrame, limit: int = 500) -> DataFrame:
    """Each listing's last disappearance, by id."""
    return first_by(gone, ["listing_id"], F.desc("observed_at"), F.desc("event_id")).orderBy("listing_id").limit(limit)


def price_changes(changes: DataFrame) -> DataFrame:
    """Of observations with previous_price."""
    delta = F.col("price") - F.col("previous_price")
    return changes.agg(F.count("*").alias("n"), F.count_if(delta < 0).alias("reductions"), F.count_if(delta > 0).alias("increases"), F.avg(delta).alias("average_change"))


def delta_histogram(changes: DataFrame, width: int = 110_000, buckets: int = 11) -> DataFrame:
    """A dense histogram with a bucket below and one above the range."""
    spine = changes.sparkSession.range(buckets + 2).select(F.col("id").alias("bucket"))
    delta = (F.col("price") - F.col("previous_price")).cast("double")
    counted = changes.filter("previous_price is not null").groupBy(F.width_bucket(delta, F.lit(-float(width)), F.lit(float(width)), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"))
    return spine.join(F.broadcast(counted), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def dense_days(rows: DataFrame, column: str, until: datetime, days: int = 21, distinct: str | None = None) -> DataFrame:
    """Counts by UTC day, quiet days included."""
    last = F.lit(until).cast("date")
    spine = rows.sparkSession.range(days).select(F.date_sub(last, F.col("id").cast("int")).alias("day"))
    count = F.count_distinct(distinct) if distinct else F.count("*")
    counted = rows.groupBy(F.col(column).cast("date").alias("day")).agg(count.alias("n"))
    return spine.join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


#: What warnings go by.
COVERAGE_PERCENT, CLEANUP_DAYS, YOUNG_DAYS, INCONCLUSIVE = 50, 7, 21, 20
#: What observations go by.
CONCENTRATED, MANY_CHANGES, CUTS_TO_RISES, SUSPICIOUS_PRICE = 3, 10, 3, 20_000


def warnings_of(gone: Column, active: Column, never_checked: Column, cleanup_at: Column, first_seen_at: Column, inconclusive: Column, missing: Column, now: Column, failed: Column) -> Column:
    """What a reader of the report is warned of, as codes; failed: an array of the providers whose imports failed."""
    days = lambda at: (micros(now) - micros(at)) / 86_400_000_000.0
    coverage = F.round(100.0 * (active - never_checked) / F.nullif(active, F.lit(0)), 1)
    found = F.array_compact(
        F.array(
            F.when(gone == 0, F.lit("no_disappearances")),
            F.when((active > 0) & (coverage < COVERAGE_PERCENT), F.lit("low_check_coverage")),
            F.when(cleanup_at.isNull() | (days(cleanup_at) > CLEANUP_DAYS), F.lit("no_recent_cleanup")),
            F.when(F.floor(days(first_seen_at)) < YOUNG_DAYS, F.lit("young_dataset")),
            F.when((inconclusive > INCONCLUSIVE) & (inconclusive >= missing), F.lit("inconclusive_sample")),
        )
    )
    return F.concat(found, F.transform(F.sort_array(failed), lambda p: F.concat(F.lit("failed_imports:"), p)))


def remarks_of(seller_gone: Column, model_gone: Column, changes: Column, cuts: Column, rises: Column, cheapest: Column) -> Column:
    """What a reader may find of note, as codes."""
    return F.array_compact(
        F.array(
            F.when(seller_gone >= CONCENTRATED, F.lit("seller_concentration")),
            F.when(model_gone >= CONCENTRATED, F.lit("model_concentration")),
            F.when((changes >= MANY_CHANGES) & (cuts > rises * CUTS_TO_RISES), F.lit("broad_cuts")),
            F.when((cheapest > 0) & (cheapest < SUSPICIOUS_PRICE), F.lit("suspicious_cheapest")),
        )
    )


def source_value(listings: DataFrame, main: str, as_of: datetime, stale_hours: int = 48) -> DataFrame:
    """Q18: what each provider adds: vehicles of its own, overlap with and lead over the main one, staleness."""
    car = listings.filter("status = 'active'").groupBy("provider", "vehicle_id").agg(
        F.count("*").alias("ads"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.bool_or(F.length(F.trim("variant")) > 0).alias("described")
    )
    sources = car.groupBy("vehicle_id").agg(F.count("*").alias("sources"), F.min(F.when(F.col("provider") == main, F.col("first_seen_at"))).alias("main_at"))
    lead = (micros(F.col("main_at")) - micros(F.col("first_seen_at"))) / 3_600_000_000.0
    n, stale = F.count("*"), F.count_if(F.col("last_seen_at") < F.lit(as_of) - F.expr(f"interval {stale_hours} hours"))
    overlap = F.count("main_at")
    other = F.col("provider") != main
    return (
        car.join(sources, "vehicle_id")
        .groupBy("provider")
        .agg(
            F.sum("ads").alias("active_listings"), n.alias("active_vehicles"), F.count_if(F.col("sources") == 1).alias("unique_vehicles"),
            ratio(F.count_if(F.col("sources") == 1), n).alias("unique_rate"), overlap.alias("overlap_vehicles"), ratio(overlap, n).alias("overlap_rate"),
            F.round(F.avg(lead)).alias("lead_hours"), ratio(F.count_if("described"), n).alias("description_coverage"), stale.alias("stale_vehicles"), ratio(stale, n).alias("stale_rate"),
        )
        .withColumn("overlap_rate", F.when(other, F.col("overlap_rate")))
        .withColumn("lead_hours", F.when(other, F.col("lead_hours")))
    )


def source_pairs(listings: DataFrame) -> DataFrame:
    """Q19: vehicles that two providers share. Providers of one vehicle are few, so pairs are made in its own row."""
    car = listings.filter("status = 'active'").select("provider", "vehicle_id").distinct()
    size = car.groupBy("provider").agg(F.count("*").alias("size"))
    names = car.groupBy("vehicle_id").agg(F.array_sort(F.collect_set("provider")).alias("p"))
    pairs = names.select(F.posexplode("p").alias("k", "a"), "p").select("a", F.explode(F.slice("p", F.col("k") + 2, F.size("p"))).alias("b"))
    shared = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))
    a, b = size.select(F.col("provider").alias("a"), F.col("size").alias("size_a")), size.select(F.col("provider").alias("b"), F.col("size").alias("size_b"))
    return shared.join(a, "a").join(b, "b").select("a", "b", "shared", ratio(F.col("shared"), F.least("size_a", "size_b")).alias("overlap"))


def per_day(rows: DataFrame, column: str, until: datetime, days: int = 7, distinct: str | None = None) -> DataFrame:
    """A daily mean over the days before a moment, quiet days included."""
    count = F.count_distinct(distinct) if distinct else F.count("*")
    start = F.lit(until) - F.expr(f"interval {days} days")
    return rows.filter((F.col(column) >= start) & (F.col(column) < F.lit(until))).agg((count / days).alias("average"))


def extreme(rows: DataFrame, current_year: int, dearest: bool = False) -> DataFrame:
    """The cheapest or the dearest plausible row; equal prices go by event id."""
    return rows.filter(plausible(current_year)).orderBy(F.desc("price") if dearest else F.asc("price"), "event_id").limit(1)


def active_count(listings: DataFrame) -> DataFrame:
    """R1."""
    return listings.filter("status = 'active'").agg(F.count("*").alias("n"))


def by_provider(rows: DataFrame) -> DataFrame:
    """How many by provider and their mean price, plausible or not."""
    return rows.groupBy(F.col("provider").alias("name")).agg(F.count("*").alias("n"), F.avg("price").alias("average_price"))


def import_health(runs: DataFrame, start: datetime, end: datetime, manual: str) -> DataFrame:
    """What the runs of each provider but the manual one did in a window."""
    counts = [F.sum(f"{c}_count").alias(f"{c}_count") for c in ("created", "updated", "removed", "failed")]
    return runs.filter(within("started_at", start, end) & (F.col("provider") != manual)).groupBy("provider").agg(F.count("*").alias("runs"), *counts, F.count_if(F.col("status") == "failed").alias("failed_runs"))


def verification_coverage(listings: DataFrame, provider: str) -> DataFrame:
    """How the active ads of one provider were last checked."""
    last = lambda s: F.count_if(F.col("check_status") == s).alias(f"last_{s}")
    return listings.filter((F.col("provider") == provider) & (F.col("status") == "active")).agg(
        F.count("*").alias("active_total"), F.count_if(F.col("checked_at").isNull()).alias("never_checked"), last("active"), last("missing"), last("inconclusive"),
        F.min("checked_at").alias("oldest_check"), F.max("checked_at").alias("newest_check"),
    )


def disappearance_methods(gone: DataFrame, listings: DataFrame) -> DataFrame:
    """How the different ads that disappeared were found out, by the status of their last check."""
    s = F.col("check_status")
    return gone.select("listing_id").distinct().join(listings.select("listing_id", "check_status"), "listing_id").agg(
        F.count_if(s.startswith("missing")).alias("direct_check"), F.count_if(s.startswith("missing:deactivated")).alias("deactivated_sold"),
        F.count_if(s.isNull() | ~s.startswith("missing")).alias("reconciliation"),
    )


def last_cleanup(runs: DataFrame) -> DataFrame:
    """When a reconciliation last cleaned up."""
    return runs.filter((F.col("mode") == "reconciliation") & F.col("cleanup_at").isNotNull()).agg(F.max("cleanup_at").alias("last_cleanup_at"))


def dataset_age(listings: DataFrame, provider: str) -> DataFrame:
    """Since when a provider's oldest active ad is known."""
    return listings.filter((F.col("provider") == provider) & (F.col("status") == "active")).agg(F.min("first_seen_at").alias("first_seen_at"))


def removed_to_date(listings: DataFrame, provider: str) -> DataFrame:
    """Removed ads, all and one provider's."""
    return listings.filter("status = 'removed'").agg(F.count("*").alias("total"), F.count_if(F.col("provider") == provider).alias("one"))

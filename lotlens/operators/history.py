"""The event log: validity intervals, seasonality, daily cohort snapshots, trends."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotlens.functions.lineage import settle
from lotlens.functions.rules import first_by, median, micros, mileage_band, mileage_cell
from lotlens.functions.selection import percentiles
from lotlens.operators.market import TRIM

LEVELS = ["model", "fuel", "transmission", "mileage"]
KEYS = ["make", "model", "fuel_type", "transmission", "mileage_bucket"]


def intervals(observations: DataFrame, as_of: datetime) -> DataFrame:
    """Each observation holds until the listing's next one, the last until as_of; ties go by event id."""
    w = Window.partitionBy("listing_id").orderBy("observed_at", "event_id")
    return (
        observations.withColumn("valid_to", F.coalesce(F.lead("observed_at").over(w), F.lit(as_of)))
        .withColumn("previous_price", F.lag("price").over(w))
        .withColumnRenamed("observed_at", "valid_from")
    )


def live_periods(observations: DataFrame, as_of: datetime, unit: str = "month") -> DataFrame:
    """A row for each period a listing was live in, in its last state there: periods are made from the interval,
    not by a join with a calendar."""
    held = intervals(observations, as_of).filter((F.col("kind") != "disappeared") & (F.col("valid_to") > F.col("valid_from")))
    last = F.date_trunc(unit, F.col("valid_to") - F.expr("interval 1 microsecond"))
    spread = held.withColumn("period", F.explode(F.sequence(F.date_trunc(unit, "valid_from"), last, F.expr(f"interval 1 {unit}"))))
    return first_by(spread, ["period", "listing_id"], F.desc("valid_from"), F.desc("event_id"))


def seasonality(observations: DataFrame, as_of: datetime, unit: str = "day", cell: int = 4) -> DataFrame:
    """Q10: inventory, price, mean residual within the period's comparable cells, reductions and age, by period."""
    keyed = live_periods(observations, as_of, unit).withColumn("mileage_cell", mileage_cell(F.col("mileage_km"))).withColumn("log_price", F.log("price"))
    keys = ["make", "model", "fuel_type", "mileage_cell"]
    cells = keyed.groupBy(*keys).agg(median("log_price").alias("m"), F.count("*").alias("cell_size")).filter(F.col("cell_size") >= cell)
    residual = F.col("log_price") - F.col("m")
    since = (micros(F.col("period") + F.expr(f"interval 1 {unit}")) - micros(F.col("valid_from"))) / 86_400_000_000.0
    rows = keyed.join(cells, keys, "left").select("period", "listing_id", "price", F.when(F.abs(residual) <= TRIM, residual).alias("r"), F.greatest(since, F.lit(0.0)).alias("age"))
    rows = settle(rows)
    sums = rows.groupBy("period").agg(
        F.count("*").alias("observation_count"), F.count_distinct("listing_id").alias("listing_count"), median("price").alias("median_price"), F.avg("r").alias("mean_log_residual")
    )
    # Ages are continuous: a period's are selected by ranges, never gathered.
    monthly = sums.join(percentiles(rows, ["period"], "age", {"median_age_days": 0.5}).drop("n"), "period")
    cut = (F.col("kind") == "price_change") & (F.col("price") < F.col("previous_price"))
    reductions = intervals(observations, as_of).filter(cut).groupBy(F.date_trunc(unit, "valid_from").alias("period")).agg(F.count_distinct("listing_id").alias("reductions"))
    return monthly.join(reductions, "period", "left").withColumn("reductions", F.coalesce("reductions", F.lit(0)))


def state_at(observations: DataFrame, day_end: datetime) -> DataFrame:
    """The last state of every listing before a moment, and since when it has been active."""
    before = observations.filter(F.col("observed_at") < F.lit(day_end))
    spell = before.groupBy("listing_id").agg(F.max(F.when(F.col("kind").isin("first_seen", "relisted"), F.col("observed_at"))).alias("active_since"))
    return first_by(before, ["listing_id"], F.desc("observed_at"), F.desc("event_id")).join(spell, "listing_id", "left")


def _levels(df: DataFrame, aggregates: list) -> DataFrame:
    """One pass over nested grouping sets, each row named by its level."""
    sets = [["make", "model"], KEYS[:3], KEYS[:4], KEYS]
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in KEYS])
    level = F.when(F.grouping("mileage_bucket") == 0, "mileage").when(F.grouping("transmission") == 0, "transmission").when(F.grouping("fuel_type") == 0, "fuel").otherwise("model")
    return grouped.agg(level.alias("granularity"), *aggregates)


def daily_snapshot(observations: DataFrame, day: datetime, day_end: datetime, least: int = 10) -> DataFrame:
    """Q12: cohorts of the active listings of a day at every level, with the day's events beside them."""
    days = F.greatest(F.lit(0.0), (micros(F.lit(day_end)) - micros(F.coalesce("active_since", "observed_at"))) / 86_400_000_000.0)
    live = state_at(observations, day_end).filter(F.col("kind") != "disappeared").withColumn("mileage_bucket", mileage_band(F.col("mileage_km"))).withColumn("days", days)
    whole = lambda x: F.bround(x).cast("long")
    cohorts = _levels(
        live,
        [
            F.count("*").alias("active_count"),
            whole(median("price")).alias("median_price"),
            F.round(F.avg("price")).cast("long").alias("average_price"),
            F.min("price").alias("minimum_price"),
            F.max("price").alias("maximum_price"),
            whole(median("price", 0.1)).alias("price_p10"),
            whole(median("price", 0.9)).alias("price_p90"),
            median("days").alias("median_days"),
        ],
    ).filter(F.col("active_count") >= least)
    w = Window.partitionBy("listing_id").orderBy("observed_at", "event_id")
    today = observations.withColumn("previous_price", F.lag("price").over(w)).filter((F.col("observed_at") >= F.lit(day)) & (F.col("observed_at") < F.lit(day_end)))
    cut = (F.col("kind") == "price_change") & (F.col("price") < F.col("previous_price"))
    events = _levels(
        today.withColumn("mileage_bucket", mileage_band(F.col("mileage_km"))),
        [
            F.count_if(F.col("kind") == "first_seen").alias("new_count"),
            F.count_if(F.col("kind") == "disappeared").alias("removed_count"),
            F.count_if(cut).alias("reduction_count"),
            F.count_distinct(F.when(cut, F.col("listing_id"))).alias("reduced_listings"),
            whole(median(F.when(cut, F.col("previous_price") - F.col("price")))).alias("median_reduction"),
        ],
    )
    a, b = cohorts.alias("a"), events.alias("b")
    same = F.lit(True)
    for c in ["granularity", *KEYS]:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return a.join(b, same, "left").select(
        "a.*", count("new_count"), count("removed_count"), count("reduction_count"), "median_reduction",
        F.coalesce(F.col("reduced_listings") / F.nullif(F.col("active_count"), F.lit(0)), F.lit(0.0)).alias("reduction_share"),
    )


def trend_point(snapshots: DataFrame, keys: list[str], day: datetime, back: int) -> DataFrame:
    """The latest snapshot at or before so many days ago: max_by over rows up to it."""
    upto = snapshots.filter(F.col("day") <= F.date_sub(F.lit(day).cast("date"), back))
    return upto.groupBy(*keys).agg(F.max("day").alias("day"), F.max_by("median_price", "day").alias("median_price"))

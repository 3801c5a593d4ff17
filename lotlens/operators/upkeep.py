"""Keeping the catalogue in order: representatives, seeds, conflicts, backfills, queues, and small selections of it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotlens.functions.lineage import small_or_none
from lotlens.functions.rules import first_by

#: Days that the windows of recent ads reach back.
RECENT = {"today": 1, "week": 7, "month": 30}
#: Ids of a list that are broadcast, at most.
LISTED = 100_000


def recent(listed: Column, window: str, now: datetime) -> Column:
    """Listed within the last day, week or month."""
    return listed >= F.lit(now) - F.expr(f"interval {RECENT[window]} days")


def plate_holds(plate: Column, wanted: str) -> Column:
    """Part of a plate, whatever its case; less than two characters narrow nothing."""
    wanted = wanted.strip().lower()
    return F.contains(F.lower(plate), F.lit(wanted)) if len(wanted) >= 2 else F.lit(True)


def shown(representative: Column, provider: Column, sources: list[str] | None) -> Column:
    """One ad a vehicle, unless the search is narrowed to sources: then all their ads."""
    return provider.isin(sources) if sources else representative


def coerced(value: Column, allowed: list[str], fallback: str) -> Column:
    """P19."""
    return F.when(value.isin(allowed), value).otherwise(F.lit(fallback))


def with_winner(listings: DataFrame, fresh: Column, winner: str = "winner") -> DataFrame:
    """Listings with the id of the ad that stands for their vehicle, if any: of its active fresh ads the newest, then the latest seen, then the least id.

    Windows by vehicle without an order: rows that are dealt out and sorted by vehicle already are neither moved nor sorted again.
    """
    of_car = Window.partitionBy("vehicle_id")
    live = (F.col("status") == "active") & fresh & F.col("vehicle_id").isNotNull()
    seen = F.struct("first_seen_at", "last_seen_at")
    rows = listings.withColumn("__last", F.max(F.when(live, seen)).over(of_car))
    return rows.withColumn(winner, F.min(F.when(live & seen.eqNullSafe(F.col("__last")), F.col("listing_id"))).over(of_car)).drop("__last")


def representatives(listings: DataFrame, fresh: Column) -> DataFrame:
    """(listing_id, vehicle_id, representative) of the ads of vehicles that have a representative."""
    found = with_winner(listings, fresh).filter("winner IS NOT NULL")
    return found.select("listing_id", "vehicle_id", (F.col("listing_id") == F.col("winner")).alias("representative"))


def changed_flags(listings: DataFrame, fresh: Column, flag: str = "is_representative") -> DataFrame:
    """Only the rows whose flag is wrong, with the right one."""
    right = representatives(listings, fresh).drop("vehicle_id")
    return listings.join(right, "listing_id").filter(~F.col(flag).eqNullSafe(F.col("representative"))).select("listing_id", "representative")


def gallery(existing_count: Column, existing_hash: Column, incoming_count: Column, incoming_hash: Column) -> Column:
    """A struct (image_hash, replace): a feed without images leaves a known ad's gallery as it is."""
    known = existing_count.isNotNull()
    keep = known & (incoming_count == 0)
    differs = ~existing_hash.eqNullSafe(incoming_hash) | ((existing_count == 0) & (incoming_count > 0))
    return F.struct(F.when(keep, existing_hash).otherwise(incoming_hash).alias("image_hash"), (~known | (~keep & differs)).alias("replace"))


def missing_analyses(listings: DataFrame, analyses: DataFrame, neutral: dict[str, Column]) -> DataFrame:
    """A neutral analysis for every ad that has none."""
    return listings.join(analyses.select("listing_id"), "listing_id", "left_anti").select("listing_id", *[v.alias(k) for k, v in neutral.items()])


def released(holders: DataFrame, identifier: str, since: str) -> DataFrame:
    """Of the rows that hold one identifier only the latest keeps it; null identifiers are nobody's."""
    w = Window.partitionBy(identifier).orderBy(F.desc(since), F.desc("listing_id"))
    return holders.withColumn("__place", F.row_number().over(w)).withColumn(identifier, F.when(F.col("__place") == 1, F.col(identifier))).drop("__place")


def reason_counts(checked: DataFrame, reasons: str, reject: list[str]) -> DataFrame:
    """How many ads each reason was found in, and whether it keeps them out."""
    each = checked.select("listing_id", F.explode(F.array_distinct(reasons)).alias("reason"))
    return each.groupBy("reason").agg(F.count("*").alias("n")).withColumn("quarantined", F.col("reason").isin(reject))


def seeded_history(listings: DataFrame, observations: DataFrame) -> DataFrame:
    """A reconstructed first sighting for every ad that the log doesn't have."""
    return listings.join(observations.select("listing_id").distinct(), "listing_id", "left_anti").select(
        "listing_id", F.lit("first_seen").alias("kind"), F.col("first_seen_at").alias("observed_at"), "price", "mileage_km", F.lit(True).alias("reconstructed")
    )


def cohort_members(listings: DataFrame, changed: DataFrame) -> DataFrame:
    """Every active ad of the makes and models that changed ads belong to."""
    touched = changed.select("make", "model").distinct()
    return listings.filter("status = 'active'").join(touched, ["make", "model"], "left_semi")


def imported_favourites(wanted: DataFrame, listings: DataFrame, held: DataFrame) -> DataFrame:
    """(user, listing) pairs to add: of ads that exist, not held yet, each once."""
    return wanted.select("user_id", "listing_id").distinct().join(listings.select("listing_id").distinct(), "listing_id", "left_semi").join(held, ["user_id", "listing_id"], "left_anti").select("user_id", "listing_id")


def latest_runs(runs: DataFrame) -> DataFrame:
    """Each provider's last run."""
    return first_by(runs, ["provider"], F.desc("started_at"), F.desc("run_id"))


def run_totals(checkpoints: DataFrame) -> DataFrame:
    """What a run's checkpoints have seen, and how many are unfinished."""
    return checkpoints.groupBy("run_id").agg(F.sum("seen").alias("seen"), F.count_if(~F.col("finished")).alias("unfinished"))


def child_counts(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """How many rows belong to each parent, none included."""
    counted = children.groupBy(key).agg(F.count("*").alias("children"))
    return parents.join(counted, key, "left").select(key, F.coalesce("children", F.lit(0)).alias("children"))


def analysis_queue(listings: DataFrame, limit: int) -> DataFrame:
    """The ads to analyse next: asked for first, then the longest ago; those never asked for last."""
    return listings.orderBy(F.col("required_at").asc_nulls_last(), F.col("calculated_at").asc_nulls_first(), "listing_id").limit(limit)


def by_score(listings: DataFrame, limit: int) -> DataFrame:
    """Rated ads by confidence and score, then the unrated ones by id."""
    return listings.orderBy(F.col("score").isNull(), F.desc("confidence_rank"), F.desc("score"), "listing_id").limit(limit)


def in_order(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of a list of ids (position, listing_id), by position; the list is broadcast if it is counted to be short."""
    return (small_or_none(ids, LISTED) or ids).join(rows, "listing_id").orderBy("position")


def known_before(listings: DataFrame, analyses: DataFrame, end: datetime) -> DataFrame:
    """Each ad with its analysis, if that was made before a moment."""
    made = analyses.filter(F.col("calculated_at") < F.lit(end))
    return listings.join(made, "listing_id", "left")


def score_audit(listings: DataFrame, top: int = 50) -> DataFrame:
    """Q23: the best of a fixed slice of the catalogue."""
    slice_ = listings.filter("status = 'active'").filter(F.col("price").between(49_949, 103_737) & (F.col("mileage_km") <= 202_000) & (F.col("transmission") == "automatic"))
    return slice_.orderBy(F.desc("confidence_rank"), F.col("score").desc_nulls_last(), "listing_id").limit(top)


def trend_deltas(daily: DataFrame, keys: list[str], day: datetime, backs: list[int]) -> DataFrame:
    """Q13: the last median up to a day and its change against those so many days before, in one pass."""
    last = F.lit(day).cast("date")
    upto = lambda n: F.max_by(F.when(F.col("day") <= F.date_sub(last, n), F.col("median_price")), F.when(F.col("day") <= F.date_sub(last, n), F.col("day")))
    out = daily.filter(F.col("day") <= last).groupBy(*keys).agg(upto(0).alias("now"), *[upto(n).alias(f"before_{n}") for n in backs])
    return out.select(*keys, "now", *[(F.col("now") / F.col(f"before_{n}") - 1).alias(f"change_{n}") for n in backs])

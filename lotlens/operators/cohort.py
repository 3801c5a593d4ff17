"""L2: the independent market of an ad: newest ads of its model about its year, valued, and where its price ranks there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotlens.functions.lineage import settle
from lotlens.functions.rules import first_by, half_up
from lotlens.operators.nearest import COHORT, SCORED, SEGMENT_HIGH, SEGMENT_LOW, SEGMENT_WEIGHT, SEGMENT_YEARS, _others, scored
from lotlens.operators.valuation import CANDIDATE, FIT, LEAST, NEAREST, TARGET, nearest_of, recency, valued, with_optional

#: Model years about the ad's, and the newest ads of those that are looked at.
YEARS, NEWEST = 8, 1_200


def newest_about(pool: DataFrame, keys: list[str], years: int, newest: int) -> DataFrame:
    """pool rows by (keys, t_year): for each model year the newest ads of the years about it. Years are limited one by one
    first, so that no group gathers more than that many rows of each of its years."""
    order = [F.desc("seen_at"), F.col("listing_id")]
    a_year = pool.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "model_year").orderBy(*order))).filter(F.col("k") <= newest)
    about = a_year.withColumn("t_year", F.explode(F.sequence(F.col("model_year") - years, F.col("model_year") + years)))
    return about.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "t_year").orderBy(*order))).filter(F.col("k") <= newest).drop("k")


def independent(targets: DataFrame, pool: DataFrame, current_year: int, newest: int = NEWEST) -> DataFrame:
    """(listing_id, tier, eligible, V4's columns, percentile) of each target; tier tells how far the cohort had to widen.

    pool: plausible ads, one a vehicle, with seen_at. Recency counts from the target's own reading. The percentile is the
    share of the closest comparables that cost no more.
    """
    pool = settle(with_optional(pool).select("listing_id", "vehicle_id", *COHORT, *SCORED, F.col("price").cast("double").alias("price"), "seen_at"))
    t = with_optional(targets).select(*[F.col(c).alias(f"t_{c}") for c in ("listing_id", "vehicle_id", *COHORT, *SCORED, "price", "seen_at")])
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.col("t_seen_at").cast("timestamp")) - F.unix_micros(F.col("seen_at").cast("timestamp"))) / 86_400_000_000.0)
    about = newest_about(pool, ["make", "model"], YEARS, newest)
    same = (F.col("make") == F.col("t_make")) & (F.col("model") == F.col("t_model")) & (F.col("t_year") == F.col("t_model_year")) & (F.col("fuel_type") == F.col("t_fuel_type"))
    pairs = t.join(about, same & _others()).withColumn("age_days", age).drop("t_year", "t_seen_at")
    by = TARGET
    best = Window.partitionBy(*by, "tier").orderBy(F.desc("weight"), "close", "listing_id")
    told = scored(pairs)
    counts = Window.partitionBy(*by)
    told = told.withColumns({f"n_{x}": F.count_if(F.col("tier") == x).over(counts) for x in "ABCD"})
    a, ab, abc = F.col("n_A"), F.col("n_A") + F.col("n_B"), F.col("n_A") + F.col("n_B") + F.col("n_C")
    whole = abc + F.col("n_D")
    stops = lambda n: (n >= FIT) | (n == whole)
    step = F.when(stops(a), 1).when(stops(ab), 2).when(stops(abc), 3).otherwise(4)
    inside = F.when(F.col("tier") == "A", 1).when(F.col("tier") == "B", 2).when(F.col("tier") == "C", 3).otherwise(4)
    kept = told.withColumn("step", step).filter(inside <= F.col("step")).withColumn("eligible", F.when(F.col("step") == 1, a).when(F.col("step") == 2, ab).when(F.col("step") == 3, abc).otherwise(whole)).filter(F.col("eligible") >= LEAST)
    few = kept.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= NEAREST)
    near = few.groupBy(*by, "step", "eligible").agg(nearest_of(F.collect_list(F.when(F.col("sane"), F.struct(*CANDIDATE)))).alias("near"))
    near = settle(near.withColumn("tier", F.element_at(F.array(*[F.lit(x) for x in ("exact", "wide_model_fuel", "model_fuel", "model_fuel")]), F.col("step"))).drop("step"))

    starved = t.join(near.select("t_listing_id"), "t_listing_id", "left_anti").withColumn("t_low", F.col("t_price") * SEGMENT_LOW).withColumn("t_high", F.col("t_price") * SEGMENT_HIGH)
    # The price range is part of what the newest are taken of, so it is met before they are; by make, year and price step.
    cut = lambda c: F.floor(F.log(c) / 0.1).cast("int")
    s = starved.filter("t_price > 0").withColumn("t_step", F.explode(F.sequence(cut(F.col("t_low")), cut(F.col("t_high"))))).withColumn("t_about", F.explode(F.sequence(F.col("t_model_year") - SEGMENT_YEARS, F.col("t_model_year") + SEGMENT_YEARS)))
    p = pool.filter("price > 0").withColumn("step", cut(F.col("price"))).drop(*[c for c in SCORED if c not in ("model_year", "mileage_km")])
    # Steps that lie inside the range whole give their newest only; the two at its ends are looked at whole.
    cell = Window.partitionBy("make", "model_year", "step").orderBy(F.desc("seen_at"), "listing_id")
    p = p.withColumn("k", F.row_number().over(cell)).filter(F.col("k") <= newest).drop("k").withColumn("end", F.lit(False)).unionByName(p.withColumn("end", F.lit(True)))
    on = (F.col("t_make") == F.col("make")) & (F.col("t_about") == F.col("model_year")) & (F.col("t_step") == F.col("step")) & (F.col("t_end") == F.col("end"))
    met = s.withColumn("t_end", (F.col("t_step") <= cut(F.col("t_low"))) | (F.col("t_step") >= cut(F.col("t_high")))).join(p, on & F.col("price").between(F.col("t_low"), F.col("t_high")))
    first = Window.partitionBy("t_listing_id").orderBy(F.desc("seen_at"), "listing_id")
    newest_rows = met.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= newest).filter(_others()).withColumn("age_days", age)
    close = F.abs(F.col("model_year") - F.col("t_model_year")) * 60_000.0 + F.abs(F.col("mileage_km") - F.col("t_mileage_km"))
    rows = newest_rows.select(*by, "listing_id", F.lit("D").alias("tier"), F.lit(0).cast("long").alias("similarity"), (SEGMENT_WEIGHT * recency(F.col("age_days"))).alias("weight"), close.alias("close"), "price", "model_year", F.col("mileage_km").cast("double").alias("mileage_km"), "age_days")
    order = Window.partitionBy(*by).orderBy(F.desc("weight"), "close", "listing_id")
    rows = rows.withColumn("eligible", F.count("*").over(Window.partitionBy(*by))).filter(F.col("eligible") >= LEAST).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= NEAREST)
    wide = rows.groupBy(*by, "eligible").agg(nearest_of(F.collect_list(F.struct(*CANDIDATE))).alias("near")).withColumn("tier", F.lit("make_fallback"))
    cohorts = settle(near.unionByName(wide.select(*near.columns)))

    values = valued(cohorts.select(*by, "near", (F.col("tier") == "make_fallback").alias("fallback")), current_year)
    out = t.select(F.col("t_listing_id").alias("listing_id"), F.col("t_price").alias("price")).join(cohorts.select(F.col("t_listing_id").alias("listing_id"), "tier", "eligible"), "listing_id", "left").join(values, "listing_id", "left")
    rank = half_up(100.0 * F.size(F.filter("prices", lambda x: x <= F.col("price"))) / F.size("prices")).cast("long")
    return out.select("listing_id", F.coalesce("tier", F.lit("insufficient")).alias("tier"), F.coalesce("eligible", F.lit(0)).cast("long").alias("eligible"), "market_value", "range_low", "range_high", F.coalesce("comparable_count", F.lit(0)).cast("long").alias("comparable_count"), "method", F.when(F.col("prices").isNotNull(), rank).alias("price_percentile"))


def one_a_vehicle(ads: DataFrame) -> DataFrame:
    """The ad that stands for each vehicle: the latest seen, then the least id."""
    return first_by(ads, ["vehicle_id"], F.desc("seen_at"), F.col("listing_id"))

"""Ownership costs, insurance estimates, equipment points, buying seasons, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotlens.functions.rules import half_up, price_floor
from lotlens.operators.text import searchable

#: Kilometres a year and energy prices a unit.
ANNUAL_KM = 15_000
ENERGY = {"petrol": 18.5, "diesel": 19.5, "ethanol": 14.0, "electric": 2.5, "hydrogen": 120.0, "plug_in_hybrid": 18.5, "self_charging_hybrid": 18.5, "other": 18.5}
#: Points of features, in the order they are tried.
FEATURES = [
    (5, "dragkrok|tow.?bar"), (5, "panorama"), (5, "360.?kamera|around.?view"), (5, "matrix|pixel.?light|laser.?light"), (5, "adaptiv.*fjadr|luftfjadr|adaptive suspension"),
    (5, "harman|bose|bowers|burmester|premium.*ljud"), (5, "elstol|elektrisk.*stol"), (5, "minnesstol|stol.*minne"), (5, "vinterhjul"), (5, "varmepump|heat.?pump"),
    (5, r"fyrhjulsdrift|\bawd\b|\b4wd\b|quattro|xdrive|4matic"), (5, "stora batter|long range|extended range"), (5, "parkeringsvarm|dieselvarm|branslevarm"),
    (3, r"adaptiv.*farth|adaptive cruise|\bacc\b"), (3, "backkamera|rear.?camera"), (3, "rattvarm|uppvarmd.*ratt"), (3, "keyless|nyckelfri"), (3, "navigation|gps"),
    (3, "tradlos.*ladd|wireless charg"), (3, "parkeringssensor|pdc"), (3, "blind.?spot|doda.?vinkel"), (1, "ambient"), (1, "tonade.*rutor"), (1, "avbland.*spegel|auto.?dim"),
    (1, "regnsensor"), (1, "bluetooth"), (1, "filvarn|lane warning"),
]
#: Insurance risk of brands (others 1.0), drivetrains, ages and licence years.
BRAND_RISK = {
    0.85: ["dacia", "kia", "hyundai", "suzuki", "fiat", "citroën", "citroen", "mitsubishi", "seat", "skoda", "toyota", "mazda"],
    1.25: ["cupra", "volvo", "audi", "mercedes-benz", "mercedes", "bmw", "land rover", "jaguar", "lexus", "mini", "polestar"],
    1.6: ["porsche", "tesla"],
}
DRIVE_RISK = {"electric": 1.2, "plug_in_hybrid": 1.5}
AGE_RISK = {"18-24": 1.35, "25-29": 1.15, "30-39": 1.0, "40-49": 0.95, "50-64": 0.9, "65+": 1.0}
LICENCE_RISK = [(2, 1.25), (5, 1.1), (15, 1.0), (None, 0.92)]
METRO, METRO_RISK = ["stockholm", "göteborg", "goteborg", "malmö", "malmo"], 1.15
#: Points a unit and the most each part may add or take.
SEASON = {"price": (3.0, 25.0), "inventory": (0.25, 12.0), "reductions": (1.5, 12.0), "age": (0.4, 8.0)}


def equipment_points(labels: DataFrame) -> DataFrame:
    """(listing_id, points, features): each label counts for the first feature it names, each feature once."""
    kind = F.lit(None).cast("int")
    for k, (_, pattern) in reversed(list(enumerate(FEATURES))):
        kind = F.when(searchable(F.col("label")).rlike(pattern), k).otherwise(kind)
    points = F.lit(0)
    for k, (n, _) in enumerate(FEATURES):
        points = F.when(F.col("feature") == k, n).otherwise(points)
    hit = labels.select("listing_id", kind.alias("feature")).filter("feature is not null").distinct()
    return hit.groupBy("listing_id").agg(F.sum(points).alias("points"), F.count("*").alias("features"))


def equipment_score(own: Column, cohort_median: Column, cohort: Column) -> Column:
    return F.when(own.isNull() | (cohort < 3), 50).otherwise(F.greatest(F.lit(10), F.least(F.lit(95), half_up(50 + (own - cohort_median) * 4))))


def retention(age: Column, electric: Column) -> Column:
    first, later = F.when(electric, 0.75).otherwise(0.8), F.when(electric, 0.88).otherwise(0.87)
    return F.when(age <= 0, 1.0).when(age <= 1, 1 - (1 - first) * age).otherwise(first * F.pow(later, age - 1))


def vehicle_tax(fuel: Column, litres: Column, model_year: Column, year: int) -> Column:
    """The yearly tax: by emissions, dearer for recent cars, with a surcharge for diesel."""
    co2, diesel = litres * F.when(fuel == "diesel", 26.4).otherwise(23.2), fuel == "diesel"
    recent = (model_year >= 2018) & (model_year >= year - 3)
    malus = F.when(co2 <= 75, 0.0).when(co2 <= 125, (co2 - 75) * 107).otherwise(50 * 107 + (co2 - 125) * 132)
    plain = 360 + F.greatest(F.lit(0.0), co2 - 111) * 22
    extra = F.when(diesel, 250 + co2 * 13.52).otherwise(0.0)
    return F.when(fuel == "electric", 360.0).when(recent, 360 + malus + extra).when(diesel & (model_year < 2018), plain * 2.37).otherwise(plain + extra)


def ownership(price: Column, model_year: Column, fuel: Column, litres: Column, power: Column, year: int) -> Column:
    """A struct of yearly costs in whole crowns; a price too low for the age is costed at its floor."""
    age = F.greatest(F.lit(0), F.lit(year) - model_year).cast("double")
    basis = F.greatest(price, price_floor(model_year, year)).cast("double")
    electric = fuel == "electric"
    use = F.when(electric, 18.0).otherwise(F.coalesce(litres, F.lit(6.5)))
    unit = F.lit(ENERGY["other"])
    for name, cost in ENERGY.items():
        unit = F.when(fuel == name, cost).otherwise(unit)
    parts = {
        "depreciation": basis * (1 - retention(age + 1, electric) / retention(age, electric)),
        "energy": ANNUAL_KM / 100 * use * unit,
        "insurance": 5_500 + F.greatest(F.lit(0), F.coalesce(power, F.lit(150)) - 150) * 15 + F.least(basis, F.lit(300_000.0)) * 0.01,
        "maintenance": 4_000 + F.least(age, F.lit(15.0)) * 350 + ANNUAL_KM / 1_000 * 60,
        "tax": vehicle_tax(fuel, use, model_year, year),
    }
    return F.struct(*[half_up(c).cast("long").alias(n) for n, c in parts.items()], (price < price_floor(model_year, year)).alias("implausible_price"))


def insurance_risk(make: Column, fuel: Column, age_band: Column, licence_years: Column, region: Column) -> Column:
    """Brand times drivetrain times what a buyer tells of themselves; an untold or unknown value changes nothing."""
    brand = F.lit(1.0)
    for risk, names in BRAND_RISK.items():
        brand = F.when(F.lower(F.trim(make)).isin(*names), risk).otherwise(brand)
    drive = F.lit(1.0)
    for name, risk in DRIVE_RISK.items():
        drive = F.when(fuel == name, risk).otherwise(drive)
    age = F.lit(1.0)
    for band, risk in AGE_RISK.items():
        age = F.when(age_band == band, risk).otherwise(age)
    licence = F.when(licence_years.isNull(), 1.0)
    for below, risk in LICENCE_RISK:
        licence = licence.otherwise(risk) if below is None else licence.when(licence_years < below, risk)
    return brand * drive * age * licence * F.when(F.lower(F.trim(region)).isin(*METRO), METRO_RISK).otherwise(1.0)


def insurance_estimate(targets: DataFrame, quotes: DataFrame, least: int = 3, nearest: int = 40) -> DataFrame:
    """For each target the narrowest tier of quotes with enough of them: model, make with body and fuel, or body
    and fuel within a band of value.

    targets (target_id, make, model, body_style, fuel_type, value), quotes the same with premium and insurer. All
    three tiers meet on body and fuel or on make, so the pairs come from two equi-joins.
    """
    t = targets.select(*[F.col(c).alias(f"t_{c}") for c in ("target_id", "make", "model", "body_style", "fuel_type", "value")])
    low = lambda c: F.lower(F.trim(c))
    by_make = quotes.join(t, low("make") == low("t_make"))
    alike = (F.col("body_style") == F.col("t_body_style")) & (F.col("fuel_type") == F.col("t_fuel_type"))
    by_body = quotes.join(t, alike).filter(F.col("value").between(F.col("t_value") * 0.6, F.col("t_value") * 1.6))
    tiers = by_make.filter(low("model") == low("t_model")).withColumn("tier", F.lit(1)).unionByName(by_make.filter(alike).withColumn("tier", F.lit(2))).unionByName(by_body.withColumn("tier", F.lit(3)))
    enough = tiers.groupBy("t_target_id", "tier").agg(F.count("*").alias("n")).filter(F.col("n") >= least).groupBy("t_target_id").agg(F.min("tier").alias("tier"))
    near = Window.partitionBy("t_target_id").orderBy(F.abs(F.col("value") - F.col("t_value")), "premium", "insurer")
    pool = tiers.join(enough, ["t_target_id", "tier"]).withColumn("k", F.row_number().over(near)).filter(F.col("k") <= nearest)
    fifty = lambda c: half_up(c / 50) * 50
    return pool.groupBy(F.col("t_target_id").alias("target_id"), "tier").agg(
        fifty(F.percentile("premium", 0.5)).alias("median_monthly"), fifty(F.min("premium")).alias("range_low"), fifty(F.max("premium")).alias("range_high"),
        F.min("premium").alias("cheapest_monthly"), F.min_by("insurer", F.struct("premium", "insurer")).alias("cheapest_insurer"), F.count("*").alias("comparables"), F.count_distinct(low("insurer")).alias("insurers"),
    )


def reliability(vehicles: DataFrame, profiles: DataFrame) -> DataFrame:
    """The narrowest sourced profile that fits each vehicle; profiles are curated and few."""
    p = profiles.filter("sourced").select(*[F.col(c).alias(f"p_{c}") for c in profiles.columns])
    either = lambda c: F.col(f"p_{c}").isNull() | (F.col(f"p_{c}") == F.col(c))
    fits = (F.lower("make") == F.lower("p_make")) & (F.lower("model") == F.lower("p_model")) & F.col("model_year").between(F.col("p_year_from"), F.col("p_year_to"))
    fits = fits & either("generation") & either("fuel_type") & either("transmission") & (F.col("p_engine").isNull() | F.contains(F.lower("engine"), F.lower("p_engine")))
    score = F.col("p_year_from") - F.col("p_year_to")
    for c, n in (("generation", 16), ("engine", 12), ("fuel_type", 6), ("transmission", 4)):
        score = score + F.when(F.col(f"p_{c}").isNotNull(), n).otherwise(0)
    pairs = vehicles.join(p, fits).withColumn("score", score)
    best = pairs.withColumn("k", F.row_number().over(Window.partitionBy("vehicle_id").orderBy(F.desc("score"), "p_profile_id"))).filter("k = 1")
    return best.select("vehicle_id", F.col("p_profile_id").alias("profile_id"), "score")


def buyer_scores(months: DataFrame, least: int = 25, scorable: int = 2) -> DataFrame:
    """Q11: each month against the selection's own average: 50 and what price, stock, cuts and age add or take.

    months: (month, listing_count, mean_log_residual, reductions, median_age_days), at most twelve rows.
    """
    every = Window.partitionBy()
    fit = (F.col("listing_count") >= least) & F.col("mean_log_residual").isNotNull()
    m = months.withColumn("fit", fit & (F.sum(fit.cast("int")).over(every) >= scorable)).withColumn("rate", F.col("reductions") / F.nullif(F.col("listing_count"), F.lit(0)))
    mean = lambda c: F.avg(F.when(F.col("fit"), F.col(c))).over(every)
    m = m.withColumn("relative_price", (F.exp(F.col("mean_log_residual") - mean("mean_log_residual")) - 1) * 100).withColumn("inventory_index", F.col("listing_count") / mean("listing_count") * 100)
    part = lambda x, name: F.coalesce(F.greatest(F.lit(-SEASON[name][1]), F.least(F.lit(SEASON[name][1]), x * SEASON[name][0])), F.lit(0.0))
    total = F.lit(50.0) + part(-F.col("relative_price"), "price") + part(F.col("inventory_index") - 100, "inventory") + part((F.col("rate") - mean("rate")) * 100, "reductions") + part(F.col("median_age_days") - mean("median_age_days"), "age")
    s = F.when(F.col("fit"), half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))))
    return m.select("month", F.when(F.col("fit"), F.col("relative_price")).alias("relative_price"), "inventory_index", s.alias("score"), F.when(s >= 68, "great").when(s >= 57, "good").when(s >= 43, "normal").when(s.isNotNull(), "expensive").alias("verdict"))



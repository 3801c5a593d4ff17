"""Market analysis over live listings: each function takes listings and gives one section."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotlens.functions.lineage import settle
from lotlens.functions.rules import MAXIMUM_MILEAGE_KM, MAXIMUM_PRICE, median, mileage_cell, price_floor
from lotlens.functions.selection import percentiles

CELL = ["make", "model", "model_year", "mileage_cell"]
GROUP, COMPARABLE, TRIM = 12, 4, math.log(2.5)
TERMS = ["age", "mileage", "manual", "private", "diesel", "electric", "plug_in_hybrid", "self_charging_hybrid"]


@dataclass(frozen=True)
class MarketFilters:
    """What narrows a selection; an absent filter adds no predicate."""

    brands: tuple[str, ...] = ()
    models: tuple[str, ...] = ()
    fuel_type: str | None = None
    transmission: str | None = None
    min_year: int | None = None
    max_year: int | None = None
    min_mileage_mil: int | None = None
    max_mileage_mil: int | None = None


@dataclass(frozen=True)
class Market:
    """The moment a market is looked at, how long a listing stays fresh after it was seen, and the filters."""

    as_of: datetime
    fresh_days: int = 7
    filters: MarketFilters = field(default_factory=MarketFilters)

    @property
    def cutoff(self) -> datetime:
        quarter = self.as_of.replace(minute=self.as_of.minute // 15 * 15, second=0, microsecond=0)
        return quarter - timedelta(days=self.fresh_days)


def selected(listings: DataFrame, f: MarketFilters) -> DataFrame:
    out = listings
    if f.brands:
        out = out.filter(F.col("make").isin(*f.brands))
    if f.models:
        out = out.filter(F.col("model").isin(*f.models))
    if f.fuel_type:
        out = out.filter(F.col("fuel_type") == f.fuel_type)
    if f.transmission:
        out = out.filter(F.col("transmission") == f.transmission)
    if f.min_year is not None:
        out = out.filter(F.col("model_year") >= f.min_year)
    if f.max_year is not None:
        out = out.filter(F.col("model_year") <= f.max_year)
    if f.min_mileage_mil is not None:
        out = out.filter(F.col("mileage_km") >= f.min_mileage_mil * 10)
    if f.max_mileage_mil is not None:
        out = out.filter(F.col("mileage_km") <= f.max_mileage_mil * 10)
    return out


def active(listings: DataFrame, market: Market) -> DataFrame:
    """Live, fresh, plausible listings of a selection."""
    fresh = F.col("last_seen_at") >= F.lit(market.cutoff)
    bounds = (F.col("price") <= MAXIMUM_PRICE) & (F.col("price") >= price_floor(F.col("model_year"), market.as_of.year)) & F.col("mileage_km").between(0, MAXIMUM_MILEAGE_KM)
    return selected(listings.filter(F.col("status") == "active").filter(fresh & bounds), market.filters)


def residuals(live: DataFrame) -> DataFrame:
    """Add residual (log price against the median of its cell) and cell_size, by one aggregate and a join."""
    priced = live.withColumn("mileage_cell", mileage_cell(F.col("mileage_km"))).withColumn("log_price", F.log("price"))
    cells = priced.groupBy(*CELL).agg(median("log_price").alias("cell_median"), F.count("*").alias("cell_size"))
    return priced.join(cells, CELL).withColumn("residual", F.col("log_price") - F.col("cell_median"))


def comparable(scored: DataFrame) -> DataFrame:
    """Rows whose cell is large enough and whose price is near it."""
    return scored.filter((F.col("cell_size") >= COMPARABLE) & (F.abs("residual") <= TRIM))


def snapshot(live: DataFrame) -> DataFrame:
    """Q1: one row on the whole selection."""
    year = F.col("model_year")
    return live.agg(
        F.count("*").alias("listing_count"),
        median("price").alias("median_price"),
        median("price", 0.25).alias("price_p25"),
        median("price", 0.75).alias("price_p75"),
        median("mileage_km").alias("median_mileage_km"),
        median(year).alias("median_model_year"),
        F.greatest(median(year, 0.02), F.min(year)).alias("year_floor"),
        F.least(median(year, 0.98), F.max(year)).alias("year_ceiling"),
    )


def scatter(live: DataFrame, sample: int = 1200) -> DataFrame:
    """Q2: a stable sample of listings within Tukey's fences, ordered by a hash of their id."""
    p = lambda c, x: median(c, x)
    fence = lambda c: F.least(p(c, 0.99), p(c, 0.75) + 1.5 * (p(c, 0.75) - p(c, 0.25)))
    bounds = live.agg(F.count("*").alias("matching_count"), p("price", 0.01).alias("price_minimum"), fence("price").alias("price_maximum"), fence("mileage_km").alias("mileage_maximum"))
    kept = live.join(F.broadcast(bounds), F.col("price").between(F.col("price_minimum"), F.col("price_maximum")) & (F.col("mileage_km") <= F.col("mileage_maximum")))
    columns = ["listing_id", "price", "mileage_km", "model_year", "make", "model", "variant", "seller_type", "municipality", "matching_count", "price_minimum", "price_maximum", "mileage_maximum"]
    return kept.select(*columns).orderBy(F.md5("listing_id"), "listing_id").limit(sample)


def year_groups(floor: float, ceiling: float, rows: int = 8) -> list[tuple[str, int, int]]:
    """(key, from, to), newest first: single years, or equal spans if there are too many."""
    low, high = math.floor(floor), math.ceil(ceiling)
    width = max(1, math.ceil((high - low + 1) / rows))
    return [(f"y{k}", max(low, high - k * width - width + 1), high - k * width) for k in range(rows) if high - k * width >= low]


def value_map(live: DataFrame) -> DataFrame:
    """Q3: median price by year group and mileage band. The groups come from Q1's one row, read by the driver."""
    ends = snapshot(live).select("year_floor", "year_ceiling").first()
    if ends is None or ends[0] is None:
        groups = []
    else:
        groups = year_groups(*ends)
    year = F.lit(None).cast("string")
    for key, low, high in reversed(groups):
        year = F.when(F.col("model_year").between(low, high), key).otherwise(year)
    band = F.when(F.col("mileage_km") < 50_000, "b1").when(F.col("mileage_km") < 80_000, "b2").when(F.col("mileage_km") < 120_000, "b3").when(F.col("mileage_km") < 160_000, "b4").otherwise("b5")
    return live.withColumn("year_key", year).withColumn("band_key", band).filter("year_key is not null").groupBy("year_key", "band_key").agg(median("price").alias("median_price"), F.count("*").alias("listing_count"))


def variant_value(live: DataFrame, group: int = GROUP, top: int = 40) -> DataFrame:
    """Q5: versions by how their prices lie against comparable cars."""
    named = comparable(residuals(live)).filter(F.length(F.trim("variant")) > 0)
    found = named.groupBy("variant").agg(
        F.count("*").alias("listing_count"), median("price").alias("median_price"), median("model_year").alias("median_model_year"), median("residual").alias("m")
    )
    return found.filter(F.col("listing_count") >= group).orderBy("m", "variant").limit(top).withColumn("value_percent", (F.exp("m") - 1) * 100).drop("m")


def depreciation(live: DataFrame, group: int = GROUP) -> DataFrame:
    """Q6: median price by model year, its share of the newest year, and whether the steepest recent drop is above it."""
    years = live.groupBy("model_year").agg(F.count("*").alias("listing_count"), median("price").alias("median_price")).filter(F.col("listing_count") >= group)
    down, up = Window.orderBy(F.desc("model_year")), Window.orderBy("model_year")
    shares = years.withColumn("place", F.row_number().over(down)).withColumn("retained_percent", 100.0 * F.col("median_price") / F.first("median_price").over(down))
    recent = shares.filter((F.col("place") <= 8) & (F.col("listing_count") >= 20))
    steps = recent.withColumn("step", F.lead("retained_percent").over(up) - F.col("retained_percent"))
    best = steps.filter("step > 0").agg(F.max_by("model_year", F.struct("step", -F.col("model_year"))).alias("sweet_spot_year"))
    return shares.join(F.broadcast(best)).select("model_year", "listing_count", "median_price", "retained_percent", F.coalesce(F.col("model_year") == F.col("sweet_spot_year"), F.lit(False)).alias("sweet_spot"))


def equipment_value(live: DataFrame, equipment: DataFrame, sample: int = 25_000, group: int = GROUP, top: int = 10) -> DataFrame:
    """Q7: what a label goes with in price, over a stable sample of listings."""
    usable = comparable(residuals(live)).select("listing_id", "vehicle_id", "residual").orderBy(F.md5("listing_id"), "listing_id").limit(sample)
    joined = usable.join(equipment, "vehicle_id").select("listing_id", "residual", "label")
    totals = joined.select("listing_id", "residual").distinct().agg(F.count("*").alias("n"), median("residual").alias("m"))
    tallied = joined.groupBy("label").agg(F.count("*").alias("listing_count"), median("residual").alias("median"))
    apart = F.col("median") - F.col("m")
    return (
        tallied.join(F.broadcast(totals))
        .filter((F.col("listing_count") >= group) & (F.col("listing_count") >= 0.05 * F.col("n")) & (F.col("listing_count") <= 0.85 * F.col("n")))
        .orderBy(F.abs(apart).desc(), "label")
        .limit(top)
        .select("label", "listing_count", ((F.exp(apart) - 1) * 100).alias("premium_percent"))
    )


def regional_prices(live: DataFrame, group: int = GROUP, ends: int = 5) -> DataFrame:
    """Q8: the cheapest and the dearest places, by residuals against the whole selection.

    Residuals are as many different numbers as ads, so that their medians are selected by ranges (functions/selection.py),
    never gathered.
    """
    usable = settle(comparable(residuals(live)).filter(F.length(F.trim("municipality")) > 0).select("municipality", "price", "residual"))
    base = percentiles(usable, [], "residual", {"m": 0.5}).select("m")
    sums = usable.groupBy("municipality").agg(F.count("*").alias("listing_count"), median("price").alias("median_price")).filter(F.col("listing_count") >= group)
    places = sums.join(percentiles(usable, ["municipality"], "residual", {"r": 0.5}).drop("n"), "municipality")
    up, down = Window.orderBy("r", "municipality"), Window.orderBy(F.desc("r"), F.desc("municipality"))
    ranked = places.withColumn("cheap", F.row_number().over(up)).withColumn("dear", F.row_number().over(down)).filter((F.col("cheap") <= ends) | (F.col("dear") <= ends))
    return ranked.join(F.broadcast(base)).select("municipality", "listing_count", "median_price", ((F.exp(F.col("r") - F.col("m")) - 1) * 100).alias("difference_percent"))


def cross_products(live: DataFrame, current_year: int) -> DataFrame:
    """Q9: one row of sums of products, demeaned within make and model; outliers of their cells are left out."""
    dummy = lambda c, v: (F.col(c) == v).cast("double")
    terms = {
        "age": (F.lit(current_year) - F.col("model_year")).cast("double"),
        "mileage": F.col("mileage_km") / 10_000.0,
        "manual": dummy("transmission", "manual"),
        "private": dummy("seller_type", "private"),
        **{fuel: dummy("fuel_type", fuel) for fuel in TERMS[4:]},
    }
    priced = live.withColumn("mileage_cell", mileage_cell(F.col("mileage_km"))).withColumn("y", F.log("price"))
    cells = priced.groupBy(*CELL).agg(median("y").alias("cell_median"), F.count("*").alias("n")).filter(F.col("n") >= COMPARABLE).drop("n")
    kept = priced.join(cells, CELL, "left").filter(F.col("cell_median").isNull() | (F.abs(F.col("y") - F.col("cell_median")) <= TRIM))
    named = kept.select("make", "model", "y", *[e.alias(n) for n, e in terms.items()])
    means = named.groupBy("make", "model").agg(F.count("*").alias("size"), *[F.avg(c).alias(f"m_{c}") for c in ["y", *TERMS]]).filter("size >= 3")
    centred = named.join(means, ["make", "model"]).select("make", "model", *[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in ["y", *TERMS]])
    sums = [F.sum(F.col("y") * F.col("y")).alias("yy")] + [F.sum(F.col(t) * F.col("y")).alias(f"xy_{t}") for t in TERMS]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"xx_{a}_{b}") for i, a in enumerate(TERMS) for b in TERMS[i:]]
    return centred.agg(F.count("*").alias("n"), F.count_distinct("make", "model").alias("groups"), *sums)


def relationships(row: dict) -> list[dict]:
    """Effects of the terms from one row of cross products: a solve of eight equations on the driver."""
    import numpy as np

    n, groups = row["n"], row["groups"]
    xx = np.array([[row.get(f"xx_{a}_{b}", row.get(f"xx_{b}_{a}")) or 0.0 for b in TERMS] for a in TERMS])
    xy = np.array([row[f"xy_{t}"] or 0.0 for t in TERMS])
    used = [k for k in range(len(TERMS)) if xx[k, k] > 1e-9]
    free = n - groups - len(used)
    if n < 60 or free <= 0 or not used:
        return []
    a, b = xx[np.ix_(used, used)], xy[used]
    inverse = np.linalg.pinv(a)
    beta = inverse @ b
    error = math.sqrt(max((row["yy"] - beta @ b) / free, 0.0))
    out = []
    for k, j in enumerate(used):
        spread = error * math.sqrt(max(inverse[k, k], 0.0))
        if spread > 0 and abs(beta[k] / spread) >= 2:
            out.append({"term": TERMS[j], "percent": (math.exp(beta[k]) - 1) * 100, "t": beta[k] / spread})
    return out
